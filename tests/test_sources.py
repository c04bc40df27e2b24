"""Files, sidecars, containers, formats, responses and sinks."""

import hashlib
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.functions import text
from trialweave.operators.ordered import block_slice
from trialweave.sources import files, literature, sinks


def test_sidecars(spark, tmp_path):
    folder = tmp_path / "sub-01" / "ses-2" / "eeg"
    folder.mkdir(parents=True)
    (folder / "sub-01_eeg.json").write_text('﻿{\n "TaskName": "mi",\n "SamplingFrequency": 512\n}', encoding="utf-8")
    (folder / "sub-01_events.tsv").write_text("onset\tduration\ttrial_type\tvalue\n0\t5\tleft_hand\t1\n6\t5\tright_hand\t2\n")
    (folder / "notes.json").write_text("{}")
    got = files.json_sidecars(spark, str(tmp_path), "TaskName string, SamplingFrequency double", "_eeg.json").collect()
    assert [(r.TaskName, r.SamplingFrequency) for r in got] == [("mi", 512.0)]
    events = files.tsv_sidecars(spark, str(tmp_path), "onset double, duration double, trial_type string, value string", "_events.tsv")
    path = F.col("path")
    rows = events.select("onset", "trial_type", "value", text.path_entity(path, "sub").alias("s"), text.path_entity(path, "ses").alias("n")).orderBy("onset").collect()
    assert [tuple(r) for r in rows] == [(0.0, "left_hand", "1", "01", "2"), (6.0, "right_hand", "2", "01", "2")]
    listed = files.file_inventory(spark, str(tmp_path))
    assert {r.relative_path for r in files.with_suffix_in_folder(listed, "_events.tsv", "eeg").collect()} == {"sub-01/ses-2/eeg/sub-01_events.tsv"}


def test_globs(spark):
    paths = ["a/x.EDF", "A/x.edf", "b/c/y.edf", "y.edf", "../z.edf", "b/y.txt"]
    inventory = spark.createDataFrame([(p,) for p in paths], "relative_path string")
    got = {r.relative_path.lower() for r in files.discover(inventory, ["**/*.edf", "**/*.EDF"]).collect()}
    assert got == {"a/x.edf", "b/c/y.edf", "y.edf"}
    assert files.discover(inventory, ["*.txt"]).count() == 0


FORMAT_PATHS = [
    ("rec/a.vhdr", False), ("rec/a.vmrk", False), ("rec/a.eeg", False), ("rec/b.VHDR", False),
    ("s.set", False), ("x.fif.gz", False), ("m.mat", False), ("p.mff", True), ("p.mff/signal1.bin", False),
]


def test_formats_and_companions(spark):
    inventory = spark.createDataFrame(FORMAT_PATHS, "relative_path string, is_dir boolean")
    rows = files.format_inventory(inventory).collect()
    assert [r.format_id for r in rows] == ["brainvision_core", "eeglab_set", "egi_mff", "mne_fif", "mat_container"]
    by = {r.format_id: r for r in rows}
    assert by["brainvision_core"].matched_files == 2 and by["brainvision_core"].companion_complete is False
    assert "one_or_more_companion_sets_are_incomplete" in by["brainvision_core"].limitations
    assert by["eeglab_set"].companion_complete is True
    assert "optional_companion_files_are_absent" in by["eeglab_set"].limitations
    assert by["egi_mff"].matched_directories == 1 and by["mne_fif"].companion_complete is None
    plain = inventory.where(~F.col("is_dir"))
    missing = {(r.relative_path, r.companion) for r in files.missing_companions(plain).collect()}
    assert missing == {("rec/b.VHDR", "rec/b.vmrk"), ("rec/b.VHDR", "rec/b.eeg")}
    assert {r.companion for r in files.dependencies(plain).collect()} == {"rec/a.vmrk", "rec/a.eeg"}


def test_array_axes(spark):
    cube = np.arange(30.0).reshape(2, 5, 3)  # channel, sample, trial
    held = io.BytesIO()
    np.savez(held, eeg=cube, y=np.array([[1, 2, 1]]))
    df = spark.createDataFrame([("sub-1/r.npz", bytearray(held.getvalue()))], "path string, content binary")
    rows = files.array_trials(df, "eeg", "y", ["channel", "sample", "trial"]).orderBy("trial_idx").collect()
    assert [r.label for r in rows] == ["1", "2", "1"] and {r.channels for r in rows} == {2}
    assert np.array_equal(np.array([r.samples for r in rows]).reshape(3, 2, 5), np.moveaxis(cube, 2, 0))


def test_package_digest(spark):
    parts = [("p", "b.bin", b"two"), ("p", "a.bin", b"one")]
    rows = [(k, n, hashlib.sha256(c).hexdigest()) for k, n, c in parts]
    got = files.package_digests(spark.createDataFrame(rows, "k string, n string, d string"), "k", "n", "d").first()
    want = hashlib.sha256()
    for _, name, content in sorted(parts, key=lambda p: p[1]):
        want.update(name.encode())
        want.update(hashlib.sha256(content).digest())
    assert got.sha256 == want.hexdigest() and got.members == 2


def test_broken_log_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"sequence": 0, "event_type": "a"}\n{"sequence": 1, "eve\n{"sequence": 2, "event_type": "c"}\n')
    rows = files.jsonl_log(spark, str(tmp_path), "sequence long, event_type string").collect()
    assert sorted(r.valid for r in rows) == [False, True, True]
    assert [r._corrupt_record for r in rows if not r.valid] == ['{"sequence": 1, "eve']


def test_crossref(spark):
    item = {
        "title": ["<b>Motor imagery</b> pipeline"], "DOI": "10.1234/ABC", "URL": "https://x", "type": "journal-article",
        "published": {"date-parts": [[2024, 2]]}, "author": [{"given": "Ada", "family": "Lovelace"}, {"family": "Noname"}, {}],
        "container-title": ["Journal &amp; Co"], "abstract": "<p>Clean&nbsp;text</p>",
    }
    raw = json.dumps({"message": {"items": [item, {"title": []}, {"title": ["Only title"], "relation": {"is-retracted-by": [1]}}]}})
    rows = literature.crossref_papers(spark.createDataFrame([(raw,)], "raw string")).orderBy("pos").collect()
    assert [r.title for r in rows] == ["Motor imagery pipeline", "Only title"]
    first, second = rows
    assert first.stable_id == "10.1234/abc" and first.year == 2024 and first.venue == "Journal & Co"
    assert first.authors == ["Ada Lovelace", "Noname"] and first.abstract == "Clean text"
    assert second.is_retracted is True and second.stable_id == "crossref:2" and second.year is None


def test_openalex(spark):
    item = {
        "id": "https://openalex/W1", "display_name": "Session adaptation", "doi": "https://doi.org/10.1234/OpenAlex",
        "publication_year": 2023, "cited_by_count": 7, "is_retracted": False,
        "abstract_inverted_index": {"helps": [2], "Session": [0], "adaptation": [1]},
        "authorships": [{"author": {"display_name": " Grace "}}], "primary_location": {"source": {"display_name": "V"}},
    }
    row = literature.openalex_papers(spark.createDataFrame([(json.dumps({"results": [item, {"id": "x"}]}),)], "raw string")).collect()
    assert len(row) == 1
    assert row[0].stable_id == "10.1234/openalex" and row[0].abstract == "Session adaptation helps"
    assert row[0].citation_count == 7 and row[0].authors == ["Grace"]


def test_write_once_and_publish(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") % 3)
    sinks.write_once(df, str(tmp_path / "once"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_once(df, str(tmp_path / "once"))
    assert sinks.publish(df, str(tmp_path / "copy"), ["id", "v"]).count() == 0


def test_sequences_go_on(spark):
    new = spark.createDataFrame([("r1", 5), ("r1", 3), ("r2", 1)], "run string, at long")
    old = spark.createDataFrame([("r1", 0), ("r1", 1)], "run string, sequence long")
    got = sinks.sequenced_events(new, old, "run", "at", block_slice("at", 2)).collect()
    assert sorted((r.run, r.at, r.sequence) for r in got) == [("r1", 3, 2), ("r1", 5, 3), ("r2", 1, 0)]


def test_revisions(spark):
    first = spark.createDataFrame([("d", "aaa", 1), ("d", "bbb", 2), ("d", "aaa", 3)], "ds string, sha string, at long")
    none = spark.createDataFrame([], "ds string, sha string, revision_number long")
    one = sinks.register_revisions(first, none, "ds", "sha", "at", block_slice("at"))
    assert sorted((r.sha, r.revision_number) for r in one.collect()) == [("aaa", 1), ("bbb", 2)]
    more = spark.createDataFrame([("d", "bbb", 9), ("d", "ccc", 10)], "ds string, sha string, at long")
    two = sinks.register_revisions(more, one, "ds", "sha", "at", block_slice("at")).collect()
    assert [(r.sha, r.revision_number, r.artifact_id) for r in two] == [("ccc", 3, "revision-0003-ccc")]
