"""File listings, sidecars, fingerprints, companions, formats, array containers."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.operators.ordered import ordered_position, top_rows

# --- sidecars -------------------------------------------------------------------


def json_sidecars(spark: SparkSession, root: str, schema: T.StructType | str, suffix: str) -> DataFrame:
    """JSON documents below a folder, one row per file, with their path.

    The schema is given, so nothing is read twice; a byte-order mark is skipped.
    """
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{suffix}")
        .json(root)
        .withColumn("path", F.col("_metadata.file_path"))
    )


def tsv_sidecars(spark: SparkSession, root: str, schema: T.StructType | str, suffix: str) -> DataFrame:
    """Tab-separated files with a header, every row with its file's path."""
    return (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{suffix}")
        .csv(root)
        .withColumn("path", F.col("_metadata.file_path"))
    )


def jsonl_log(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Log lines with ``valid``; a broken line is a row with its text kept."""
    read = (
        spark.read.schema(f"{schema}, _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("recursiveFileLookup", True)
        .json(root)
    )
    return read.withColumn("valid", F.col("_corrupt_record").isNull())


# --- listings -------------------------------------------------------------------


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Path and length of every file; contents are not opened."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    )
    base = "/" + root.split("://")[-1].strip("/") + "/"
    return listed.withColumn("relative_path", F.substring_index(F.col("path"), base, -1))


def with_suffix_in_folder(inventory: DataFrame, suffix: str, folder: str, entity: str = "sub") -> DataFrame:
    """Files with a suffix, below a folder of the given name and a named entity."""
    p = F.col("relative_path")
    return inventory.where(
        p.endswith(suffix) & p.rlike(rf"(^|/){re.escape(folder)}/") & p.rlike(rf"(^|/){entity}-")
    )


# Suffixes of signal files.
SIGNAL_SUFFIXES = (".edf", ".bdf", ".vhdr", ".set")


def signal_files(inventory: DataFrame, folder: str = "eeg") -> DataFrame:
    suffixes = "|".join(re.escape(s) for s in SIGNAL_SUFFIXES)
    p = F.col("relative_path")
    return inventory.where(
        p.rlike(rf"_eeg(?i:{suffixes})$") & p.rlike(rf"(^|/){folder}/") & p.rlike(r"(^|/)sub-")
    )


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob over relative paths: ** spans folders, * does not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def discover(inventory: DataFrame, globs: Sequence[str]) -> DataFrame:
    """Paths that match any glob, one per spelling regardless of case.

    Paths that climb out of the root never match.
    """
    p = F.col("relative_path")
    inside = ~p.rlike(r"(^|/)\.\.(/|$)") & ~p.startswith("/")
    hit = F.lit(False)
    for g in globs:
        hit = hit | p.rlike(glob_pattern(g))
    return (
        inventory.where(inside & hit)
        .groupBy(F.lower(p).alias("key"))
        .agg(F.max("relative_path").alias("relative_path"))
        .select("relative_path")
    )


# --- fingerprints ---------------------------------------------------------------


def file_digests(contents: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return contents.select(path, F.sha2(content, 256).alias("sha256"))


def package_digests(files: DataFrame, package: str, name: str, digest: str) -> DataFrame:
    """Digest of each package: names and file digests in name order.

    A package is one recording stored as a folder, or a file with its companions, so
    a group holds the members of one recording; only names and digests are brought
    together, never contents.
    """
    part = F.concat(F.hex(F.encode(F.col(name), "UTF-8")), F.col(digest))
    members = F.array_sort(F.collect_list(F.struct(F.col(name), part.alias("part"))))
    joined = F.array_join(F.transform(members, lambda m: m["part"]), "")
    return files.groupBy(package).agg(
        F.sha2(F.unhex(joined), 256).alias("sha256"), F.count(F.lit(1)).alias("members")
    )


# --- companions and formats -----------------------------------------------------

# Fixed values: (format id, file suffixes, companion suffixes, required, folder
# suffixes, generic container).
FORMATS = (
    ("brainvision_core", (".vhdr",), (".vmrk", ".eeg"), True, (), False),
    ("brainvision_recording", (".bvrh",), (".bvrm", ".bvrd"), True, (), False),
    ("edf_edfplus", (".edf",), (), True, (), False),
    ("biosemi_bdf", (".bdf",), (), True, (), False),
    ("eeglab_set", (".set",), (".fdt",), False, (), False),
    ("mne_fif", (".fif", ".fif.gz"), (), True, (), False),
    ("biosig_gdf", (".gdf",), (), True, (), False),
    ("neuroscan_cnt", (".cnt",), (), True, (), False),
    ("egi_mff", (), (), True, (".mff",), False),
    ("xdf", (".xdf", ".xdfz"), (), True, (), False),
    ("nwb", (".nwb",), (), True, (), False),
    ("mat_container", (".mat",), (), True, (), True),
    ("hdf5_container", (".h5", ".hdf5", ".hdf"), (), True, (), True),
    ("numpy_container", (".npy", ".npz"), (), True, (), True),
)
# Companions a source takes along when they exist.
DEPENDENCIES = {".vhdr": (".vmrk", ".eeg"), ".set": (".fdt",)}
SAMPLE_PATHS = 5


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def suffix_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def companion_links(inventory: DataFrame, companions: dict[str, Sequence[str]]) -> DataFrame:
    """(relative_path, companion, present) for every expected companion of a file."""
    p = F.col("relative_path")
    table = F.create_map(
        *[
            x
            for ext, exts in companions.items()
            for x in (F.lit(ext), F.array(*[F.lit(e) for e in exts]))
        ]
    )
    wanted = inventory.select(
        "relative_path",
        F.explode(F.try_element_at(table, F.lower(suffix_of(p)))).alias("ext"),
    ).select("relative_path", F.concat(stem(p), F.col("ext")).alias("companion"))
    there = inventory.select(p.alias("companion"), F.lit(True).alias("__there"))
    return wanted.join(there, "companion", "left").select(
        "relative_path", "companion", F.coalesce("__there", F.lit(False)).alias("present")
    )


def dependencies(inventory: DataFrame) -> DataFrame:
    """(relative_path, companion) a source is fingerprinted together with.

    Header files take the marker and signal files that exist.
    """
    return companion_links(inventory, DEPENDENCIES).where("present").drop("present")


def missing_companions(inventory: DataFrame) -> DataFrame:
    """Required companions that are absent."""
    required = {e: c for _, exts, c, need, _, _ in FORMATS if c and need for e in exts}
    return companion_links(inventory, required).where(~F.col("present")).drop("present")


def format_inventory(inventory: DataFrame) -> DataFrame:
    """One row per format found, generic containers last.

    ``inventory`` has relative_path and is_dir.  Formats are matched inside the row
    against literals; only matches are grouped.
    """
    name = F.lower(F.element_at(F.split("relative_path", "/"), -1))

    def ends(exts: Sequence[str]) -> Column:
        hit = F.lit(False)
        for e in exts:
            hit = hit | name.endswith(e)
        return hit

    tests = [
        F.when(
            (~F.col("is_dir") & ends(files)) | (F.col("is_dir") & ends(folders)),
            F.struct(F.lit(fid).alias("format_id"), F.lit(generic).alias("generic")),
        )
        for fid, files, _, _, folders, generic in FORMATS
    ]
    matches = inventory.select("relative_path", "is_dir", F.inline(F.array(*tests))).where(
        F.col("format_id").isNotNull()
    )
    links = companion_links(
        inventory.where(~F.col("is_dir")),
        {e: c for _, exts, c, _, _, _ in FORMATS if c for e in exts},
    )
    complete = links.groupBy("relative_path").agg(F.bool_and("present").alias("complete"))
    counted = (
        matches.join(complete, "relative_path", "left")
        .groupBy("format_id", "generic")
        .agg(
            F.count_if(~F.col("is_dir")).alias("matched_files"),
            F.count_if(F.col("is_dir")).alias("matched_directories"),
            F.bool_and("complete").alias("all_present"),
        )
    )
    samples = (
        top_rows(matches, ["format_id"], ["is_dir", "relative_path"], SAMPLE_PATHS, "place")
        .groupBy("format_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "relative_path"))).alias("s"))
        .select("format_id", F.transform("s", lambda x: x["relative_path"]).alias("sample_paths"))
    )
    optional = F.col("format_id").isin(*[f[0] for f in FORMATS if f[2] and not f[3]])
    ok = F.when(F.col("all_present").isNotNull(), F.col("all_present") | optional)
    gap = F.when(
        ~F.col("all_present"),
        F.when(optional, "optional_companion_files_are_absent").otherwise("one_or_more_companion_sets_are_incomplete"),
    )
    return counted.join(samples, "format_id").select(
        "format_id",
        "generic",
        "matched_files",
        "matched_directories",
        ok.alias("companion_complete"),
        F.filter(
            F.array(gap, F.lit("format_detection_does_not_establish_experiment_semantics")),
            lambda x: x.isNotNull(),
        ).alias("limitations"),
        "sample_paths",
    ).orderBy("generic", "format_id")


# --- array containers -----------------------------------------------------------

TRIAL_ROW = "path string, trial_idx int, label string, channels int, samples array<double>"


def array_trials(
    files: DataFrame, signal_key: str, label_key: str, axis_order: Sequence[str]
) -> DataFrame:
    """Trials of numpy containers (path, content), one row per trial.

    Declared axes are moved to trial, channel, sample.  A container is decoded by the
    task that holds its bytes, so nothing is shuffled.
    """
    place = [list(axis_order).index(a) for a in ("trial", "channel", "sample")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                held = np.load(io.BytesIO(content), allow_pickle=False)
                cube = np.transpose(np.asarray(held[signal_key], dtype=float), place)
                labels = np.ravel(held[label_key])
                if len(labels) != len(cube):
                    raise ValueError(f"{path}: {len(labels)} labels for {len(cube)} trials")
                yield pd.DataFrame(
                    {
                        "path": path,
                        "trial_idx": np.arange(len(cube), dtype="int32"),
                        "label": [str(v) for v in labels.tolist()],
                        "channels": np.int32(cube.shape[1]),
                        "samples": list(cube.reshape(len(cube), -1)),
                    }
                )

    return files.select("path", "content").mapInPandas(decode, TRIAL_ROW)


def concatenate_runs(trials: DataFrame, keys: Sequence[str], run: str, slice_by: Column) -> DataFrame:
    """Runs of a session end to end in run order, trials numbered anew."""
    placed = ordered_position(
        trials.withColumn("__within", slice_by), keys, [run, "trial_idx"], F.struct(run, "__within"), "__p"
    )
    return placed.withColumn("trial_idx", F.col("__p") - 1).drop("__p", "__within")


# --- recordings -----------------------------------------------------------------


def recording_facts(recordings: DataFrame) -> DataFrame:
    """One row per recording header: rate, channel and EOG counts, line frequency."""
    eog = F.filter("channels", lambda c: F.lower(c["type"]) == "eog")
    return recordings.select(
        "path", "subject", "session", "sfreq", "line_freq",
        F.size("channels").alias("channel_count"),
        F.size(eog).alias("eog_channel_count"),
        F.array_join(F.transform("channels", lambda c: c["name"]), ",").alias("channel_names"),
    )


def recording_events(recordings: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Annotations as event rows with their mapped label; unmapped ones stay null."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return recordings.select("path", "subject", "session", F.inline("annotations")).withColumn(
        "label", F.try_element_at(pairs, F.col("description"))
    )
