"""Sources, sinks and the stream (SC1-SC12, SK1-SK6, ST1).

Files are written by Spark from the given tables into the shared folder and read back
by the operators, so the work grows with the tables.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trialweave.functions import text
from trialweave.operators.logs import COUNTERS
from trialweave.operators.ordered import block_slice, day_slice, ordered_position
from trialweave.plans.registry import query, table
from trialweave.session import materialise, shared_dir
from trialweave.sources import files, literature, sinks
from trialweave.streaming import budget_stream

SIDECAR_SCHEMA = "TaskName string, SamplingFrequency double, PowerLineFrequency string, EEGChannelCount int"
FOLDER_PATTERN = r"lang=(?P<subject>[^/]+)/source=(?P<session>[^/]+)/"


@query(
    "sc1_json_sidecars",
    """
    SELECT lang AS subject, source AS session, source || '-' || lang AS task, max(n_chars)::DOUBLE AS sampling_frequency, count(*)::INTEGER AS channel_count, CASE WHEN count(*) % 2 = 0 THEN NULL ELSE 50.0::DOUBLE END AS line_frequency FROM documents GROUP BY 1, 2
    """,
)
def sc1_json_sidecars(spark, sf):
    """One pretty-printed JSON document with a byte-order mark per (lang, source)."""
    docs = table(spark, sf, "documents").groupBy("lang", "source").agg(
        F.max("n_chars").cast("double").alias("f"), F.count(F.lit(1)).cast("int").alias("c")
    )
    body = F.to_json(
        F.struct(
            F.concat_ws("-", "source", "lang").alias("TaskName"),
            F.col("f").alias("SamplingFrequency"),
            F.when(F.col("c") % 2 == 0, "n/a").otherwise("50").alias("PowerLineFrequency"),
            F.col("c").alias("EEGChannelCount"),
        ),
        {"pretty": "true"},
    )
    root = shared_dir(spark, "sidecars")
    docs.select("lang", "source", F.concat(F.lit("﻿"), body).alias("value")).repartition(
        "lang", "source"
    ).write.partitionBy("lang", "source").text(root)
    read = files.json_sidecars(spark, root, SIDECAR_SCHEMA, ".txt")
    path = F.col("path")
    return read.select(
        text.declared_identity(path, FOLDER_PATTERN, "subject").alias("subject"),
        text.declared_identity(path, FOLDER_PATTERN, "session").alias("session"),
        F.col("TaskName").alias("task"),
        F.col("SamplingFrequency").alias("sampling_frequency"),
        F.col("EEGChannelCount").alias("channel_count"),
        text.optional_double(F.col("PowerLineFrequency")).alias("line_frequency"),
    )


@query(
    "sc2_tsv_sidecars",
    "SELECT event_type AS trial_type, user_id % 10 AS subject, event_id, value AS onset, props AS value FROM events",
)
def sc2_tsv_sidecars(spark, sf):
    root = shared_dir(spark, "tsv")
    table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("sub"), "event_id", F.col("value").alias("onset"), F.col("event_type").alias("trial_type"), F.col("props").alias("value")
    ).write.partitionBy("sub").option("sep", "\t").option("header", True).csv(root)
    read = files.tsv_sidecars(spark, root, "event_id long, onset double, trial_type string, value string", ".csv")
    subject = text.declared_identity(F.col("path"), r"/sub=(?P<sub>[0-9]+)/", "sub").cast("long")
    return read.select("trial_type", subject.alias("subject"), "event_id", "onset", "value")


@query(
    "sc3_file_listing",
    "SELECT DISTINCT lang, source, true AS has_content FROM documents",
)
def sc3_file_listing(spark, sf):
    root = shared_dir(spark, "listing")
    table(spark, sf, "documents").select("lang", "source", "doc_id", "n_chars").repartition("lang", "source").write.partitionBy(
        "lang", "source"
    ).json(root)
    listed = files.file_inventory(spark, root).where(F.col("relative_path").endswith(".json"))
    p = F.col("relative_path")
    return listed.select(
        F.regexp_extract(p, r"lang=([^/]+)/", 1).alias("lang"),
        F.regexp_extract(p, r"source=([^/]+)/", 1).alias("source"),
        (F.col("length") > 0).alias("has_content"),
    )


URL_PATH_SQL = "SELECT regexp_replace(regexp_replace(CASE WHEN page_id % 4 = 0 THEN upper(u) WHEN page_id % 29 = 0 THEN '../' || u ELSE u END, '[?#].*$', ''), '/$', '') AS p FROM (SELECT page_id, regexp_replace(url, '^https?://[^/]+/', '') AS u FROM pages UNION ALL SELECT page_id + 1, regexp_replace(url, '^https?://[^/]+/', '') FROM pages)"


def url_paths(spark, sf):
    base = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"^https?://[^/]+/", "").alias("u"))
    both = base.unionByName(base.withColumn("page_id", F.col("page_id") + 1))
    shaped = (
        F.when(F.col("page_id") % 4 == 0, F.upper("u"))
        .when(F.col("page_id") % 29 == 0, F.concat(F.lit("../"), "u"))
        .otherwise(F.col("u"))
    )
    clean = F.regexp_replace(F.regexp_replace(shaped, r"[?#].*$", ""), r"/$", "")
    return both.select(clean.alias("relative_path"))


@query(
    "sc4_glob_discovery",
    rf"""
    WITH p AS ({URL_PATH_SQL}) SELECT max(p) AS relative_path FROM p
    WHERE NOT starts_with(p, '../') AND (regexp_full_match(p, '([^/]+/)*[^/]*\.html') OR regexp_full_match(p, 'EN/[^/]*') OR regexp_full_match(p, 'd[^/]/[^/]*'))
    GROUP BY lower(p)
    """,
)
def sc4_glob_discovery(spark, sf):
    return files.discover(url_paths(spark, sf), ["**/*.html", "EN/*", "d?/*"])


@query(
    "sc5_array_containers",
    """
    WITH e AS (SELECT vec_id, label, vec_id % 2 AS session_id, list_transform(embedding, lambda x: x::DOUBLE) AS s FROM embeddings)
    SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY vec_id) - 1)::BIGINT AS trial_idx, label::VARCHAR AS label, 4 AS channels, s[1] AS first_sample, s[64] AS last_sample, round(list_sum(s), 9) AS total FROM e
    """,
)
def sc5_array_containers(spark, sf):
    """Containers of up to a hundred trials stored as channel x sample x trial."""
    vectors = table(spark, sf, "embeddings").select(
        "vec_id", "label", (F.col("vec_id") % 2).alias("session_id"), F.floor(F.col("vec_id") / 200).alias("run_id"),
        F.col("embedding").cast("array<double>").alias("samples"),
    )

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        cube = np.stack(rows["samples"].tolist()).reshape(len(rows), 4, 16)
        held = io.BytesIO()
        np.savez(held, eeg=np.moveaxis(cube, 0, 2), y=rows["label"].to_numpy())
        return pd.DataFrame({"path": [f"ses-{key[0]}/run-{key[1]:09d}.npz"], "content": [held.getvalue()]})

    packed = vectors.groupBy("session_id", "run_id").applyInPandas(pack, "path string, content binary")
    trials = files.array_trials(packed, "eeg", "y", ["channel", "sample", "trial"])
    identified = trials.select(
        text.path_entity(F.col("path"), "ses").cast("long").alias("session_id"),
        F.regexp_extract("path", r"run-([0-9]+)", 1).alias("run_id"),
        "trial_idx", "label", "channels", "samples",
    )
    joined = files.concatenate_runs(identified, ["session_id"], "run_id", block_slice("trial_idx"))
    return joined.select(
        "session_id", "trial_idx", "label", "channels",
        F.get("samples", F.lit(0)).alias("first_sample"),
        F.get("samples", F.lit(63)).alias("last_sample"),
        F.round(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x), 9).alias("total"),
    )


@query(
    "sc6_fingerprints",
    """
    WITH f AS (SELECT conv_id, 'turn-' || turn || '.txt' AS n, sha256(text) AS h FROM conversations)
    SELECT conv_id, count(*)::BIGINT AS members, sha256(unhex(string_agg(hex(encode(n)) || h, '' ORDER BY n))) AS sha256 FROM f GROUP BY 1
    """,
)
def sc6_fingerprints(spark, sf):
    members = table(spark, sf, "conversations").select(
        "conv_id",
        F.concat(F.lit("turn-"), F.col("turn").cast("string"), F.lit(".txt")).alias("name"),
        F.sha2("text", 256).alias("digest"),
    )
    return files.package_digests(members, "conv_id", "name", "digest")


LINE_FILES_SQL = """
    f AS (SELECT DISTINCT 'sub-' || l_suppkey || '/eeg/rec-' || l_orderkey || CASE l_linenumber WHEN 1 THEN '.vhdr' WHEN 2 THEN '.vmrk' WHEN 3 THEN '.eeg' WHEN 4 THEN '.set' WHEN 5 THEN '.fdt' WHEN 6 THEN '.EDF' ELSE '.fif.gz' END AS p, false AS is_dir FROM lineitem
      UNION ALL SELECT DISTINCT 'sub-' || l_suppkey || '/eeg/day-' || year(l_shipdate) || '.mff', true FROM lineitem)
"""


def line_files(spark, sf):
    lines = table(spark, sf, "lineitem")
    exts = F.array(*[F.lit(e) for e in (".vhdr", ".vmrk", ".eeg", ".set", ".fdt", ".EDF", ".fif.gz")])
    folder = F.concat(F.lit("sub-"), F.col("l_suppkey").cast("string"), F.lit("/eeg/"))
    recs = lines.select(
        F.concat(folder, F.lit("rec-"), F.col("l_orderkey").cast("string"), F.get(exts, F.col("l_linenumber") - 1)).alias("relative_path"),
        F.lit(False).alias("is_dir"),
    )
    days = lines.select(
        F.concat(folder, F.lit("day-"), F.year("l_shipdate").cast("string"), F.lit(".mff")).alias("relative_path"), F.lit(True).alias("is_dir")
    )
    # A stored listing, as a file scan would leave it.
    return materialise(recs.distinct().unionByName(days.distinct()), "inventory")


@query(
    "sc7_companions",
    f"""
    WITH {LINE_FILES_SQL}, g AS MATERIALIZED (SELECT DISTINCT p FROM f), h AS (SELECT p, regexp_replace(p, '\\.vhdr$', '') AS s FROM f WHERE p LIKE '%.vhdr'), w AS (SELECT p, s || e AS c FROM h, (VALUES ('.vmrk'), ('.eeg')) x(e)),
    d AS (SELECT p, s || e AS c FROM (SELECT p, regexp_replace(p, '\\.set$', '') AS s FROM f WHERE p LIKE '%.set'), (VALUES ('.fdt')) x(e) UNION ALL SELECT * FROM w)
    SELECT w.p AS relative_path, w.c AS companion, 'missing' AS kind FROM w LEFT JOIN g ON g.p = w.c WHERE g.p IS NULL
    UNION ALL SELECT d.p, d.c, 'dependency' FROM d JOIN g ON g.p = d.c
    """,
)
def sc7_companions(spark, sf):
    inventory = line_files(spark, sf).where(~F.col("is_dir"))
    missing = files.missing_companions(inventory).withColumn("kind", F.lit("missing"))
    held = files.dependencies(inventory).withColumn("kind", F.lit("dependency"))
    return missing.unionByName(held)


@query(
    "sc8_format_inventory",
    f"""
    WITH {LINE_FILES_SQL}, m AS (SELECT p, is_dir, CASE WHEN is_dir THEN 'egi_mff' WHEN p LIKE '%.vhdr' THEN 'brainvision_core' WHEN p LIKE '%.set' THEN 'eeglab_set' WHEN p LIKE '%.EDF' THEN 'edf_edfplus' WHEN p LIKE '%.fif.gz' THEN 'mne_fif' END AS format_id FROM f),
    c AS (SELECT format_id, count_if(NOT is_dir)::BIGINT AS matched_files, count_if(is_dir)::BIGINT AS matched_directories, list(p ORDER BY p)[1:5] AS s FROM m WHERE format_id IS NOT NULL GROUP BY 1)
    SELECT format_id, false AS generic, matched_files, matched_directories, CASE format_id WHEN 'brainvision_core' THEN false WHEN 'eeglab_set' THEN true END AS companion_complete,
      CASE format_id WHEN 'brainvision_core' THEN 'one_or_more_companion_sets_are_incomplete;' WHEN 'eeglab_set' THEN 'optional_companion_files_are_absent;' ELSE '' END || 'format_detection_does_not_establish_experiment_semantics' AS limitations, array_to_string(s, ';') AS sample_paths FROM c
    """,
)
def sc8_format_inventory(spark, sf):
    found = files.format_inventory(line_files(spark, sf))
    return found.withColumns(
        {"limitations": F.array_join("limitations", ";"), "sample_paths": F.array_join("sample_paths", ";")}
    )


def responses(spark, sf, item, head, tail):
    """Response documents of up to twenty items each, as one search returns."""
    docs = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 20).alias("block"), "doc_id", F.to_json(item).alias("i")
    )
    packed = docs.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("doc_id", "i"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["i"]), ",")
    return packed.select("block", F.concat(F.lit(head), body, F.lit(tail)).alias("raw"))


@query(
    "sc9_crossref_papers",
    r"""
    SELECT doc_id // 20 AS block, (doc_id % 20)::INTEGER AS pos, CASE WHEN n_chars % 3 = 0 THEN 'http://x/' || doc_id ELSE '10.1/' || upper(source) || doc_id END AS source_id,
      CASE WHEN n_chars % 3 = 0 THEN NULL ELSE '10.1/' || upper(source) || doc_id END AS doi, 'Title & ' || doc_id AS title, CASE WHEN n_chars % 5 = 0 THEN NULL ELSE 2000 + (n_chars % 20)::INTEGER END AS year,
      'Ada ' || lang || ';' || source AS authors, CASE WHEN n_chars % 7 = 0 THEN true END AS is_retracted,
      CASE WHEN n_chars % 3 = 0 THEN 'crossref:http://x/' || doc_id ELSE lower('10.1/' || source || doc_id) END AS stable_id, 'Press of ' || lang AS publisher
    FROM documents WHERE n_chars % 11 <> 0
    """,
)
def sc9_crossref_papers(spark, sf):
    n, doc = F.col("n_chars"), F.col("doc_id").cast("string")
    item = F.struct(
        F.when(n % 11 != 0, F.array(F.concat(F.lit("<b>Title</b>\n &amp; "), doc))).alias("title"),
        F.when(n % 3 != 0, F.concat(F.lit("10.1/"), F.upper("source"), doc)).alias("DOI"),
        F.concat(F.lit("http://x/"), doc).alias("URL"),
        F.when(n % 5 != 0, F.struct(F.array(F.array((n % 20 + 2000).cast("int"))).alias("date-parts"))).alias("published"),
        F.array(
            F.struct(F.lit("Ada").alias("given"), F.col("lang").alias("family")),
            F.struct(F.lit(None).cast("string").alias("given"), F.col("source").alias("family")),
            F.struct(F.lit(None).cast("string").alias("given"), F.lit("").alias("family")),
        ).alias("author"),
        F.when(n % 7 == 0, F.struct(F.lit("y").alias("is-retracted-by"))).alias("relation"),
        F.concat(F.lit("Press of "), "lang").alias("publisher"),
    )
    papers = literature.crossref_papers(responses(spark, sf, item, '{"message": {"items": [', ']}}'))
    return papers.select(
        "block", "pos", "source_id", "doi", "title", "year", F.array_join("authors", ";").alias("authors"), "is_retracted", "stable_id",
        F.get_json_object("metadata_json", "$.publisher").alias("publisher"),
    )


def broken_responses(spark, sf):
    """Responses of which some are cut short and some carry no item list."""
    item = F.struct(F.array(F.col("source")).alias("title"))
    block = F.col("block")
    raw = (
        F.when(block % 5 == 1, F.substring("raw", 1, 30))
        .when(block % 5 == 2, F.lit('{"message": {"items": null}, "status": "failed"}'))
        .when(block % 5 == 3, F.lit('{"message": {"items": []}}'))
        .otherwise(F.col("raw"))
    )
    return responses(spark, sf, item, '{"message": {"items": [', ']}}').withColumn("raw", raw)


@query(
    "sc9_response_faults",
    """
    WITH b AS (SELECT DISTINCT doc_id // 20 AS block FROM documents)
    SELECT block, CASE block % 5 WHEN 1 THEN 'response_is_json' ELSE 'response_lists_items' END AS rule_id FROM b WHERE block % 5 IN (1, 2)
    """,
)
def sc9_response_faults(spark, sf):
    return literature.response_faults(broken_responses(spark, sf), literature.CROSSREF_ITEMS)


@query(
    "sc10_openalex_papers",
    r"""
    SELECT doc_id // 20 AS block, (doc_id % 20)::INTEGER AS pos, 'W' || doc_id AS source_id, CASE WHEN n_chars % 3 = 0 THEN NULL ELSE '10.2/' || source || doc_id END AS doi, 'Work ' || doc_id AS title,
      'A ' || lang AS authors, n_chars AS citation_count, n_chars % 2 = 0 AS is_retracted, lang || ' ' || source || ' ' || lang AS abstract
    FROM documents WHERE n_chars % 13 <> 0
    """,
)
def sc10_openalex_papers(spark, sf):
    n, doc = F.col("n_chars"), F.col("doc_id").cast("string")
    item = F.struct(
        F.concat(F.lit("W"), doc).alias("id"),
        F.when(n % 13 == 0, "<i> </i>").otherwise(F.concat(F.lit("Work "), doc)).alias("display_name"),
        F.when(n % 3 != 0, F.concat(F.lit("https://doi.org/10.2/"), "source", doc)).alias("doi"),
        n.alias("cited_by_count"),
        (n % 2 == 0).alias("is_retracted"),
        F.map_from_arrays(
            F.array("source", "lang"), F.array(F.array(F.lit(1)), F.array(F.lit(0), F.lit(2)))
        ).alias("abstract_inverted_index"),
        F.array(
            F.struct(F.struct(F.concat(F.lit(" A "), "lang").alias("display_name")).alias("author")),
            F.struct(F.struct(F.lit(" ").alias("display_name")).alias("author")),
        ).alias("authorships"),
    )
    papers = literature.openalex_papers(responses(spark, sf, item, '{"results": [', ']}'))
    return papers.select(
        "block", "pos", "source_id", "doi", "title", F.array_join("authors", ";").alias("authors"), "citation_count", "is_retracted", "abstract"
    )


@query(
    "sc11_jsonl_log",
    """
    SELECT CASE WHEN event_id % 17 <> 0 THEN event_type END AS event_type, event_id % 17 <> 0 AS valid, count(*)::BIGINT AS lines, sum(CASE WHEN event_id % 17 <> 0 THEN event_id END)::BIGINT AS ids FROM events GROUP BY 1, 2
    """,
)
def sc11_jsonl_log(spark, sf):
    root = shared_dir(spark, "jsonl")
    line = F.to_json(F.struct(F.col("event_id").alias("sequence"), "event_type", "props"))
    broken = F.substring(line, 1, 20)
    table(spark, sf, "events").select(
        F.when(F.col("event_id") % 17 == 0, broken).otherwise(line).alias("value")
    ).write.text(root)
    read = files.jsonl_log(spark, root, "sequence long, event_type string, props string")
    # A broken line may give away some leading fields; only whole lines count.
    whole = F.col("valid")
    return read.groupBy(F.when(whole, F.col("event_type")).alias("event_type"), "valid").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.when(whole, F.col("sequence"))).alias("ids")
    )


@query(
    "sc12_recordings",
    """
    WITH o AS (SELECT o_custkey AS subject, year(o_orderdate)::VARCHAR AS session, o_orderkey AS path, o_orderstatus AS d, o_totalprice AS dur FROM orders)
    SELECT subject, session, CASE d WHEN 'F' THEN 'left' WHEN 'O' THEN 'right' END AS label, count(*)::BIGINT AS events, round(min(dur), 2) AS shortest FROM o GROUP BY 1, 2, 3
    UNION ALL SELECT subject, session, 'rest', count(*), 1.5 FROM o GROUP BY 1, 2
    """,
)
def sc12_recordings(spark, sf):
    note = F.array(
        F.struct(F.col("o_orderstatus").alias("description"), F.col("o_totalprice").alias("duration")),
        F.struct(F.lit("T0").alias("description"), F.lit(1.5).alias("duration")),
    )
    recordings = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("path"),
        F.col("o_custkey").alias("subject"),
        F.year("o_orderdate").cast("string").alias("session"),
        note.alias("annotations"),
    )
    events = files.recording_events(recordings, {"F": "left", "O": "right", "T0": "rest"})
    return events.groupBy("subject", "session", "label").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.min("duration"), 2).alias("shortest")
    )


@query(
    "sk1_append_events",
    """
    SELECT user_id AS run_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts >= TIMESTAMP '2024-01-15', ts, event_id) - 1)::BIGINT AS sequence FROM events
    """,
)
def sk1_append_events(spark, sf):
    """Two appends to one log; the second continues the first one's sequences."""
    root = shared_dir(spark, "append")
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.struct("ts", "event_id").alias("at"), "event_id", "event_type", "ts"
    )
    cut = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    schema = "event_id long, event_type string, sequence long, timestamp_utc string, run_id long"
    nothing = spark.createDataFrame([], "run_id long, sequence long")
    first = sinks.sequenced_events(events.where(cut), nothing, "run_id", "at", day_slice("ts"))
    sinks.append_events(first.drop("at", "ts"), root, "run_id")
    stored = sinks.read_events(spark, root, schema)
    second = sinks.sequenced_events(events.where(~cut), stored, "run_id", "at", day_slice("ts"))
    # The new rows are fixed before the folder they were numbered from grows.
    sinks.append_events(materialise(second.drop("at", "ts"), "append-rows"), root, "run_id")
    return sinks.read_events(spark, root, schema).select("run_id", "event_id", "sequence")


@query("sk2_write_once", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def sk2_write_once(spark, sf):
    root = shared_dir(spark, "write-once")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    sinks.write_once(orders, root)
    return spark.read.schema(orders.schema).parquet(root)


@query(
    "sk4_publication",
    """
    WITH r AS (SELECT lang AS stage, substr(sha256(text), 1, 2) AS name, doc_id, sha256(text) AS h FROM documents)
    SELECT stage, name, max(doc_id) AS published_at, arg_max(h, doc_id) AS sha256, 0::BIGINT AS unequal_digests FROM r GROUP BY 1, 2
    """,
)
def sk4_publication(spark, sf):
    records = table(spark, sf, "documents").select(
        F.col("lang").alias("stage"),
        F.substring(F.sha2("text", 256), 1, 2).alias("name"),
        F.col("doc_id").alias("published_at"),
        F.sha2("text", 256).alias("sha256"),
    )
    differing = sinks.publish(records, shared_dir(spark, "publication"), ["stage", "name", "published_at", "sha256"])
    index = sinks.publication_index(records, ["stage", "name"], "published_at")
    return index.withColumn("unequal_digests", differing.agg(F.count(F.lit(1))).scalar())


@query(
    "sk5_revision_registry",
    """
    WITH d AS (SELECT source, sha256(text) AS sha, doc_id, n_chars % 2 = 0 AS early FROM documents), g AS (SELECT source, sha, min(doc_id) AS f FROM d WHERE early GROUP BY 1, 2),
    r AS (SELECT source, sha, row_number() OVER (PARTITION BY source ORDER BY f) AS n FROM g), l AS (SELECT source, max(n) AS last FROM r GROUP BY 1),
    i AS (SELECT source, sha, min(doc_id) AS f FROM d WHERE NOT early AND (source, sha) NOT IN (SELECT (source, sha) FROM r) GROUP BY 1, 2)
    SELECT i.source, sha, (coalesce(last, 0) + row_number() OVER (PARTITION BY i.source ORDER BY f))::BIGINT AS revision_number, 'revision-' || lpad((coalesce(last, 0) + row_number() OVER (PARTITION BY i.source ORDER BY f))::VARCHAR, 4, '0') || '-' || substr(sha, 1, 12) AS artifact_id FROM i LEFT JOIN l ON l.source = i.source
    """,
)
def sk5_revision_registry(spark, sf):
    docs = table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("sha"), "doc_id", "n_chars")
    early = F.col("n_chars") % 2 == 0
    empty = docs.select("source", F.lit(0).alias("last_revision")).where(F.lit(False))
    registry = sinks.numbered_revisions(docs.where(early), empty, "source", "sha", "doc_id", block_slice("doc_id"))
    new = sinks.register_revisions(docs.where(~early), registry, "source", "sha", "doc_id", block_slice("doc_id"))
    return new.select("source", "sha", "revision_number", "artifact_id")


@query(
    "sk6_failure_rows",
    "SELECT 'run-1' AS search_run_id, doc_id AS query_id, source, 0 AS result_count, 'failed' AS status, substr(text, 1, 2000) AS error FROM documents",
)
def sk6_failure_rows(spark, sf):
    attempts = table(spark, sf, "documents").select(
        F.lit("run-1").alias("search_run_id"), F.col("doc_id").alias("query_id"), "source", F.col("text").alias("error")
    )
    return sinks.failure_rows(attempts)


STREAM_SQL = """
    o AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS sequence, o_orderkey % 3 = 0 AS asks,
      round(o_totalprice)::BIGINT AS cost, o_orderkey % 100 AS tokens, o_orderkey % 4 AS retries, sha256(o_orderkey::VARCHAR) AS sha FROM orders),
    w AS (SELECT *, coalesce(sum(CASE WHEN asks THEN 0 ELSE cost END) OVER s, 0)::BIGINT AS c, coalesce(sum(CASE WHEN asks THEN 0 ELSE tokens END) OVER s, 0)::BIGINT AS t,
      coalesce(sum(CASE WHEN asks THEN 0 ELSE retries END) OVER s, 0)::BIGINT AS r FROM o WINDOW s AS (PARTITION BY run ORDER BY sequence)),
    x AS (SELECT *, CASE WHEN c + CASE WHEN asks THEN cost ELSE 0 END > 1000000 + 1000 * (run % 7) THEN 'paid_cost;' ELSE '' END AS over_cost,
      CASE WHEN t + CASE WHEN asks THEN tokens ELSE 0 END > 300 THEN 'api_total_tokens;' ELSE '' END AS over_tokens,
      CASE WHEN r + CASE WHEN asks THEN retries ELSE 0 END > 12 THEN 'provider_retries;' ELSE '' END AS over_retries FROM w),
    v AS (SELECT run, sequence, c AS paid_cost, t AS api_total_tokens, r AS provider_retries, over_tokens || over_cost || over_retries AS exceeded, sha AS last_event_sha256, asks FROM x)
"""


def budget_log(spark, sf):
    """The customers' orders as budget events with three counters and limits per run."""
    orders = table(spark, sf, "orders")
    placed = ordered_position(
        orders.withColumnRenamed("o_custkey", "run"), ["run"], ["o_orderdate", "o_orderkey"],
        F.trunc("o_orderdate", "month"), "place",
    )
    key, asks = F.col("o_orderkey"), F.col("o_orderkey") % 3 == 0
    amounts = F.create_map(
        F.lit("paid_cost"), F.round("o_totalprice"),
        F.lit("api_total_tokens"), (key % 100).cast("double"),
        F.lit("provider_retries"), (key % 4).cast("double"),
    )
    limits = F.create_map(
        F.lit("paid_cost"), (1_000_000 + 1000 * (F.col("run") % 7)).cast("double"),
        F.lit("api_total_tokens"), F.lit(300.0),
        F.lit("provider_retries"), F.lit(12.0),
    )
    return placed.select(
        "run",
        (F.col("place") - 1).alias("sequence"),
        F.when(asks, "precheck").otherwise("usage").alias("event_type"),
        F.when(~asks, amounts).alias("used"),
        F.when(asks, amounts).alias("requested"),
        F.when(F.col("place") == 1, limits).alias("limits"),
        F.sha2(key.cast("string"), 256).alias("event_sha256"),
    )


def accounted(spark, log):
    base = shared_dir(spark, "stream")
    log.repartition(16, F.xxhash64("run", "sequence")).write.json(f"{base}/log")
    return budget_stream.account_files(
        spark, f"{base}/log", f"{base}/verdicts", f"{base}/progress", files_per_batch=8
    )


@query(
    "st1_budget_stream",
    f"""
    WITH {STREAM_SQL}
    SELECT run, sequence, CASE WHEN asks AND exceeded <> '' THEN 'precheck_rejected' WHEN asks THEN 'precheck_passed' WHEN exceeded <> '' THEN 'post_account_exceeded' ELSE 'usage_recorded' END AS verdict,
      exceeded, paid_cost, api_total_tokens, provider_retries, last_event_sha256 FROM v
    """,
)
def st1_budget_stream(spark, sf):
    """The customers' budget log as a stream of files in arbitrary row order."""
    total = {c: F.get("totals", F.lit(COUNTERS.index(c))).cast("long").alias(c)
             for c in ("paid_cost", "api_total_tokens", "provider_retries")}
    names = F.transform("exceeded", lambda c: F.concat(c, F.lit(";")))
    return accounted(spark, budget_log(spark, sf)).select(
        "run", "sequence", "verdict", F.array_join(names, "").alias("exceeded"),
        *total.values(), "last_event_sha256",
    )


@query(
    "st1_fractional_limits",
    """
    WITH o AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS sequence, o_totalprice::DECIMAL(38, 12) AS cost FROM orders),
    t AS (SELECT *, sum(cost) OVER (PARTITION BY run ORDER BY sequence) AS total FROM o),
    l AS (SELECT run, max(total) FILTER (sequence <= 4) AS cap FROM t GROUP BY 1)
    SELECT run, sequence, (total * 100)::BIGINT AS paid_cents, CASE WHEN total > cap THEN 'post_account_exceeded' ELSE 'usage_recorded' END AS verdict FROM t JOIN l USING (run)
    """,
)
def st1_fractional_limits(spark, sf):
    """Each run's limit is what its first five events cost to the cent: the fifth reaches
    it and does not pass it, whatever the order of the files."""
    log = budget_log(spark, sf)
    cost = F.col("o_totalprice").cast("decimal(38,12)")
    prices = table(spark, sf, "orders").select(
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("event_sha256"), cost.alias("cost")
    )
    priced = log.join(prices, "event_sha256")
    caps = priced.where("sequence <= 4").groupBy("run").agg(F.sum("cost").cast("double").alias("cap"))
    events = priced.join(caps, "run").select(
        "run", "sequence", F.lit("usage").alias("event_type"),
        F.create_map(F.lit("paid_cost"), F.col("cost").cast("double")).alias("used"),
        F.lit(None).cast("map<string,double>").alias("requested"),
        F.when(F.col("sequence") == 0, F.create_map(F.lit("paid_cost"), F.col("cap"))).alias("limits"),
        "event_sha256",
    )
    cents = F.round(F.get("totals", F.lit(COUNTERS.index("paid_cost"))) * 100).cast("long")
    return accounted(spark, events).select("run", "sequence", cents.alias("paid_cents"), "verdict")


@query(
    "st1_faults",
    """
    WITH o AS (SELECT o_custkey AS run, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS sequence FROM orders),
    g AS (SELECT run, min(sequence) AS gap FROM o WHERE o_orderkey % 61 = 0 AND o_orderkey % 53 <> 0 GROUP BY 1)
    SELECT run, sequence, 'sequence_repeated' AS verdict FROM o WHERE o_orderkey % 53 = 0
    UNION ALL SELECT run, sequence, 'sequence_gap' FROM o JOIN g USING (run) WHERE sequence > gap AND (o_orderkey % 61 <> 0 OR o_orderkey % 53 = 0)
    """,
)
def st1_faults(spark, sf):
    """Two planted faults: some events are logged twice with other amounts, so each second
    line is a fault, and some are lost, so all later events of their run wait for ever."""
    log = budget_log(spark, sf)
    twice, lost = F.col("o_orderkey") % 53 == 0, F.col("o_orderkey") % 61 == 0
    orders = table(spark, sf, "orders").select(
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("event_sha256"),
        twice.alias("twice"), (lost & ~twice).alias("lost"),
    )
    marked = log.join(orders, "event_sha256")
    kept = marked.where("not lost").select(*log.columns)
    spoilt = marked.where("twice").select(*log.columns).withColumns({
        "used": F.create_map(F.lit("paid_cost"), F.lit(7.0)),
        "event_sha256": F.concat(F.lit("x"), "event_sha256"),
    })
    found = accounted(spark, kept.unionByName(spoilt))
    return found.where("verdict in ('sequence_repeated', 'sequence_gap')").select(
        "run", "sequence", "verdict"
    )
