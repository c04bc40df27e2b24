"""Collection aggregates and content digests (AG1-AG10, AG29-AG34)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.functions import hashing, text
from trialweave.operators import inventory, logs
from trialweave.plans.registry import query, table

# The order lines as recording events: supplier, year, order and return flag stand
# for subject, session, run and label; a tax of zero leaves the label blank.
EVENTS_SQL = """
    e AS (SELECT l_suppkey AS subject, year(l_shipdate) AS session, l_orderkey AS run, l_linenumber AS at, CASE WHEN l_tax = 0 THEN '' ELSE l_returnflag END AS label,
      l_linestatus AS code, l_quantity AS duration, round(l_extendedprice * 100)::BIGINT AS bytes FROM lineitem)
"""
RUNS_SQL = f"""
    {EVENTS_SQL}, r AS (SELECT subject, session, run, count(*) AS trials, sum(bytes)::BIGINT AS bytes FROM e GROUP BY ALL)
"""


def recording_events(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("subject"),
        F.year("l_shipdate").alias("session"),
        F.col("l_orderkey").alias("run"),
        F.col("l_linenumber").alias("at"),
        F.when(F.col("l_tax") == 0, "").otherwise(F.col("l_returnflag")).alias("label"),
        F.col("l_linestatus").alias("code"),
        F.col("l_quantity").alias("duration"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("bytes"),
    )


def recording_runs(spark, sf):
    return recording_events(spark, sf).groupBy("subject", "session", "run").agg(
        F.count(F.lit(1)).alias("trials"), F.sum("bytes").alias("bytes")
    )


@query(
    "ag1_event_counts",
    f"WITH {EVENTS_SQL} SELECT label, count(*)::BIGINT AS events, count(DISTINCT code)::BIGINT AS codes, label <> '' AS listed FROM e GROUP BY label",
)
def ag1_event_counts(spark, sf):
    return inventory.event_counts(recording_events(spark, sf), "label", "code")


@query(
    "ag1_label_values",
    f"WITH {EVENTS_SQL} SELECT DISTINCT subject, label, code FROM e WHERE label <> ''",
)
def ag1_label_values(spark, sf):
    return inventory.label_values(recording_events(spark, sf), "label", "code", ["subject"])


@query("ag1_durations", f"WITH {EVENTS_SQL} SELECT DISTINCT duration FROM e")
def ag1_durations(spark, sf):
    return inventory.distinct_durations(recording_events(spark, sf), "duration")


@query(
    "ag2_session_summary",
    f"""
    WITH {EVENTS_SQL}, s AS (SELECT subject, count(DISTINCT session) AS n FROM e GROUP BY 1)
    SELECT count(*)::BIGINT AS subjects, sum(n)::BIGINT AS subject_sessions, min(n)::BIGINT AS fewest_sessions, max(n)::BIGINT AS most_sessions, max(n) > 1 AS longitudinal FROM s
    """,
)
def ag2_session_summary(spark, sf):
    return inventory.session_summary(recording_events(spark, sf), "subject", "session")


@query(
    "ag3_field_agreement",
    """
    WITH c AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS a, count(DISTINCT o_orderpriority) AS b, count(DISTINCT year(o_orderdate)) AS c, bool_or(year(o_orderdate) = 2000) AS n0, bool_or(year(o_orderdate) <> 2000) AS n1 FROM orders GROUP BY 1)
    SELECT o_custkey, 'reference' AS field FROM c WHERE a > 1 UNION ALL SELECT o_custkey, 'manufacturer' FROM c WHERE b > 1
    UNION ALL SELECT o_custkey, 'power_line' FROM c WHERE c > 1
    """,
)
def ag3_field_agreement(spark, sf):
    from trialweave.operators.checks import disagreements

    files = table(spark, sf, "orders").select(
        "o_custkey",
        F.col("o_orderstatus").alias("reference"),
        F.col("o_orderpriority").alias("manufacturer"),
        F.when(F.year("o_orderdate") != 2000, F.year("o_orderdate")).alias("power_line"),
        F.lit("EEG").alias("task"),
    )
    return disagreements(files, ["o_custkey"], ["reference", "manufacturer", "power_line", "task"])


SIGNATURE_SQL = f"""
    c AS (SELECT l_orderkey AS file, sha256({hashing.canonical_sql('l_linenumber', 'l_returnflag', 'l_linestatus')}) AS h FROM lineitem),
    s AS (SELECT file, count(*) AS n, {hashing.set_digest_sql('h')} AS signature FROM c GROUP BY 1)
"""


@query(
    "ag4_channel_signatures",
    f"WITH {SIGNATURE_SQL} SELECT signature, count(*)::BIGINT AS files, min(n)::BIGINT AS channels FROM s GROUP BY 1",
)
def ag4_channel_signatures(spark, sf):
    signatures = inventory.channel_signatures(
        table(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber", "l_returnflag", "l_linestatus"]
    )
    return inventory.signature_agreement(signatures)


@query(
    "ag5_status_counts",
    "SELECT coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END, 'unknown') AS status, count(*)::BIGINT AS channels FROM orders GROUP BY 1",
)
def ag5_status_counts(spark, sf):
    status = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus"))
    return inventory.status_counts(table(spark, sf, "orders").select(status.alias("status")), "status")


@query(
    "ag6_runs_per_session",
    f"""
    WITH {EVENTS_SQL}, n AS (SELECT subject, session, count(DISTINCT run) AS n FROM e GROUP BY 1, 2)
    SELECT session, max(n)::BIGINT AS runs, min(n)::BIGINT AS fewest_runs, min(n) = max(n) AS agrees FROM n GROUP BY 1
    """,
)
def ag6_runs_per_session(spark, sf):
    return inventory.runs_per_session(recording_events(spark, sf), "subject", "session", "run")


@query(
    "ag7_volume",
    f"WITH {RUNS_SQL} SELECT count(DISTINCT subject)::BIGINT AS subjects, count(DISTINCT (subject, session))::BIGINT AS subject_sessions, count(*)::BIGINT AS runs, sum(trials)::BIGINT AS trials, sum(bytes)::BIGINT AS signal_bytes FROM r",
)
def ag7_volume(spark, sf):
    return inventory.volume(recording_runs(spark, sf), "subject", "session", "trials", "bytes")


@query(
    "ag8_nominal_trials",
    """
    WITH t AS (SELECT l_suppkey AS subject, l_linenumber AS trials, count(*) AS n, min(l_orderkey) AS f FROM lineitem GROUP BY 1, 2)
    SELECT subject, arg_max(trials, (n, -f, trials)) AS nominal FROM t GROUP BY 1
    """,
)
def ag8_nominal_trials(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "subject")
    return inventory.first_seen_mode(lines, "l_linenumber", "l_orderkey", ["subject"])


ORDER_RUNS_SQL = """
    r AS (SELECT l_orderkey AS run, count(*) AS trials FROM lineitem GROUP BY 1),
    m AS (SELECT trials FROM r GROUP BY 1 ORDER BY count(*) DESC, min(run) LIMIT 1)
"""


@query(
    "ag9_trial_anomalies",
    f"WITH {ORDER_RUNS_SQL} SELECT run, r.trials, m.trials AS nominal_trials, r.trials - m.trials AS difference, greatest(0, m.trials - r.trials) AS missing_trials FROM r, m WHERE r.trials <> m.trials",
)
def ag9_trial_anomalies(spark, sf):
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.count(F.lit(1)).alias("trials"))
    return inventory.trial_anomalies(runs, "trials", "run")


@query(
    "ag10_run_quality",
    """
    WITH r AS (SELECT l_orderkey, bool_and(l_discount > 0) AS f, count_if(l_tax = 0) AS flat, count_if(l_quantity = 50) AS c FROM lineitem GROUP BY 1)
    SELECT count_if(f AND flat = 0 AND c = 0)::BIGINT AS valid_runs, count_if(NOT (f AND flat = 0 AND c = 0))::BIGINT AS invalid_runs, count_if(NOT f)::BIGINT AS nonfinite_runs,
      count_if(flat > 0)::BIGINT AS flat_channel_runs, count_if(c > 0)::BIGINT AS identity_conflicts FROM r
    """,
)
def ag10_run_quality(spark, sf):
    runs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.bool_and(F.col("l_discount") > 0).alias("all_finite"),
        F.count_if(F.col("l_tax") == 0).alias("flat_channel_count"),
        F.count_if(F.col("l_quantity") == 50).alias("identity_conflict_count"),
    )
    valid = F.col("all_finite") & (F.col("flat_channel_count") == 0) & (F.col("identity_conflict_count") == 0)
    return inventory.run_quality(runs.withColumn("valid", valid))


@query(
    "ag29_budget_snapshot",
    """
    WITH e AS (SELECT o_custkey AS run, o_orderkey AS seq, round(o_totalprice)::DOUBLE AS cost FROM orders),
    l AS (SELECT c_custkey AS run, unnest(['paid_cost', 'api_total_tokens', 'provider_retries']) AS field, unnest([1000000.0::DOUBLE, 40.0, 5.0]) AS lim FROM customer),
    u AS (SELECT run, 'paid_cost' AS field, sum(cost) AS total FROM e GROUP BY 1 UNION ALL SELECT run, 'api_total_tokens', count(*)::DOUBLE FROM e GROUP BY 1),
    h AS (SELECT run, count(*) AS n, arg_max(sha256(seq::VARCHAR), seq) AS last FROM e GROUP BY 1)
    SELECT l.run, l.field, lim AS "limit", coalesce(total, 0) AS total, lim - coalesce(total, 0) AS remaining, n AS event_count, last AS last_event_sha256
    FROM l LEFT JOIN u USING (run, field) LEFT JOIN h ON h.run = l.run
    """,
)
def ag29_budget_snapshot(spark, sf):
    events = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run"),
        F.col("o_orderkey").alias("sequence"),
        F.create_map(
            F.lit("paid_cost"), F.round("o_totalprice"), F.lit("api_total_tokens"), F.lit(1.0)
        ).alias("delta"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("event_sha256"),
    )
    caps = F.array(
        *[F.struct(F.lit(f).alias("field"), F.lit(v).alias("limit")) for f, v in (("paid_cost", 1000000.0), ("api_total_tokens", 40.0), ("provider_retries", 5.0))]
    )
    limits = table(spark, sf, "customer").select(F.col("c_custkey").alias("run"), F.inline(caps))
    return logs.budget_snapshot(events, limits, "run", "sequence", "delta")


PRICES = {"prompt": 3.0, "cached": 0.5, "completion": 15.0}


@query(
    "ag30_token_cost",
    """
    WITH m AS (SELECT conv_id, role, greatest(1, (octet_length(encode(text)) + 2) // 3)::BIGINT AS est, length(text) AS chars FROM conversations),
    u AS (SELECT conv_id, sum(CASE WHEN role <> 'assistant' THEN est ELSE 0 END)::BIGINT AS prompt, sum(CASE WHEN role = 'assistant' THEN est ELSE 0 END)::BIGINT AS completion, max(est) * 2 AS cached FROM m GROUP BY 1)
    SELECT conv_id, prompt, completion, ((prompt - least(cached, prompt)) * 3.0::DOUBLE + least(cached, prompt) * 0.5::DOUBLE + completion * 15.0::DOUBLE) / 1000000.0::DOUBLE AS cost FROM u
    """,
)
def ag30_token_cost(spark, sf):
    size = text.prompt_size_estimate(F.col("text"))
    spoken = F.col("role") == "assistant"
    usage = (
        table(spark, sf, "conversations")
        .select("conv_id", spoken.alias("spoken"), size.alias("est"))
        .groupBy("conv_id")
        .agg(
            F.sum(F.when(~F.col("spoken"), F.col("est")).otherwise(0)).alias("prompt"),
            F.sum(F.when(F.col("spoken"), F.col("est")).otherwise(0)).alias("completion"),
            (F.max("est") * 2).alias("cached"),
        )
    )
    cost = logs.token_cost(F.col("prompt"), F.col("completion"), F.col("cached"), PRICES)
    return usage.select("conv_id", "prompt", "completion", cost.alias("cost"))


@query(
    "ag31_distinct_configurations",
    f"SELECT p_brand, count(*)::BIGINT AS tried, count(DISTINCT sha256({hashing.canonical_sql('p_type', 'p_size')}))::BIGINT AS distinct_configurations FROM part GROUP BY 1",
)
def ag31_distinct_configurations(spark, sf):
    digest = hashing.content_hash([F.col("p_type"), F.col("p_size")])
    return (
        table(spark, sf, "part")
        .groupBy("p_brand")
        .agg(F.count(F.lit(1)).alias("tried"), F.countDistinct(digest).alias("distinct_configurations"))
    )


def digest_rows(df, keys, item):
    """Distinct non-blank items per key with their order-free digest."""
    items = df.select(*keys, F.trim(item).alias("item")).where(F.col("item") != "").distinct()
    return hashing.set_digest(items.withColumn("h", F.sha2("item", 256)), keys, "h", "digest")


@query(
    "ag32_unit_catalogue",
    f"""
    WITH i AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS item FROM events), h AS (SELECT user_id, sha256(item) AS h FROM i)
    SELECT user_id, count(*)::BIGINT AS item_count, {hashing.set_digest_sql('h')} AS digest FROM h GROUP BY 1
    """,
)
def ag32_unit_catalogue(spark, sf):
    day = F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd"))
    return digest_rows(table(spark, sf, "events"), ["user_id"], day)


@query(
    "ag33_candidate_universe",
    f"""
    WITH i AS (SELECT DISTINCT l_suppkey, l_returnflag || '/' || l_partkey AS item FROM lineitem), h AS (SELECT l_suppkey, sha256(item) AS h FROM i)
    SELECT l_suppkey, count(*)::BIGINT AS item_count, {hashing.set_digest_sql('h')} AS digest FROM h GROUP BY 1
    """,
)
def ag33_candidate_universe(spark, sf):
    pair = F.concat_ws("/", "l_returnflag", F.col("l_partkey").cast("string"))
    return digest_rows(table(spark, sf, "lineitem"), ["l_suppkey"], pair)


@query(
    "ag34_direction_hash",
    f"""
    WITH h AS (SELECT doc_id % 10 AS review, sha256({hashing.canonical_sql('lang', 'source', "array_to_string(list_sort(list_distinct(string_split(text, ' '))), ' ')")}) AS h FROM documents)
    SELECT review, count(*)::BIGINT AS item_count, {hashing.set_digest_sql('h')} AS semantic_sha256 FROM h GROUP BY 1
    """,
)
def ag34_direction_hash(spark, sf):
    words = F.array_sort(F.array_distinct(F.split("text", " ")))
    item = hashing.content_hash([F.col("lang"), F.col("source"), F.array_join(words, " ")])
    rows = table(spark, sf, "documents").select((F.col("doc_id") % 10).alias("review"), item.alias("h"))
    return hashing.set_digest(rows, ["review"], "h", "semantic_sha256")
