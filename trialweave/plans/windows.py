"""Ordered scans over logs, replays and revisions (WN3-WN15, AG25, AG26, GJ8, GJ9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialweave.functions.hashing import canonical_sql
from trialweave.operators import logs, search
from trialweave.operators.ordered import block_slice, day_slice
from trialweave.plans.registry import query, table
from trialweave.session import materialise

TOLERANCE, MIN_CYCLES, MAX_CYCLES, STOP = 0.02, 2, 4, 0.75

SCORES_SQL = """
    s AS (SELECT user_id AS subject, event_type || '-' || event_id % 8 AS candidate, value / 500.0 AS score, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle FROM events)
"""
REPLAY_SQL = f"""
    {SCORES_SQL}, b AS (SELECT subject, max(score) AS best FROM s GROUP BY 1),
    r AS (SELECT s.*, best, max(score) OVER (PARTITION BY subject ORDER BY cycle) AS running FROM s JOIN b USING (subject)),
    k AS (SELECT subject, min(CASE WHEN cycle >= {MIN_CYCLES} AND (running >= {STOP} OR cycle >= {MAX_CYCLES}) THEN cycle END) AS stopped FROM r GROUP BY 1),
    v AS (SELECT subject, arg_max(candidate, (score, -cycle)) AS locked_candidate, max(score) AS locked_score, coalesce(max(stopped), {MAX_CYCLES})::INTEGER AS locked_cycle, max(best) AS best_possible,
      min(CASE WHEN best - running <= {TOLERANCE} THEN cycle END)::INTEGER AS cycles_to_near_best FROM r JOIN k USING (subject) WHERE cycle <= coalesce(stopped, {MAX_CYCLES}) GROUP BY subject),
    replay AS (SELECT *, best_possible - locked_score AS gap_at_lock, best_possible - locked_score <= {TOLERANCE} AS near_best_at_lock FROM v)
"""


def search_scores(spark, sf):
    """Scores of each user's events in time order."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("subject"),
        F.concat_ws("-", "event_type", (F.col("event_id") % 8).cast("string")).alias("candidate"),
        (F.col("value") / 500.0).alias("score"),
        F.struct("ts", "event_id").alias("cycle"),
        "event_id",
    )


def replays(spark, sf):
    return search.replay(
        search_scores(spark, sf), ["subject"], "cycle", "candidate", "score", TOLERANCE, MIN_CYCLES, MAX_CYCLES, STOP
    )


@query("wn3_search_replay", f"WITH {REPLAY_SQL} SELECT * FROM replay")
def wn3_search_replay(spark, sf):
    return replays(spark, sf)


@query(
    "ag25_strategy_summary",
    f"""
    WITH {REPLAY_SQL} SELECT 'guided' AS strategy, count(*)::BIGINT AS subjects, round(avg(locked_cycle), 9) AS mean_locked_cycle, round(avg(coalesce(cycles_to_near_best, 9)), 9) AS mean_cycles_to_near_best,
      round(avg(near_best_at_lock::INT), 9) AS near_best_rate, round(avg(gap_at_lock), 9) AS mean_gap_at_lock, count(DISTINCT locked_candidate)::BIGINT AS distinct_locks FROM replay
    """,
)
def ag25_strategy_summary(spark, sf):
    summary = search.strategy_summary(replays(spark, sf).withColumn("strategy", F.lit("guided")), ["strategy"], 8)
    means = ("mean_locked_cycle", "mean_cycles_to_near_best", "near_best_rate", "mean_gap_at_lock")
    return summary.withColumns({c: F.round(c, 9) for c in means})


@query(
    "ag25_lock_histogram",
    f"WITH {REPLAY_SQL} SELECT locked_candidate, count(*)::BIGINT AS subjects FROM replay GROUP BY 1",
)
def ag25_lock_histogram(spark, sf):
    return search.lock_histogram(replays(spark, sf), [])


CANDIDATE_SQL = "c AS (SELECT user_id AS subject, event_type AS candidate, avg(value) / 500.0 AS score, min(event_id) AS first FROM events GROUP BY 1, 2)"


def candidate_scores(spark, sf):
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("subject"), F.col("event_type").alias("candidate"))
        .agg((F.avg("value") / 500.0).alias("score"), F.min("event_id").alias("first"))
    )


@query(
    "ag26_best_on_average",
    f"""
    WITH {CANDIDATE_SQL}, m AS (SELECT candidate, avg(score) AS m, min(first) AS f FROM c GROUP BY 1), w AS (SELECT candidate, m FROM m ORDER BY m DESC, f LIMIT 1), o AS (SELECT subject, max(score) AS own FROM c GROUP BY 1)
    SELECT candidate, round(max(m), 9) AS mean_score, round(avg(own - score), 9) AS mean_gap FROM c JOIN w USING (candidate) JOIN o USING (subject) GROUP BY 1
    """,
)
def ag26_best_on_average(spark, sf):
    best = search.best_on_average(candidate_scores(spark, sf), "subject", "candidate", "score", "first")
    return best.select("candidate", F.round("mean_score", 9).alias("mean_score"), F.round("mean_gap", 9).alias("mean_gap"))


@query(
    "tk4_arg_max",
    f"WITH {CANDIDATE_SQL} SELECT subject, arg_max(candidate, (score, -first)) AS best_candidate, round(max(score), 9) AS best_score FROM c GROUP BY 1",
)
def tk4_arg_max(spark, sf):
    best = search.arg_max(candidate_scores(spark, sf), ["subject"], "candidate", "score", "first")
    return best.withColumn("best_score", F.round("best_score", 9))


TRACE_SQL = """
    a AS (SELECT o_custkey AS subject, o_orderkey AS pos, o_orderpriority || o_orderstatus AS configuration, o_totalprice / 600000.0 AS score FROM orders),
    f AS (SELECT *, row_number() OVER (PARTITION BY subject, configuration ORDER BY pos) AS dup FROM a),
    n AS (SELECT *, CASE WHEN dup = 1 THEN row_number() OVER (PARTITION BY subject, dup = 1 ORDER BY pos) END AS cyc FROM f),
    t AS (SELECT *, max(CASE WHEN cyc <= 5 THEN pos END) OVER (PARTITION BY subject) AS last5, max(cyc) OVER (PARTITION BY subject) AS cmax FROM n),
    trace AS (SELECT subject, pos, configuration, score, CASE WHEN cyc <= 5 THEN cyc END::INTEGER AS research_cycle,
      CASE WHEN cyc <= 5 THEN 'admitted' WHEN cmax >= 5 AND pos > last5 THEN 'budget_exhausted' ELSE 'duplicate_configuration' END AS verdict FROM t)
"""


def trace(spark, sf):
    attempts = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject"),
        F.col("o_orderkey").alias("pos"),
        F.concat("o_orderpriority", "o_orderstatus").alias("configuration"),
        (F.col("o_totalprice") / 600000.0).alias("score"),
    )
    return search.admitted_trace(attempts, ["subject"], "pos", "configuration", 5)


@query("gj8_search_trace", f"WITH {TRACE_SQL} SELECT subject, pos, research_cycle, verdict FROM trace")
def gj8_search_trace(spark, sf):
    return trace(spark, sf).select("subject", "pos", "research_cycle", "verdict")


@query(
    "gj9_search_lock",
    f"""
    WITH {TRACE_SQL}, d AS (SELECT * FROM trace WHERE verdict = 'admitted'),
    l AS (SELECT subject, count(DISTINCT configuration) AS n, max(score) AS best, max(CASE WHEN pos % 3 <> 0 THEN score END) AS sel, arg_max(pos, (score, -research_cycle)) FILTER (pos % 3 <> 0 AND score IS NOT NULL) AS ex, count(*) AS c FROM d GROUP BY 1)
    SELECT subject, n::BIGINT AS distinct_candidates, round(best, 9) AS observed_best_score, round(sel, 9) AS selected_score, CASE WHEN sel IS NOT NULL THEN ex END AS selected_experiment, c::BIGINT AS research_cycles, round(best - sel, 9) AS gap_to_best, best - sel <= 0.02 AS within_tolerance,
      CASE WHEN n < 2 THEN 'too_few_candidates' WHEN sel IS NULL THEN 'selection_not_in_trace' ELSE 'locked_awaiting_confirmation' END AS status FROM l
    """,
)
def gj9_search_lock(spark, sf):
    admitted = (
        trace(spark, sf)
        .where("verdict = 'admitted'")
        .withColumnRenamed("pos", "experiment_id")
        .withColumn("chosen", F.col("experiment_id") % 3 != 0)
    )
    locks = search.lock_best(admitted, ["subject"], "chosen")
    return locks.withColumns(
        {c: F.round(c, 9) for c in ("observed_best_score", "selected_score", "gap_to_best")}
    )


# A log per customer: orders by date and key, chained by hash.  Some rows are spoilt.
LOG_SQL = """
    o AS (SELECT o_custkey AS run, o_orderkey, o_orderdate, round(o_totalprice)::BIGINT AS delta, o_totalprice AS cost, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS sequence FROM orders),
    h AS (SELECT *, sha256(run || ':' || sequence) AS good FROM o),
    p AS (SELECT *, lag(good) OVER (PARTITION BY run ORDER BY sequence) AS prev FROM h)
"""


def customer_log(spark, sf):
    from trialweave.operators.ordered import POSITION, ordered_scan, previous

    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run"),
        "o_orderkey",
        "o_orderdate",
        F.round("o_totalprice").cast("long").alias("delta"),
        F.col("o_totalprice").alias("cost"),
    )
    month = F.trunc("o_orderdate", "month")
    placed = ordered_scan(orders, ["run"], ["o_orderdate", "o_orderkey"], month, {"p": POSITION})
    # The log the operators below read; it stands for a stored table.
    return materialise(placed.withColumn("sequence", F.col("p") - 1).drop("p"), "customer-log")


@query(
    "wn4_chain_faults",
    f"""
    WITH {LOG_SQL}, e AS (SELECT run, sequence, CASE WHEN sequence = 0 AND run % 50 = 0 THEN 'usage' WHEN sequence = 0 THEN 'ledger_opened' ELSE 'usage' END AS event_type,
      CASE WHEN o_orderkey % 97 = 0 AND sequence > 0 THEN 'broken' ELSE prev END AS previous, good, CASE WHEN o_orderkey % 89 = 0 THEN delta + 1 ELSE delta END AS delta, delta AS d0 FROM p),
    x AS (SELECT run, sequence, event_type, previous, CASE WHEN d0 = delta THEN sha256({canonical_sql('run', 'sequence', 'event_type', 'previous', 'delta')}) ELSE sha256({canonical_sql('run', 'sequence', 'event_type', 'previous', 'd0')}) END AS own,
      sha256({canonical_sql('run', 'sequence', 'event_type', 'previous', 'delta')}) AS re FROM e),
    c AS (SELECT *, lag(own) OVER (PARTITION BY run ORDER BY sequence) AS before FROM x)
    SELECT run, sequence, 'own_hash_recomputes' AS rule_id FROM c WHERE own <> re
    UNION ALL SELECT run, sequence, 'previous_hash_matches' FROM c WHERE previous IS DISTINCT FROM before
    UNION ALL SELECT run, sequence, 'first_event_opens' FROM c WHERE sequence = 0 AND event_type <> 'ledger_opened'
    """,
)
def wn4_chain_faults(spark, sf):
    from trialweave.functions.hashing import content_hash
    from trialweave.operators.ordered import ordered_scan, previous

    log = customer_log(spark, sf).withColumn("good", F.sha2(F.concat_ws(":", "run", "sequence"), 256))
    log = ordered_scan(log, ["run"], ["sequence"], block_slice("sequence", 1000), {"prev": previous("good")})
    opened = F.when((F.col("sequence") == 0) & (F.col("run") % 50 != 0), "ledger_opened").otherwise("usage")
    previous_hash = F.when((F.col("o_orderkey") % 97 == 0) & (F.col("sequence") > 0), "broken").otherwise(F.col("prev"))
    hashed = ["run", "sequence", "event_type", "previous_event_sha256", "delta"]
    events = (
        log.withColumn("event_type", opened)
        .withColumn("previous_event_sha256", previous_hash)
        .withColumn("event_sha256", content_hash([F.col(c) for c in hashed]))
        .withColumn("delta", F.col("delta") + F.when(F.col("o_orderkey") % 89 == 0, 1).otherwise(0))
    )
    log = materialise(events, "chained-log")
    return logs.chain_faults(log, "run", "sequence", block_slice("sequence", 1000), hashed)


@query(
    "wn4_opening_binding",
    f"""
    WITH {LOG_SQL}
    SELECT run, sequence, 'event_names_its_run' AS rule_id FROM p WHERE o_orderkey % 83 = 0
    UNION ALL SELECT run, 0, 'authority_matches' FROM p WHERE sequence = 0 AND (run % 9 = 4 OR run % 31 = 7)
    UNION ALL SELECT run, 0, 'limits_match' FROM p WHERE sequence = 0 AND (run % 10 = 3 OR run % 31 = 7)
    """,
)
def wn4_opening_binding(spark, sf):
    """Logs opened under another authority or other limits, and events of another run."""
    run, first = F.col("run"), F.col("sequence") == 0

    def limits(cost):
        return F.create_map(F.lit("paid_cost"), cost, F.lit("api_total_tokens"), F.lit(9.0))

    events = customer_log(spark, sf).select(
        "run",
        "sequence",
        F.when(F.col("o_orderkey") % 83 == 0, run + 1).otherwise(run).alias("event_run"),
        F.when(first, F.sha2(F.when(run % 9 == 4, "other").otherwise(run.cast("string")), 256)).alias("authority_sha256"),
        F.when(first, limits(F.when(run % 10 == 3, 6.0).otherwise(5.0))).alias("limits"),
    )
    authorities = (
        table(spark, sf, "customer")
        .select(F.col("c_custkey").alias("run"))
        .where(run % 31 != 7)
        .select("run", F.sha2(run.cast("string"), 256).alias("authority_sha256"), limits(F.lit(5.0)).alias("limits"))
    )
    return logs.binding_faults(events, authorities, "run", "sequence")


TOTAL_SQL = f"""
    {LOG_SQL}, t AS (SELECT run, sequence, o_orderkey, c_mktsegment AS seg, sum(cost::DECIMAL(38, 12)) OVER (PARTITION BY run ORDER BY sequence) AS total FROM p JOIN customer ON c_custkey = run)
"""


def log_totals(spark, sf):
    """Running cost per customer with the limit of its market segment."""
    log = customer_log(spark, sf).join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("run"), "c_mktsegment"), "run"
    )
    totals = logs.running_totals(log, "run", ["sequence"], block_slice("sequence", 1000), ["cost"])
    limit = F.when(F.col("c_mktsegment") == "BUILDING", 1_000_000).when(F.col("c_mktsegment") == "MACHINERY", 3_000_000)
    return totals.withColumn("limit", limit)


@query(
    "wn5_running_totals",
    f"""
    WITH {TOTAL_SQL}
    SELECT run, sequence, 'total_cost_recorded' AS rule_id FROM t WHERE o_orderkey % 71 = 0
    UNION ALL SELECT run, sequence, 'total_cost_within_limit' FROM t WHERE (seg = 'BUILDING' AND total > 1000000) OR (seg = 'MACHINERY' AND total > 3000000)
    """,
)
def wn5_running_totals(spark, sf):
    """Fractional amounts; the recorder adds doubles one by one, with planted slips."""
    by_double = Window.partitionBy("run").orderBy("sequence")
    slip = F.when(F.col("o_orderkey") % 71 == 0, 0.5).otherwise(0.0)
    totals = log_totals(spark, sf).withColumn("recorded", F.sum("cost").over(by_double) + slip)
    return logs.total_faults(totals, "run", "sequence", {"total_cost": "recorded"}, {"total_cost": "limit"})


VERDICT_SQL = f"""
    {LOG_SQL}, q AS (SELECT run, sequence, CASE WHEN o_orderkey % 3 = 0 THEN 'precheck' ELSE 'usage' END AS event_type, delta FROM p),
    w AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'usage' THEN delta ELSE 0 END) OVER (PARTITION BY run ORDER BY sequence), 0)::BIGINT AS total FROM q)
    SELECT run, sequence, total, CASE WHEN event_type = 'precheck' AND total + delta > 1000000 THEN 'precheck_rejected' WHEN event_type = 'precheck' THEN 'precheck_passed' WHEN total > 1000000 THEN 'post_account_exceeded' ELSE 'usage_recorded' END AS verdict FROM w
"""


def budget_operations(spark, sf):
    """Budget log: every third order asks first, the others record usage."""
    asks = F.col("o_orderkey") % 3 == 0
    return customer_log(spark, sf).select(
        "run",
        "sequence",
        F.when(asks, "precheck").otherwise("usage").alias("event_type"),
        F.when(asks, 0).otherwise(F.col("delta")).alias("used"),
        F.when(asks, F.col("delta")).otherwise(0).alias("requested"),
    )


@query("wn5_budget_verdicts", f"WITH {VERDICT_SQL}")
def wn5_budget_verdicts(spark, sf):
    totals = logs.running_totals(
        budget_operations(spark, sf), "run", ["sequence"], block_slice("sequence", 1000), ["used"]
    ).withColumn("limit", F.lit(1_000_000))
    judged = logs.precheck(totals, "total_used", "requested", "limit")
    return judged.select("run", "sequence", F.col("total_used").alias("total"), "verdict")


TURN_STAGES = ("dataset_inspection", "dataset_profile", "canonical_search_space", "frontier_discovery", "dataset_critic")


def stage_records(spark, sf):
    """Stage logs from conversations: turns are stages, with some slips."""
    stages = F.array(*[F.lit(s[0]) for s in logs.STAGES])
    kinds = F.array(*[F.lit(s[1]) for s in logs.STAGES])
    states = F.array(*[F.lit(s[2]) for s in logs.STAGES])
    turn = F.col("turn").cast("int")
    from trialweave.operators.ordered import ordered_scan, previous

    turns = table(spark, sf, "conversations").withColumn("sha256", F.sha2("text", 256))
    linked = ordered_scan(turns, ["conv_id"], ["turn"], block_slice("turn", 1000), {"prev": previous("sha256")})
    slip = F.col("conv_id") % 7 == 3
    return linked.select(
        "conv_id",
        F.col("turn").alias("recorded_at"),
        F.when(slip & (turn == 2), "unheard_of").otherwise(F.get(stages, turn)).alias("stage"),
        F.get(kinds, turn).alias("artifact_type"),
        F.when(F.col("role") == "system", "draft").otherwise(F.get(states, turn)).alias("artifact_status"),
        "sha256",
        F.when(F.col("prev").isNull(), F.array().cast("array<string>"))
        .when(F.col("conv_id") % 5 == 1, F.array(F.lit("other")))
        .otherwise(F.array("prev"))
        .alias("upstream_sha256"),
    )


STAGE_SQL = f"s(pos, name, kind, state) AS (VALUES {', '.join(f'({i}, {n!r}, {k!r}, {s!r})' for i, (n, k, s) in enumerate(logs.STAGES))})"


@query(
    "wn8_stage_faults",
    f"""
    WITH {STAGE_SQL}, c AS (SELECT conv_id, turn AS recorded_at, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, CASE WHEN conv_id % 7 = 3 AND turn = 2 THEN 'unheard_of' ELSE name END AS stage, kind, state, s.pos AS pos FROM conversations JOIN s ON s.pos = turn)
    SELECT conv_id, recorded_at, stage, 'stage_known' AS rule_id FROM c WHERE stage = 'unheard_of'
    UNION ALL SELECT conv_id, recorded_at, stage, 'stage_in_order' FROM c WHERE stage = 'unheard_of' OR pos <> place
    UNION ALL SELECT conv_id, recorded_at, stage, 'artifact_type' FROM c WHERE stage = 'unheard_of'
    UNION ALL SELECT conv_id, recorded_at, stage, 'artifact_status' FROM c WHERE stage = 'unheard_of' OR role = 'system'
    UNION ALL SELECT conv_id, recorded_at, stage, 'upstream_binding' FROM c WHERE place > 0 AND conv_id % 5 = 1
    """,
)
def wn8_stage_faults(spark, sf):
    return logs.stage_faults(stage_records(spark, sf), "conv_id", "recorded_at", block_slice("recorded_at", 1000))


@query(
    "wn8_next_stage",
    f"""
    WITH {STAGE_SQL}, c AS (SELECT conv_id, CASE WHEN conv_id % 7 = 3 AND turn = 2 THEN 'unheard_of' ELSE name END AS stage FROM conversations JOIN s ON s.pos = turn),
    k AS (SELECT DISTINCT conv_id FROM c)
    SELECT conv_id, arg_min(name, pos) AS next_stage FROM (SELECT k.conv_id, s.name, s.pos FROM k, s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = k.conv_id AND c.stage = s.name)) GROUP BY 1
    """,
)
def wn8_next_stage(spark, sf):
    return logs.next_stage(stage_records(spark, sf), "conv_id")


@query(
    "wn9_sequence_faults",
    """
    WITH c AS (SELECT conv_id AS log, turn AS sequence, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, CASE WHEN role = 'system' AND conv_id % 4 = 0 THEN 'b' ELSE 'a' END AS run FROM conversations WHERE role <> 'user' OR conv_id % 2 = 0)
    SELECT log, sequence, 'sequence_contiguous' AS rule_id FROM c WHERE sequence <> p
    UNION ALL SELECT log, NULL, 'single_run' FROM c GROUP BY log HAVING count(DISTINCT run) > 1
    """,
)
def wn9_sequence_faults(spark, sf):
    """A log loses its user turns in every other conversation."""
    events = table(spark, sf, "conversations").where("role <> 'user' or conv_id % 2 = 0").select(
        F.col("conv_id").alias("log"),
        F.col("turn").alias("sequence"),
        F.when((F.col("role") == "system") & (F.col("conv_id") % 4 == 0), "b").otherwise("a").alias("run"),
    )
    return logs.sequence_faults(events, "log", "sequence", "run", block_slice("sequence", 1000))


@query(
    "wn11_adapter_ranking",
    """
    WITH r AS (SELECT doc_id, source, lang, n_chars / 40000.0 AS c, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place, lead(n_chars / 40000.0) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS nx FROM documents)
    SELECT source, doc_id AS adapter_id, abs(c - nx) < 0.05 AS ambiguous FROM r WHERE place = 1
    """,
)
def wn11_adapter_ranking(spark, sf):
    """Best and second best by one top-two cut, then compared in the row."""
    from trialweave.operators.ordered import top_rows

    probes = table(spark, sf, "documents").select("source", "doc_id", (F.col("n_chars") / 40000.0).alias("confidence"))
    two = top_rows(probes, ["source"], [F.col("confidence").desc(), F.col("doc_id")], 2, "place")
    best = two.groupBy("source").agg(
        F.min_by("doc_id", "place").alias("adapter_id"),
        F.max("confidence").alias("a"),
        F.min("confidence").alias("b"),
        F.count(F.lit(1)).alias("n"),
    )
    return best.select("source", "adapter_id", ((F.col("n") > 1) & (F.col("a") - F.col("b") < 0.05)).alias("ambiguous"))


@query(
    "wn12_revision_numbers",
    """
    WITH d AS (SELECT source, sha256(text) AS sha, min(doc_id) AS first FROM documents GROUP BY 1, 2)
    SELECT source, sha, (10 + row_number() OVER (PARTITION BY source ORDER BY first))::BIGINT AS revision_number FROM d
    """,
)
def wn12_revision_numbers(spark, sf):
    from trialweave.sources.sinks import numbered_revisions

    rows = table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("sha"), "doc_id")
    registered = rows.groupBy("source").agg(F.lit(10).alias("last_revision"))
    numbered = numbered_revisions(rows, registered, "source", "sha", "doc_id", block_slice("doc_id"))
    return numbered.select("source", "sha", "revision_number")


@query(
    "wn14_repeated_calls",
    """
    WITH e AS (SELECT event_id, user_id, event_type, props, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) AS n FROM events)
    SELECT event_id, n::BIGINT AS occurrence, n > 2 AS repeated FROM e
    """,
)
def wn14_repeated_calls(spark, sf):
    events = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    flagged = logs.repeated_calls(events, "user_id", "at", ["event_type", "props"], day_slice("ts"))
    return flagged.select("event_id", "occurrence", "repeated")


@query(
    "wn15_unchanged_revisions",
    """
    WITH c AS (SELECT conv_id, turn, sha256(text) AS h, sha256(role || length(text) // 100) AS s FROM conversations),
    l AS (SELECT *, lag(h) OVER (PARTITION BY conv_id ORDER BY turn) AS ph, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS ps, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM c)
    SELECT conv_id, turn, n > 1 AND (h IS NOT DISTINCT FROM ph OR s IS NOT DISTINCT FROM ps) AS unchanged FROM l
    """,
)
def wn15_unchanged_revisions(spark, sf):
    loose = F.sha2(F.concat("role", F.floor(F.length("text") / 100).cast("string")), 256)
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.sha2("text", 256).alias("exact"), loose.alias("semantic")
    )
    marked = logs.unchanged_revisions(turns, "conv_id", "turn", ["exact", "semantic"], block_slice("turn", 1000))
    return marked.select("conv_id", "turn", "unchanged")
