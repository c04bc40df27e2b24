"""Joins by meaning and set operations (JN1-JN17, PF12, SO1-SO3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions import parameters
from trialweave.functions.components import (
    DEFAULT_COMPONENTS,
    DEFERRED_COMPONENTS,
    component_table,
    default_components,
)
from trialweave.operators import evidence, inventory, reconcile, rules, signal
from trialweave.operators.ordered import block_slice, ordered_position
from trialweave.plans.filters import MARKED_SQL, ROLE_SQL, marked_papers, papers, user_roles
from trialweave.plans.registry import query, table


def search_results(spark, sf):
    """Search results: documents of one source and language, ranked by arrival."""
    rows = papers(spark, sf).select(
        F.col("search").alias("query_id"), F.col("lang").alias("source"), "doc_id"
    )
    ranked = ordered_position(rows, ["query_id", "source"], ["doc_id"], block_slice("doc_id"), "rank")
    return ranked.withColumn("search_run_id", F.lit("run-1")).withColumnRenamed("doc_id", "stable_id")


RESULTS_SQL = "SELECT 'run-1' AS search_run_id, source AS query_id, lang AS source, doc_id AS stable_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id)::BIGINT AS rank FROM documents"


@query(
    "jn1_query_papers",
    f"SELECT r.stable_id, r.query_id, r.source, r.rank, d.n_chars AS citation_count FROM ({RESULTS_SQL}) r JOIN documents d ON d.doc_id = r.stable_id WHERE r.query_id = 'src7'",
)
def jn1_query_papers(spark, sf):
    details = table(spark, sf, "documents").select(
        F.col("doc_id").alias("stable_id"), F.col("n_chars").alias("citation_count")
    )
    found = evidence.search_listing(search_results(spark, sf), details, "run-1", "src7")
    return found.select("stable_id", "query_id", "source", "rank", "citation_count")


def search_plan(spark, sf):
    """Planned searches per source of documents, and the attempts made."""
    docs = table(spark, sf, "documents").select("source", "lang", "n_chars")
    plan = docs.select(F.col("source").alias("query_id")).distinct().withColumn(
        "source_names", F.array(*[F.lit(x) for x in ("en", "de", "fr", "es", "it")])
    )
    attempts = docs.groupBy(F.col("source").alias("query_id"), F.col("lang").alias("source")).agg(
        F.when(F.max("n_chars") > 6000, "completed").otherwise("failed").alias("status")
    )
    return plan, attempts


PLAN_SQL = """
    p AS (SELECT DISTINCT source AS query_id FROM documents), pp AS (SELECT query_id, unnest(['en', 'de', 'fr', 'es', 'it']) AS source FROM p),
    a AS (SELECT source AS query_id, lang AS source, CASE WHEN max(n_chars) > 6000 THEN 'completed' ELSE 'failed' END AS status FROM documents GROUP BY 1, 2)
"""


@query("jn2_missing_searches", f"WITH {PLAN_SQL} SELECT query_id, source FROM pp EXCEPT SELECT query_id, source FROM a")
def jn2_missing_searches(spark, sf):
    return evidence.missing_searches(*search_plan(spark, sf))


@query(
    "jn2_coverage",
    f"""
    WITH {PLAN_SQL}, t AS (SELECT pp.query_id, pp.source, a.status FROM pp LEFT JOIN a USING (query_id, source)),
    q AS (SELECT query_id, coalesce(bool_or(status = 'completed'), false) AS ok FROM t GROUP BY 1), d AS (SELECT count(*) AS n FROM labels WHERE quality = 1)
    SELECT count(*)::BIGINT AS planned_searches, count(status)::BIGINT AS attempted_searches, count_if(status IS NULL)::BIGINT AS missing_searches,
      (SELECT count(*) FROM q)::BIGINT AS planned_queries, (SELECT count_if(NOT ok) FROM q)::BIGINT AS queries_without_success, (SELECT n FROM d)::BIGINT AS directions, false AS complete FROM t
    """,
)
def jn2_coverage(spark, sf):
    plan, attempts = search_plan(spark, sf)
    return evidence.coverage(plan, attempts, table(spark, sf, "labels").where("quality = 1"))


@query(
    "jn3_citation_integrity",
    """
    WITH c AS (SELECT conv_id AS candidate_id, 'run-' || conv_id % 4 AS search_run_id, conv_id * 7 + turn AS stable_id, role FROM conversations),
    k AS (SELECT 'run-' || doc_id % 4 AS search_run_id, doc_id AS stable_id FROM documents)
    SELECT c.search_run_id, candidate_id, c.stable_id::VARCHAR AS stable_id, 'unknown_paper' AS fault FROM c LEFT JOIN k USING (search_run_id, stable_id) WHERE role = 'user' AND k.stable_id IS NULL
    UNION ALL SELECT search_run_id, candidate_id, NULL, 'no_citation' FROM c WHERE role <> 'user'
    """,
)
def jn3_citation_integrity(spark, sf):
    cited = F.array((F.col("conv_id") * 7 + F.col("turn")).cast("string"))
    directions = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("candidate_id"),
        F.concat(F.lit("run-"), (F.col("conv_id") % 4).cast("string")).alias("search_run_id"),
        F.when(F.col("role") == "user", cited).alias("supporting_papers"),
    )
    known = table(spark, sf, "documents").select(
        F.concat(F.lit("run-"), (F.col("doc_id") % 4).cast("string")).alias("search_run_id"),
        F.col("doc_id").cast("string").alias("stable_id"),
    )
    return evidence.uncited_or_unknown(directions, known)


@query(
    "jn4_profile_fields",
    """
    WITH f AS (SELECT l_orderkey AS claim_id, CASE l_returnflag WHEN 'A' THEN 'nation.' || l_linenumber ELSE 'part.size_' || l_quantity::INT END AS path FROM lineitem),
    c AS (SELECT 'nation.' || n_nationkey AS path FROM nation UNION SELECT 'part.size_' || p_size FROM part WHERE p_size <= 40)
    SELECT claim_id, path FROM f WHERE path NOT IN (SELECT path FROM c)
    """,
)
def jn4_profile_fields(spark, sf):
    path = F.when(
        F.col("l_returnflag") == "A", F.concat(F.lit("nation."), F.col("l_linenumber").cast("string"))
    ).otherwise(F.concat(F.lit("part.size_"), F.col("l_quantity").cast("int").cast("string")))
    cited = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"), path.alias("path"))
    catalogue = (
        table(spark, sf, "nation")
        .select(F.concat(F.lit("nation."), F.col("n_nationkey").cast("string")).alias("path"))
        .unionByName(
            table(spark, sf, "part").where("p_size <= 40").select(F.concat(F.lit("part.size_"), F.col("p_size").cast("string")).alias("path"))
        )
        .distinct()
    )
    return cited.join(catalogue, "path", "left_anti").select("claim_id", "path")


@query(
    "jn5_grid_gaps",
    """
    WITH o AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events), u AS (SELECT DISTINCT user_id FROM o), c AS (SELECT DISTINCT d FROM o)
    SELECT user_id, strftime(d, '%Y-%m-%d') AS session FROM (SELECT user_id, d FROM u, c EXCEPT SELECT user_id, d FROM o)
    """,
)
def jn5_grid_gaps(spark, sf):
    observed = table(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("session"))
    return inventory.grid_gaps(observed, "user_id", "session", F.substring("session", 1, 7))


RECORD_SQL = """
    SELECT o_orderkey, round(o_totalprice)::BIGINT AS event_total, o_orderstatus AS reference, 1 + o_orderkey % 7 AS runs, CASE WHEN o_orderkey % 3 = 0 THEN 50 END AS line_frequency FROM orders
"""
SEEN_SQL = """
    SELECT l_orderkey AS o_orderkey, round(sum(round(l_extendedprice * 100)::BIGINT) / 100)::BIGINT AS event_total, max(l_linestatus) AS reference, count(*) AS runs, CASE WHEN l_orderkey % 2 = 0 THEN 60 END AS line_frequency FROM lineitem GROUP BY 1, 5
"""


def declared_and_observed(spark, sf):
    declared = table(spark, sf, "orders").select(
        "o_orderkey",
        F.round("o_totalprice").cast("long").alias("event_total"),
        F.col("o_orderstatus").alias("reference"),
        (1 + F.col("o_orderkey") % 7).alias("runs"),
        F.when(F.col("o_orderkey") % 3 == 0, 50).alias("line_frequency"),
    )
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    observed = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.round(cents / 100).cast("long").alias("event_total"),
            F.max("l_linestatus").alias("reference"),
            F.count(F.lit(1)).alias("runs"),
        )
        .withColumn("line_frequency", F.when(F.col("o_orderkey") % 2 == 0, 60))
    )
    return declared, observed


@query(
    "jn6_declared_vs_observed",
    f"""
    WITH d AS ({RECORD_SQL}), o AS ({SEEN_SQL}), j AS (SELECT coalesce(d.o_orderkey, o.o_orderkey) AS o_orderkey, d.*, o.event_total AS e2, o.reference AS r2, o.runs AS n2, o.line_frequency AS f2 FROM d FULL JOIN o ON d.o_orderkey = o.o_orderkey)
    SELECT o_orderkey, 'event_total' AS field, event_total::VARCHAR AS declared, e2::VARCHAR AS observed FROM j WHERE event_total IS DISTINCT FROM e2
    UNION ALL SELECT o_orderkey, 'reference', reference, r2 FROM j WHERE reference IS DISTINCT FROM r2
    UNION ALL SELECT o_orderkey, 'runs', runs::VARCHAR, n2::VARCHAR FROM j WHERE runs IS DISTINCT FROM n2
    UNION ALL SELECT o_orderkey, 'line_frequency', line_frequency::VARCHAR, f2::VARCHAR FROM j WHERE f2 IS NOT NULL AND line_frequency IS DISTINCT FROM f2
    """,
)
def jn6_declared_vs_observed(spark, sf):
    declared, observed = declared_and_observed(spark, sf)
    return reconcile.declared_vs_observed(
        declared, observed, ["o_orderkey"], ["event_total", "reference", "runs", "line_frequency"], ["line_frequency"]
    )


@query(
    "jn7_totals_agree",
    f"""
    WITH d AS ({RECORD_SQL}), o AS ({SEEN_SQL}), j AS (SELECT d.o_orderkey, d.runs, o.runs AS n2, d.line_frequency, o.line_frequency AS f2 FROM d LEFT JOIN o ON d.o_orderkey = o.o_orderkey)
    SELECT o_orderkey, 'runs' AS rule_id FROM j WHERE runs IS DISTINCT FROM n2
    UNION ALL SELECT o_orderkey, 'line_frequency' FROM j WHERE line_frequency IS NOT NULL AND line_frequency IS DISTINCT FROM f2
    """,
)
def jn7_totals_agree(spark, sf):
    declared, observed = declared_and_observed(spark, sf)
    seen = observed.select("o_orderkey", F.col("runs").alias("seen_runs"), F.col("line_frequency").alias("seen_line"))
    return reconcile.totals_agree(
        declared, seen, ["o_orderkey"], {"runs": "seen_runs", "line_frequency": "seen_line"}
    )


@query(
    "jn8_inventory_status",
    """
    WITH s AS (SELECT 'doc/' || doc_id AS relative_path, sha256(CASE WHEN n_chars % 13 = 0 THEN text || '!' ELSE text END) AS sha256 FROM documents),
    n AS (SELECT 'doc/' || doc_id AS relative_path, sha256(text) AS now FROM documents WHERE n_chars % 17 <> 0)
    SELECT relative_path, sha256, CASE WHEN now IS NULL THEN 'missing' WHEN now = sha256 THEN 'ok' ELSE 'changed' END AS status FROM s LEFT JOIN n USING (relative_path)
    """,
)
def jn8_inventory_status(spark, sf):
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("relative_path")
    docs = table(spark, sf, "documents")
    planted = F.when(F.col("n_chars") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    stored = docs.select(path, F.sha2(planted, 256).alias("sha256"))
    present = docs.where(F.col("n_chars") % 17 != 0).select(path, F.sha2("text", 256).alias("sha256"))
    return reconcile.inventory_status(stored, present, "relative_path", "sha256")


@query(
    "jn9_session_pairs",
    """
    WITH s AS (SELECT o_custkey AS subject, year(o_orderdate) AS y, sum(round(o_totalprice * 100)::BIGINT) AS cents FROM orders GROUP BY 1, 2)
    SELECT l.subject, l.y AS left_session, r.y AS right_session, abs(l.cents - r.cents)::BIGINT AS shift FROM s l JOIN s r ON l.subject = r.subject AND l.y < r.y
    """,
)
def jn9_session_pairs(spark, sf):
    """Pairs over session summaries; a subject has as many sessions as years."""
    sessions = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("subject"), F.year("o_orderdate").alias("y"))
        .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    )
    return signal.session_pairs(sessions, ["subject"], "y", ["cents"]).select(
        "subject", "left_session", "right_session",
        F.abs(F.col("left_cents") - F.col("right_cents")).alias("shift"),
    )


def component_profiles(spark, sf):
    """One dataset profile per customer."""
    per = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("dataset_id"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.countDistinct(F.year("o_orderdate")).alias("sessions_per_subject"),
            F.countDistinct("o_orderstatus").alias("n_actions"),
            F.bool_or(F.col("o_orderpriority") == "5-LOW").alias("rest_present"),
        )
    )
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "dataset_id")
    nation = F.col("c_nationkey")
    return per.join(c, "dataset_id").select(
        "dataset_id",
        F.when(nation % 3 == 0, "motor_imagery").when(nation % 3 == 1, "erp").otherwise("bids_task_rest").alias("family"),
        F.col("n_actions"),
        F.when(nation % 5 == 0, F.array(F.lit("MEG"))).otherwise(F.array(F.lit("EEG"), F.lit("EOG"))).alias("modalities"),
        nation.alias("channel_count"),
        (F.col("orders") * 15).alias("trials"),
        "sessions_per_subject",
        F.when(nation % 7 == 0, F.lit(False)).alias("montage_verified"),
        F.when(nation % 2 == 0, "10-20").otherwise(" ").alias("placement_scheme"),
        (nation % 4).alias("eog_channel_count"),
        "rest_present",
    )


def _components_sql() -> str:
    rows = []
    for cid, category, req in DEFAULT_COMPONENTS:
        fam = (req.get("paradigms") or [""])[0]
        flags = [str(bool(req.get(k))).lower() for k in ("modalities_any", "binary_classes", "multiple_sessions", "requires_montage", "requires_eog", "requires_resting_state")]
        rows.append(f"('{cid}', '{category}', '{fam}', {req.get('min_channels', 0)}, {req.get('min_trials', 0)}, {', '.join(flags)}, {str(cid in DEFERRED_COMPONENTS).lower()})")
    return f"c(id, category, fam, mc, mt, eeg, bin, multi, mont, eog, rest, deferred) AS (VALUES {', '.join(rows)})"


APPLICABLE_SQL = f"""
    WITH {_components_sql()},
    o AS (SELECT o_custkey AS dataset_id, count(*) AS n, count(DISTINCT year(o_orderdate)) AS s, count(DISTINCT o_orderstatus) AS a, bool_or(o_orderpriority = '5-LOW') AS r FROM orders GROUP BY 1),
    p AS (SELECT dataset_id, n * 15 AS trials, s, a, r, c_nationkey AS nk, ['motor_imagery', 'erp', 'bids_task_rest'][1 + c_nationkey % 3] AS fam FROM o JOIN customer ON c_custkey = dataset_id),
    x AS (SELECT dataset_id, id, category, deferred, list_filter([
      CASE WHEN c.eeg AND nk % 5 = 0 THEN 'required signal modality is unavailable' END,
      CASE WHEN c.fam <> '' AND c.fam <> p.fam THEN 'component does not support the detected paradigm' END,
      CASE WHEN nk < mc THEN 'insufficient channel count' END,
      CASE WHEN trials < mt THEN 'insufficient trial count' END,
      CASE WHEN bin AND a <> 2 THEN 'component requires exactly two action classes' END,
      CASE WHEN multi AND s < 2 THEN 'component requires multiple sessions' END,
      CASE WHEN mont AND (nk % 7 = 0 OR nk % 2 = 1) THEN 'component requires verified electrode geometry/montage' END,
      CASE WHEN eog AND nk % 4 = 0 THEN 'component requires EOG channels' END,
      CASE WHEN rest AND NOT r THEN 'component requires independent resting-state data' END], lambda v: v IS NOT NULL) AS reasons FROM p, c)
"""


def registry(spark):
    return component_table(spark, default_components(), DEFERRED_COMPONENTS)


@query(
    "pf12_requirement_failures",
    f"{APPLICABLE_SQL} SELECT dataset_id, id AS component_id, unnest(reasons) AS reason FROM x",
)
def pf12_requirement_failures(spark, sf):
    judged = rules.applicability(component_profiles(spark, sf), registry(spark))
    return judged.select("dataset_id", F.col("component.id").alias("component_id"), F.explode("reasons").alias("reason"))


@query(
    "jn10_applicability",
    f"{APPLICABLE_SQL} SELECT dataset_id, id AS component_id, category, CASE WHEN len(reasons) > 0 THEN 'excluded' WHEN deferred THEN 'deferred' ELSE 'applicable' END AS verdict FROM x",
)
def jn10_applicability(spark, sf):
    judged = rules.applicability(component_profiles(spark, sf), registry(spark))
    return judged.select(
        "dataset_id", F.col("component.id").alias("component_id"), F.col("component.category").alias("category"), "verdict"
    )


@query(
    "jn11_registry_faults",
    """
    WITH c AS (SELECT p_name AS id, CASE WHEN p_size > 45 THEN NULL ELSE p_type END AS category, p_brand AS family FROM part),
    r AS (SELECT 'rule-' || l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_quantity > 40 THEN 'no such thing' ELSE p_name END AS n FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT id AS entity, 'component_id_unique' AS rule_id FROM c GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT id, 'has_category' FROM c WHERE category IS NULL
    UNION ALL SELECT DISTINCT id, 'names_known_component' FROM r WHERE n NOT IN (SELECT id FROM c)
    """,
)
def jn11_registry_faults(spark, sf):
    part = table(spark, sf, "part")
    components = part.select(
        F.col("p_name").alias("id"),
        F.when(F.col("p_size") <= 45, F.col("p_type")).alias("category"),
        F.col("p_brand").alias("family"),
    )
    named = table(spark, sf, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    links = named.select(
        F.concat_ws("-", F.lit("rule"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.when(F.col("l_quantity") > 40, "no such thing").alias("if_component"),
        F.when(F.col("l_quantity") <= 40, F.array("p_name")).alias("requires_any"),
    )
    return reconcile.registry_faults(components, links, ["category", "family"])


@query(
    "jn12_unit_partition",
    f"""
    WITH r0 AS ({ROLE_SQL}), r AS (SELECT * FROM r0 WHERE unit_id % 11 <> 0 UNION ALL SELECT unit_id, 'frozen_confirmation' FROM r0 WHERE unit_id % 17 = 0 UNION ALL SELECT unit_id + 100000, 'frozen_confirmation' FROM r0 WHERE unit_id % 50 = 0),
    c AS (SELECT DISTINCT user_id AS unit_id FROM events), u AS (SELECT unit_id, count(*) AS n, count(DISTINCT role) AS d FROM r GROUP BY 1),
    j AS (SELECT coalesce(u.unit_id, c.unit_id)::VARCHAR AS subject, n, d, c.unit_id IS NOT NULL AS known FROM u FULL JOIN c ON u.unit_id = c.unit_id)
    SELECT 'events' AS dataset_id, subject, 'roles_disjoint' AS rule_id FROM j WHERE d > 1
    UNION ALL SELECT 'events', subject, 'role_without_repeats' FROM j WHERE n <> d
    UNION ALL SELECT 'events', subject, 'unit_assigned' FROM j WHERE n IS NULL
    UNION ALL SELECT 'events', subject, 'unit_in_catalogue' FROM j WHERE NOT known
    """,
)
def jn12_unit_partition(spark, sf):
    base = user_roles(spark, sf)
    twice = base.where("unit_id % 17 = 0").withColumn("role", F.lit("frozen_confirmation"))
    alien = base.where("unit_id % 50 = 0").select(
        (F.col("unit_id") + 100000).alias("unit_id"), F.lit("frozen_confirmation").alias("role")
    )
    roles = base.where("unit_id % 11 <> 0").unionByName(twice).unionByName(alien).withColumn("dataset_id", F.lit("events"))
    catalogue = table(spark, sf, "events").select(F.lit("events").alias("dataset_id"), F.col("user_id").alias("unit_id"))
    return reconcile.partition_faults(roles, catalogue, ["dataset_id"], "unit_id")


# Locks from the orders, traces from their lines.
LOCK_SQL = """
    t0 AS (SELECT l_orderkey AS lock_id, l_partkey::VARCHAR AS e, max(sha256(l_partkey::VARCHAR)) AS sha, max(l_extendedprice) AS score, bool_or(l_tax = 0.08) AS conf FROM lineitem GROUP BY 1, 2),
    s AS (SELECT lock_id, count(*) AS n, bool_and(NOT conf) AS clean, max(e) AS hi, min(e) AS lo FROM t0 GROUP BY 1),
    l AS (SELECT o_orderkey AS lock_id, o_orderstatus AS st, o_orderpriority AS pr, o_custkey AS ck,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'none' ELSE hi END AS sel, lo, n, clean FROM orders LEFT JOIN s ON s.lock_id = o_orderkey),
    j AS (SELECT l.*, t0.e IS NOT NULL AS found, t0.sha, t0.score FROM l LEFT JOIN t0 ON t0.lock_id = l.lock_id AND t0.e = l.sel)
"""


def lock_tables(spark, sf):
    """Locks, their traces and limits.  Lines are dealt once by lock, and all groups and
    joins by (lock, experiment) or lock below keep that partitioning."""
    lines = table(spark, sf, "lineitem").repartition(F.col("l_orderkey"))
    trace = lines.groupBy(F.col("l_orderkey").alias("lock_id"), F.col("l_partkey").cast("string").alias("experiment_id")).agg(
        F.max("l_extendedprice").alias("score"),
        F.bool_or(F.col("l_tax") == 0.08).alias("confirmation_data_accessed"),
    ).withColumns({
        "pipeline_sha256": F.sha2("experiment_id", 256), "data_role": F.lit("pipeline_search_and_lock")
    })
    ends = trace.groupBy("lock_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("experiment_id", "score")).alias("top"),
        F.min("experiment_id").alias("lo"),
    )
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "lock_id")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    hi, selected = F.col("top.experiment_id"), F.col("sel") == F.col("top.experiment_id")
    locks = (
        orders.join(ends, "lock_id", "left")
        .withColumn("sel", F.when(urgent, "none").otherwise(hi))
        .withColumn("sel_score", F.when(selected, F.col("top.score")))
        .withColumn("sel_sha", F.when(selected, F.sha2("sel", 256)))
        .select(
            "lock_id",
            F.col("o_custkey").alias("subject_id"),
            F.col("sel").alias("selected_experiment_id"),
            F.when(F.col("o_orderpriority") == "2-HIGH", "bad").otherwise(F.col("sel_sha")).alias("pipeline_sha256"),
            F.lit("balanced_accuracy").alias("primary_metric"),
            (F.col("sel_score") + F.when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.0)).alias("selected_search_score"),
            F.array("lo", F.when(F.col("o_orderpriority") != "5-LOW", F.col("sel")).otherwise(F.col("lo"))).alias("evidence_experiment_ids"),
            F.col("n").alias("candidate_executions"),
            (F.col("n") + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("research_cycles"),
            F.lit(6).alias("authorised_maximum"),
        )
    )
    limits = orders.select(
        "lock_id",
        F.when(F.col("o_custkey") % 10 == 0, "accuracy").otherwise("balanced_accuracy").alias("primary_metric"),
        F.lit(6).alias("authorised"),
    )
    return locks, trace, limits


@query(
    "jn13_lock_reconciliation",
    f"WITH {LOCK_SQL} "
    + """
    SELECT lock_id, 'selection_in_trace' AS rule_id FROM j WHERE NOT found
    UNION ALL SELECT lock_id, 'pipeline_hash_matches' FROM j WHERE NOT found OR pr = '2-HIGH'
    UNION ALL SELECT lock_id, 'score_matches' FROM j WHERE NOT found OR st = 'P'
    UNION ALL SELECT lock_id, 'selection_cited' FROM j WHERE sel IS NULL OR (pr = '5-LOW' AND sel <> lo)
    UNION ALL SELECT lock_id, 'citations_in_trace' FROM j WHERE sel IS NULL OR sel = 'none'
    UNION ALL SELECT lock_id, 'trace_is_search_only' FROM j WHERE clean IS DISTINCT FROM true
    UNION ALL SELECT lock_id, 'executions_match_trace' FROM j WHERE n IS NULL
    UNION ALL SELECT lock_id, 'cycles_match_trace' FROM j WHERE n IS NULL OR st = 'F'
    UNION ALL SELECT lock_id, 'within_authorised_budget' FROM j WHERE n IS NULL OR n > 6
    UNION ALL SELECT lock_id, 'metric_matches_protocol' FROM j WHERE ck % 10 = 0
    """,
)
def jn13_lock_reconciliation(spark, sf):
    return reconcile.lock_faults(*lock_tables(spark, sf))


@query(
    "jn14_report_reconciliation",
    """
    WITH l AS (SELECT l_orderkey AS k, count(*) AS n, max(l_quantity) AS q, min(l_quantity) AS m FROM lineitem GROUP BY 1),
    r AS (SELECT o_orderkey AS report_id, o_orderstatus AS st, o_orderpriority AS pr, n, q, m FROM orders LEFT JOIN l ON k = o_orderkey)
    SELECT report_id, 'subject_matches' AS rule_id FROM r WHERE n IS NULL OR pr = '3-MEDIUM'
    UNION ALL SELECT report_id, 'conclusion_is_decision' FROM r WHERE n IS NULL OR st = 'P'
    UNION ALL SELECT report_id, 'metric_matches' FROM r WHERE n IS NULL
    UNION ALL SELECT report_id, 'search_score_matches' FROM r WHERE n IS NULL OR pr = '1-URGENT'
    UNION ALL SELECT report_id, 'confirmation_score_matches' FROM r WHERE n IS NULL
    UNION ALL SELECT report_id, 'difference_matches' FROM r WHERE n IS NULL OR (pr = '2-HIGH' AND q <> m)
    UNION ALL SELECT report_id, 'cycles_match' FROM r WHERE n IS NULL
    UNION ALL SELECT report_id, 'executions_match' FROM r WHERE n IS NULL OR st = 'F'
    UNION ALL SELECT report_id, 'unused_cycles_match' FROM r WHERE n IS NULL OR n > 8
    UNION ALL SELECT report_id, 'headline_present' FROM r WHERE pr = '4-NOT SPECIFIED'
    UNION ALL SELECT report_id, 'scope_internal' FROM r WHERE pr = '5-LOW'
    """,
)
def jn14_report_reconciliation(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("lock_id")).agg(
        F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("q"), F.min("l_quantity").alias("m")
    )
    locks = lines.select(
        "lock_id", F.lit("s").alias("subject_id"), F.col("n").alias("research_cycles"),
        F.col("n").alias("candidate_executions"), F.lit(8).alias("authorised_maximum"),
    )
    confirmations = lines.select(
        "lock_id", F.lit("accuracy").alias("primary_metric"), F.col("q").alias("search_score"), F.col("m").alias("confirmation_score")
    )
    decisions = lines.select("lock_id", F.lit("success").alias("outcome"))
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    reports = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "lock_id").join(lines, "lock_id", "left").select(
        "lock_id",
        F.col("lock_id").alias("report_id"),
        F.when(pr == "3-MEDIUM", "t").otherwise("s").alias("subject_id"),
        F.when(st == "P", "refuse").otherwise("success").alias("conclusion"),
        F.lit("accuracy").alias("primary_metric"),
        (F.col("q") + F.when(pr == "1-URGENT", 1).otherwise(0)).alias("search_score"),
        F.col("m").alias("confirmation_score"),
        F.when(pr == "2-HIGH", F.lit(0.0)).otherwise(F.col("m") - F.col("q")).alias("confirmation_minus_search"),
        F.col("n").alias("research_cycles"),
        (F.col("n") + F.when(st == "F", 1).otherwise(0)).alias("candidate_executions"),
        F.greatest(F.lit(0), 8 - F.col("n")).alias("unused_authorised_cycles"),
        F.when(pr == "4-NOT SPECIFIED", " ").otherwise("found").alias("headline"),
        F.lit("internal_evidence_report").alias("scope"),
        (pr == "5-LOW").alias("external_claim_authorized"),
    )
    return reconcile.report_faults(reports, locks, confirmations, decisions)


@query(
    "jn15_budget_subset",
    """
    WITH r AS (SELECT o_orderkey, c_nationkey AS nk, c_mktsegment AS seg, o_totalprice AS cost, o_orderkey % 12 AS cycles, o_custkey AS ex, c_acctbal AS sec FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT o_orderkey, 'max_research_cycles' AS rule_id FROM r WHERE cycles > nk UNION ALL SELECT o_orderkey, 'max_candidate_executions' FROM r WHERE ex > nk * 100
    UNION ALL SELECT o_orderkey, 'max_compute_seconds' FROM r WHERE sec < 0 OR sec > 5000 UNION ALL SELECT o_orderkey, 'max_paid_cost' FROM r WHERE cost > 300000
    UNION ALL SELECT o_orderkey, 'paid_cost_currency' FROM r WHERE seg = 'BUILDING'
    """,
)
def jn15_budget_subset(spark, sf):
    base = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    requested = base.select(
        "o_orderkey",
        (F.col("o_orderkey") % 12).alias("max_research_cycles"),
        F.col("o_custkey").alias("max_candidate_executions"),
        F.col("c_acctbal").alias("max_compute_seconds"),
        F.lit(10).alias("max_api_tokens"),
        F.col("o_totalprice").alias("max_paid_cost"),
        F.when(F.col("c_mktsegment") == "BUILDING", "EUR").otherwise(" USD").alias("paid_cost_currency"),
    )
    authorised = base.select(
        "o_orderkey",
        F.col("c_nationkey").alias("max_research_cycles"),
        (F.col("c_nationkey") * 100).alias("max_candidate_executions"),
        F.lit(5000.0).alias("max_compute_seconds"),
        F.lit(10).alias("max_api_tokens"),
        F.lit(300000.0).alias("max_paid_cost"),
        F.lit("USD").alias("paid_cost_currency"),
    )
    return reconcile.budget_excess(requested, authorised, "o_orderkey")


@query(
    "jn16_preference_lookup",
    """
    WITH b(bp, low, high) AS (VALUES (0, 8.0::DOUBLE, 30.0::DOUBLE), (1, 4.0, 40.0), (2, 8.0, 13.0), (3, 13.0, 30.0)), f(fp, family) AS (VALUES (0, 'bandpower_lda'), (1, 'csp_lda'))
    SELECT s_suppkey AS subject_id, 1 + 2 * bp + fp AS place, family || '-' || low::INT || '-' || high::INT AS pipeline_id FROM supplier, b, f
    """,
)
def jn16_preference_lookup(spark, sf):
    from trialweave.operators.search import fixed_preferences

    subjects = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("subject_id"), "s_nationkey")
    prefs = subjects.select("subject_id", F.explode(fixed_preferences()).alias("p")).select("subject_id", "p.*")
    grid = subjects.select("subject_id", F.explode(parameters.candidate_grid(F.col("s_nationkey"))).alias("c")).select("subject_id", "c.*")
    looked = prefs.join(grid.select("subject_id", "family", "low", "high", "pipeline_id"), ["subject_id", "family", "low", "high"])
    return looked.select("subject_id", "place", "pipeline_id")


@query(
    "jn17_frozen_copy_diff",
    """
    SELECT o_orderkey, 'provenance' AS field FROM orders WHERE o_orderkey % 100 = 1
    UNION ALL SELECT o_orderkey, 'frontier_space' FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT o_orderkey, 'stage_boundary' FROM orders WHERE o_orderpriority = '5-LOW'
    """,
)
def jn17_frozen_copy_diff(spark, sf):
    orders = table(spark, sf, "orders")
    source = orders.select(
        "o_orderkey",
        F.col("o_custkey").alias("dataset_id"),
        F.struct("o_orderstatus", F.array(F.col("o_totalprice")).alias("v")).alias("frontier_space"),
        F.struct(F.lit("orders").alias("path"), F.col("o_orderdate").alias("at")).alias("provenance"),
        F.lit(None).cast("string").alias("stage_boundary"),
    )
    frozen = orders.select(
        "o_orderkey",
        F.col("o_custkey").alias("dataset_id"),
        F.struct("o_orderstatus", F.when(F.col("o_orderstatus") == "P", F.array(F.lit(0.0))).otherwise(F.array(F.col("o_totalprice"))).alias("v")).alias("frontier_space"),
        F.struct(F.when(F.col("o_orderkey") % 100 == 1, "moved").otherwise("orders").alias("path"), F.col("o_orderdate").alias("at")).alias("provenance"),
        F.when(F.col("o_orderpriority") == "5-LOW", "x").alias("stage_boundary"),
    )
    return reconcile.changed_bound_fields(
        frozen, source, "o_orderkey", ["dataset_id", "frontier_space", "provenance", "stage_boundary"]
    )


@query(
    "so1_concatenate_sessions",
    """
    WITH e AS (SELECT vec_id, label, vec_id % 3 AS session_id FROM embeddings)
    SELECT session_id, vec_id AS trial_id, (dense_rank() OVER (ORDER BY session_id, vec_id) - 1)::BIGINT AS trial_idx FROM e
    """,
)
def so1_concatenate_sessions(spark, sf):
    from trialweave.operators.signal import concatenate_sessions

    trials = table(spark, sf, "embeddings").select(
        F.lit("s1").alias("subject_id"),
        (F.col("vec_id") % 3).alias("session_id"),
        F.col("vec_id").alias("trial_id"),
        F.lit(64.0).alias("sfreq"),
        F.lit(1).alias("channels"),
        F.size("embedding").alias("samples"),
    )
    joined, _ = concatenate_sessions(trials, block_slice("trial_id"))
    return joined.select("session_id", "trial_id", "trial_idx")


def mixed_sessions(spark, sf):
    """Orders as trials, customers as subjects; some subjects change rate or montage."""
    key, subject = F.col("o_orderkey"), F.col("o_custkey")
    late = key % 2 == 1
    return table(spark, sf, "orders").select(
        subject.alias("subject_id"),
        F.year("o_orderdate").alias("session_id"),
        key.alias("trial_id"),
        F.when((subject % 7 == 2) & late, 128.0).otherwise(64.0).alias("sfreq"),
        F.when((subject % 11 == 3) & late, 7).otherwise(8).alias("channels"),
        F.lit(256).alias("samples"),
    )


MIXED_SQL = """
    t AS (SELECT o_custkey AS subject_id, year(o_orderdate) AS session_id, o_orderkey AS trial_id, CASE WHEN o_custkey % 7 = 2 AND o_orderkey % 2 = 1 THEN 128 ELSE 64 END AS sfreq,
      CASE WHEN o_custkey % 11 = 3 AND o_orderkey % 2 = 1 THEN 7 ELSE 8 END AS channels FROM orders),
    f AS (SELECT subject_id, unnest(['sfreq', 'channels']) AS field, unnest([count(DISTINCT sfreq), count(DISTINCT channels)]) AS n FROM t GROUP BY 1)
"""


@query("so1_faults", f"WITH {MIXED_SQL} SELECT subject_id, field FROM f WHERE n > 1")
def so1_faults(spark, sf):
    from trialweave.operators.signal import concatenate_sessions

    return concatenate_sessions(mixed_sessions(spark, sf), block_slice("trial_id"))[1]


@query(
    "so1_refused_subjects_stay_apart",
    f"""
    WITH {MIXED_SQL} SELECT subject_id, session_id, trial_id, row_number() OVER (PARTITION BY subject_id ORDER BY session_id, trial_id) - 1 AS trial_idx
    FROM t WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.subject_id = t.subject_id AND n > 1)
    """,
)
def so1_refused_subjects_stay_apart(spark, sf):
    from trialweave.operators.signal import concatenate_sessions

    joined = concatenate_sessions(mixed_sessions(spark, sf), block_slice("trial_id"))[0]
    return joined.select("subject_id", "session_id", "trial_id", "trial_idx")


@query(
    "so2_guards",
    """
    WITH n AS (SELECT count_if(source = 'src1') AS a, count_if(source = 'src2') AS b FROM documents)
    SELECT 'src2' AS target_run, 'target_is_empty' AS rule_id FROM n WHERE b > 0
    UNION ALL SELECT 'src1', 'source_and_target_differ' UNION ALL SELECT 'src1', 'target_is_empty' FROM n WHERE a > 0
    UNION ALL SELECT 'copy', 'source_has_rows'
    """,
)
def so2_guards(spark, sf):
    """Clones that are refused: into a run with rows, into itself, out of no rows."""
    runs = table(spark, sf, "documents").withColumnRenamed("source", "search_run_id")
    tried = [("src1", "src2"), ("src1", "src1"), ("nobody", "copy"), ("src1", "fresh")]
    return reduce(DataFrame.unionByName, [evidence.clone_run(runs, a, b)[1] for a, b in tried])


@query(
    "so2_clone_search",
    f"SELECT 'run-2' AS search_run_id, query_id, source, stable_id, rank FROM ({RESULTS_SQL})",
)
def so2_clone_search(spark, sf):
    clone, _ = evidence.clone_run(search_results(spark, sf), "run-1", "run-2")
    return clone.select("search_run_id", "query_id", "source", "stable_id", "rank")


@query(
    "so3_key_sets",
    """
    WITH l AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01')
    SELECT coalesce(l.k, r.k) AS part, CASE WHEN l.k IS NULL THEN 'right' WHEN r.k IS NULL THEN 'left' ELSE 'both' END AS side FROM l FULL JOIN r ON l.k = r.k
    """,
)
def so3_key_sets(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "part")
    return reconcile.set_relation(
        lines.where("l_returnflag = 'R'"), lines.where("l_shipdate < timestamp '1997-01-01'"), ["part"]
    )


@query(
    "tk1_ordered_listings",
    f"WITH {PLAN_SQL} SELECT query_id, source, status FROM a",
)
def tk1_ordered_listings(spark, sf):
    _, attempts = search_plan(spark, sf)
    return attempts.orderBy("query_id", "source")


@query(
    "tk3_compact_papers",
    f"""
    {MARKED_SQL}, e AS (SELECT doc_id, search, text, row_number() OVER (PARTITION BY search ORDER BY doc_id)::INTEGER AS place FROM f WHERE reason IS NULL)
    SELECT doc_id, search, place, nullif(substr(trim(text), 1, 320), '') AS abstract FROM e WHERE place <= 4
    """,
)
def tk3_compact_papers(spark, sf):
    first = evidence.compact_papers(papers(spark, sf), ["search"], "doc_id")
    return first.select("doc_id", "search", "place", "abstract")


@query(
    "wn1_arrival_rank",
    f"SELECT query_id, source, stable_id, rank FROM ({RESULTS_SQL})",
)
def wn1_arrival_rank(spark, sf):
    return search_results(spark, sf).select("query_id", "source", "stable_id", "rank")


@query(
    "wn2_first_per_title",
    f"{MARKED_SQL} SELECT doc_id, search, title_key FROM f WHERE reason IS NULL",
)
def wn2_first_per_title(spark, sf):
    return marked_papers(spark, sf).where("reason is null").select("doc_id", "search", "title_key")


@query(
    "ag27_table_counts",
    f"SELECT (SELECT count(*) FROM documents)::BIGINT AS papers, count(*)::BIGINT AS results, count(DISTINCT query_id)::BIGINT AS queries, count(DISTINCT stable_id)::BIGINT AS known_ids FROM ({RESULTS_SQL})",
)
def ag27_table_counts(spark, sf):
    papers_n = table(spark, sf, "documents").agg(F.count(F.lit(1))).scalar()
    results = search_results(spark, sf)
    ids = results.groupBy("stable_id").agg(F.count(F.lit(1)).alias("n"))
    totals = ids.agg(F.sum("n").alias("results"), F.count(F.lit(1)).alias("known_ids"))
    queries = results.select("query_id").distinct().agg(F.count(F.lit(1))).scalar()
    return totals.select(papers_n.alias("papers"), "results", queries.alias("queries"), "known_ids")


@query(
    "ag28_exclusion_histogram",
    f"{MARKED_SQL} SELECT search, reason, count(*)::BIGINT AS papers FROM f WHERE reason IS NOT NULL GROUP BY ALL",
)
def ag28_exclusion_histogram(spark, sf):
    return evidence.exclusion_histogram(marked_papers(spark, sf), ["search"])


@query(
    "sk3_paper_upsert",
    f"""
    WITH v AS (SELECT substr(sha256(text), 1, 2) AS stable_id, doc_id, source, lang AS doi, n_chars AS citation_count FROM documents)
    SELECT stable_id, arg_min(source, doc_id) AS source, arg_min(doc_id, doc_id) AS source_id, arg_min(doi, doc_id) AS doi, arg_max(citation_count, doc_id) AS citation_count, max(doc_id) AS updated FROM v GROUP BY 1
    """,
)
def sk3_paper_upsert(spark, sf):
    versions = table(spark, sf, "documents").select(
        F.substring(F.sha2("text", 256), 1, 2).alias("stable_id"),
        "source",
        F.col("doc_id").alias("source_id"),
        F.col("lang").alias("doi"),
        F.col("n_chars").alias("citation_count"),
        F.col("doc_id").alias("updated"),
    )
    cut = F.col("updated") % 2 == 0
    return evidence.upsert_papers(versions.where(cut), versions.where(~cut), "updated", ["citation_count", "updated"])
