"""Decisions, reviews, protocol rules, subject profiles (GJ12-GJ15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.operators import rules, search
from trialweave.plans.registry import query, table

CASE_SQL = """
    c AS (SELECT o_orderkey AS lock_id, o_orderstatus AS st, o_orderpriority AS pr, coalesce(n, 0) AS n, coalesce(q, 0) / 50.0 AS search_score, coalesce(m, 0) / 50.0 AS score
      FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n, max(l_quantity) AS q, avg(l_quantity)::DOUBLE AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
"""


def cases(spark, sf):
    trace = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("lock_id")).agg(
        F.countDistinct("l_partkey").alias("n"), F.max("l_quantity").alias("q"), F.avg("l_quantity").alias("m")
    )
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    rows = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "lock_id").join(trace, "lock_id", "left")
    return rows.select(
        "lock_id",
        F.when(pr == "1-URGENT", "draft").otherwise("frozen_autonomous").alias("protocol_status"),
        F.lit("locked_awaiting_confirmation").alias("lock_status"),
        F.when(pr == "2-HIGH", F.col("lock_id") + 1).otherwise(F.col("lock_id")).alias("c_lock_id"),
        F.when(st == "P", "failed").otherwise("completed_one_shot").alias("confirmation_status"),
        F.lit("balanced_accuracy").alias("primary_metric"),
        F.when(pr == "3-MEDIUM", "accuracy").otherwise("balanced_accuracy").alias("c_metric"),
        (pr == "4-NOT SPECIFIED").alias("refit_after_confirmation"),
        F.when(pr != "5-LOW", F.lit(False)).alias("search_reopened"),
        F.coalesce("n", F.lit(0)).alias("distinct_candidates"),
        (F.coalesce("q", F.lit(0.0)) / 50.0).alias("search_score"),
        (F.coalesce("m", F.lit(0.0)) / 50.0).alias("confirmation_score"),
        F.lit(0.5).alias("chance_level"),
        F.lit(0.6).alias("minimum_confirmation_score"),
        F.lit(0.15).alias("maximum_search_to_confirmation_drop"),
        F.lit(2).alias("minimum_distinct_search_candidates"),
    )


@query(
    "gj12_frozen_decision",
    f"""
    WITH {CASE_SQL}, k AS (SELECT *, st <> 'P' AS done, n >= 2 AS enough, score >= 0.6 AS high, search_score - score <= 0.15 AS steady FROM c)
    SELECT lock_id, CASE WHEN NOT done THEN 'refuse' WHEN enough AND high AND steady THEN 'success' WHEN score < 0.5 THEN 'refuse' ELSE 'inconclusive' END AS outcome,
      CASE WHEN NOT done THEN 'confirmation_failed_or_incomplete' WHEN enough AND high AND steady THEN 'all_frozen_success_thresholds_met' WHEN score < 0.5 THEN 'confirmation_below_frozen_chance_level' ELSE 'not_all_success_thresholds_met' END AS reason_code,
      enough AS enough_candidates, CASE WHEN done THEN high END AS score_high_enough, CASE WHEN done THEN steady END AS drop_small_enough FROM k
    """,
)
def gj12_frozen_decision(spark, sf):
    return search.decide(cases(spark, sf))


@query(
    "gj12_decision_errors",
    f"""
    WITH {CASE_SQL} SELECT lock_id, 'protocol_frozen' AS rule_id FROM c WHERE pr = '1-URGENT' UNION ALL SELECT lock_id, 'confirmation_names_lock' FROM c WHERE pr = '2-HIGH'
    UNION ALL SELECT lock_id, 'metric_matches_protocol' FROM c WHERE st <> 'P' AND pr = '3-MEDIUM' UNION ALL SELECT lock_id, 'no_selection_after_confirmation' FROM c WHERE st <> 'P' AND pr = '4-NOT SPECIFIED'
    UNION ALL SELECT lock_id, 'search_not_reopened' FROM c WHERE st <> 'P' AND pr = '5-LOW'
    """,
)
def gj12_decision_errors(spark, sf):
    return search.decision_errors(cases(spark, sf))


REVIEW_SQL = """
    r AS (SELECT o_orderkey AS id, ['dataset', 'protocol', 'lock', 'scientific'][1 + o_orderkey % 4] AS kind, CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'revise' ELSE CASE WHEN o_custkey % 20 = 0 THEN 'maybe' ELSE 'reject' END END AS verdict,
      o_orderpriority <> '1-URGENT' AS valid, CASE WHEN o_custkey % 30 = 1 THEN ' ' ELSE 'why' END AS rationale FROM orders),
    f AS (SELECT l_orderkey AS id, CASE WHEN l_quantity = 50 THEN ' ' ELSE 'c' || l_linenumber END AS code, CASE WHEN l_discount < 0.03 THEN 'major' WHEN l_discount > 0.09 THEN 'fatal' ELSE 'note' END AS sev,
      CASE WHEN l_tax < 0.03 THEN 'none' WHEN l_tax < 0.06 THEN 'literature_scout' ELSE 'research_protocol_planner' END AS owner, CASE WHEN l_quantity = 49 THEN '' ELSE 'text' END AS msg, CASE WHEN l_returnflag = 'A' THEN 'colour' ELSE 'uncertainty' END AS dim FROM lineitem),
    v AS (SELECT l_orderkey AS id, CASE WHEN l_quantity > 45 THEN 'zz' ELSE 'c' || l_linenumber END AS code, CASE WHEN l_quantity = 30 THEN '' ELSE 'do' END AS told FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'R'),
    fk AS (SELECT f.*, r.kind, f.sev = 'major' AS blk FROM f JOIN r USING (id)),
    fa AS (SELECT id, count(*) AS n, count_if(blk) AS blocking, count_if(blk AND ((kind = 'dataset' AND owner <> 'literature_scout') OR (kind = 'protocol' AND owner <> 'research_protocol_planner'))) AS misrouted, count_if(sev = 'fatal') AS badsev,
      count_if((kind = 'dataset' AND owner = 'research_protocol_planner') OR (kind = 'protocol' AND owner = 'literature_scout')) AS badowner, count_if(msg = '') AS nomsg, count_if(trim(code) = '') AS nocode, count_if(kind = 'dataset' AND dim = 'colour') AS baddim FROM fk GROUP BY 1),
    rep AS (SELECT id, max(n) AS rep FROM (SELECT id, code, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY 1),
    vr AS (SELECT id, code, count(*) AS n, bool_and(told <> '') AS told FROM v GROUP BY 1, 2),
    plan AS (SELECT DISTINCT id, code FROM fk WHERE kind = 'protocol' AND blk AND owner = 'research_protocol_planner'),
    vm AS (SELECT coalesce(vr.id, plan.id) AS id, n, told, plan.id IS NOT NULL AS planned, vr.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f WHERE f.id = vr.id AND f.code = vr.code) AS unk FROM vr FULL JOIN plan ON vr.id = plan.id AND vr.code = plan.code),
    va AS (SELECT id, coalesce(sum(n), 0) AS revs, coalesce(max(n), 0) AS vrep, count_if(NOT told) AS untold, count_if(unk) AS unknown, count_if(n IS NULL OR NOT planned) AS unmatched FROM vm GROUP BY 1),
    x AS (SELECT r.id AS review_id, kind, verdict, valid, rationale, coalesce(fa.n, 0) AS n, coalesce(blocking, 0) AS blocking, coalesce(misrouted, 0) AS misrouted, coalesce(badsev, 0) AS badsev, coalesce(badowner, 0) AS badowner, coalesce(nomsg, 0) AS nomsg, coalesce(nocode, 0) AS nocode, coalesce(baddim, 0) AS baddim,
      coalesce(rep, 0) AS rep, coalesce(revs, 0) AS revs, coalesce(vrep, 0) AS vrep, coalesce(untold, 0) AS untold, coalesce(unknown, 0) AS unknown, coalesce(unmatched, 0) AS unmatched, kind IN ('dataset', 'protocol') AS coded FROM r LEFT JOIN fa ON fa.id = r.id LEFT JOIN rep ON rep.id = r.id LEFT JOIN va ON va.id = r.id)
"""
REVIEW_FAILURES = {
    "verdict_known": "verdict = 'maybe'",
    "rationale_present": "trim(rationale) = ''",
    "severities_known": "badsev > 0",
    "codes_unique": "coded AND (nocode > 0 OR rep > 1)",
    "owners_known": "badowner > 0",
    "dimensions_known": "baddim > 0",
    "messages_present": "coded AND nomsg > 0",
    "revisions_well_formed": "(coded AND untold > 0) OR (kind = 'protocol' AND vrep > 1)",
    "revisions_name_findings": "kind = 'protocol' AND unknown > 0",
    "pass_needs_valid_input": "verdict = 'pass' AND NOT valid",
    "pass_is_clean": "verdict = 'pass' AND (blocking > 0 OR revs > 0)",
    "revise_has_revisions": "verdict = 'revise' AND revs = 0",
    "revise_is_routed": "verdict = 'revise' AND coded AND misrouted > 0",
    "revise_covers_findings": "verdict = 'revise' AND kind = 'protocol' AND unmatched > 0",
    "reject_has_findings": "verdict = 'reject' AND CASE WHEN kind = 'protocol' THEN blocking = 0 ELSE n = 0 END",
    "reject_asks_nothing": "verdict = 'reject' AND kind = 'protocol' AND revs > 0",
}


@query(
    "gj13_review_consistency",
    f"WITH {REVIEW_SQL} "
    + " UNION ALL ".join(f"SELECT review_id, '{r}' AS rule_id FROM x WHERE {bad}" for r, bad in REVIEW_FAILURES.items()),
)
def gj13_review_consistency(spark, sf):
    order = table(spark, sf, "orders")
    kinds = F.array(*[F.lit(k) for k in ("dataset", "protocol", "lock", "scientific")])
    st = F.col("o_orderstatus")
    reviews = order.select(
        F.col("o_orderkey").alias("review_id"),
        F.get(kinds, (F.col("o_orderkey") % 4).cast("int")).alias("kind"),
        F.when(st == "F", "pass").when(st == "O", "revise").when(F.col("o_custkey") % 20 == 0, "maybe").otherwise("reject").alias("verdict"),
        F.when(F.col("o_custkey") % 30 == 1, " ").otherwise("why").alias("rationale"),
        (F.col("o_orderpriority") != "1-URGENT").alias("input_valid"),
    )
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "review_id")
    code = F.concat(F.lit("c"), F.col("l_linenumber").cast("string"))
    findings = lines.select(
        "review_id",
        F.when(F.col("l_quantity") == 50, " ").otherwise(code).alias("code"),
        F.when(F.col("l_discount") < 0.03, "major").when(F.col("l_discount") > 0.09, "fatal").otherwise("note").alias("severity"),
        F.when(F.col("l_tax") < 0.03, "none").when(F.col("l_tax") < 0.06, "literature_scout").otherwise("research_protocol_planner").alias("owner"),
        F.when(F.col("l_quantity") == 49, "").otherwise("text").alias("message"),
        F.when(F.col("l_returnflag") == "A", "colour").otherwise("uncertainty").alias("dimension"),
    )
    revisions = lines.where("l_linestatus = 'O' and l_returnflag = 'R'").select(
        "review_id",
        F.when(F.col("l_quantity") > 45, "zz").otherwise(code).alias("finding_code"),
        F.when(F.col("l_quantity") == 30, "").otherwise("do").alias("instruction"),
    )
    return search.review_faults(reviews, findings, revisions)


PROTOCOL_FAILURES = {
    "primary_metric": "p_brand = 'Brand#1'",
    "secondary_metrics": "p_size % 5 IN (0, 1)",
    "secondary_unique": "p_size % 5 = 2",
    "aggregation_unit": "p_type = 'PROMO'",
    "aggregation_reducer": "p_type = 'SMALL'",
    "missing_policy": "p_type = 'LARGE'",
    "minimum_units": "p_size < 2",
    "interval_level": "p_size >= 40",
    "interval_resamples": "p_size * 40 < 999",
    "stopping_version": "p_brand = 'Brand#2'",
    "stop_on_budget": "p_brand = 'Brand#3'",
    "plateau_patience": "p_size % 7 = 0",
    "plateau_improvement": "p_size % 11 = 0",
    "chance_level_in_unit_interval": "p_size > 48",
    "confirmation_above_chance": "p_size >= 24",
    "distinct_candidates": "p_size % 3 < 2",
    "units_shared": "p_size < 2 OR p_size % 13 = 0",
    "success_needs_all": "p_brand = 'Brand#4'",
    "failure_refuses": "p_brand = 'Brand#5'",
}


@query(
    "gj14_protocol_rules",
    "WITH p AS (SELECT * FROM part), a AS (SELECT l_partkey, CASE WHEN l_linenumber = 7 THEN '' ELSE 'a' || l_orderkey % 50 END AS aid, l_linenumber AS n, l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT p_partkey AS protocol_id, 'protocol' AS subject, '{r}' AS rule_id FROM p WHERE {bad}" for r, bad in PROTOCOL_FAILURES.items()
    )
    + """
    UNION ALL SELECT p_partkey, 'protocol', 'analyses_present' FROM p WHERE p_partkey NOT IN (SELECT l_partkey FROM a)
    UNION ALL SELECT l_partkey, aid, 'analysis_id_present' FROM a WHERE aid = ''
    UNION ALL SELECT l_partkey, aid, 'test_known' FROM a WHERE q > 45
    UNION ALL SELECT l_partkey, aid, 'alpha_in_interval' FROM a WHERE d = 0
    UNION ALL SELECT l_partkey, aid, 'permutations_enough' FROM a WHERE q * 50 < 999
    UNION ALL SELECT l_partkey, aid, 'correction_known' FROM a WHERE t = 0
    UNION ALL SELECT l_partkey, aid, 'family_present' FROM a WHERE n = 3
    UNION ALL SELECT l_partkey, aid, 'analysis_id_unique' FROM a WHERE aid <> '' GROUP BY ALL HAVING count(*) > 1
    """,
)
def gj14_protocol_rules(spark, sf):
    size, kind, brand = F.col("p_size"), F.col("p_type"), F.col("p_brand")
    yes = F.lit(True)
    pick = F.array(
        F.array(F.lit("f2")), F.array(F.lit("kappa")), F.array(F.lit("roc_auc"), F.lit("roc_auc")),
        F.array(F.lit("roc_auc")), F.array().cast("array<string>"),
    )
    protocols = table(spark, sf, "part").select(
        F.col("p_partkey").alias("protocol_id"),
        F.when(brand == "Brand#1", "speed").otherwise("accuracy").alias("primary_metric"),
        F.get(pick, size % 5).alias("secondary_metrics"),
        F.when(kind == "PROMO", "run").otherwise("subject").alias("aggregation_unit"),
        F.when(kind == "SMALL", "max").otherwise("median").alias("aggregation_reducer"),
        F.when(kind == "LARGE", "ignore").otherwise("fail_closed").alias("missing_value_policy"),
        size.alias("minimum_evaluable_units"),
        F.lit("bootstrap_bca").alias("interval_method"),
        (size / 40.0).alias("interval_level"),
        (size * 40).alias("interval_resamples"),
        F.lit(1).alias("interval_seed"),
        F.when(brand == "Brand#2", "2.0").otherwise("1.0").alias("stopping_version"),
        (brand != "Brand#3").alias("stop_on_budget_exhaustion"),
        yes.alias("stop_on_candidate_universe_exhaustion"),
        yes.alias("plateau_enabled"),
        F.lit(1).alias("plateau_minimum_candidates"),
        (size % 7).alias("plateau_patience"),
        F.when(size % 11 == 0, -0.1).otherwise(0.0).alias("plateau_minimum_improvement"),
        (size / 48.0).alias("chance_level"),
        F.lit(0.5).alias("minimum_confirmation_score"),
        F.lit(0.1).alias("maximum_search_to_confirmation_drop"),
        (size % 3).alias("minimum_distinct_search_candidates"),
        F.when(size % 13 == 0, size + 1).otherwise(size).alias("decision_minimum_units"),
        (brand != "Brand#4").alias("success_requires_all_thresholds"),
        F.lit("refuse").alias("below_chance_outcome"),
        F.lit("inconclusive").alias("otherwise_outcome"),
        F.when(brand == "Brand#5", "retry").otherwise("refuse").alias("confirmation_failure_outcome"),
    )
    n = F.col("l_linenumber")
    analyses = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("protocol_id"),
        F.when(n == 7, "").otherwise(F.concat(F.lit("a"), (F.col("l_orderkey") % 50).cast("string"))).alias("analysis_id"),
        F.when(F.col("l_quantity") > 45, "t_test").otherwise("paired_permutation").alias("test_id"),
        F.lit("greater").alias("alternative"),
        F.col("l_discount").alias("alpha"),
        (F.col("l_quantity") * 50).alias("permutations"),
        n.alias("random_seed"),
        F.when(F.col("l_tax") == 0, "bonferroni").otherwise("holm").alias("correction"),
        F.when(n == 3, " ").otherwise("family").alias("family_id"),
    )
    return rules.protocol_violations(protocols, analyses)


@query(
    "gj15_profile_evidence",
    """
    WITH m AS (SELECT o_custkey AS s, 'm' || o_orderkey AS mid, o_orderkey, ['signal_quality', 'spectral_profile', 'class_separability', 'stability', 'other'][o_orderpriority[1]::INT] AS kind, o_orderstatus AS st FROM orders),
    c AS (SELECT s, CASE WHEN o_orderkey % 41 = 0 THEN mid || 'x' ELSE mid END AS mid FROM m WHERE o_orderkey % 37 <> 0),
    h AS (SELECT s, 'h' || o_orderkey % 60 AS hid, (o_orderkey % 103) / 100.0 AS conf, o_orderkey, st, mid FROM m),
    r AS (SELECT s, hid, CASE WHEN st = 'P' THEN 'none' ELSE mid END AS mid FROM h WHERE o_orderkey % 9 <> 0),
    k AS (SELECT s, unnest(['signal_quality', 'spectral_profile', 'class_separability', 'stability']) AS kind FROM m)
    SELECT DISTINCT s AS subject_id, 'measured_' || kind AS rule_id FROM k WHERE (s, kind) NOT IN (SELECT (s, kind) FROM m)
    UNION SELECT s, 'every_measurement_cited' FROM m WHERE (s, mid) NOT IN (SELECT (s, mid) FROM c)
    UNION SELECT s, 'citations_exist' FROM c WHERE (s, mid) NOT IN (SELECT (s, mid) FROM m)
    UNION SELECT s, 'hypothesis_id_unique' FROM h GROUP BY s, hid HAVING count(*) > 1
    UNION SELECT s, 'confidence_in_unit_interval' FROM h WHERE conf > 1
    UNION SELECT s, 'references_exist' FROM r WHERE (s, mid) NOT IN (SELECT (s, mid) FROM m)
    UNION SELECT s, 'hypothesis_has_reference' FROM h WHERE (s, hid) NOT IN (SELECT (s, hid) FROM r)
    """,
)
def gj15_profile_evidence(spark, sf):
    key = F.col("o_orderkey")
    mid = F.concat(F.lit("m"), key.cast("string"))
    kinds = F.array(*[F.lit(k) for k in (*search.MEASUREMENT_KINDS, "other")])
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        mid.alias("measurement_id"),
        F.get(kinds, F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("kind"),
        key.alias("k"),
        F.concat(F.lit("h"), (key % 60).cast("string")).alias("hypothesis_id"),
        ((key % 103) / 100.0).alias("confidence"),
        F.col("o_orderstatus").alias("st"),
    )
    cited = rows.where("k % 37 <> 0").select(
        "subject_id",
        F.when(F.col("k") % 41 == 0, F.concat("measurement_id", F.lit("x"))).otherwise(F.col("measurement_id")).alias("measurement_id"),
    )
    references = rows.where("k % 9 <> 0").select(
        "subject_id", "hypothesis_id", F.when(F.col("st") == "P", "none").otherwise(F.col("measurement_id")).alias("measurement_id")
    )
    return search.subject_profile_faults(
        rows.select("subject_id", "measurement_id", "kind"), cited, rows.select("subject_id", "hypothesis_id", "confidence"), references
    )
