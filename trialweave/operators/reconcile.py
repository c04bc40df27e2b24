"""Reconciliation of what was declared with what was observed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.operators.checks import violations

SCORE_TOLERANCE = 1e-12


def _long_form(df: DataFrame, keys: Sequence[str], fields: Sequence[str], value: str) -> DataFrame:
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v"))
                for f in fields
            ]
        )
    )
    return df.select(*keys, rows.alias("x")).select(*keys, "x.field", F.col("x.v").alias(value))


def declared_vs_observed(
    declared: DataFrame, observed: DataFrame, keys: Sequence[str], fields: Sequence[str], optional: Sequence[str] = ()
) -> DataFrame:
    """(keys, field, declared, observed) where the two differ.

    ``optional`` fields are compared only where they were observed.
    """
    keys = list(keys)
    both = _long_form(declared, keys, fields, "declared").join(
        _long_form(observed, keys, fields, "observed"), [*keys, "field"], "full_outer"
    )
    skip = F.col("field").isin(*optional) & F.col("observed").isNull() if optional else F.lit(False)
    return both.where(~F.col("declared").eqNullSafe(F.col("observed")) & ~skip)


def totals_agree(declared: DataFrame, observed: DataFrame, keys: Sequence[str], pairs: dict[str, str]) -> DataFrame:
    """Declared totals against observed ones; an undeclared total is not checked."""
    keys = list(keys)
    rules = [
        (name, F.col(name).isNull() | F.col(name).eqNullSafe(F.col(seen)))
        for name, seen in pairs.items()
    ]
    return violations(declared.join(observed, keys, "left"), keys, rules)


def inventory_status(stored: DataFrame, current: DataFrame, path: str, digest: str) -> DataFrame:
    """Stored file inventory against the present one: ok, missing or changed."""
    now = current.select(path, F.col(digest).alias("__now"))
    return (
        stored.join(now, path, "left")
        .withColumn(
            "status",
            F.when(F.col("__now").isNull(), "missing")
            .when(F.col("__now") == F.col(digest), "ok")
            .otherwise("changed"),
        )
        .drop("__now")
    )


def registry_faults(components: DataFrame, rules: DataFrame, required: Sequence[str]) -> DataFrame:
    """Faults of a registry table: repeated ids, missing keys, unknown names in rules."""
    repeated = (
        components.groupBy("id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("id").alias("entity"), F.lit("component_id_unique").alias("rule_id"))
    )
    incomplete = violations(
        components.select(F.col("id").alias("entity"), *required),
        ["entity"],
        [(f"has_{c}", F.col(c).isNotNull()) for c in required],
    )
    named = rules.select(
        F.col("id").alias("entity"),
        F.explode(
            F.concat(F.array(F.col("if_component")), F.coalesce("requires_any", F.array().cast("array<string>")))
        ).alias("id"),
    ).where(F.col("id").isNotNull())
    unknown = (
        named.join(components.select("id"), "id", "left_anti")
        .select("entity", F.lit("names_known_component").alias("rule_id"))
        .distinct()
    )
    return repeated.unionByName(incomplete).unionByName(unknown)


# The three data roles.
DATA_ROLES = ("profiling_and_calibration", "pipeline_search_and_lock", "frozen_confirmation")


def partition_faults(roles: DataFrame, catalogue: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """Faults of a role assignment against the unit catalogue.

    Roles must be disjoint, free of repeats, non-empty, known, and cover the
    catalogue exactly.
    """
    keys = list(keys)
    per_unit = roles.groupBy(*keys, unit).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("role").alias("roles")
    )
    both = per_unit.join(
        catalogue.select(*keys, unit).distinct().withColumn("known", F.lit(True)), [*keys, unit], "full_outer"
    )
    unit_rules = violations(
        both,
        [*keys, F.col(unit).cast("string").alias("subject")],
        [
            ("roles_disjoint", F.coalesce(F.col("roles") <= 1, F.lit(True))),
            ("role_without_repeats", F.coalesce(F.col("n") == F.col("roles"), F.lit(True))),
            ("unit_assigned", F.col("n").isNotNull()),
            ("unit_in_catalogue", F.coalesce("known", F.lit(False))),
        ],
    )
    present = roles.groupBy(*keys).agg(
        *[F.bool_or(F.col("role") == r).alias(f"__{r}") for r in DATA_ROLES],
        F.bool_and(F.col("role").isin(*DATA_ROLES)).alias("__known"),
    )
    role_rules = violations(
        present.withColumn("subject", F.lit("roles")),
        [*keys, "subject"],
        [
            *[(f"{r}_not_empty", F.col(f"__{r}")) for r in DATA_ROLES],
            ("role_names_known", F.col("__known")),
        ],
    )
    return unit_rules.unionByName(role_rules)


def lock_faults(locks: DataFrame, trace: DataFrame, limits: DataFrame) -> DataFrame:
    """(lock_id, rule_id): the lock against its search trace and budget.

    ``locks``: lock_id, selected_experiment_id, pipeline_sha256, primary_metric,
    selected_search_score, evidence_experiment_ids, candidate_executions,
    research_cycles.  ``trace``: lock_id, experiment_id, pipeline_sha256, score,
    data_role, confirmation_data_accessed.  ``limits``: lock_id, primary_metric,
    authorised (the smallest of the budgets).
    """
    told = trace.select(
        "lock_id",
        F.col("experiment_id").alias("t_id"),
        F.col("pipeline_sha256").alias("t_sha"),
        F.col("score").alias("t_score"),
        (
            (F.col("data_role") == "pipeline_search_and_lock") & ~F.col("confirmation_data_accessed")
        ).alias("t_clean"),
        F.lit(True).alias("in_trace"),
    )
    # One join by lock; the groups keep its partitioning, so the trace is dealt once.  Only
    # the records a lock names go through the groups.
    named = F.array_append(
        F.coalesce("evidence_experiment_ids", F.array()), F.col("selected_experiment_id")
    )
    asked = locks.groupBy("lock_id").agg(F.array_distinct(F.flatten(F.collect_list(named))).alias("named"))
    facts = (
        told.join(asked, "lock_id")
        .select(
            "lock_id", "t_clean",
            F.when(F.array_contains("named", F.col("t_id")), F.struct("t_id", "t_sha", "t_score", "in_trace")).alias("hit"),
        )
        .groupBy("lock_id")
        .agg(
            F.count(F.lit(1)).alias("t_count"),
            F.bool_and("t_clean").alias("t_clean"),
            F.collect_list("hit").alias("hits"),
        )
    )
    own = F.filter("hits", lambda h: h["t_id"] == F.col("selected_experiment_id"))
    known = F.coalesce(F.transform("hits", lambda h: h["t_id"]), F.array())
    facts = (
        locks.join(facts, "lock_id", "left")
        .select("*", F.explode_outer(own).alias("hit"))
        .select(
            *locks.columns, "t_count", "t_clean", "hit.t_sha", "hit.t_score", "hit.in_trace",
            F.when(
                F.col("evidence_experiment_ids").isNotNull(),
                F.size(F.array_except("evidence_experiment_ids", known)),
            ).alias("unknown_citations"),
        )
    )
    bounds = limits.select("lock_id", F.col("primary_metric").alias("p_metric"), "authorised")
    joined = facts.join(bounds, "lock_id", "left")
    close = F.abs(F.col("selected_search_score") - F.col("t_score")) <= SCORE_TOLERANCE
    return violations(
        joined,
        ["lock_id"],
        [
            ("selection_in_trace", F.col("in_trace")),
            ("pipeline_hash_matches", F.col("pipeline_sha256") == F.col("t_sha")),
            ("score_matches", close),
            ("selection_cited", F.array_contains("evidence_experiment_ids", F.col("selected_experiment_id"))),
            ("citations_in_trace", F.coalesce("unknown_citations", F.lit(0)) == 0),
            ("trace_is_search_only", F.col("t_clean")),
            ("executions_match_trace", F.col("candidate_executions") == F.col("t_count")),
            ("cycles_match_trace", F.col("research_cycles") == F.col("t_count")),
            ("within_authorised_budget", F.col("candidate_executions").between(1, F.col("authorised"))),
            ("metric_matches_protocol", F.col("primary_metric") == F.col("p_metric")),
        ],
    )


def report_faults(reports: DataFrame, locks: DataFrame, confirmations: DataFrame, decisions: DataFrame) -> DataFrame:
    """(report_id, rule_id): report rows against lock, confirmation and decision."""
    lock = locks.select(
        "lock_id",
        F.col("subject_id").alias("l_subject"),
        F.col("research_cycles").alias("l_cycles"),
        F.col("candidate_executions").alias("l_executions"),
        F.col("authorised_maximum").alias("l_maximum"),
    )
    conf = confirmations.select(
        "lock_id",
        F.col("primary_metric").alias("c_metric"),
        F.col("search_score").alias("c_search"),
        F.col("confirmation_score").alias("c_score"),
    )
    dec = decisions.select("lock_id", F.col("outcome").alias("d_outcome"))
    joined = reports.join(lock, "lock_id", "left").join(conf, "lock_id", "left").join(dec, "lock_id", "left")
    return violations(
        joined,
        ["report_id"],
        [
            ("subject_matches", F.col("subject_id") == F.col("l_subject")),
            ("conclusion_is_decision", F.col("conclusion") == F.col("d_outcome")),
            ("metric_matches", F.col("primary_metric") == F.col("c_metric")),
            ("search_score_matches", F.col("search_score") == F.col("c_search")),
            ("confirmation_score_matches", F.col("confirmation_score") == F.col("c_score")),
            ("difference_matches", F.col("confirmation_minus_search") == F.col("c_score") - F.col("c_search")),
            ("cycles_match", F.col("research_cycles") == F.col("l_cycles")),
            ("executions_match", F.col("candidate_executions") == F.col("l_executions")),
            ("unused_cycles_match", F.col("unused_authorised_cycles") == F.col("l_maximum") - F.col("l_cycles")),
            ("headline_present", F.trim("headline") != ""),
            ("scope_internal", (F.col("scope") == "internal_evidence_report") & ~F.col("external_claim_authorized")),
        ],
    )


# Budget fields a child may not exceed.
BUDGET_FIELDS = (
    "max_research_cycles",
    "max_candidate_executions",
    "max_compute_seconds",
    "max_api_tokens",
    "max_paid_cost",
)


def budget_excess(requested: DataFrame, authorised: DataFrame, key: str) -> DataFrame:
    """(key, rule_id): requested budget fields outside the authorised ones."""
    allowed = authorised.select(
        key, *[F.col(f).alias(f"a_{f}") for f in (*BUDGET_FIELDS, "paid_cost_currency")]
    )
    rules = [
        (f, (F.col(f) >= 0) & (F.col(f) <= F.col(f"a_{f}"))) for f in BUDGET_FIELDS
    ]
    currency = (F.trim("paid_cost_currency") != "") & (
        F.trim("paid_cost_currency") == F.trim("a_paid_cost_currency")
    )
    return violations(
        requested.join(allowed, key, "left"), [key], [*rules, ("paid_cost_currency", currency)]
    )


def preferences_to_candidates(preferences: DataFrame, candidates: DataFrame) -> DataFrame:
    """Ordered (family, band) preferences to candidate ids."""
    return preferences.join(
        candidates.select("family", "low", "high", "pipeline_id"), ["family", "low", "high"]
    )


def changed_bound_fields(frozen: DataFrame, source: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field) where a frozen copy differs from its source; nested fields as JSON."""

    def packed(df: DataFrame, name: str) -> DataFrame:
        def as_text(f: str) -> Column:
            return F.to_json(F.struct(F.col(f).alias("v")), {"ignoreNullFields": "false"})

        rows = F.explode(
            F.array(*[F.struct(F.lit(f).alias("field"), as_text(f).alias("v")) for f in fields])
        )
        return df.select(key, rows.alias("x")).select(key, "x.field", F.col("x.v").alias(name))

    both = packed(frozen, "frozen").join(packed(source, "source"), [key, "field"], "full_outer")
    return both.where(~F.col("frozen").eqNullSafe(F.col("source"))).select(key, "field")


def set_relation(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every distinct key with the side it stands on: left, right or both."""
    keys = list(keys)
    sides = left.select(*keys).withColumn("__l", F.lit(1)).withColumn("__r", F.lit(0)).unionByName(
        right.select(*keys).withColumn("__l", F.lit(0)).withColumn("__r", F.lit(1))
    )
    held = sides.groupBy(*keys).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r"))
    return held.select(
        *keys,
        F.when(F.col("__l") + F.col("__r") == 2, "both")
        .when(F.col("__l") == 1, "left")
        .otherwise("right")
        .alias("side"),
    )
