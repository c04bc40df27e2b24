"""Search replay, stopping, locks, summaries, decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.operators.checks import violations
from trialweave.operators.ordered import top_rows

# Order of the fixed strategy, (family, low, high).
FIXED_ORDER = (
    ("bandpower_lda", 8.0, 30.0),
    ("csp_lda", 8.0, 30.0),
    ("bandpower_lda", 4.0, 40.0),
    ("csp_lda", 4.0, 40.0),
    ("bandpower_lda", 8.0, 13.0),
    ("csp_lda", 8.0, 13.0),
    ("bandpower_lda", 13.0, 30.0),
    ("csp_lda", 13.0, 30.0),
)
# Ratio of median to largest effect from which power features lead;
# tolerance of a lock below the best score; candidates needed before a lock.
FAMILY_RATIO = 0.55
LOCK_TOLERANCE = 0.02
MINIMUM_CANDIDATES = 2
MU = (8.0, 13.0)
BETA = (13.0, 30.0)


def fixed_preferences() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("place"),
                F.lit(f).alias("family"),
                F.lit(lo).alias("low"),
                F.lit(hi).alias("high"),
            )
            for i, (f, lo, hi) in enumerate(FIXED_ORDER)
        ]
    )


def guided_preferences(profiles: DataFrame, policy: str = "bandwise") -> DataFrame:
    """Eight ranked (family, band) choices per subject from its measurements.

    ``mean_spectrum`` compares the two spectral peaks and uses the broad-band
    effects; ``bandwise`` takes the band with the larger effect.  Needs subject_id,
    mu_power, beta_power, broad_median, broad_max, mu_median, mu_max, beta_median and
    beta_max.
    """
    zero = F.lit(0.0)

    def number(c: str) -> Column:
        return F.coalesce(F.col(c), zero)

    if policy == "mean_spectrum":
        mu_first = number("mu_power") >= number("beta_power")
        median, largest = number("broad_median"), number("broad_max")
    elif policy == "bandwise":
        mu_first = number("mu_max") >= number("beta_max")
        median = F.when(mu_first, number("mu_median")).otherwise(number("beta_median"))
        largest = F.when(mu_first, number("mu_max")).otherwise(number("beta_max"))
    else:
        raise ValueError(f"unknown guidance policy: {policy}")
    ratio = F.when(largest > 0, median / largest).otherwise(zero)
    power_first = ratio >= FAMILY_RATIO
    preferred = F.when(power_first, "bandpower_lda").otherwise("csp_lda")
    other = F.when(power_first, "csp_lda").otherwise("bandpower_lda")

    def edge(i: int, flip: bool) -> Column:
        first, second = (BETA, MU) if flip else (MU, BETA)
        return F.when(mu_first, first[i]).otherwise(second[i])

    bands = [
        (edge(0, False), edge(1, False)),
        (F.lit(8.0), F.lit(30.0)),
        (F.lit(4.0), F.lit(40.0)),
        (edge(0, True), edge(1, True)),
    ]
    rows = [
        F.struct(
            F.lit(2 * i + j + 1).alias("place"), fam.alias("family"), lo.alias("low"), hi.alias("high")
        )
        for i, (lo, hi) in enumerate(bands)
        for j, fam in enumerate((preferred, other))
    ]
    return profiles.select(
        "subject_id", ratio.alias("effect_ratio"), F.explode(F.array(*rows)).alias("p")
    ).select("subject_id", "effect_ratio", "p.*")


# --- replay ---------------------------------------------------------------------


def replay(
    scores: DataFrame,
    keys: Sequence[str],
    cycle: str,
    candidate: str,
    score: str,
    tolerance: float,
    minimum_cycles: int,
    maximum_cycles: int,
    stop_score: float,
) -> DataFrame:
    """Outcome of a sequential search per key.

    Only the first ``maximum_cycles`` rows of a key can matter besides its overall
    best, so the window works on that many rows (cut before the shuffle) and the best
    comes from an aggregate.
    """
    keys = list(keys)
    best = scores.groupBy(*keys).agg(F.max(score).alias("best_possible"))
    head = top_rows(scores, keys, [cycle], maximum_cycles, "place")
    upto = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    walked = head.withColumn("running", F.max(score).over(upto))
    stop = (F.col("place") >= minimum_cycles) & (
        (F.col("running") >= stop_score) | (F.col("place") >= maximum_cycles)
    )
    lock = walked.groupBy(*keys).agg(
        F.min(F.when(stop, F.col("place"))).alias("stopped"), F.max("place").alias("length")
    )
    seen = (
        walked.join(lock, keys)
        .join(best, keys)
        .where(F.col("place") <= F.coalesce("stopped", "length"))
    )
    near = F.col("best_possible") - F.col("running") <= tolerance
    out = seen.groupBy(*keys).agg(
        F.max_by(candidate, F.struct(F.col(score), -F.col("place"))).alias("locked_candidate"),
        F.max(score).alias("locked_score"),
        # A replay that runs out of candidates reports the maximum as its cycle.
        F.coalesce(F.max("stopped"), F.lit(maximum_cycles)).alias("locked_cycle"),
        F.max("best_possible").alias("best_possible"),
        F.min(F.when(near, F.col("place"))).alias("cycles_to_near_best"),
    )
    gap = F.col("best_possible") - F.col("locked_score")
    return out.withColumn("gap_at_lock", gap).withColumn("near_best_at_lock", gap <= tolerance)


def strategy_summary(replays: DataFrame, keys: Sequence[str], candidates: int) -> DataFrame:
    """Means over subjects; a search that never got near counts candidates + 1."""
    return replays.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("subjects"),
        F.avg("locked_cycle").alias("mean_locked_cycle"),
        F.avg(F.coalesce("cycles_to_near_best", F.lit(candidates + 1))).alias("mean_cycles_to_near_best"),
        F.avg(F.col("near_best_at_lock").cast("int")).alias("near_best_rate"),
        F.avg("gap_at_lock").alias("mean_gap_at_lock"),
        F.countDistinct("locked_candidate").alias("distinct_locks"),
    )


def lock_histogram(replays: DataFrame, keys: Sequence[str]) -> DataFrame:
    return replays.groupBy(*keys, "locked_candidate").agg(F.count(F.lit(1)).alias("subjects"))


def best_on_average(scores: DataFrame, subject: str, candidate: str, score: str, position: str) -> DataFrame:
    """The candidate with the highest mean score and its mean gap to each subject's best."""
    means = scores.groupBy(candidate).agg(F.avg(score).alias("mean_score"), F.min(position).alias("__first"))
    winner = means.agg(
        F.max_by(F.struct(candidate, "mean_score"), F.struct(F.col("mean_score"), -F.col("__first"))).alias("w")
    ).select("w.*")
    own = scores.groupBy(subject).agg(F.max(score).alias("__own"))
    chosen = scores.join(winner, candidate).join(own, subject)
    return chosen.groupBy(candidate).agg(
        F.max("mean_score").alias("mean_score"), F.avg(F.col("__own") - F.col(score)).alias("mean_gap")
    )


def arg_max(scores: DataFrame, keys: Sequence[str], candidate: str, score: str, position: str) -> DataFrame:
    """Best candidate per key; the first seen among equals."""
    return scores.groupBy(*keys).agg(
        F.max_by(candidate, F.struct(F.col(score), -F.col(position))).alias("best_candidate"),
        F.max(score).alias("best_score"),
    )


# --- trace and lock -------------------------------------------------------------


def admitted_trace(
    attempts: DataFrame, keys: Sequence[str], position: str, configuration: str, maximum: int
) -> DataFrame:
    """Attempts with ``verdict``: admitted, duplicate_configuration or budget_exhausted.

    The first attempt of each configuration is found by a combined minimum; among
    those only the first ``maximum`` are admitted, cut before the shuffle.
    """
    keys = list(keys)
    firsts = attempts.groupBy(*keys, configuration).agg(F.min(position).alias("__first"))
    admitted = top_rows(
        firsts.select(*keys, F.col("__first").alias(position)), keys, [position], maximum, "research_cycle"
    )
    closed = admitted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__admitted"), F.max(position).alias("__last")
    )
    full = (F.col("__admitted") >= maximum) & (F.col(position) > F.col("__last"))
    return (
        attempts.join(admitted, [*keys, position], "left")
        .join(closed, keys, "left")
        .withColumn(
            "verdict",
            F.when(F.col("research_cycle").isNotNull(), "admitted")
            .when(full, "budget_exhausted")
            .otherwise("duplicate_configuration"),
        )
        .drop("__admitted", "__last")
    )


def lock_best(trace: DataFrame, keys: Sequence[str], selected: str) -> DataFrame:
    """One lock row per key: selected versus best score of the admitted trace.

    ``trace`` has experiment_id, score, research_cycle, configuration; ``selected``
    marks the chosen experiment.  Of chosen experiments with equal scores the one of the
    earliest cycle is named.
    """
    keys = list(keys)
    facts = trace.groupBy(*keys).agg(
        F.countDistinct("configuration").alias("distinct_candidates"),
        F.max("score").alias("observed_best_score"),
        F.max(F.when(F.col(selected), F.col("score"))).alias("selected_score"),
        F.max_by(
            "experiment_id",
            F.when(
                F.col(selected) & F.col("score").isNotNull(), F.struct(F.col("score"), -F.col("research_cycle"))
            ),
        ).alias("selected_experiment"),
        F.count(F.lit(1)).alias("research_cycles"),
    )
    gap = F.col("observed_best_score") - F.col("selected_score")
    return facts.withColumn("gap_to_best", gap).withColumn(
        "within_tolerance", gap <= LOCK_TOLERANCE
    ).withColumn(
        "status",
        F.when(F.col("distinct_candidates") < MINIMUM_CANDIDATES, "too_few_candidates")
        .when(F.col("selected_score").isNull(), "selection_not_in_trace")
        .otherwise("locked_awaiting_confirmation"),
    )


# --- confirmation and decision --------------------------------------------------


def confirm(locks: DataFrame, evaluated: DataFrame, accesses: DataFrame) -> DataFrame:
    """Confirmation rows of locks not accessed before.

    ``locks``: lock_id, subject_id, pipeline_id, search_score; ``evaluated``:
    subject_id, pipeline_id, score.  Subjects without an evaluation come out failed.
    """
    fresh = locks.join(accesses.select("lock_id"), "lock_id", "left_anti")
    scored = fresh.join(
        evaluated.select("subject_id", "pipeline_id", F.col("score").alias("confirmation_score")),
        ["subject_id", "pipeline_id"],
        "left",
    )
    return scored.withColumn(
        "confirmation_minus_search", F.col("confirmation_score") - F.col("search_score")
    ).withColumn(
        "status",
        F.when(F.col("confirmation_score").isNotNull(), "completed_one_shot").otherwise("failed"),
    )


def decision_errors(cases: DataFrame) -> DataFrame:
    """(lock_id, rule_id): cases whose documents do not belong together."""
    complete = F.col("confirmation_status") == "completed_one_shot"
    return violations(
        cases,
        ["lock_id"],
        [
            ("protocol_frozen", F.col("protocol_status") == "frozen_autonomous"),
            ("lock_awaits_confirmation", F.col("lock_status") == "locked_awaiting_confirmation"),
            ("confirmation_names_lock", F.col("c_lock_id") == F.col("lock_id")),
            ("metric_matches_protocol", ~complete | F.col("c_metric").eqNullSafe(F.col("primary_metric"))),
            ("no_selection_after_confirmation", ~complete | F.coalesce(~F.col("refit_after_confirmation"), F.lit(False))),
            ("search_not_reopened", ~complete | F.coalesce(~F.col("search_reopened"), F.lit(False))),
        ],
    )


def decide(cases: DataFrame) -> DataFrame:
    """Outcome and reason per case from four criteria, no judgement left open.

    Extra policy columns are ignored, so older and newer policy versions both work.
    """
    complete = F.col("confirmation_status") == "completed_one_shot"
    enough = F.col("distinct_candidates") >= F.col("minimum_distinct_search_candidates")
    high = F.col("confirmation_score") >= F.col("minimum_confirmation_score")
    drop = F.col("search_score") - F.col("confirmation_score")
    steady = drop <= F.col("maximum_search_to_confirmation_drop")
    chance = F.col("confirmation_score") < F.col("chance_level")
    success = enough & high & steady
    return cases.select(
        "lock_id",
        F.when(~complete, "refuse").when(success, "success").when(chance, "refuse").otherwise("inconclusive").alias("outcome"),
        F.when(~complete, "confirmation_failed_or_incomplete")
        .when(success, "all_frozen_success_thresholds_met")
        .when(chance, "confirmation_below_frozen_chance_level")
        .otherwise("not_all_success_thresholds_met")
        .alias("reason_code"),
        enough.alias("enough_candidates"),
        F.when(complete, high).alias("score_high_enough"),
        F.when(complete, steady).alias("drop_small_enough"),
    )


# --- reviews --------------------------------------------------------------------

# Severities, blocking ones, dimensions and owners by review kind.
SEVERITIES = ("critical", "major", "minor", "note")
BLOCKING = ("critical", "major")
DATASET_DIMENSIONS = (
    "dataset_semantics",
    "evidence_integrity",
    "canonical_coverage",
    "hard_exclusions",
    "network_coverage",
    "frontier_claims",
    "uncertainty",
    "stage_boundary",
)
DATASET_OWNERS = (
    "literature_scout",
    "dataset_profiler_adapter",
    "canonical_registry",
    "deterministic_builder",
    "external_authority",
    "none",
)
PROTOCOL_OWNERS = (
    "research_protocol_planner",
    "dataset_contract",
    "autonomy_authority",
    "method_engineering",
    "deterministic_validator",
    "external_authority",
    "none",
)
VERDICTS = ("pass", "revise", "reject")
REVISING_OWNER = {"dataset": "literature_scout", "protocol": "research_protocol_planner"}


def review_faults(reviews: DataFrame, findings: DataFrame, revisions: DataFrame) -> DataFrame:
    """(review_id, rule_id) over reviews of four kinds.

    ``reviews``: review_id, kind (dataset, protocol, lock, scientific), verdict,
    rationale, input_valid.  ``findings``: review_id, code, severity, owner, message,
    dimension.  ``revisions``: review_id, finding_code, instruction.  Facts per review
    are combined counts; no list of findings is built.
    """
    kinds = reviews.select("review_id", "kind")
    f = findings.join(kinds, "review_id")
    blocking = F.col("severity").isin(*BLOCKING)
    coded = F.col("kind").isin("dataset", "protocol")
    owner_ok = F.when(F.col("kind") == "dataset", F.col("owner").isin(*DATASET_OWNERS)).when(
        F.col("kind") == "protocol", F.col("owner").isin(*PROTOCOL_OWNERS)
    ).otherwise(F.lit(True))
    router = F.when(F.col("kind") == "dataset", REVISING_OWNER["dataset"]).when(
        F.col("kind") == "protocol", REVISING_OWNER["protocol"]
    )
    per_code = f.groupBy("review_id", "code").agg(F.count(F.lit(1)).alias("n"))
    repeats = per_code.groupBy("review_id").agg(F.max("n").alias("code_repeats"))
    facts = f.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(blocking).alias("blocking"),
        F.count_if(blocking & (F.col("owner") != router)).alias("misrouted"),
        F.count_if(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False))).alias("bad_severity"),
        F.count_if(coded & ~F.coalesce(owner_ok, F.lit(False))).alias("bad_owner"),
        F.count_if(coded & (F.trim(F.coalesce("message", F.lit(""))) == "")).alias("empty_message"),
        F.count_if(coded & (F.trim(F.coalesce("code", F.lit(""))) == "")).alias("empty_code"),
        F.count_if((F.col("kind") == "dataset") & ~F.coalesce(F.col("dimension").isin(*DATASET_DIMENSIONS), F.lit(False))).alias("bad_dimension"),
    )
    planned = f.where((F.col("kind") == "protocol") & blocking & (F.col("owner") == REVISING_OWNER["protocol"])).select(
        "review_id", F.col("code").alias("finding_code"), F.lit(True).alias("planned")
    ).distinct()
    codes = f.select("review_id", F.col("code").alias("finding_code"), F.lit(True).alias("known")).distinct()
    per_revision = revisions.groupBy("review_id", "finding_code").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.trim(F.coalesce("instruction", F.lit(""))) != "").alias("told"),
    )
    matched = per_revision.join(codes, ["review_id", "finding_code"], "left").join(
        planned, ["review_id", "finding_code"], "full_outer"
    )
    asked = matched.groupBy("review_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("revisions"),
        F.coalesce(F.max("n"), F.lit(0)).alias("revision_repeats"),
        F.count_if(~F.col("told")).alias("untold"),
        F.count_if(F.col("n").isNotNull() & F.col("known").isNull()).alias("unknown_codes"),
        F.count_if(F.col("n").isNull() | F.col("planned").isNull()).alias("unmatched"),
    )
    joined = reviews.join(facts, "review_id", "left").join(repeats, "review_id", "left").join(asked, "review_id", "left")
    numbers = (
        "findings", "blocking", "misrouted", "bad_severity", "bad_owner", "empty_message", "empty_code",
        "bad_dimension", "code_repeats", "revisions", "revision_repeats", "untold", "unknown_codes", "unmatched",
    )
    joined = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in numbers})
    kind, verdict = F.col("kind"), F.col("verdict")
    coded = kind.isin("dataset", "protocol")
    protocol = kind == "protocol"
    is_pass, is_revise, is_reject = (verdict == v for v in VERDICTS)

    def only(condition: Column, ok: Column) -> Column:
        return ~condition | ok

    return violations(
        joined,
        ["review_id"],
        [
            ("verdict_known", verdict.isin(*VERDICTS)),
            ("rationale_present", F.trim("rationale") != ""),
            ("severities_known", F.col("bad_severity") == 0),
            ("codes_unique", only(coded, (F.col("empty_code") == 0) & (F.col("code_repeats") <= 1))),
            ("owners_known", F.col("bad_owner") == 0),
            ("dimensions_known", F.col("bad_dimension") == 0),
            ("messages_present", F.col("empty_message") == 0),
            ("revisions_well_formed", only(coded, (F.col("untold") == 0)) & only(protocol, F.col("revision_repeats") <= 1)),
            ("revisions_name_findings", only(protocol, F.col("unknown_codes") == 0)),
            ("pass_needs_valid_input", only(is_pass, F.col("input_valid"))),
            ("pass_is_clean", only(is_pass, (F.col("blocking") == 0) & (F.col("revisions") == 0))),
            ("revise_has_revisions", only(is_revise, F.col("revisions") > 0)),
            ("revise_is_routed", only(is_revise & coded, F.col("misrouted") == 0)),
            ("revise_covers_findings", only(is_revise & protocol, F.col("unmatched") == 0)),
            ("reject_has_findings", only(is_reject, F.when(protocol, F.col("blocking") > 0).otherwise(F.col("findings") > 0))),
            ("reject_asks_nothing", only(is_reject & protocol, F.col("revisions") == 0)),
        ],
    )


# --- subject profiles -----------------------------------------------------------

# Measurement kinds every subject profile rests on.
MEASUREMENT_KINDS = ("signal_quality", "spectral_profile", "class_separability", "stability")


def subject_profile_faults(
    measurements: DataFrame, cited: DataFrame, hypotheses: DataFrame, references: DataFrame
) -> DataFrame:
    """(subject_id, rule_id): evidence rules of recorded subject profiles.

    ``measurements``: subject_id, measurement_id, kind.  ``cited``: subject_id,
    measurement_id.  ``hypotheses``: subject_id, hypothesis_id, confidence.
    ``references``: subject_id, hypothesis_id, measurement_id.
    """
    kinds = measurements.groupBy("subject_id").agg(
        *[F.bool_or(F.col("kind") == k).alias(k) for k in MEASUREMENT_KINDS]
    )
    kind_faults = violations(
        kinds, ["subject_id"], [(f"measured_{k}", F.col(k)) for k in MEASUREMENT_KINDS]
    )
    known = measurements.select("subject_id", "measurement_id").distinct()
    uncited = known.join(cited, ["subject_id", "measurement_id"], "left_anti").select(
        "subject_id", F.lit("every_measurement_cited").alias("rule_id")
    )
    alien = cited.join(known, ["subject_id", "measurement_id"], "left_anti").select(
        "subject_id", F.lit("citations_exist").alias("rule_id")
    )
    ids = hypotheses.groupBy("subject_id", "hypothesis_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.coalesce(F.col("confidence").between(0, 1), F.lit(False))).alias("ok"),
    )
    hypothesis_faults = violations(
        ids,
        ["subject_id"],
        [
            ("hypothesis_id_unique", (F.col("n") == 1) & (F.trim("hypothesis_id") != "")),
            ("confidence_in_unit_interval", F.col("ok")),
        ],
    )
    loose = references.join(known, ["subject_id", "measurement_id"], "left_anti").select(
        "subject_id", F.lit("references_exist").alias("rule_id")
    )
    bare = ids.join(references, ["subject_id", "hypothesis_id"], "left_anti").select(
        "subject_id", F.lit("hypothesis_has_reference").alias("rule_id")
    )
    out = kind_faults
    for part in (uncited, alien, hypothesis_faults, loose, bare):
        out = out.unionByName(part)
    return out.distinct()
