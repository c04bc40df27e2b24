"""Append-only logs: chains, running totals, budgets, stages, repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.hashing import content_hash
from trialweave.operators.checks import violations
from trialweave.operators.ordered import HEAVY_ROWS, POSITION, ordered_scan, previous, running_sum

# Budget counters and the tolerance of totals and limits.
COUNTERS = (
    "research_cycles",
    "candidate_executions",
    "compute_seconds",
    "api_prompt_tokens",
    "api_completion_tokens",
    "api_cached_tokens",
    "api_total_tokens",
    "paid_cost",
    "provider_retries",
    "provider_failures",
    "recovery_attempts",
    "confirmation_accesses",
)
TOLERANCE = 1e-12


def chain_faults(
    events: DataFrame, run: str, sequence: str, slice_by: Column, hashed: Sequence[str], opening: str = "ledger_opened"
) -> DataFrame:
    """(run, sequence, rule_id) over a hash-chained log.

    ``hashed`` are the columns an event's own hash covers, in order, and include
    ``previous_event_sha256``.  Runs are scanned in slices of their sequence.
    """
    walked = ordered_scan(
        events.withColumn("__own", content_hash([F.col(c) for c in hashed])),
        [run],
        [sequence],
        slice_by,
        {"__place": POSITION, "__prev": previous("event_sha256")},
    )
    first = F.col("__place") == 1
    return violations(
        walked,
        [run, sequence],
        [
            ("sequence_contiguous", F.col(sequence) == F.col("__place") - 1),
            ("previous_hash_matches", F.col("previous_event_sha256").eqNullSafe(F.col("__prev"))),
            ("own_hash_recomputes", F.col("event_sha256") == F.col("__own")),
            ("first_event_opens", ~first | (F.col("event_type") == opening)),
        ],
    )


def binding_faults(
    events: DataFrame, authorities: DataFrame, run: str, sequence: str
) -> DataFrame:
    """(run, sequence, rule_id): events that do not belong to the log they are in.

    ``events`` has the log's ``run``, the event's own ``event_run`` and, on the opening event
    (sequence 0), ``authority_sha256`` and a map ``limits``.  ``authorities`` has one row per
    run with the digest and the limits the log must open with.
    """
    def entries(limits: Column) -> Column:
        return F.array_sort(F.map_entries(F.coalesce(limits, F.create_map().cast("map<string,double>"))))

    bound = authorities.select(
        run, F.col("authority_sha256").alias("__sha"), F.col("limits").alias("__limits")
    )
    own = violations(events, [run, sequence], [("event_names_its_run", F.col("event_run") == F.col(run))])
    opened = events.where(F.col(sequence) == 0).join(bound, run, "left")
    opening = violations(
        opened,
        [run, sequence],
        [
            ("authority_matches", F.col("authority_sha256") == F.col("__sha")),
            ("limits_match", F.col("__sha").isNotNull() & (entries(F.col("limits")) == entries(F.col("__limits")))),
        ],
    )
    return own.unionByName(opening)


def running_totals(
    events: DataFrame,
    run: str,
    order: Sequence[str],
    slice_by: Column,
    deltas: Sequence[str],
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Cumulative ``total_<field>`` of each delta column, and ``event_place`` from 1.

    Fractional amounts are added as decimals with twelve places, so the total does not
    depend on the order or the slicing of the additions.
    """
    kinds = dict(events.dtypes)
    fractional = [d for d in deltas if kinds[d] in ("double", "float")]
    exact = events.withColumns({f"__{d}": F.col(d).cast("decimal(38,12)") for d in fractional})
    outputs = {
        f"total_{d}": running_sum(f"__{d}" if d in fractional else d) for d in deltas
    }
    totals = ordered_scan(
        exact, [run], order, slice_by, {"event_place": POSITION, **outputs}, heavy_rows
    )
    return totals.withColumns(
        {f"total_{d}": F.col(f"total_{d}").cast("double") for d in fractional}
    ).drop(*[f"__{d}" for d in fractional])


def total_faults(totals: DataFrame, run: str, sequence: str, recorded: dict[str, str], limits: dict[str, str]) -> DataFrame:
    """Recorded totals that differ from the replay, and totals beyond their limits.

    ``recorded`` and ``limits`` map a computed total column to the recorded total and
    to the limit column of the same row; a null limit does not bind.  A recorder that adds
    doubles one by one may be off by half a unit in the last place per event; that much is
    allowed besides the tolerance.
    """
    def allowed(total: str) -> Column:
        return F.lit(TOLERANCE) + F.col("event_place") * F.lit(2.0**-53) * F.abs(F.col(total))

    rules = [
        (f"{total}_recorded", F.abs(F.coalesce(F.col(seen), F.lit(0.0)) - F.col(total)) <= allowed(total))
        for total, seen in recorded.items()
    ]
    rules += [
        (f"{total}_within_limit", F.col(limit).isNull() | (F.col(total) <= F.col(limit) + TOLERANCE))
        for total, limit in limits.items()
    ]
    return violations(totals, [run, sequence], rules)


def precheck(totals: DataFrame, total: str, requested: str, limit: str) -> DataFrame:
    """Verdict of each operation: a request is refused when it would pass the limit,
    recorded usage is flagged once it has.  Requests never move the total."""
    is_request = F.col("event_type") == "precheck"
    over_request = F.col(total) + F.col(requested) > F.col(limit) + TOLERANCE
    over_usage = F.col(total) > F.col(limit) + TOLERANCE
    return totals.withColumn(
        "verdict",
        F.when(is_request & over_request, "precheck_rejected")
        .when(is_request, "precheck_passed")
        .when(over_usage, "post_account_exceeded")
        .otherwise("usage_recorded"),
    )


def delta_faults(events: DataFrame, run: str, sequence: str, delta: str) -> DataFrame:
    """Unknown counters and negative amounts of a delta map."""
    known = F.array(*[F.lit(c) for c in COUNTERS])
    return violations(
        events,
        [run, sequence],
        [
            ("counters_known", F.size(F.array_except(F.map_keys(delta), known)) == 0),
            ("amounts_not_negative", F.forall(F.map_values(delta), lambda v: v >= 0)),
        ],
    )


def budget_snapshot(events: DataFrame, limits: DataFrame, run: str, sequence: str, delta: str) -> DataFrame:
    """(run, field): total, limit, remaining; with event count and last hash per run."""
    used = (
        events.select(run, F.explode(delta).alias("field", "amount"))
        .groupBy(run, "field")
        .agg(F.sum("amount").alias("total"))
    )
    heads = events.groupBy(run).agg(
        F.count(F.lit(1)).alias("event_count"), F.max_by("event_sha256", sequence).alias("last_event_sha256")
    )
    return (
        limits.join(used, [run, "field"], "left")
        .withColumn("total", F.coalesce("total", F.lit(0.0)))
        .withColumn("remaining", F.col("limit") - F.col("total"))
        .join(heads, run, "left")
    )


def token_cost(prompt: Column, completion: Column, cached: Column, prices: dict[str, float]) -> Column:
    """Price of one call; cached tokens are clamped to the prompt."""
    zero = F.lit(0)
    prompt = F.greatest(prompt, zero)
    held = F.least(F.greatest(cached, zero), prompt)
    total = (
        (prompt - held) * prices["prompt"]
        + held * prices["cached"]
        + F.greatest(completion, zero) * prices["completion"]
    )
    return total / 1_000_000.0


def sequence_faults(events: DataFrame, log: str, sequence: str, run: str, slice_by: Column) -> DataFrame:
    """Contiguity of sequences and a single run id per log."""
    walked = ordered_scan(events, [log], [sequence], slice_by, {"__place": POSITION})
    gaps = violations(
        walked, [log, sequence], [("sequence_contiguous", F.col(sequence) == F.col("__place") - 1)]
    )
    mixed = (
        events.groupBy(log)
        .agg(F.min(run).alias("a"), F.max(run).alias("b"))
        .where("a <> b")
        .select(log, F.lit(None).cast("long").alias(sequence), F.lit("single_run").alias("rule_id"))
    )
    return gaps.unionByName(mixed)


def repeated_calls(events: DataFrame, run: str, sequence: str, call: Sequence[str], slice_by: Column, allowed: int = 2) -> DataFrame:
    """Running count of identical calls per run, flagged above ``allowed``."""
    prints = events.withColumn("fingerprint", content_hash([F.col(c) for c in call]))
    counted = ordered_scan(prints, [run, "fingerprint"], [sequence], slice_by, {"occurrence": POSITION})
    return counted.withColumn("repeated", F.col("occurrence") > allowed)


def unchanged_revisions(revisions: DataFrame, key: str, cycle: str, digests: Sequence[str], slice_by: Column) -> DataFrame:
    """Revisions equal to the one before by any of the given digests."""
    walked = ordered_scan(
        revisions, [key], [cycle], slice_by,
        {"__place": POSITION, **{f"__{d}": previous(d) for d in digests}},
    )
    same = F.lit(False)
    for d in digests:
        same = same | F.col(d).eqNullSafe(F.col(f"__{d}"))
    return walked.withColumn("unchanged", (F.col("__place") > 1) & same).drop(
        "__place", *[f"__{d}" for d in digests]
    )


# --- stages ---------------------------------------------------------------------

# Stages in order with the artifact type and status each requires.
STAGES = (
    ("dataset_inspection", "DatasetInspection", "validated"),
    ("dataset_profile", "DatasetProfile", "validated"),
    ("canonical_search_space", "CanonicalSearchSpace", "validated"),
    ("frontier_discovery", "FrontierDiscovery", "completed"),
    ("dataset_critic", "DatasetCritique", "pass"),
    ("dataset_level_contract", "DatasetLevelContract", "frozen_dataset_level_contract"),
    ("research_protocol_proposal", "ResearchProtocolProposal", "proposed_for_autonomous_review"),
    ("protocol_critic", "ProtocolCritique", "pass"),
    ("research_protocol", "ResearchProtocol", "frozen_autonomous"),
    ("subject_profile", "SubjectProfile", "validated"),
    ("pipeline_search", "PipelineSearchTrace", "completed"),
    ("pipeline_lock", "PipelineLock", "locked_awaiting_confirmation"),
    ("frozen_confirmation", "FrozenConfirmation", "completed_one_shot"),
    ("evidence_report", "EvidenceReport", "completed"),
)


def _stage_entry(stage: Column) -> Column:
    table = F.create_map(
        *[
            x
            for i, (name, kind, status) in enumerate(STAGES)
            for x in (
                F.lit(name),
                F.struct(F.lit(i).alias("at"), F.lit(kind).alias("type"), F.lit(status).alias("status")),
            )
        ]
    )
    return F.try_element_at(table, stage)


def stage_faults(records: DataFrame, dataset: str, order: str, slice_by: Column) -> DataFrame:
    """(dataset, order, stage, rule_id): order, artifact type and status, upstream hash.

    ``records``: dataset, an order column, stage, artifact_type, artifact_status,
    sha256, upstream_sha256 (array).
    """
    walked = ordered_scan(
        records.withColumn("__e", _stage_entry(F.col("stage"))),
        [dataset],
        [order],
        slice_by,
        {"__place": POSITION, "__prev": previous("sha256")},
    )
    expected = F.when(F.col("__prev").isNull(), F.array().cast("array<string>")).otherwise(F.array("__prev"))
    return violations(
        walked,
        [dataset, order, "stage"],
        [
            ("stage_known", F.col("__e").isNotNull()),
            ("stage_in_order", F.col("__e.at") == F.col("__place") - 1),
            ("artifact_type", F.col("artifact_type") == F.col("__e.type")),
            ("artifact_status", F.col("artifact_status") == F.col("__e.status")),
            ("upstream_binding", F.col("upstream_sha256") == expected),
        ],
    )


def next_stage(records: DataFrame, dataset: str) -> DataFrame:
    """First stage in order a dataset has not recorded; null when all are done."""
    done = [
        F.bool_or(F.col("stage") == name).alias(f"__{i}") for i, (name, _, _) in enumerate(STAGES)
    ]
    flags = records.groupBy(dataset).agg(*done)
    first = F.coalesce(*[F.when(~F.col(f"__{i}"), F.lit(name)) for i, (name, _, _) in enumerate(STAGES)])
    return flags.select(dataset, first.alias("next_stage"))
