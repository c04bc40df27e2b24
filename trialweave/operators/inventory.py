"""Collection inventory: counts, agreement, completeness, anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.hashing import content_hash, set_digest
from trialweave.operators.checks import disagreements
from trialweave.operators.ordered import ordered_position
from trialweave.session import materialise


def event_counts(events: DataFrame, label: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per label: events and distinct codes.  Blank labels are counted, not listed."""
    named = F.coalesce(F.col(label) != "", F.lit(False))
    return (
        events.groupBy(*keys, label)
        .agg(F.count(F.lit(1)).alias("events"), F.countDistinct(value).alias("codes"))
        .withColumn("listed", named)
    )


def label_values(events: DataFrame, label: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct codes of each listed label as rows."""
    return events.where(F.col(label) != "").select(*keys, label, value).distinct()


def distinct_durations(events: DataFrame, duration: str) -> DataFrame:
    return events.select(duration).distinct().orderBy(duration)


def session_summary(runs: DataFrame, subject: str, session: str) -> DataFrame:
    """Subjects, subject-sessions, sessions per subject, longitudinal flag."""
    per_subject = (
        runs.select(subject, session).distinct().groupBy(subject).agg(F.count(F.lit(1)).alias("__n"))
    )
    return per_subject.agg(
        F.count(F.lit(1)).alias("subjects"),
        F.sum("__n").alias("subject_sessions"),
        F.min("__n").alias("fewest_sessions"),
        F.max("__n").alias("most_sessions"),
        F.coalesce(F.max("__n") > 1, F.lit(False)).alias("longitudinal"),
    )


def channel_signatures(channels: DataFrame, file: str, fields: Sequence[str]) -> DataFrame:
    """One digest per file over its (position, name, type, units) rows.

    The position is part of each item, so equal digests mean equal ordered lists;
    nothing is collected per file.
    """
    items = channels.withColumn("__item", content_hash([F.col(f) for f in fields]))
    return set_digest(items, [file], "__item", "signature")


def signature_agreement(signatures: DataFrame) -> DataFrame:
    """Number of files per signature; more than one row is a disagreement."""
    return signatures.groupBy("signature").agg(
        F.count(F.lit(1)).alias("files"), F.min("item_count").alias("channels")
    )


def status_counts(channels: DataFrame, status: str) -> DataFrame:
    return channels.groupBy(F.coalesce(status, F.lit("unknown")).alias("status")).agg(
        F.count(F.lit(1)).alias("channels")
    )


def runs_per_session(runs: DataFrame, subject: str, session: str, run: str, on_disagree: str = "violation") -> DataFrame:
    """Run count of each session over subjects.

    ``max`` takes the largest count; ``violation`` also tells whether all subjects
    that have the session agree.
    """
    counts = (
        runs.select(subject, session, run)
        .distinct()
        .groupBy(subject, session)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    per_session = counts.groupBy(session).agg(
        F.max("__n").alias("runs"), F.min("__n").alias("fewest_runs")
    )
    if on_disagree == "max":
        return per_session.select(session, "runs")
    return per_session.withColumn("agrees", F.col("runs") == F.col("fewest_runs"))


def volume(runs: DataFrame, subject: str, session: str, trials: str, size: str) -> DataFrame:
    """Totals over run rows; subject-sessions are distinct pairs."""
    pairs = runs.groupBy(subject, session).agg(
        F.count(F.lit(1)).alias("__r"), F.sum(trials).alias("__t"), F.sum(size).alias("__b")
    )
    per_subject = pairs.groupBy(subject).agg(
        F.count(F.lit(1)).alias("__s"), F.sum("__r").alias("__r"), F.sum("__t").alias("__t"), F.sum("__b").alias("__b")
    )
    return per_subject.agg(
        F.count(F.lit(1)).alias("subjects"),
        F.sum("__s").alias("subject_sessions"),
        F.sum("__r").alias("runs"),
        F.sum("__t").alias("trials"),
        F.sum("__b").alias("signal_bytes"),
    )


def first_seen_mode(rows: DataFrame, value: str, position: str, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent value; among equals the one seen first, among those the greatest."""
    tally = rows.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("__n"), F.min(position).alias("__first")
    )
    return tally.groupBy(*keys).agg(
        F.max_by(value, F.struct(F.col("__n"), -F.col("__first"), F.col(value))).alias("nominal")
    )


def trial_anomalies(runs: DataFrame, trials: str, position: str) -> DataFrame:
    """Runs whose trial count differs from the nominal one, with missing trials."""
    nominal = first_seen_mode(runs, trials, position).scalar()
    return (
        runs.withColumn("nominal_trials", nominal)
        .where(F.col(trials) != F.col("nominal_trials"))
        .withColumn("difference", F.col(trials) - F.col("nominal_trials"))
        .withColumn("missing_trials", F.greatest(F.lit(0), -F.col("difference")))
    )


def run_quality(runs: DataFrame) -> DataFrame:
    """Roll-up of run flags."""
    return runs.agg(
        F.count_if("valid").alias("valid_runs"),
        F.count_if(~F.col("valid")).alias("invalid_runs"),
        F.count_if(~F.col("all_finite")).alias("nonfinite_runs"),
        F.count_if(F.col("flat_channel_count") > 0).alias("flat_channel_runs"),
        F.count_if(F.col("identity_conflict_count") > 0).alias("identity_conflicts"),
    )


def array_checks(epochs: DataFrame, run: Sequence[str], channel: str, samples: str) -> DataFrame:
    """Per run: all samples finite, number of channels with zero peak-to-peak."""
    finite = F.forall(samples, lambda x: ~(F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    per_channel = (
        epochs.select(
            *run,
            channel,
            finite.alias("__f"),
            F.array_max(samples).alias("__hi"),
            F.array_min(samples).alias("__lo"),
        )
        .groupBy(*run, channel)
        .agg(F.bool_and("__f").alias("__f"), F.max("__hi").alias("__hi"), F.min("__lo").alias("__lo"))
    )
    return per_channel.groupBy(*run).agg(
        F.bool_and("__f").alias("all_finite"),
        F.count_if(F.col("__hi") - F.col("__lo") == 0).alias("flat_channel_count"),
    )


#: Cells of a hole that unfold from one row.
HOLE_BLOCK = 10_000


def grid_gaps(observed: DataFrame, unit: str, cell: str, slice_by: Column) -> DataFrame:
    """(unit, cell) pairs of the full grid nobody observed, without building the grid.

    Cells get dense numbers; per unit the observed numbers are walked and only the
    holes between them are expanded.  Work is observed pairs plus holes, and a unit
    never has more rows than there are cells.  The distinct pairs and the numbered
    cells are written once, as each is read several times.
    """
    pairs = materialise(observed.select(unit, cell).distinct(), "grid-pairs")
    cells = materialise(
        ordered_position(pairs.select(cell).distinct(), [], [cell], slice_by, "__at"), "grid-cells"
    )
    last = cells.agg(F.max("__at")).scalar()
    walk = Window.partitionBy(unit).orderBy("__at")
    placed = (
        pairs.join(cells, cell)
        .select(
            unit,
            "__at",
            F.lag("__at").over(walk).alias("__prev"),
            F.lead("__at").over(walk).alias("__next"),
        )
    )
    upto = F.coalesce("__next", last + 1)
    behind = F.when(F.col("__at") + 1 < upto, F.struct((F.col("__at") + 1).alias("lo"), (upto - 1).alias("hi")))
    ahead = F.when(
        F.col("__prev").isNull() & (F.col("__at") > 1),
        F.struct(F.lit(1).cast("long").alias("lo"), (F.col("__at") - 1).alias("hi")),
    )
    gaps = placed.select(unit, F.inline(F.array_compact(F.array(ahead, behind))))
    # A long hole unfolds block by block, so no row holds an array of all its cells.
    block = F.lit(HOLE_BLOCK).cast("long")
    blocks = gaps.select(unit, "hi", F.explode(F.sequence("lo", "hi", block)).alias("lo"))
    holes = blocks.select(
        unit, F.explode(F.sequence("lo", F.least("hi", F.col("lo") + block - 1))).alias("__at")
    )
    return holes.join(cells, "__at").select(unit, cell)


def metadata_agreement(files: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Sidecar fields that differ between files."""
    return disagreements(files, [], fields)
