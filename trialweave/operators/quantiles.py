"""Exact grouped quantiles (linear interpolation) that survive a heavy group.

The built-in exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer.  Here a mergeable sketch of fixed size first brackets every wanted
quantile between two values.  A second pass counts: values outside all brackets only
add to a counter, values inside keep themselves with their count, and both combine
map-side.  What reaches one task per group is the content of the brackets, a fixed
small share of the group, and the wanted ranks are read off exactly.  Where that share of
the largest group could be too much, brackets are narrowed first: each pass counts the
values of a bracket in bins and keeps the bins that hold the wanted ranks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.session import materialise

ACCURACY = 10_000
# Brackets reach this many times the sketch's rank error to each side.
SLACK = 4
# Groups up to this many times the accuracy are ranked whole.
KEEP_ALL = 8
# Values of one bracket that one task may rank, and the bins of a narrowing pass.
MOST_INSIDE, BINS = 1 << 20, 4096


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    accuracy: int = ACCURACY,
    most_inside: int = MOST_INSIDE,
) -> DataFrame:
    """One row per key with one column per named probability.

    Null and NaN values are left out, as nan-aware medians do.  Keys without any
    value give no row.  The input is evaluated twice, and once more per narrowing pass;
    write an expensive one down first.  No task ranks more than ``most_inside`` distinct
    values of a bracket, or the values of a group of up to 8 times the accuracy.
    """
    keys = list(keys)
    wanted = sorted(probabilities.items(), key=lambda item: item[1])
    data = df.select(*keys, F.col(value).cast("double").alias("__v")).where(
        F.col("__v").isNotNull() & ~F.isnan("__v")
    )
    margin = SLACK / accuracy
    edges = [e for _, p in wanted for e in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
        F.percentile_approx("__v", F.array(*[F.lit(e) for e in edges]), F.lit(accuracy)).alias("__e"),
    )
    # Interpolation needs a neighbour, so brackets at the ends reach the extremes.  A
    # group too small for the margin to span several ranks keeps all its values, whose
    # number this bounds.
    small = F.col("__n") <= KEEP_ALL * accuracy
    brackets = sketch.select(
        *keys,
        "__n",
        *[
            (F.col("__min") if p <= margin else F.when(small, F.col("__min")).otherwise(F.col("__e")[2 * i])).alias(f"__lo{i}")
            for i, (_, p) in enumerate(wanted)
        ],
        *[
            (F.col("__max") if p >= 1 - margin else F.when(small, F.col("__max")).otherwise(F.col("__e")[2 * i + 1])).alias(f"__hi{i}")
            for i, (_, p) in enumerate(wanted)
        ],
    )
    # What the sketch promises about a bracket, in values per value of the group.
    brackets = materialise(brackets, "brackets")
    largest = brackets.where(~small).agg(F.max("__n")).first()[0] or 0
    if largest * 2 * (SLACK + 1) / accuracy > most_inside:
        brackets = _narrowed(data, brackets, keys, [p for _, p in wanted], most_inside)
    span = range(len(wanted))
    inside = reduce(
        lambda a, b: a | b,
        [(F.col("__v") >= F.col(f"__lo{i}")) & (F.col("__v") <= F.col(f"__hi{i}")) for i in span],
    )
    passed = reduce(
        lambda a, b: a + b, [(F.col("__v") > F.col(f"__hi{i}")).cast("int") for i in span]
    )
    counted = (
        data.join(brackets, keys)
        .select(
            *keys,
            "__n",
            passed.alias("__gap"),
            inside.alias("__in"),
            F.when(inside, F.col("__v")).alias("__v"),
        )
        .groupBy(*keys, "__n", "__gap", "__in", "__v")
        .agg(F.count(F.lit(1)).alias("__size"))
    )
    walk = (
        Window.partitionBy(*keys)
        .orderBy("__gap", "__in", "__v")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = counted.withColumn("__start", F.coalesce(F.sum("__size").over(walk), F.lit(0)))

    def at(rank: Column) -> Column:
        covers = (
            F.col("__in")
            & (rank >= F.col("__start"))
            & (rank < F.col("__start") + F.col("__size"))
        )
        return F.max(F.when(covers, F.col("__v")))

    def place(p: float) -> Column:
        return F.lit(float(p)) * (F.col("__n") - 1)

    picked = ranked.groupBy(*keys, "__n").agg(
        *[at(F.floor(place(p))).alias(f"__a{i}") for i, (_, p) in enumerate(wanted)],
        *[at(F.ceil(place(p))).alias(f"__b{i}") for i, (_, p) in enumerate(wanted)],
    )
    out = {}
    for i, (name, p) in enumerate(wanted):
        low, high = F.col(f"__a{i}"), F.col(f"__b{i}")
        part = place(p) - F.floor(place(p))
        # A rank outside its bracket would mean a broken sketch: fail, never guess.
        out[name] = (
            F.when(low.isNull() | high.isNull(), F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"))
            .when(part == 0, low)
            .otherwise(low + (high - low) * part)
            .alias(name)
        )
    return picked.select(*keys, *[out[name] for name in probabilities])


def _narrowed(
    data: DataFrame, brackets: DataFrame, keys: Sequence[str], shares: Sequence[float], most: int
) -> DataFrame:
    """Brackets cut down until each holds at most ``most`` values or one value many times.

    A bracket's values are counted in equal bins of its width, with the values below it.
    The bin of the two ranks that are interpolated gives the new ends, as values really
    there, so two different ends always part.  Ranks in two bins are the last value of one
    and the first of the other, and the bracket is settled.
    """
    span, before = range(len(shares)), None
    while True:
        sides = F.inline(F.array(*[
            F.struct(F.lit(i).alias("__i"), F.col(f"__lo{i}").alias("__lo"), F.col(f"__hi{i}").alias("__hi"))
            for i in span
        ]))
        v, low, high = F.col("__v"), F.col("__lo"), F.col("__hi")
        # Halves, so that no difference overflows; -1 is below the bracket.
        part = (v / 2 - low / 2) / (high / 2 - low / 2)
        bin_ = (
            F.when(v < low, -1)
            .when(high / 2 > low / 2, F.least(F.floor(part * BINS), F.lit(BINS - 1)))
            .otherwise(0).cast("long")
        )
        counted = (
            data.join(brackets, list(keys)).select(*keys, "__n", "__v", sides)
            .where(v <= high)
            .groupBy(*keys, "__n", "__i", bin_.alias("__bin"))
            .agg(F.count(F.lit(1)).alias("__size"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
        )
        walk = (
            Window.partitionBy(*keys, "__i").orderBy("__bin")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        start = F.coalesce(F.sum("__size").over(walk), F.lit(0))
        share = F.element_at(F.array(*[F.lit(float(p)) for p in shares]), F.col("__i") + 1)
        place = share * (F.col("__n") - 1)

        def holds(rank: Column) -> Column:
            return (
                (F.col("__bin") >= 0) & (rank >= F.col("__start"))
                & (rank < F.col("__start") + F.col("__size"))
            )

        first, last = holds(F.floor(place)), holds(F.ceil(place))
        ends = (
            counted.withColumn("__start", start)
            .groupBy(*keys, "__n", "__i")
            .agg(
                F.min(F.when(first & last, F.col("__least")).when(first, F.col("__most"))).alias("__lo"),
                F.max(F.when(first & last, F.col("__most")).when(last, F.col("__least"))).alias("__hi"),
                F.sum(F.when(first & last & (F.col("__least") < F.col("__most")), F.col("__size"))).alias("__in"),
            )
            .groupBy(*keys, "__n")
            .agg(
                *[F.max(F.when(F.col("__i") == i, F.col("__lo"))).alias(f"__lo{i}") for i in span],
                *[F.max(F.when(F.col("__i") == i, F.col("__hi"))).alias(f"__hi{i}") for i in span],
                F.max("__in").alias("__in"),
            )
        )
        brackets = materialise(ends, "brackets")
        inside, now = brackets.agg(F.max("__in"), F.sum("__in")).first()
        brackets = brackets.drop("__in")
        if (inside or 0) <= most or now == before:
            return brackets
        before = now


def few_values_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """The same numbers for groups that are small by nature, such as the channels of a
    recording: the built-in exact aggregate in one shuffle."""
    v = F.col(value).cast("double")
    kept = F.when(~F.isnan(v), v)
    return (
        df.groupBy(*keys)
        .agg(*[F.percentile(kept, F.lit(p)).alias(n) for n, p in probabilities.items()])
        .where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in probabilities]))
    )


def robust_z_of_few(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """:func:`robust_z` for groups that are small by nature."""
    keys = list(keys)
    center = few_values_quantiles(df, keys, value, {"__median": 0.5})
    centered = df.join(center, keys).withColumn("__dev", F.abs(F.col(value) - F.col("__median")))
    spread = few_values_quantiles(centered, keys, "__dev", {"__mad": 0.5})
    return _scored(centered.join(spread, keys), value, name)


def robust_z(
    df: DataFrame, keys: Sequence[str], value: str, name: str, accuracy: int = ACCURACY
) -> DataFrame:
    """Add (x - median) / (1.4826 x MAD); zero where that scale is at most epsilon."""
    keys = list(keys)
    # One small row per key each; written, so that the data is not read again for them.
    center = materialise(exact_quantiles(df, keys, value, {"__median": 0.5}, accuracy), "medians")
    centered = df.join(center, keys).withColumn(
        "__dev", F.abs(F.col(value) - F.col("__median"))
    )
    spread = materialise(exact_quantiles(centered, keys, "__dev", {"__mad": 0.5}, accuracy), "deviations")
    return _scored(centered.join(spread, keys), value, name)


def _scored(rows: DataFrame, value: str, name: str) -> DataFrame:
    scale = F.lit(MAD_SCALE) * F.col("__mad")
    z = F.when(scale <= EPSILON, F.lit(0.0)).otherwise((F.col(value) - F.col("__median")) / scale)
    return rows.withColumn(name, z).drop("__dev", "__median", "__mad")


# Scale of the median absolute deviation, double machine epsilon.
MAD_SCALE = 1.4826
EPSILON = 2.220446049250313e-16
