"""Metrics, tests, corrections and intervals over units; plateau stopping.

Random draws are leading bits of a digest of (seed, block of repetitions, unit), so they
need no shared state, reruns agree, units may be of any type, and every repetition is summed
map-side where the unit is.  Repetitions are columns of a block: a unit costs one row per
block, and a group one row per block and task in the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.operators.ordered import POSITION, ordered_scan, running_max, running_sum
from trialweave.operators.quantiles import exact_quantiles
from trialweave.session import materialise

#: Signs, and weights of 16 bits, that one digest block yields.
SIGNS, WEIGHTS = 32, 8
#: Values with equal bits up to here count as equal when sums are compared.
TIE_BITS = 40
#: Thresholds of a Poisson draw of mean one in 16 bits, for 0, 1, 2, ...
POISSON = [
    round(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8)
]
EXACT_UNITS = 50


def digest(seed: int, block: Column, unit: Column) -> Column:
    """32 hex digits that depend on the seed, the block of repetitions and the unit."""
    text = F.coalesce(unit.cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}|"), block.cast("string"), F.lit("|"), text).cast("binary"))


def _hex_number(hexes: Column, start: int, size: int) -> Column:
    return F.conv(F.substring(hexes, start, size), 16, 10).cast("long")


def sign_bits(seed: int, block: Column, unit: Column) -> Column:
    """A whole number whose lowest ``SIGNS`` bits are the unit's signs in a block."""
    return _hex_number(digest(seed, block, unit), 1, 8)


def weights(seed: int, block: Column, unit: Column) -> list[Column]:
    """The unit's weights, Poisson draws of mean one, in the ``WEIGHTS`` places of a block."""
    hexes = digest(seed, block, unit)
    out = []
    for k in range(WEIGHTS):
        share = _hex_number(hexes, 4 * k + 1, 4)
        weight = F.lit(0)
        for limit in POISSON:
            weight = weight + (share >= limit).cast("int")
        out.append(weight.cast("long"))
    return out


def _blocks(repetitions: int, size: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(-(-repetitions // size) - 1))).alias("__block")


def _in_whole_steps(rows: DataFrame, keys: Sequence[str], value: str, spare: int) -> DataFrame:
    """Add __v, the value in whole steps, and per group __step, __n and __total.

    A group's step is the power of two that lets the sum of all its values, with ``spare``
    bits more, just fit a long.  Sums of steps are exact, so they depend on no order; with
    up to a hundred units the steps are finer than the doubles themselves.  Null and NaN
    values and infinities are left out.
    """
    known = rows.withColumn("__x", F.col(value).cast("double")).where(
        F.col("__x").isNotNull() & ~F.isnan("__x") & (F.abs("__x") < float("inf"))
    )
    sizes = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.max(F.abs("__x")).alias("__top")
    )
    room = F.lit(60 - spare) - F.ceil(F.log2(F.col("__n") + 1))
    magnitude = F.when(F.col("__top") > 0, F.ceil(F.log2("__top"))).otherwise(0)
    step = F.pow(F.lit(2.0), (magnitude - room).cast("double"))
    held = known.join(sizes.select(*keys, "__n", step.alias("__step")), list(keys))
    return held.withColumn("__v", F.round(F.col("__x") / F.col("__step")).cast("long"))


# --- the normal distribution in columns ---------------------------------------

# Coefficients of the rational approximations of the normal distribution
# (Abramowitz and Stegun 26.2.17, error below 7.5e-8) and of its quantiles (Acklam,
# relative error below 1.2e-9).
CDF_SCALE = 0.2316419
CDF = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
CENTRE_UP = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
CENTRE_DOWN = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
TAIL_UP = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
TAIL_DOWN = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00, 1.0,
)
TAIL = 0.02425


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    total = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        total = total * x + F.lit(float(c))
    return total


def normal_cdf(x: Column) -> Column:
    """The share of a standard normal distribution below x."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(CDF_SCALE) * F.abs(x))
    density = F.exp(-x * x / 2.0) / F.lit(math.sqrt(2 * math.pi))
    upper = density * t * _polynomial(CDF[::-1], t)
    return F.when(x >= 0, F.lit(1.0) - upper).otherwise(upper)


def normal_quantile(p: Column) -> Column:
    """The point a share p of a standard normal distribution lies below; infinite at 0 and 1."""
    far = F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p)))
    tail = _polynomial(TAIL_UP, far) / _polynomial(TAIL_DOWN, far)
    q = p - 0.5
    centre = q * _polynomial(CENTRE_UP, q * q) / _polynomial(CENTRE_DOWN, q * q)
    return (
        F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf")))
        .when(p < TAIL, tail).when(p > 1 - TAIL, -tail).otherwise(centre)
    )


# --- metrics --------------------------------------------------------------------


def macro_f1(rows: DataFrame, keys: Sequence[str], label: str, predicted: str) -> DataFrame:
    """Mean F1 over the classes of each group; a class never predicted nor met has none."""
    cells = rows.groupBy(*keys, label, predicted).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)
    sides = cells.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(label).alias("c"), F.col("n"), hit.alias("hit")),
                F.struct(F.col(predicted).alias("c"), F.col("n"), F.lit(0).cast("long").alias("hit")),
            )
        ).alias("s"),
    )
    per_class = sides.groupBy(*keys, "s.c").agg(F.sum("s.n").alias("n"), F.sum("s.hit").alias("hit"))
    return per_class.groupBy(*keys).agg(F.avg(F.lit(2.0) * F.col("hit") / F.col("n")).alias("macro_f1"))


def roc_auc(
    rows: DataFrame, keys: Sequence[str], positive: Column, score: str, slice_by: Column
) -> DataFrame:
    """Chance that a positive scores above a negative, equal scores counted half.

    Equal scores are counted first; the ordered scan then sees distinct scores, in slices.
    Groups without both kinds have a null.
    """
    tally = rows.groupBy(*keys, score).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    walked = ordered_scan(tally, keys, [score], slice_by, {"neg_upto": running_sum("neg")})
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    return walked.groupBy(*keys).agg(
        F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc")
    )


def paired_permutation(
    pairs: DataFrame,
    keys: Sequence[str],
    unit: str,
    difference: str,
    permutations: int = 999,
    seed: int = 0,
    alternative: str = "two_sided",
) -> DataFrame:
    """p of each group's sum of paired differences under random signs of its units.

    A unit is any value with a text; rows of one unit share its sign.  Missing differences
    are left out.  Sums that differ by less than 2^-40 of all absolute differences are
    equal, so rounding makes no sum more extreme than the one observed.
    """
    if permutations < 999:
        raise ValueError("at least 999 permutations")
    held = _in_whole_steps(
        pairs.select(*keys, F.col(unit).alias("__unit"), F.col(difference).alias("__d")),
        keys, "__d", 0,
    )
    seen = held.groupBy(*keys).agg(
        F.count_distinct("__unit").alias("units"),
        F.sum("__v").alias("__seen"),
        F.shiftright(F.sum(F.abs("__v")), TIE_BITS).alias("__slack"),
        F.first("__step").alias("__step"),
    )
    bits = held.select(*keys, "__unit", "__v", _blocks(permutations, SIGNS)).withColumn(
        "__bits", sign_bits(seed, F.col("__block"), F.col("__unit"))
    )

    def signed(k: int) -> Column:
        return F.sum(
            F.when(F.col("__bits").bitwiseAND(F.lit(1 << k)) == 0, F.col("__v")).otherwise(-F.col("__v"))
        )

    sums = bits.groupBy(*keys, "__block").agg(*[signed(k).alias(f"__s{k}") for k in range(SIGNS)])
    observed, slack = F.col("__seen"), F.col("__slack")

    def extreme(s: Column) -> Column:
        return {
            "two_sided": F.abs(s) >= F.abs(observed) - slack,
            "greater": s >= observed - slack,
            "less": s <= observed + slack,
        }[alternative]

    hits = F.lit(0)
    for k in range(SIGNS):
        counted = F.col("__block") * SIGNS + k < permutations
        hits = hits + (counted & extreme(F.col(f"__s{k}"))).cast("int")
    return (
        sums.join(seen, list(keys))
        .select(*keys, "units", "__seen", "__step", hits.alias("__hits"))
        .groupBy(*keys)
        .agg(
            F.first("units").alias("units"),
            F.first(F.col("__seen") * F.col("__step")).alias("statistic"),
            ((F.sum("__hits") + 1) / F.lit(float(permutations + 1))).alias("p_value"),
        )
    )


def _null_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares of all sign choices whose positive rank sum is at most, and at least, w_plus.

    Dynamic programming over the doubled ranks: each unit halves the shares and adds them
    again, moved on by its rank.  Equal ranks are one entry with a count.
    """
    for batch in batches:
        below, above = [], []
        w_plus = batch.column("w_plus").to_pylist()
        for seen, ranks in zip(w_plus, batch.column("ranks").to_pylist(), strict=True):
            whole = sum(r["twice"] * r["n"] for r in ranks)
            share = np.zeros(whole + 1)
            share[0] = 1.0
            for r in ranks:
                for _ in range(r["n"]):
                    share *= 0.5
                    share[r["twice"] :] += share[: whole + 1 - r["twice"]].copy()
            at = round(2 * seen)
            below.append(min(1.0, float(share[: at + 1].sum())))
            above.append(min(1.0, float(share[at:].sum())))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-2], pa.array(below, pa.float64()), pa.array(above, pa.float64())],
            names=[*batch.schema.names[:-2], "__below", "__above"],
        )


def signed_rank(
    pairs: DataFrame,
    keys: Sequence[str],
    difference: str,
    slice_by: Column,
    alternative: str = "two_sided",
    exact_units: int = EXACT_UNITS,
) -> DataFrame:
    """Rank sums of positive and negative differences, z with the tie correction, and p.

    Zero, null and NaN differences drop out.  ``slice_by`` is a function of ``size``, the
    absolute difference; equal sizes are counted first and share their mean rank.  Groups of
    up to ``exact_units`` units get the p of the exact null distribution of their ranks, ties
    included (``method`` exact); larger ones the p of z (``method`` normal), which differs
    from the exact one by less than 0.01 from there on.
    """
    tally = (
        pairs.where((F.col(difference) != 0) & ~F.isnan(F.col(difference).cast("double")))
        .groupBy(*keys, F.abs(difference).alias("size"))
        .agg(F.count_if(F.col(difference) > 0).alias("pos"), F.count(F.lit(1)).alias("n"))
    )
    walked = materialise(
        ordered_scan(tally, keys, ["size"], slice_by, {"upto": running_sum("n")})
        .withColumn("twice", 2 * F.col("upto") - F.col("n") + 1)
        .select(*keys, "twice", "pos", "n"),
        "ranks",
    )
    twice = F.col("twice")
    sums = walked.groupBy(*keys).agg(
        F.sum("n").alias("units"),
        (F.sum(F.col("pos") * twice) / 2).alias("w_plus"),
        (F.sum((F.col("n") - F.col("pos")) * twice) / 2).alias("w_minus"),
        F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("__ties"),
    )
    u = F.col("units")
    spread = F.sqrt(u * (u + 1) * (2 * u + 1) / 24 - F.col("__ties") / 48)
    z = F.try_divide(F.col("w_plus") - u * (u + 1) / 4, spread)
    sums = sums.withColumn("z", z).drop("__ties")
    few = sums.where(u <= exact_units)
    ranks = (
        walked.join(few.select(*keys, "w_plus"), list(keys))
        .groupBy(*keys, "w_plus")
        .agg(F.collect_list(F.struct("twice", "n")).alias("ranks"))  # at most exact_units
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranks.schema[: len(keys)])
    shares = ranks.mapInArrow(_null_shares, f"{kinds}, __below double, __above double")
    by_z = {"less": normal_cdf(F.col("z")), "greater": normal_cdf(-F.col("z"))}
    by_count = {"less": F.col("__below"), "greater": F.col("__above")}
    for held in (by_z, by_count):
        held["two_sided"] = F.least(F.lit(1.0), 2.0 * F.least(held["less"], held["greater"]))
    exact = F.col("units") <= exact_units
    return sums.join(shares, list(keys), "left").select(
        *keys, "units", "w_plus", "w_minus", "z",
        F.when(exact, by_count[alternative]).otherwise(by_z[alternative]).alias("p_value"),
        F.when(exact, "exact").otherwise("normal").alias("method"),
    )


def holm(tests: DataFrame, family: Sequence[str], test: str, p_value: str) -> DataFrame:
    """Adjusted p of every test.  A family is the tests of one protocol, so it is short."""
    order = Window.partitionBy(*family).orderBy(p_value, test)
    size = F.count(F.lit(1)).over(Window.partitionBy(*family))
    stepped = tests.withColumn(
        "__step", F.least(F.lit(1.0), (size - F.row_number().over(order) + 1) * F.col(p_value))
    )
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stepped.withColumn("adjusted_p", F.max("__step").over(upto)).drop("__step")


def bootstrap_interval(
    rows: DataFrame,
    keys: Sequence[str],
    unit: str,
    value: str,
    level: float = 0.95,
    resamples: int = 999,
    seed: int = 0,
    method: str = "percentile",
) -> DataFrame:
    """Interval of each group's mean over resampled units: low, high.

    A unit's weight in a resample is a Poisson draw of mean one, made where the unit is, so
    units need no numbering and heavy groups no shuffle; given its total, such a resample is
    a draw of that many units with replacement.  Resamples without any unit are left out.
    ``bca`` shifts the wanted shares by the median bias of the resamples and by the
    acceleration, which the jackknife finds from totals less their own part; if every
    resample lies on one side of the mean the interval ends there.
    """
    if resamples < 999:
        raise ValueError("at least 999 resamples")
    if method not in ("percentile", "bca"):
        raise ValueError(f"unknown method {method}")
    held = _in_whole_steps(
        rows.select(*keys, F.col(unit).alias("__unit"), F.col(value).alias("__d")), keys, "__d", 3
    )
    blocks = held.select(*keys, "__unit", "__v", _blocks(resamples, WEIGHTS))
    drawn = blocks.withColumns({
        f"__w{k}": w for k, w in enumerate(weights(seed, F.col("__block"), F.col("__unit")))
    })
    totals = drawn.groupBy(*keys, "__block").agg(
        *[F.sum(f"__w{k}").alias(f"__n{k}") for k in range(WEIGHTS)],
        *[F.sum(F.col(f"__w{k}") * F.col("__v")).alias(f"__t{k}") for k in range(WEIGHTS)],
    )
    means = [
        F.when(
            F.col("__block") * WEIGHTS + k < resamples,
            F.try_divide(F.col(f"__t{k}").cast("double"), F.col(f"__n{k}").cast("double")),
        )
        for k in range(WEIGHTS)
    ]
    # One array of at most ``resamples`` means per group.
    found = (
        totals.select(*keys, F.explode(F.array(*means)).alias("__m"))
        .where("__m is not null")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("__m")).alias("__means"))
    )
    seen = held.groupBy(*keys).agg(
        F.first("__step").alias("__step"),
        F.count(F.lit(1)).alias("__n"),
        F.sum("__v").alias("__total"),
        F.max(F.abs("__v")).alias("__top"),
    )
    tail = (1 - level) / 2
    if method == "percentile":
        shares = [F.lit(tail), F.lit(1 - tail)]
        found = found.join(seen, list(keys))
    else:
        mean = F.col("__total").cast("double") / F.col("__n").cast("double")
        seen = seen.withColumn("__mean", mean)
        off = F.col("__v").cast("double") - F.col("__mean")
        moments = (
            held.select(*keys, "__v")
            .join(seen.select(*keys, "__mean"), list(keys))
            .groupBy(*keys)
            .agg(F.sum(off * off * off).alias("__cubes"), F.sum(off * off).alias("__squares"))
        )
        acceleration = F.coalesce(
            F.try_divide(F.col("__cubes"), 6.0 * F.pow(F.col("__squares"), F.lit(1.5))), F.lit(0.0)
        )
        slack = F.col("__top") * F.lit(2.0**-TIE_BITS)
        under = F.size(F.filter("__means", lambda m: m < F.col("__mean") - slack))
        over = F.size(F.filter("__means", lambda m: m > F.col("__mean") + slack))
        count = F.size("__means")
        bias = normal_quantile((under + (count - under - over) / 2.0) / count)
        found = (
            found.join(seen, list(keys)).join(moments, list(keys))
            .withColumns({"__bias": bias, "__speed": acceleration})
        )

        def shifted(share: float) -> Column:
            z = F.col("__bias") + normal_quantile(F.lit(share))
            moved = normal_cdf(F.col("__bias") + z / (1.0 - F.col("__speed") * z))
            return F.when(F.abs("__bias") == float("inf"), F.when(F.col("__bias") < 0, 0.0).otherwise(1.0)).otherwise(moved)

        shares = [shifted(tail), shifted(1 - tail)]

    def at(share: Column) -> Column:
        place = share * (F.size("__means") - 1)
        low = F.floor(place).cast("int")
        a = F.get("__means", low)
        b = F.get("__means", F.ceil(place).cast("int"))
        return (a + (b - a) * (place - low)) * F.col("__step")

    return found.select(*keys, at(shares[0]).alias("low"), at(shares[1]).alias("high"))


def reduce_units(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    reducer: str = "macro_mean",
    missing: str = "fail_closed",
    minimum_units: int = 2,
) -> DataFrame:
    """One value per group from one row per unit, with counts and a status.

    ``fail_closed`` gives no value where any unit lacks one; ``complete_case_with_audit``
    uses the others and counts what is missing.  Too few units give no value either.  A value
    that is not finite is missing.  Means are exact sums over the count; medians never hold
    a group in one task.
    """
    v = F.col(value).cast("double")
    known = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    counts = rows.groupBy(*keys).agg(
        F.count_if(known).alias("units_used"),
        (F.count(F.lit(1)) - F.count_if(known)).alias("units_missing"),
    )
    if reducer == "macro_mean":
        reduced = (
            _in_whole_steps(rows.select(*keys, v.alias("__d")), keys, "__d", 0)
            .groupBy(*keys)
            .agg((F.sum("__v").cast("double") / F.count(F.lit(1)) * F.first("__step")).alias("value"))
        )
    elif reducer == "median":
        reduced = exact_quantiles(
            rows.select(*keys, F.when(known, v).alias("__d")), keys, "__d", {"value": 0.5}
        )
    else:
        raise ValueError(f"unknown reducer {reducer}")
    status = (
        F.when(F.col("units_missing") > 0, "missing_values") if missing == "fail_closed" else F.when(F.lit(False), "")
    )
    status = status.when(F.col("units_used") < minimum_units, "too_few_units").otherwise("ok")
    return (
        counts.join(reduced, list(keys), "left")
        .withColumn("status", status)
        .select(
            *keys, "units_used", "units_missing",
            F.when(F.col("status") == "ok", F.col("value")).alias("value"), "status",
        )
    )


def plateau_stop(
    scores: DataFrame,
    keys: Sequence[str],
    order: str,
    score: str,
    slice_by: Column,
    minimum_candidates: int,
    patience: int,
    minimum_improvement: float,
) -> DataFrame:
    """Where each search stops: the first place from which the best has not grown enough.

    A place counts once ``minimum_candidates`` were seen; the best there is compared with
    the best ``patience`` places before.  ``stopped_at`` is null where it never stops.
    """
    walked = ordered_scan(
        scores, keys, [order], slice_by, {"place": POSITION, "best": running_max(score)}
    ).select(*keys, "place", "best")
    earlier = walked.select(*keys, (F.col("place") + patience).alias("place"), F.col("best").alias("past"))
    flat = F.col("past").isNotNull() & (F.col("best") - F.col("past") < minimum_improvement)
    stop = flat & (F.col("place") >= minimum_candidates)
    return (
        walked.join(earlier, [*keys, "place"], "left")
        .groupBy(*keys)
        .agg(F.max("place").alias("candidates"), F.min(F.when(stop, F.col("place"))).alias("stopped_at"))
    )
