"""Epoch signal measurement: quality, spectrum, separability, stability.

An epoch table has one row per trial and channel: subject_id, session_id, trial_idx,
channel_idx, label, sfreq, samples.  A trial table has one row per trial with its
channels laid end to end in ``samples`` and their number in ``channels``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions import kernels
from trialweave.operators import ordered
from trialweave.operators.checks import disagreements
from trialweave.operators.quantiles import (
    ACCURACY,
    EPSILON,
    few_values_quantiles,
    robust_z,
    robust_z_of_few,
)
from trialweave.session import materialise

SESSION = ["subject_id", "session_id"]
FLOOR = 1e-12

# Bands in Hz (both ends count), the total's band, peak ranges.
BANDS = {
    "theta_4_8": (4.0, 8.0),
    "mu_8_13": (8.0, 13.0),
    "beta_13_30": (13.0, 30.0),
    "motor_8_30": (8.0, 30.0),
}
TOTAL_BAND = (1.0, 45.0)
PEAKS = {"mu": (7.0, 15.0), "beta": (15.0, 30.0)}
# Flat threshold relative to the median deviation; outlier limit.
FLAT_RATIO = 1e-4
OUTLIER_Z = 6.0


def epochs_of_trials(trials: DataFrame) -> DataFrame:
    """One row per trial and channel; a narrow slice of the packed samples."""
    width = F.floor(F.size("samples") / F.col("channels")).cast("int")
    at = F.explode(F.sequence(F.lit(0), F.col("channels") - 1))
    return (
        trials.withColumn("channel_idx", at)
        .withColumn("samples", F.slice("samples", F.col("channel_idx") * width + 1, width))
        .drop("channels")
    )


def trials_of_epochs(epochs: DataFrame) -> DataFrame:
    """Pack the channels of each trial; a group is one trial's few channels."""
    return (
        epochs.groupBy(*SESSION, "trial_idx")
        .agg(
            F.first("label").alias("label"),
            F.first("sfreq").alias("sfreq"),
            F.count(F.lit(1)).cast("int").alias("channels"),
            F.array_sort(F.collect_list(F.struct("channel_idx", "samples"))).alias("c"),
        )
        .withColumn("samples", F.flatten(F.transform("c", lambda x: x["samples"])))
        .drop("c")
    )


def concatenate_sessions(trials: DataFrame, slice_by: Column) -> tuple[DataFrame, DataFrame]:
    """Sessions of each subject end to end with new trial numbers, and the faults.

    Faults (subject_id, field) name subjects whose sessions differ in channels, samples or
    rate; their trials are not joined.
    """
    faults = disagreements(trials, ["subject_id"], ["sfreq", "channels", "samples"])
    fitting = trials.join(faults.select("subject_id").distinct(), "subject_id", "left_anti")
    keyed = fitting.withColumn("__within", slice_by)
    scanned = ordered.ordered_position(
        keyed,
        ["subject_id"],
        ["session_id", "trial_id"],
        F.struct("session_id", "__within"),
        "__place",
    )
    joined = scanned.withColumn("trial_idx", F.col("__place") - 1).drop("__place", "__within")
    return joined, faults


# --- quality --------------------------------------------------------------------


def _finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def sample_moments(epochs: DataFrame) -> DataFrame:
    """Per row: sample count, finite count, mean, squared deviations, peak; NaN left out."""
    kept = F.filter("samples", lambda x: x.isNotNull() & ~F.isnan(x))
    size = F.size("__kept")
    total = F.aggregate("__kept", F.lit(0.0), lambda s, x: s + x)
    dev = F.aggregate(
        "__kept", F.lit(0.0), lambda s, x: s + (x - F.col("__mean")) * (x - F.col("__mean"))
    )
    return (
        epochs.withColumn("__kept", kept)
        .withColumn("__mean", F.when(size > 0, total / size))
        .select(
            *SESSION,
            "trial_idx",
            "channel_idx",
            F.size("samples").alias("samples_n"),
            F.size(F.filter("samples", _finite)).alias("finite_n"),
            size.alias("n"),
            F.col("__mean").alias("mean"),
            dev.alias("m2"),
            F.array_max(F.transform("__kept", F.abs)).alias("peak"),
        )
    )


def channel_deviation(moments: DataFrame) -> DataFrame:
    """Population deviation per channel from per-row moments.

    The spread of the row means is taken around the channel's mean in a second pass over
    the moment rows; a difference of squares would drown it where the level is high.
    """
    by = [*SESSION, "channel_idx"]
    grand = moments.groupBy(*by).agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("__grand")
    )
    between = F.col("n") * F.pow(F.col("mean") - F.col("__grand"), 2)
    merged = moments.join(grand, by).groupBy(*by).agg(
        F.sum(F.col("m2") + between).alias("ss"), F.sum("n").alias("n")
    )
    return merged.select(*by, F.sqrt(F.col("ss") / F.col("n")).alias("std"))


def channel_flags(deviation: DataFrame) -> DataFrame:
    """Flat and robust-outlier flags per channel; flags never drop a row.

    One row per channel comes in, so a session's group is as long as its montage.
    """
    spread = few_values_quantiles(
        deviation, SESSION, "std", {"std_median": 0.5, "std_q25": 0.25, "std_q75": 0.75}
    )
    scored = robust_z_of_few(
        deviation.withColumn("__log", F.log(F.col("std") + FLOOR)), SESSION, "__log", "z"
    )
    flat = F.col("std") <= F.greatest(F.lit(EPSILON), F.col("std_median") * FLAT_RATIO)
    return scored.join(spread, SESSION).select(
        *SESSION,
        "channel_idx",
        "std",
        "std_median",
        (F.col("std_q75") - F.col("std_q25")).alias("std_iqr"),
        flat.alias("flat"),
        (F.abs("z") > OUTLIER_Z).alias("outlier"),
    )


def trial_flags(moments: DataFrame, accuracy: int = ACCURACY) -> DataFrame:
    """Robust-outlier flag per trial from its largest absolute sample."""
    peaks = moments.groupBy(*SESSION, "trial_idx").agg(F.max("peak").alias("peak"))
    scored = robust_z(
        peaks.withColumn("__log", F.log(F.col("peak") + FLOOR)), SESSION, "__log", "z", accuracy
    )
    return scored.select(*SESSION, "trial_idx", "peak", (F.abs("z") > OUTLIER_Z).alias("outlier"))


def signal_quality(epochs: DataFrame, accuracy: int = ACCURACY) -> DataFrame:
    """One row per session: counts, finite fraction, deviation summary, flag counts."""
    # Raw samples are read once; all below works on a few numbers per row.
    moments = materialise(sample_moments(epochs), "sample-moments")
    channels = channel_flags(channel_deviation(moments))
    trials = trial_flags(moments, accuracy)
    base = moments.groupBy(*SESSION).agg(
        (F.sum("finite_n") / F.sum("samples_n")).alias("finite_fraction"),
        F.max("samples_n").alias("sample_count"),
    )
    per_channel = channels.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("channel_count"),
        F.max("std_median").alias("channel_std_median"),
        F.max("std_iqr").alias("channel_std_iqr"),
        F.count_if("flat").alias("flat_channels"),
        F.count_if("outlier").alias("outlier_channels"),
    )
    per_trial = trials.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("trial_count"), F.count_if("outlier").alias("outlier_trials")
    )
    return base.join(per_channel, SESSION).join(per_trial, SESSION)


# --- spectrum -------------------------------------------------------------------


def power_density(epochs: DataFrame) -> DataFrame:
    """Add ``psd`` (Welch) and ``bin_hz``; rows with non-finite samples get null."""

    @F.pandas_udf("array<double>")
    def welch(samples: pd.Series, sfreq: pd.Series) -> pd.Series:
        return kernels.welch_batch(samples, sfreq)

    n = F.least(F.size("samples"), F.greatest(F.lit(64), F.rint("sfreq").cast("int")))
    return epochs.withColumn("bin_hz", F.col("sfreq") / n).withColumn(
        "psd", welch(F.col("samples"), F.col("sfreq"))
    )


def band_power(psd: Column, bin_hz: Column, low: Column | float, high: Column | float) -> Column:
    """Trapezoid of a density array over the bins inside a band; null below two bins."""
    low = F.lit(low) if isinstance(low, float) else low
    high = F.lit(high) if isinstance(high, float) else high
    first = F.ceil(low / bin_hz - 1e-9).cast("int")
    last = F.least(F.floor(high / bin_hz + 1e-9).cast("int"), F.size(psd) - 1)
    inside = F.slice(psd, F.greatest(first, F.lit(0)) + 1, F.greatest(last - first + 1, F.lit(0)))
    total = F.aggregate(inside, F.lit(0.0), lambda s, p: s + p)
    ends = (F.get(psd, first) + F.get(psd, last)) / 2
    return F.when(last > first, (total - ends) * bin_hz)


def mean_spectrum(densities: DataFrame) -> DataFrame:
    """Mean density per session and bin over trials and channels."""
    return (
        densities.select(*SESSION, "bin_hz", F.posexplode("psd").alias("bin", "power"))
        .groupBy(*SESSION, "bin")
        .agg(F.avg("power").alias("power"), F.first("bin_hz").alias("bin_hz"))
        .withColumn("hz", F.col("bin") * F.col("bin_hz"))
    )


def adjacent_areas(spectrum: DataFrame) -> DataFrame:
    """Add ``area``, the trapezoid between each bin and the one before, null for the first.

    A session has as many rows as bins.  Summed over the bins of a band, less the first,
    they are its power."""
    before = F.lag("power").over(Window.partitionBy(*SESSION).orderBy("bin"))
    return spectrum.withColumn("area", (F.col("power") + before) / 2 * F.col("bin_hz"))


def spectral_profile(epochs: DataFrame) -> DataFrame:
    """One row per session and band or peak: absolute and relative power, frequency.

    Bands and peaks come from one aggregate over the session's mean spectrum.  On its
    uniform grid a trapezoid is the sum of the bins less half of both ends.
    """
    spectrum = mean_spectrum(power_density(epochs))
    aggs: list[Column] = []
    for name, (low, high) in {**BANDS, "total": TOTAL_BAND}.items():
        inside = (F.col("hz") >= low) & (F.col("hz") <= high)
        value, hz = F.when(inside, F.col("power")), F.when(inside, F.col("hz"))
        ends = (F.min_by("power", hz) + F.max_by("power", hz)) / 2
        aggs.append(F.when(F.count(value) >= 2, (F.sum(value) - ends) * F.first("bin_hz")).alias(name))
    for name, (low, high) in PEAKS.items():
        inside = (F.col("hz") >= low) & (F.col("hz") <= high)
        order = F.when(inside, F.struct(F.col("power"), -F.col("hz")))
        aggs += [
            F.max_by("hz", order).alias(f"{name}_hz"),
            F.max_by("power", order).alias(f"{name}_power"),
        ]
    none = F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(name).alias("measure"),
            none.alias("hz"),
            F.col(name).alias("power"),
            F.try_divide(F.col(name), F.col("total")).alias("relative"),
        )
        for name in BANDS
    ] + [
        F.struct(
            F.lit(f"{name}_peak").alias("measure"),
            F.col(f"{name}_hz").alias("hz"),
            F.col(f"{name}_power").alias("power"),
            none.alias("relative"),
        )
        for name in PEAKS
    ]
    return spectrum.groupBy(*SESSION).agg(*aggs).select(*SESSION, F.inline(F.array(*rows)))


# --- separability ---------------------------------------------------------------


def log_band_features(densities: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """One row per epoch and band with ``feature`` = ln(band power + 1e-12)."""
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("band"),
                    F.log(band_power(F.col("psd"), F.col("bin_hz"), low, high) + FLOOR).alias("feature"),
                )
                for name, (low, high) in bands.items()
            ]
        )
    )
    return densities.select(*SESSION, "trial_idx", "channel_idx", "label", rows.alias("r")).select(
        *SESSION, "trial_idx", "channel_idx", "label", "r.band", "r.feature"
    )


def class_effects(
    features: DataFrame, keys: Sequence[str], channel: str, label: str, feature: str
) -> DataFrame:
    """Standardised class difference per key and channel, later label minus earlier.

    Keys need exactly two labels; others get no row.  One shuffle: (key, channel,
    label) moments combine map-side; the rest works on those few rows.
    """
    keys = list(keys)
    moments = features.groupBy(*keys, channel, label).agg(
        F.count(feature).alias("__n"), F.avg(feature).alias("__m"), F.var_pop(feature).alias("__v")
    )
    pair = moments.groupBy(*keys, channel).agg(
        F.count(F.lit(1)).alias("__labels"),
        F.min(label).alias("left_label"),
        F.max(label).alias("right_label"),
        F.min_by("__m", label).alias("__ml"),
        F.max_by("__m", label).alias("__mr"),
        F.min_by("__v", label).alias("__vl"),
        F.max_by("__v", label).alias("__vr"),
        F.min_by("__n", label).alias("left_n"),
        F.max_by("__n", label).alias("right_n"),
    )
    pooled = F.sqrt((F.col("__vl") + F.col("__vr")) / 2 + FLOOR)
    return pair.where("__labels = 2").select(
        *keys,
        channel,
        "left_label",
        "right_label",
        "left_n",
        "right_n",
        ((F.col("__mr") - F.col("__ml")) / pooled).alias("effect"),
    )


def effect_summary(effects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median and largest absolute effect over the channels of each key."""
    sized = effects.withColumn("__abs", F.abs("effect"))
    return few_values_quantiles(
        sized, keys, "__abs", {"median_abs_effect": 0.5, "max_abs_effect": 1.0}
    )


def top_effects(effects: DataFrame, keys: Sequence[str], channel: str, k: int = 10) -> DataFrame:
    """Channels with the largest absolute effects; lowest channel first on ties."""
    return ordered.top_rows(effects, keys, [F.abs("effect").desc(), F.col(channel)], k, "place")


def class_separability(epochs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, top channels) per session and band; ten broad, three narrow."""
    bands = {n: BANDS[n] for n in ("motor_8_30", "mu_8_13", "beta_13_30")}
    # A few numbers per session, band and channel; written, so that medians and
    # rankings do not measure the signals again.
    effects = materialise(
        class_effects(
            log_band_features(power_density(epochs), bands), [*SESSION, "band"], "channel_idx", "label", "feature"
        ),
        "class-effects",
    )
    top = top_effects(effects, [*SESSION, "band"], "channel_idx", 10)
    return (
        effect_summary(effects, [*SESSION, "band"]),
        top.where((F.col("band") == "motor_8_30") | (F.col("place") <= 3)),
    )


# --- stability ------------------------------------------------------------------


def guarded_correlation(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson correlation from moments; null where a side is constant."""
    cov = F.covar_pop(x, y)
    return rows.groupBy(*keys).agg(
        cov.alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy")
    ).select(*keys, F.try_divide(F.col("c"), F.sqrt(F.col("vx") * F.col("vy"))).alias("correlation"))


def alternate_halves(trials: DataFrame, slice_by: Column) -> DataFrame:
    """Even and odd trials within each session and label, by trial order."""
    placed = ordered.ordered_position(trials, [*SESSION, "label"], ["trial_idx"], slice_by, "__p")
    return placed.withColumn("half", (F.col("__p") - 1) % 2).drop("__p")


def written_features(epochs: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Log band features in the shared folder, for the measures that read them often."""
    return materialise(log_band_features(power_density(epochs), bands), "band-features")


def split_half_stability(features: DataFrame, slice_by: Column) -> DataFrame:
    """Correlation over channels of the class effects of two alternating halves."""
    halves = alternate_halves(
        features.select(*SESSION, "trial_idx", "label").distinct(), slice_by
    ).select(*SESSION, "trial_idx", "half")
    effects = class_effects(
        features.join(halves, [*SESSION, "trial_idx"]), [*SESSION, "half"], "channel_idx", "label", "feature"
    )
    sides = effects.groupBy(*SESSION, "channel_idx").agg(
        F.max(F.when(F.col("half") == 0, F.col("effect"))).alias("a"),
        F.max(F.when(F.col("half") == 1, F.col("effect"))).alias("b"),
    )
    return guarded_correlation(sides, SESSION, "a", "b")


def session_pairs(
    summaries: DataFrame, keys: Sequence[str], session: str, values: Sequence[str]
) -> DataFrame:
    """Each pair of a key's sessions once, the lesser first: left_ and right_ of the session
    and of every value.  A key has a handful of summary rows, one per session."""
    left = summaries.select(*keys, *[F.col(c).alias(f"left_{n}") for c, n in _sides(session, values)])
    right = summaries.select(*keys, *[F.col(c).alias(f"right_{n}") for c, n in _sides(session, values)])
    return left.join(right, list(keys)).where("left_session < right_session")


def _sides(session: str, values: Sequence[str]) -> list[tuple[str, str]]:
    return [(session, "session"), *[(v, v) for v in values]]


def session_pair_stability(features: DataFrame) -> DataFrame:
    """Effect correlation and RMS log-power shift for each pair of a subject's sessions.

    The join runs over (session, channel) summaries on (subject, channel); a subject
    has a handful of sessions whatever the number of trials.
    """
    effects = class_effects(features, SESSION, "channel_idx", "label", "feature")
    levels = features.groupBy(*SESSION, "channel_idx").agg(F.avg("feature").alias("level"))
    summary = effects.join(levels, [*SESSION, "channel_idx"])
    pairs = session_pairs(summary, ["subject_id", "channel_idx"], "session_id", ["effect", "level"])
    keys = ["subject_id", "left_session", "right_session"]
    gap = F.col("left_level") - F.col("right_level")
    shift = pairs.groupBy(*keys).agg(F.sqrt(F.avg(gap * gap)).alias("rms_shift"))
    return guarded_correlation(pairs, keys, "left_effect", "right_effect").join(shift, keys)
