"""Candidate evaluation as one job over (subject, candidate, fold).

Raw samples are filtered once per trial and distinct band; each trial then shrinks to
its channel covariance.  Features, spatial filters, standardisation and classifier
statistics are sums of those small rows.  Sums are taken once per fold, and the
training side of a fold is the total less its own fold, so no trial is copied to every
training set.

Trial table: subject_id, trial_id, label, sfreq, channels, samples (channel-major).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions import kernels
from trialweave.functions.hashing import content_hash
from trialweave.functions.parameters import BANDS
from trialweave.operators.checks import Rule, holds, violations
from trialweave.operators.ordered import hash_slice, ordered_position
from trialweave.operators.sums import array_sums
from trialweave.session import materialise

FLOOR = 1e-12
TRACE_FLOOR = 2.220446049250313e-16


@dataclass(frozen=True)
class Candidate:
    """One decoding configuration; a handful of them are literals of the plan."""

    pipeline_id: str
    family: str
    low: float
    high: float
    csp_components: int = 0
    lda_shrinkage: float = 0.1
    cv_folds: int = 3
    random_seed: int = 0

    @property
    def spatial(self) -> bool:
        return self.family == "csp_lda"


def default_candidates(seed: int = 0, components: int = 4, folds: int = 3) -> list[Candidate]:
    return [
        Candidate(
            f"{family}-{int(low)}-{int(high)}",
            family,
            low,
            high,
            components if family == "csp_lda" else 0,
            0.1,
            folds,
            seed,
        )
        for low, high in BANDS
        for family in ("bandpower_lda", "csp_lda")
    ]


def _bands(candidates: Sequence[Candidate]) -> list[tuple[float, float]]:
    return sorted({(c.low, c.high) for c in candidates})


def _splits(candidates: Sequence[Candidate]) -> list[tuple[int, int]]:
    return sorted({(c.cv_folds, c.random_seed) for c in candidates})


def configuration_hash() -> Column:
    """Identity of a configuration row without its display id."""
    return content_hash(
        [
            F.col(c)
            for c in (
                "family", "low", "high", "spatial_filter", "csp_components",
                "feature", "model", "lda_shrinkage", "cv_folds", "random_seed",
            )
        ]
    )


# --- guards ---------------------------------------------------------------------


def subject_facts(summaries: DataFrame) -> DataFrame:
    """One row per subject: its two labels, their trial counts, and signal shape.

    Works on trial summaries, so the raw samples are read once only.
    """
    shape = ("sfreq", "channels", "width")
    per_label = summaries.groupBy("subject_id", "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("covs").isNotNull()).alias("finite"),
        *[F.min(c).alias(f"{c}_lo") for c in shape],
        *[F.max(c).alias(f"{c}_hi") for c in shape],
    )
    return per_label.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("labels"),
        F.min("label").alias("class_0"),
        F.max("label").alias("class_1"),
        F.min_by("n", "label").alias("n_0"),
        F.max_by("n", "label").alias("n_1"),
        F.bool_and("finite").alias("finite"),
        *[F.min(f"{c}_lo").alias(f"{c}_lo") for c in shape],
        *[F.max(f"{c}_hi").alias(f"{c}_hi") for c in shape],
    )


def refusal_rules(candidates: Sequence[Candidate]) -> list[Rule]:
    """What a subject's facts must meet before any candidate runs."""
    most_folds = max(c.cv_folds for c in candidates)
    highest = max(c.high for c in candidates)
    needed = max(c.csp_components for c in candidates)
    same = (
        (F.col("sfreq_lo") == F.col("sfreq_hi"))
        & (F.col("channels_lo") == F.col("channels_hi"))
        & (F.col("width_lo") == F.col("width_hi"))
    )
    return [
        ("two_labels", F.col("labels") == 2),
        ("label_has_a_trial_per_fold", F.least("n_0", "n_1") >= most_folds),
        ("samples_finite", F.col("finite")),
        ("one_signal_shape", same),
        ("band_below_nyquist", F.col("sfreq_lo") / 2 > highest),
        ("samples_cover_padding", F.col("width_lo") > kernels.PAD),
        ("components_within_channels", F.col("channels_lo") >= needed),
    ]


def decoding_faults(summaries: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    """(subject_id, rule_id) for subjects the executor refuses."""
    return violations(subject_facts(summaries), ["subject_id"], refusal_rules(candidates))


def accepted(summaries: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    """Rows of subjects without a fault, with ``class`` and the class's trial count.

    Class 0 is the lower label.  One join with the per-subject facts does all three.
    """
    good = (
        subject_facts(summaries)
        .where(holds(refusal_rules(candidates)))
        .select("subject_id", "class_0", "n_0", "n_1")
    )
    first = F.col("label") == F.col("class_0")
    return (
        summaries.join(good, "subject_id")
        .withColumn("class", F.when(first, 0).otherwise(1))
        .withColumn("class_trials", F.when(first, F.col("n_0")).otherwise(F.col("n_1")))
        .drop("class_0", "n_0", "n_1")
    )


# --- filtering ------------------------------------------------------------------


def bandpass(epochs: DataFrame, low: float, high: float) -> DataFrame:
    """Zero-phase band-pass of each row's samples; null where refused."""

    @F.pandas_udf("array<double>")
    def run(samples: pd.Series, sfreq: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        return kernels.bandpass_batch(samples, sfreq, lo, hi)

    return epochs.withColumn(
        "filtered", run(F.col("samples"), F.col("sfreq"), F.lit(float(low)), F.lit(float(high)))
    )


def trial_summaries(trials: DataFrame, bands: Sequence[tuple[float, float]]) -> DataFrame:
    """One small row per trial: the channel covariance of each filtered band.

    ``covs`` is null where samples are not finite; a band the signal cannot carry is
    null inside it.  Map-only: raw samples are never shuffled.
    """
    wanted = sorted(set(bands), key=lambda b: (b[0] is not None, b))

    @F.pandas_udf("array<array<double>>")
    def run(samples: pd.Series, channels: pd.Series, sfreq: pd.Series) -> pd.Series:
        return kernels.covariance_batch(samples, channels, sfreq, wanted)

    kept = [c for c in trials.columns if c != "samples"]
    return trials.select(
        *kept,
        (F.size("samples") / F.col("channels")).cast("int").alias("width"),
        run(F.col("samples"), F.col("channels"), F.col("sfreq")).alias("covs"),
    )


#: The band of the unfiltered signal.
UNFILTERED = (None, None)


def covariance_rows(trials: DataFrame, band: tuple = UNFILTERED) -> DataFrame:
    """One row per trial with the channel covariance of one band, by default of the raw
    signal; trials without a finite one are left out."""
    return band_rows(trial_summaries(trials, [band])).drop("band")


def summarise(trials: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    """Trial summaries written to the shared folder: the one pass over raw samples."""
    return materialise(trial_summaries(trials, _bands(candidates)), "trial-summaries")


def band_rows(summaries: DataFrame) -> DataFrame:
    """One row per trial and band (numbered in band order) with its covariance."""
    named = F.transform("covs", lambda cov, i: F.struct(i.alias("band"), cov.alias("cov")))
    rest = [c for c in summaries.columns if c != "covs"]
    return summaries.select(*rest, F.inline(named)).where(F.col("cov").isNotNull())


# --- folds ----------------------------------------------------------------------


def fold_of_place(place: Column, size: Column, folds: int) -> Column:
    """Part number of a place (from 1) when ``size`` places are cut into even parts.

    Parts of size q + 1 come first, r of them, as an even split does.
    """
    q, r, at = F.floor(size / folds), size % folds, place - 1
    large = r * (q + 1)
    fold = F.when(at < large, F.floor(at / (q + 1))).otherwise(r + F.floor((at - large) / q))
    return F.when(q > 0, fold).otherwise(at).cast("int")


def stratified_folds(
    trials: DataFrame, keys: Sequence[str], trial: str, size: str, folds: int, seed: int
) -> DataFrame:
    """Add ``fold``: hashed order within ``keys`` cut into near-equal parts.

    ``keys`` name the stratum (subject and class), ``size`` its number of trials.  The
    order hash spreads evenly, so cutting its range cuts a large stratum into slices of
    equal size, and a subject with most of the trials is still ranked by many tasks.
    """
    text = F.concat_ws(":", F.lit(str(seed)), F.col(trial).cast("string"))
    hashed = trials.withColumn("__h", F.sha2(text, 256))
    placed = ordered_position(hashed, list(keys), ["__h"], hash_slice("__h", F.col(size)), "__p")
    return placed.withColumn("fold", fold_of_place(F.col("__p"), F.col(size), folds)).drop("__h", "__p")


def with_folds(labelled: DataFrame, splits: Sequence[tuple[int, int]]) -> DataFrame:
    """Rows repeated per (folds, seed) in use, with ``split`` and ``fold``."""
    parts = [
        stratified_folds(labelled, ["subject_id", "class"], "trial_id", "class_trials", k, seed).withColumn(
            "split", F.lit(i)
        )
        for i, (k, seed) in enumerate(splits)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- sums -----------------------------------------------------------------------


def gathered_sums(rows: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """One row per key: sums of ``vector`` laid out by class, fold and element.

    Arrays are added as arrays, inside the tasks first; gathered are one array per class
    and fold.
    """
    sums = array_sums(rows, [*keys, "class", "fold"], vector)
    cells = F.array_sort(F.collect_list(F.struct("class", "fold", "total", "n")))
    return (
        sums.groupBy(*keys)
        .agg(cells.alias("__c"))
        .select(
            *keys,
            F.flatten(F.transform("__c", lambda c: c["total"])).alias("sums"),
            F.transform("__c", lambda c: c["n"]).alias("counts"),
            F.array_sort(F.array_distinct(F.transform("__c", lambda c: c["fold"]))).alias("folds"),
        )
    )


def normalised_covariance(cov: Column, channels: Column) -> Column:
    """Covariance over its trace."""
    trace = F.aggregate(
        F.sequence(F.lit(0), channels - 1),
        F.lit(0.0),
        lambda s, i: s + F.get(cov, i * (channels + 1)),
    )
    return F.transform(cov, lambda x: x / F.greatest(trace, F.lit(TRACE_FLOOR)))


def mean_covariances(covs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, mean_covariance): mean of the trials' covariances over their traces, flat."""
    normal = covs.withColumn("__cov", normalised_covariance(F.col("cov"), F.col("channels")))
    return array_sums(normal, keys, "__cov").select(
        *keys, F.transform("total", lambda x: x / F.col("n")).alias("mean_covariance")
    )


def log_shares(cov: Column, channels: Column) -> Column:
    """Log of each channel's share of the variance."""
    own = F.transform(
        F.sequence(F.lit(0), channels - 1), lambda i: F.get(cov, i * (channels + 1))
    )
    whole = F.aggregate(own, F.lit(0.0), lambda s, v: s + v)
    return F.transform(own, lambda v: F.log(v / whole + FLOOR))


def log_variances(cov: Column, channels: Column, width: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), channels - 1),
        lambda i: F.log(F.get(cov, i * (channels + 1)) / width + FLOOR),
    )


# --- spatial filters ------------------------------------------------------------


def fit_spatial_filters(covs: DataFrame, components: Sequence[int]) -> DataFrame:
    """(subject, band, split, csp_components, held, filters) from class covariances.

    Expects subject_id, band, split, fold, class, channels, cov.  Each fold's filters
    are fitted on the other folds.
    """
    keys = ["subject_id", "band", "split"]
    normal = covs.withColumn("cov", normalised_covariance(F.col("cov"), F.col("channels")))

    @F.pandas_udf("array<array<double>>")
    def run(sums: pd.Series, counts: pd.Series, k: pd.Series) -> pd.Series:
        return kernels.spatial_filters_batch(sums, counts, k)

    wanted = F.explode(F.array(*[F.lit(int(k)) for k in components]))
    fitted = gathered_sums(normal, keys, "cov").withColumn("csp_components", wanted)
    per_fold = fitted.select(
        *keys,
        "csp_components",
        "folds",
        F.posexplode(run(F.col("sums"), F.col("counts"), F.col("csp_components"))).alias("at", "filters"),
    )
    return per_fold.select(*keys, "csp_components", F.get("folds", F.col("at")).alias("held"), "filters")


def spatial_features(covs: DataFrame, filters: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add ``x``: log share of each projected variance."""

    @F.pandas_udf("array<double>")
    def run(cov: pd.Series, w: pd.Series) -> pd.Series:
        return kernels.projected_shares_batch(cov, w)

    return covs.join(filters, list(on)).withColumn(
        "x", run(F.col("cov"), F.col("filters"))
    )


# --- classifier -----------------------------------------------------------------


def moment_vector(x: Column) -> Column:
    """One array per row: 1, the features, and their products; summing it gives all
    that standardisation and the classifier need."""
    products = F.flatten(F.transform(x, lambda a: F.transform(x, lambda b: a * b)))
    return F.concat(F.array(F.lit(1.0)), x, products)


def class_moments(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, sums, counts, folds) of moment vectors by class and fold."""
    return gathered_sums(features.withColumn("m", moment_vector(F.col("x"))), keys, "m")


MODEL_TYPE = (
    "array<struct<center:array<double>,scale:array<double>,means:array<double>,"
    "precision:array<double>,weights:array<double>,bias:array<double>>>"
)


def fit_classifier(moments: DataFrame, keys: Sequence[str], holdout: bool) -> DataFrame:
    """Shrinkage discriminant per row of class moments and fold; needs ``shrinkage``.

    ``holdout`` says that a fold's sums are its own trials, to be left out of its
    training; otherwise they are its training trials already.
    """

    @F.pandas_udf(MODEL_TYPE)
    def run(sums: pd.Series, counts: pd.Series, shrinkage: pd.Series) -> pd.Series:
        return kernels.discriminant_batch(sums, counts, holdout, shrinkage)

    fitted = moments.select(
        *keys,
        "folds",
        F.posexplode(run(F.col("sums"), F.col("counts"), F.col("shrinkage"))).alias("at", "m"),
    )
    return fitted.select(*keys, F.get("folds", F.col("at")).alias("fold"), "m.*")


STATISTICS_TYPE = (
    "array<struct<center:array<double>,scale:array<double>,means:array<double>,"
    "covariance:array<double>,priors:array<double>>>"
)


def classifier_statistics(moments: DataFrame, keys: Sequence[str], holdout: bool) -> DataFrame:
    """Scaling, standardised class means, shrunk covariance and priors per row and fold:
    what :func:`fit_classifier` makes its models from, by the same kernel."""

    @F.pandas_udf(STATISTICS_TYPE)
    def run(sums: pd.Series, counts: pd.Series, shrinkage: pd.Series) -> pd.Series:
        return kernels.statistics_batch(sums, counts, holdout, shrinkage)

    found = moments.select(
        *keys,
        "folds",
        F.posexplode(run(F.col("sums"), F.col("counts"), F.col("shrinkage"))).alias("at", "s"),
    )
    return found.select(*keys, F.get("folds", F.col("at")).alias("fold"), "s.*")


def standardised_features(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``z``: held-out features scaled by the mean and deviation of the other folds."""
    moments = class_moments(features, keys).withColumn("shrinkage", F.lit(0.0))
    scales = classifier_statistics(moments, keys, holdout=True).select(*keys, "fold", "center", "scale")
    centred = F.zip_with("x", "center", lambda a, b: a - b)
    return (
        features.join(scales, [*keys, "fold"])
        .withColumn("z", F.zip_with(centred, "scale", lambda a, b: a / b))
        .drop("center", "scale")
    )


def discriminant_scores(x: Column, weights: Column, bias: Column) -> tuple[Column, Column]:
    """Linear score of each of the two classes, in the JVM."""
    size = F.size(x)

    def score(k: int) -> Column:
        w = F.slice(weights, F.lit(1) + size * k, size)
        return F.aggregate(
            F.zip_with(x, w, lambda a, b: a * b), F.get(bias, F.lit(k)), lambda s, v: s + v
        )

    return score(0), score(1)


def predicted_class(x: Column, weights: Column, bias: Column) -> Column:
    """First largest score wins."""
    a, b = discriminant_scores(x, weights, bias)
    return F.when(b > a, 1).otherwise(0)


# --- metrics --------------------------------------------------------------------


def classification_metrics(predictions: DataFrame, keys: Sequence[str], label: str, predicted: str) -> DataFrame:
    """Accuracy, balanced accuracy over true labels, kappa; from a confusion table."""
    keys = list(keys)
    cells = predictions.groupBy(*keys, label, predicted).agg(F.count(F.lit(1)).alias("__n"))
    both = F.explode(
        F.array(
            F.struct(F.lit("true").alias("side"), F.col(label).alias("value")),
            F.struct(F.lit("predicted").alias("side"), F.col(predicted).alias("value")),
        )
    )
    hit = F.when((F.col(label) == F.col(predicted)), F.col("__n")).otherwise(0)
    margins = (
        cells.select(*keys, "__n", hit.alias("__hit"), both.alias("__side"))
        .groupBy(*keys, F.col("__side.value").alias("__value"))
        .agg(
            F.sum(F.when(F.col("__side.side") == "true", F.col("__n")).otherwise(0)).alias("__t"),
            F.sum(F.when(F.col("__side.side") == "predicted", F.col("__n")).otherwise(0)).alias("__p"),
            F.sum(F.when(F.col("__side.side") == "true", F.col("__hit")).otherwise(0)).alias("__h"),
        )
    )
    total = F.sum("__t")
    summed = margins.groupBy(*keys).agg(
        total.alias("trials"),
        (F.sum("__h") / total).alias("accuracy"),
        F.avg(F.when(F.col("__t") > 0, F.col("__h") / F.col("__t"))).alias("balanced_accuracy"),
        (F.sum(F.col("__t") / F.lit(1.0) * F.col("__p")) / (total / F.lit(1.0) * total)).alias("__chance"),
    )
    kappa = F.when(
        F.col("__chance") < 1.0,
        (F.col("accuracy") - F.col("__chance")) / (1 - F.col("__chance")),
    ).otherwise(F.lit(0.0))
    return summed.withColumn("kappa", kappa).withColumn("cohen_kappa", kappa).drop("__chance")


# --- jobs -----------------------------------------------------------------------


def _candidate_rows(candidates: Sequence[Candidate]) -> Column:
    bands, splits = _bands(candidates), _splits(candidates)
    return F.array(
        *[
            F.struct(
                F.lit(c.pipeline_id).alias("pipeline_id"),
                F.lit(bands.index((c.low, c.high))).alias("c_band"),
                F.lit(splits.index((c.cv_folds, c.random_seed))).alias("c_split"),
                F.lit(c.csp_components if c.spatial else 0).alias("csp_components"),
                F.lit(float(c.lda_shrinkage)).alias("shrinkage"),
            )
            for c in candidates
        ]
    )


FEATURE_KEY = ["subject_id", "band", "split", "csp_components"]


def _with_candidates(moments: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    """Candidates that share features share their moments; shrinkage differs."""
    return (
        moments.withColumn("c", F.explode(_candidate_rows(candidates)))
        .where(
            (F.col("c.c_band") == F.col("band"))
            & (F.col("c.c_split") == F.col("split"))
            & (F.col("c.csp_components") == F.col("csp_components"))
        )
        .select(*moments.columns, "c.pipeline_id", "c.shrinkage")
    )


def _prepared(
    summaries: DataFrame, candidates: Sequence[Candidate], splits: Sequence[tuple[int, int]]
) -> DataFrame:
    """Band rows of accepted subjects with class and fold, written once for the steps
    that read them: spatial filters, training sums and held-out features."""
    labelled = accepted(summaries, candidates)
    if splits:
        placed = with_folds(labelled, splits)
    else:
        placed = labelled.withColumn("split", F.lit(0)).withColumn("fold", F.lit(-1))
    rows = band_rows(placed).select(
        "subject_id", "trial_id", "class", "channels", "width", "split", "fold", "band", "cov"
    )
    return materialise(rows, "band-rows")


def predictions(summaries: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    """Out-of-fold prediction of every trial by every candidate.

    (subject_id, pipeline_id, fold, trial_id, class, predicted)
    """
    candidates = list(candidates)
    covs = _prepared(summaries, candidates, _splits(candidates))
    feature_rows: list[DataFrame] = []
    model_rows: list[DataFrame] = []
    keep = [*FEATURE_KEY, "fold", "trial_id", "class", "x"]

    def models_of(features: DataFrame, holdout: bool) -> DataFrame:
        moments = _with_candidates(class_moments(features, FEATURE_KEY), candidates)
        return fit_classifier(moments, [*FEATURE_KEY, "pipeline_id"], holdout)

    if any(not c.spatial for c in candidates):
        x = log_variances(F.col("cov"), F.col("channels"), F.col("width"))
        plain = covs.withColumn("x", x).withColumn("csp_components", F.lit(0)).select(*keep)
        feature_rows.append(plain)
        model_rows.append(models_of(plain, holdout=True))
    components = sorted({c.csp_components for c in candidates if c.spatial})
    if components:
        filters = materialise(fit_spatial_filters(covs, components), "spatial-filters")
        spatial = spatial_features(covs, filters, ["subject_id", "band", "split"])
        train = spatial.where(F.col("fold") != F.col("held")).drop("fold")
        model_rows.append(models_of(train.withColumnRenamed("held", "fold"), holdout=False))
        feature_rows.append(spatial.where(F.col("fold") == F.col("held")).select(*keep))
    features, models = feature_rows[0], model_rows[0]
    for f, m in zip(feature_rows[1:], model_rows[1:], strict=True):
        features, models = features.unionByName(f), models.unionByName(m)
    models = models.select(*FEATURE_KEY, "fold", "pipeline_id", "weights", "bias")
    return features.join(models, [*FEATURE_KEY, "fold"]).select(
        "subject_id",
        "pipeline_id",
        "fold",
        "trial_id",
        "class",
        predicted_class(F.col("x"), F.col("weights"), F.col("bias")).alias("predicted"),
    )


def evaluate(summaries: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    """Metrics per subject, candidate and fold; fold -1 is the pooled result."""
    rows = predictions(summaries, candidates)
    both = rows.withColumn("fold", F.explode(F.array(F.col("fold"), F.lit(-1))))
    return classification_metrics(both, ["subject_id", "pipeline_id", "fold"], "class", "predicted")


def fit_models(summaries: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    """One frozen model per subject and candidate, fitted on all given trials."""
    candidates = [replace(c, cv_folds=2, random_seed=0) for c in candidates]
    bands = _bands(candidates)
    covs = _prepared(summaries, candidates, [])
    parts: list[DataFrame] = []

    def models_of(features: DataFrame) -> DataFrame:
        moments = _with_candidates(class_moments(features, FEATURE_KEY), candidates)
        return fit_classifier(moments, [*FEATURE_KEY, "pipeline_id"], holdout=False)

    if any(not c.spatial for c in candidates):
        x = log_variances(F.col("cov"), F.col("channels"), F.col("width"))
        plain = covs.withColumn("x", x).withColumn("csp_components", F.lit(0))
        parts.append(models_of(plain).withColumn("filters", F.lit(None).cast("array<double>")))
    components = sorted({c.csp_components for c in candidates if c.spatial})
    if components:
        filters = materialise(fit_spatial_filters(covs, components).drop("held"), "spatial-filters")
        spatial = spatial_features(covs, filters, ["subject_id", "band", "split"])
        parts.append(models_of(spatial).join(filters, FEATURE_KEY))
    fitted = parts[0]
    for p in parts[1:]:
        fitted = fitted.unionByName(p)
    shape = summaries.groupBy("subject_id").agg(
        F.min("label").alias("class_0"),
        F.max("label").alias("class_1"),
        F.max("sfreq").alias("sfreq"),
        F.max("channels").alias("channels"),
    )
    edge = F.element_at(
        F.array(*[F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high")) for lo, hi in bands]),
        F.col("band") + 1,
    )
    models = fitted.join(shape, "subject_id").select(
        "subject_id", "pipeline_id", edge["low"].alias("low"), edge["high"].alias("high"),
        "csp_components", "sfreq", "channels", "class_0", "class_1", "filters",
        "center", "scale", "means", "precision", "weights", "bias",
    )
    return models.withColumn("model_sha256", model_hash())


def model_hash() -> Column:
    """Hash over a model's state, numbers written to nine significant places."""

    def numbers(c: str) -> Column:
        return F.array_join(F.transform(c, lambda v: F.format_string("%.8e", v)), ",")

    return F.sha2(
        F.concat_ws(
            "|", "subject_id", "pipeline_id", "sfreq", "channels", "class_0", "class_1",
            *[
                F.coalesce(numbers(c), F.lit("none"))
                for c in ("filters", "center", "scale", "means", "precision", "bias")
            ],
        ),
        256,
    )


def frozen_faults(models: DataFrame, summaries: DataFrame) -> DataFrame:
    """(subject_id, rule_id): evaluation rows a frozen model refuses."""
    known = models.groupBy("subject_id").agg(
        F.max("sfreq").alias("m_sfreq"), F.max("channels").alias("m_channels")
    )
    facts = summaries.groupBy("subject_id").agg(
        F.bool_and(F.col("covs").isNotNull()).alias("finite"),
        *[F.min(c).alias(f"{c}_lo") for c in ("sfreq", "channels")],
        *[F.max(c).alias(f"{c}_hi") for c in ("sfreq", "channels")],
    )
    return violations(
        facts.join(known, "subject_id", "left"),
        ["subject_id"],
        [
            ("model_of_this_subject", F.col("m_sfreq").isNotNull()),
            ("rate_matches_model", (F.col("sfreq_lo") == F.col("m_sfreq")) & (F.col("sfreq_hi") == F.col("m_sfreq"))),
            ("channels_match_model", (F.col("channels_lo") == F.col("m_channels")) & (F.col("channels_hi") == F.col("m_channels"))),
            ("samples_finite", F.col("finite")),
        ],
    )


def apply_models(models: DataFrame, summaries: DataFrame, bands: Sequence[tuple[float, float]]) -> DataFrame:
    """Predictions of frozen models on other sessions; nothing is refitted.

    ``bands`` are the bands the summaries were taken in.
    """
    refused = frozen_faults(models, summaries).select("subject_id").distinct()
    edges = F.array(
        *[F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high")) for lo, hi in sorted(set(bands))]
    )
    edge = F.element_at(edges, F.col("band") + 1)
    rows = (
        band_rows(summaries.join(refused, "subject_id", "left_anti"))
        .select(
            "subject_id", "trial_id", "label", F.col("channels").alias("c"), "width", "cov",
            edge["low"].alias("low"), edge["high"].alias("high"),
        )
        .join(models.drop("channels", "sfreq"), ["subject_id", "low", "high"])
    )

    @F.pandas_udf("array<double>")
    def shares(cov: pd.Series, w: pd.Series) -> pd.Series:
        return kernels.projected_shares_batch(cov, w)

    plain = rows.where("filters is null").withColumn(
        "x", log_variances(F.col("cov"), F.col("c"), F.col("width"))
    )
    spatial = rows.where("filters is not null").withColumn("x", shares(F.col("cov"), F.col("filters")))
    winner = predicted_class(F.col("x"), F.col("weights"), F.col("bias"))
    return plain.unionByName(spatial).select(
        "subject_id",
        "pipeline_id",
        "trial_id",
        "label",
        F.when(winner == 1, F.col("class_1")).otherwise(F.col("class_0")).alias("predicted"),
        "model_sha256",
    )


def evaluate_frozen(models: DataFrame, summaries: DataFrame, bands: Sequence[tuple[float, float]]) -> DataFrame:
    """Metrics of frozen models per subject and candidate."""
    return classification_metrics(
        apply_models(models, summaries, bands),
        ["subject_id", "pipeline_id", "model_sha256"],
        "label",
        "predicted",
    )
