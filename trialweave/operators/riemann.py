"""Decoding on the manifold of covariance matrices: tangent space and distance to mean.

Works on the covariance rows of ``decode``.  A mean on the manifold is no difference of
sums, so each held-out fold has means of its own, fitted on the trials of the others.  Only
the small covariance rows are repeated per fold, and a step of the mean is one sum of arrays
per (subject, band, split, fold), combined inside the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.functions import manifold
from trialweave.operators import decode
from trialweave.operators.sums import array_sums
from trialweave.session import materialise

DOUBLES = T.ArrayType(T.DoubleType())

#: The largest norm of a mean's last step, and the steps after which it must be there.
CLOSE, MOST_STEPS = 1e-9, 60


@dataclass(frozen=True)
class ManifoldCandidate(decode.Candidate):
    """``family`` is ``tangent_lda`` or ``mdm``; ``metric`` is riemann or logeuclid."""

    metric: str = "riemann"
    covariance: str = "oas"

    def __post_init__(self) -> None:
        if self.family not in ("tangent_lda", "mdm"):
            raise ValueError(f"unknown family {self.family}")
        if self.metric not in ("riemann", "logeuclid"):
            raise ValueError(f"unknown metric {self.metric}")
        if self.covariance not in ("oas", "none"):
            raise ValueError(f"unknown covariance {self.covariance}")


def shrunk_covariances(rows: DataFrame, estimator: str = "oas") -> DataFrame:
    """Replace ``cov`` (sums of products over ``width`` samples) by a positive estimate.

    ``oas`` is the oracle approximating shrinkage towards the mean variance; ``none`` only
    divides by the samples.  Matrices that are not positive after it become null.
    """
    @F.pandas_udf("array<double>")
    def run(cov: pd.Series, width: pd.Series) -> pd.Series:
        return manifold.shrunk_batch(cov, width, estimator == "oas")

    return rows.withColumn("cov", run(F.col("cov"), F.col("width")))


@F.pandas_udf(DOUBLES)
def log_map(cov: pd.Series, mean: pd.Series) -> pd.Series:
    """log(M^-1/2 C M^-1/2), flat."""
    return manifold.log_map_batch(cov, mean)


@F.pandas_udf(DOUBLES)
def exp_step(mean: pd.Series, step: pd.Series) -> pd.Series:
    """M^1/2 exp(S) M^1/2, flat."""
    return manifold.exp_step_batch(mean, step)


@F.pandas_udf(DOUBLES)
def matrix_log(cov: pd.Series) -> pd.Series:
    return manifold.log_batch(cov)


@F.pandas_udf(DOUBLES)
def matrix_exp(log: pd.Series) -> pd.Series:
    return manifold.exp_batch(log)


def _averages(rows: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    return array_sums(rows, keys, vector).select(
        *keys, F.transform("total", lambda x: x / F.col("n")).alias("average")
    )


def matrix_means(
    rows: DataFrame, keys: Sequence[str], metric: str = "riemann", cov: str = "cov"
) -> DataFrame:
    """(keys, mean): the mean of each key's positive matrices, flat.

    ``riemann`` is the Karcher mean: from the log-Euclidean mean on, the average of all log
    maps is walked along until every key's step is shorter than ``CLOSE``; groups that are
    there already stay put.  ``logeuclid`` is the exponential of the average logarithm.
    ``rows`` is read once per step: pass a stored table.  The driver sees one number a step.
    """
    keys = list(keys)
    start = _averages(rows.withColumn("__log", matrix_log(F.col(cov))), keys, "__log")
    means = start.select(*keys, matrix_exp(F.col("average")).alias("mean"))
    if metric == "logeuclid":
        return means
    means = materialise(means, "means")
    length = F.sqrt(F.aggregate("average", F.lit(0.0), lambda s, x: s + x * x))
    for _ in range(MOST_STEPS):
        mapped = rows.join(means, keys).withColumn("__step", log_map(F.col(cov), F.col("mean")))
        steps = _averages(mapped, keys, "__step")
        means = materialise(
            means.join(steps, keys).select(
                *keys, exp_step(F.col("mean"), F.col("average")).alias("mean"), length.alias("length")
            ),
            "means",
        )
        longest = means.agg(F.max("length")).first()[0]
        means = means.drop("length")
        if longest is None or longest < CLOSE:
            return means
    raise RuntimeError(f"a mean is still moving by {longest} after {MOST_STEPS} steps")


def tangent_vector(log: Column, channels: Column) -> Column:
    """Upper triangle of a flat symmetric matrix; off the diagonal times the root of two,
    so that distances stay."""
    at = F.sequence(F.lit(0), channels - 1)
    row = lambda i: F.transform(
        F.sequence(i, channels - 1),
        lambda j: F.get(log, i * channels + j) * F.when(i == j, 1.0).otherwise(2.0**0.5),
    )
    return F.flatten(F.transform(at, row))


def _training_rows(covs: DataFrame) -> DataFrame:
    """Each row once per held-out fold it may be learnt from (``held``)."""
    folds = covs.groupBy("split").agg(F.max("fold").alias("__last"))
    held = F.filter(F.sequence(F.lit(0), F.col("__last")), lambda f: f != F.col("fold"))
    return covs.join(folds, "split").withColumn("held", F.explode(held)).drop("__last")


PLACE = ["subject_id", "band", "split"]
OUTPUT = ("subject_id", "pipeline_id", "fold", "trial_id", "class", "predicted")


def manifold_predictions(summaries: DataFrame, candidates: Sequence[ManifoldCandidate]) -> DataFrame:
    """Out-of-fold prediction of every trial by every candidate, as ``decode.predictions``.

    Means, tangent points and classifiers are fitted on the other folds only.
    """
    candidates = list(candidates)
    covs = decode._prepared(summaries, candidates, decode._splits(candidates))
    parts = []
    for estimator in sorted({c.covariance for c in candidates}):
        rows = materialise(
            shrunk_covariances(covs, estimator).where("cov is not null"), "positive-covariances"
        )
        train = _training_rows(rows)
        for metric in sorted({c.metric for c in candidates if c.covariance == estimator}):
            own = [c for c in candidates if (c.covariance, c.metric) == (estimator, metric)]
            for family, run in (("tangent_lda", _tangent), ("mdm", _nearest_mean)):
                if chosen := [c for c in own if c.family == family]:
                    parts.append(run(rows, train, _named_by(chosen, candidates), metric))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _named_by(chosen: Sequence[ManifoldCandidate], every: Sequence[ManifoldCandidate]) -> Column:
    """Ids, bands, splits and shrinkages of some candidates, numbered as in the rows."""
    bands, splits = decode._bands(every), decode._splits(every)
    return F.array(*[
        F.struct(
            F.lit(c.pipeline_id).alias("pipeline_id"),
            F.lit(bands.index((c.low, c.high))).alias("c_band"),
            F.lit(splits.index((c.cv_folds, c.random_seed))).alias("c_split"),
            F.lit(float(c.lda_shrinkage)).alias("shrinkage"),
        )
        for c in chosen
    ])


def _named(rows: DataFrame, names: Column) -> DataFrame:
    """Rows once per candidate of their band and split, with its id and shrinkage."""
    return (
        rows.withColumn("c", F.explode(names))
        .where((F.col("c.c_band") == F.col("band")) & (F.col("c.c_split") == F.col("split")))
        .select(*rows.columns, "c.pipeline_id", "c.shrinkage")
    )


def tangent_features(rows: DataFrame, train: DataFrame, metric: str) -> DataFrame:
    """Every row once per held-out fold with ``x``, its vector in the tangent space at the
    mean of that fold's training trials."""
    point = matrix_means(train, [*PLACE, "held"], metric)
    if metric == "logeuclid":
        local = matrix_log(F.col("cov"))
        off = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
        vector = off(local, matrix_log(F.col("mean")))
    else:
        vector = log_map(F.col("cov"), F.col("mean"))
    return rows.join(point, PLACE).withColumn("__log", vector).withColumn(
        "x", tangent_vector(F.col("__log"), F.col("channels"))
    ).drop("__log", "mean", "cov")


def _tangent(rows: DataFrame, train: DataFrame, names: Column, metric: str) -> DataFrame:
    features = materialise(tangent_features(rows, train, metric), "tangent-features")
    learnt = features.where("fold <> held").drop("fold").withColumnRenamed("held", "fold")
    moments = _named(decode.class_moments(learnt, PLACE), names)
    models = decode.fit_classifier(moments, [*PLACE, "pipeline_id"], holdout=False).select(
        *PLACE, "fold", "pipeline_id", "weights", "bias"
    )
    return features.where("fold = held").join(models, [*PLACE, "fold"]).withColumn(
        "predicted", decode.predicted_class(F.col("x"), F.col("weights"), F.col("bias"))
    ).select(*OUTPUT)


def class_distances(rows: DataFrame, train: DataFrame, metric: str) -> DataFrame:
    """Distance of every held-out row to each class mean of its fold's training trials."""
    means = matrix_means(train, [*PLACE, "held", "class"], metric).withColumnRenamed("class", "of_class")
    if metric == "logeuclid":
        gap = F.zip_with(matrix_log(F.col("cov")), matrix_log(F.col("mean")), lambda x, y: x - y)
    else:
        gap = log_map(F.col("cov"), F.col("mean"))
    return (
        rows.join(means.withColumnRenamed("held", "fold"), [*PLACE, "fold"])
        .withColumn("__gap", gap)
        .withColumn("distance", F.sqrt(F.aggregate("__gap", F.lit(0.0), lambda s, x: s + x * x)))
        .drop("__gap", "mean", "cov")
    )


def _nearest_mean(rows: DataFrame, train: DataFrame, names: Column, metric: str) -> DataFrame:
    """The class of the nearest mean; the first of equals."""
    nearest = (
        class_distances(rows, train, metric)
        .groupBy(*PLACE, "fold", "trial_id", "class")
        .agg(F.min(F.struct("distance", "of_class")).alias("best"))
        .withColumn("predicted", F.col("best.of_class"))
        .drop("best")
    )
    return _named(nearest, names).select(*OUTPUT)


def evaluate(summaries: DataFrame, candidates: Sequence[ManifoldCandidate]) -> DataFrame:
    """Metrics per subject, candidate and fold; fold -1 is the pooled result."""
    rows = manifold_predictions(summaries, candidates)
    both = rows.withColumn("fold", F.explode(F.array(F.col("fold"), F.lit(-1))))
    return decode.classification_metrics(both, ["subject_id", "pipeline_id", "fold"], "class", "predicted")
