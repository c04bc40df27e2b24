"""Logistic and margin classifiers by Newton steps over sums of arrays.

All models of a job (subjects, bands, folds, ...) move together.  A step is one pass: each
training row adds its loss, gradient and curvature to one array of its model, summed inside
the tasks, and the solve sees one row per model.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.operators.sums import array_sums
from trialweave.session import materialise

DOUBLES = T.ArrayType(T.DoubleType())

#: Largest gradient entry of a finished model, per unit of C and row; passes until then.
CLOSE, MOST_PASSES = 1e-9, 100
LOSSES = ("logistic", "squared_hinge")


def _row_terms(loss: str, c: float):
    @F.pandas_udf("array<double>")
    def run(x: pd.Series, side: pd.Series, weights: pd.Series) -> pd.Series:
        out: list = [None] * len(x)
        sizes = np.array([len(v) for v in x])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            rows = np.ones((len(at), size + 1))
            rows[:, :size] = np.stack([x.iat[i] for i in at])
            w = np.stack([weights.iat[i] for i in at])
            y = side.to_numpy()[at].astype(float)
            margin = y * (rows * w).sum(axis=1)
            if loss == "logistic":
                value = np.logaddexp(0.0, -margin)
                wrong = np.exp(-np.logaddexp(0.0, margin))
                slope, bend = -wrong, wrong * (1 - wrong)
            else:
                short = np.maximum(0.0, 1 - margin)
                value, slope, bend = short**2, -2 * short, 2.0 * (short > 0)
            terms = np.concatenate(
                [
                    (c * value)[:, None],
                    (c * slope * y)[:, None] * rows,
                    (c * bend[:, None, None] * rows[:, :, None] * rows[:, None, :]).reshape(len(at), -1),
                ],
                axis=1,
            )
            for i, row in zip(at, terms, strict=True):
                out[i] = row
        return pd.Series(out)

    return run


STATE = T.StructType([
    *[T.StructField(name, DOUBLES) for name in ("weights", "base", "step")],
    *[T.StructField(name, T.DoubleType()) for name in ("loss", "slope")],
])


@F.pandas_udf(STATE)
def _advance(total: pd.Series, n: pd.Series, weights: pd.Series, base: pd.Series, step: pd.Series, loss: pd.Series) -> pd.DataFrame:
    """The next point of each model: a full step from a better one, half a step back else."""
    out = []
    for sums, rows, w, b, s, before in zip(total, n, weights, base, step, loss, strict=True):
        sums, w = np.asarray(sums), np.asarray(w)
        size = len(w)
        inner = np.append(np.ones(size - 1), 0.0)  # the intercept is free
        now = sums[0] + 0.5 * (inner * w * w).sum()
        gradient = sums[1 : size + 1] + inner * w
        if now <= before + 1e-12 * abs(before):
            bend = sums[size + 1 :].reshape(size, size) + np.diag(inner)
            bend[-1, -1] += 1e-12  # no row near the margin: the intercept has no curvature
            s = -np.linalg.solve(bend, gradient)
            out.append((w + s, w, s, now, np.abs(gradient).max() / rows))
        else:
            b, s = np.asarray(b), np.asarray(s) / 2
            out.append((b + s, b, s, before, np.inf))
    return pd.DataFrame(out, columns=["weights", "base", "step", "loss", "slope"])


def fit_linear(
    rows: DataFrame, keys: Sequence[str], x: str, side: str, loss: str = "logistic", c: float = 1.0
) -> DataFrame:
    """(keys, weights, loss): the minimum of |w|^2 / 2 + C times the sum of row losses.

    ``x`` is an array of features of one length per key, ``side`` is 1 or -1.  The last
    weight is the intercept, which is not penalised.  ``logistic`` is log(1 + exp(-y z)),
    ``squared_hinge`` the square of max(0, 1 - y z); both have one minimum.  ``rows`` is read
    once per pass: pass a stored table.  The driver sees one number a pass.
    """
    if loss not in LOSSES:
        raise ValueError(f"unknown loss {loss}")
    if not c > 0:
        raise ValueError("c must be positive")
    keys = list(keys)
    zeros = F.transform(F.sequence(F.lit(0), F.max(F.size(x))), lambda _: F.lit(0.0))
    models = rows.groupBy(*keys).agg(zeros.alias("weights")).withColumns({
        "base": F.col("weights"), "step": F.col("weights"), "loss": F.lit(float("inf")),
        "slope": F.lit(float("inf")),
    })
    models = materialise(models, "linear-models")
    terms = _row_terms(loss, float(c))
    for _ in range(MOST_PASSES):
        seen = rows.select(*keys, F.col(x).alias("__x"), F.col(side).alias("__y")).join(
            models.select(*keys, "weights"), keys
        )
        sums = array_sums(
            seen.withColumn("__t", terms(F.col("__x"), F.col("__y"), F.col("weights"))), keys, "__t"
        )
        moved = models.join(sums, keys).select(
            *keys,
            _advance(*[F.col(n) for n in ("total", "n", "weights", "base", "step", "loss")]).alias("s"),
        )
        models = materialise(moved.select(*keys, "s.*"), "linear-models")
        steepest = models.agg(F.max("slope")).first()[0]
        if steepest is None or steepest < CLOSE * c:
            return models.select(*keys, F.col("base").alias("weights"), "loss")
    raise RuntimeError(f"a model still has slope {steepest} after {MOST_PASSES} passes")


def standardised(x: Column, center: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(x, center, lambda a, b: a - b), scale, lambda a, b: a / b)


def linear_score(x: Column, weights: Column) -> Column:
    """w x + b; the class is 1 above zero."""
    size = F.size(x)
    inner = F.zip_with(x, F.slice(weights, F.lit(1), size), lambda a, b: a * b)
    return F.aggregate(inner, F.get(weights, size), lambda s, v: s + v)


def linear_predictions(
    features: DataFrame, keys: Sequence[str], loss: str = "logistic", c: float = 1.0
) -> DataFrame:
    """Out-of-fold predictions of one model per key and held-out fold.

    ``features`` has the keys, trial_id, class (0 or 1), fold, held and ``x``, a row per
    trial and held-out fold.  Scaling and model are fitted where fold differs from held;
    the held-out rows are predicted: (keys, fold, trial_id, class, score, predicted).
    """
    from trialweave.operators import decode

    keys = list(keys)
    learnt = features.where("fold <> held").drop("fold").withColumnRenamed("held", "fold")
    moments = decode.class_moments(learnt, keys).withColumn("shrinkage", F.lit(0.0))
    scales = materialise(
        decode.fit_classifier(moments, keys, holdout=False).select(*keys, "fold", "center", "scale"),
        "scales",
    )
    scaled = materialise(
        learnt.join(scales, [*keys, "fold"]).select(
            *keys, "fold",
            standardised(F.col("x"), F.col("center"), F.col("scale")).alias("z"),
            F.when(F.col("class") == 1, 1.0).otherwise(-1.0).alias("side"),
        ),
        "scaled-features",
    )
    models = fit_linear(scaled, [*keys, "fold"], "z", "side", loss, c).drop("loss")
    held = features.where("fold = held").join(scales, [*keys, "fold"]).join(models, [*keys, "fold"])
    z = standardised(F.col("x"), F.col("center"), F.col("scale"))
    return held.withColumn("score", linear_score(z, F.col("weights"))).select(
        *keys, "fold", "trial_id", "class", "score",
        F.when(F.col("score") > 0, 1).otherwise(0).alias("predicted"),
    )
