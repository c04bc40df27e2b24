"""Alignment of sessions by statistics that need no labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.functions import manifold
from trialweave.operators.riemann import matrix_means
from trialweave.operators.sums import array_sums

DOUBLES = T.ArrayType(T.DoubleType())


@F.pandas_udf(DOUBLES)
def _whitened(cov: pd.Series, mean: pd.Series) -> pd.Series:
    return manifold.whiten_batch(cov, mean)


@F.pandas_udf(DOUBLES)
def _recoloured(x: pd.Series, own: pd.Series, target: pd.Series) -> pd.Series:
    """x S^-1/2 T^1/2 for the session's and the target's covariances."""
    out: list = [None] * len(x)
    pairs: dict = {}
    for i, (v, s, t) in enumerate(zip(x, own, target, strict=True)):
        key = (s.tobytes(), t.tobytes())
        if key not in pairs:
            side = int(round(len(s) ** 0.5))
            pairs[key] = _root(s.reshape(side, side), -0.5) @ _root(t.reshape(side, side), 0.5)
        out[i] = v @ pairs[key]
    return pd.Series(out)


def _root(m: np.ndarray, power: float) -> np.ndarray:
    values, vectors = np.linalg.eigh(m)
    return (vectors * values**power) @ vectors.T


def recentred(rows: DataFrame, keys: Sequence[str], metric: str = "riemann") -> DataFrame:
    """Replace each ``cov`` by M^-1/2 C M^-1/2, M the mean of its ``keys`` (a session).

    Afterwards every session's mean is the identity.  Only the session's own matrices are
    used and no label, so a held-out session is aligned by itself.  ``rows`` is read several
    times: pass a stored table of positive matrices (``riemann.shrunk_covariances``).
    """
    means = matrix_means(rows, keys, metric)
    return rows.join(means, list(keys)).withColumn(
        "cov", _whitened(F.col("cov"), F.col("mean"))
    ).drop("mean")


def feature_covariances(rows: DataFrame, keys: Sequence[str], x: str, regularization: float) -> DataFrame:
    """(keys, center, covariance): mean and covariance of features, ridge added, by one sum."""
    one = F.concat(
        F.col(x), F.flatten(F.transform(x, lambda a: F.transform(x, lambda b: a * b)))
    )
    sums = array_sums(rows.withColumn("__m", one), keys, "__m")

    @F.pandas_udf("struct<center:array<double>,covariance:array<double>>")
    def split(total: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for sums, count in zip(total, n, strict=True):
            # f + f^2 values
            f = int(round((np.sqrt(1 + 4 * len(sums)) - 1) / 2))
            center = sums[:f] / count
            spread = sums[f:].reshape(f, f) / count - np.outer(center, center)
            out.append((center, (spread + regularization * np.eye(f)).ravel()))
        return pd.DataFrame(out, columns=["center", "covariance"])

    return sums.select(*keys, split(F.col("total"), F.col("n")).alias("s")).select(*keys, "s.*")


def coral(
    rows: DataFrame, group: Sequence[str], session: str, target: str, x: str = "x", regularization: float = 1e-3
) -> DataFrame:
    """Align the features of each session to those of the group's ``target`` session.

    Features are centred by their session, whitened by its covariance (with the ridge) and
    recoloured by the target's.  No label is read.  Groups without the target session give
    no rows.  ``rows`` is read twice: pass a stored table.
    """
    keys = [*group, session]
    facts = feature_covariances(rows, keys, x, regularization)
    goal = facts.where(F.col(session) == F.lit(target)).select(
        *group, F.col("center").alias("__goal"), F.col("covariance").alias("__target")
    )
    joined = rows.join(facts, keys).join(goal, list(group))
    off = F.zip_with(x, "center", lambda a, b: a - b)
    moved = _recoloured(off, F.col("covariance"), F.col("__target"))
    return joined.withColumn(x, F.zip_with(moved, "__goal", lambda a, b: a + b)).drop(
        "center", "covariance", "__goal", "__target"
    )
