"""Preparation of raw samples: eye artifacts, spatial reference, sampling rate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.operators.sums import array_sums

DOUBLES = T.ArrayType(T.DoubleType())


# --- eye artifacts --------------------------------------------------------------


def _cube(samples: pd.Series, at: np.ndarray, channels: int) -> np.ndarray:
    """Trials of one shape, each channel less its mean over the trial."""
    x = np.stack([samples.iat[i] for i in at]).reshape(len(at), channels, -1)
    return x - x.mean(axis=2, keepdims=True)


def _shapes(samples: pd.Series, channels: pd.Series):
    sizes = np.array([len(s) for s in samples])
    wide = channels.to_numpy()
    for size, c in np.unique(np.stack([sizes, wide], axis=1), axis=0):
        yield np.flatnonzero((sizes == size) & (wide == c)), int(c)


def fit_eog(trials: DataFrame, keys: Sequence[str], eog: Sequence[int], ridge: float = 1e-9) -> DataFrame:
    """(keys, weights): how much of each eye channel every other channel holds.

    Trials have channel-major ``samples`` and ``channels``; ``eog`` lists the eye channels.
    The normal equations of a key are one sum of small matrices over its trials, so no
    recording is gathered.  ``weights`` is flat, a row per channel in order, a column per eye
    channel; rows of eye channels are zero.
    """
    keys, eyes = list(keys), list(eog)

    @F.pandas_udf(DOUBLES)
    def products(samples: pd.Series, channels: pd.Series) -> pd.Series:
        out: list = [None] * len(samples)
        for at, c in _shapes(samples, channels):
            x = _cube(samples, at, c)
            e = x[:, eyes]
            both = np.concatenate([e @ e.transpose(0, 2, 1), x @ e.transpose(0, 2, 1)], axis=1)
            for i, m in zip(at, both, strict=True):
                out[i] = m.ravel() if np.isfinite(m).all() else None
        return pd.Series(out)

    @F.pandas_udf(DOUBLES)
    def solve(total: pd.Series) -> pd.Series:
        out = []
        for flat in total:
            m = flat.reshape(-1, len(eyes))
            own, cross = m[: len(eyes)], m[len(eyes) :]
            scale = np.trace(own) / len(eyes)
            w = np.linalg.solve(own + (ridge * scale + 1e-300) * np.eye(len(eyes)), cross.T).T
            w[eyes] = 0.0
            out.append(w.ravel())
        return pd.Series(out)

    held = trials.withColumn("__p", products(F.col("samples"), F.col("channels")))
    return array_sums(held, keys, "__p").select(*keys, solve(F.col("total")).alias("weights"))


def remove_eog(trials: DataFrame, weights: DataFrame, keys: Sequence[str], eog: Sequence[int]) -> DataFrame:
    """Subtract what :func:`fit_eog` found from the raw samples; eye channels stay as they are."""
    eyes = list(eog)

    @F.pandas_udf(DOUBLES)
    def clean(samples: pd.Series, channels: pd.Series, w: pd.Series) -> pd.Series:
        out: list = [None] * len(samples)
        for at, c in _shapes(samples, channels):
            raw = np.stack([samples.iat[i] for i in at]).reshape(len(at), c, -1)
            e = raw[:, eyes] - raw[:, eyes].mean(axis=2, keepdims=True)
            done = raw - np.stack([w.iat[i] for i in at]).reshape(len(at), c, -1) @ e
            for i, m in zip(at, done, strict=True):
                out[i] = m.ravel()
        return pd.Series(out)

    return trials.join(weights, list(keys)).withColumn(
        "samples", clean(F.col("samples"), F.col("channels"), F.col("weights"))
    ).drop("weights")


# --- surface Laplacian ----------------------------------------------------------


def laplacian_weights(positions: DataFrame, keys: Sequence[str], channel: str, neighbours: int = 4) -> DataFrame:
    """(keys, channel, neighbour, weight): the neighbour graph of each montage.

    ``positions`` has a channel's x, y, z; a montage is small by nature.  Each channel gets
    its nearest ``neighbours`` (the lesser channel of equals) with weights by inverse
    distance that add up to one, and itself with weight -1 as the neighbour.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("name the montage")
    here = positions.select(*keys, channel, *[F.col(a).alias(f"__{a}") for a in "xyz"])
    there = positions.select(*keys, F.col(channel).alias("neighbour"), *"xyz")
    gap = F.sqrt(sum((F.col(a) - F.col(f"__{a}")) * (F.col(a) - F.col(f"__{a}")) for a in "xyz"))
    near = Window.partitionBy(*keys, channel).orderBy("gap", "neighbour")
    kept = (
        here.join(there, keys).where(F.col(channel) != F.col("neighbour")).withColumn("gap", gap)
        .withColumn("__place", F.row_number().over(near)).where(F.col("__place") <= neighbours)
    )
    share = (1 / F.col("gap")) / F.sum(1 / F.col("gap")).over(Window.partitionBy(*keys, channel))
    own = positions.select(*keys, channel, F.col(channel).alias("neighbour"), F.lit(-1.0).alias("weight"))
    return kept.select(*keys, channel, "neighbour", share.alias("weight")).unionByName(own)


def surface_laplacian(epochs: DataFrame, weights: DataFrame, keys: Sequence[str], channel: str, on: Sequence[str] = ()) -> DataFrame:
    """(keys, channel, samples): each channel less the weighted mean of its neighbours.

    ``epochs`` has a row per trial and channel, ``keys`` name the trial, ``on`` the montage of
    the weights among them.  A sparse product: rows meet the few channels they are a
    neighbour of, and the parts of a channel are added as arrays.
    """
    into = weights.select(
        *on, F.col("neighbour").alias(channel), F.col(channel).alias("__into"), "weight"
    )
    part = F.transform("samples", lambda x: -x * F.col("weight"))
    parts = epochs.join(into, [*on, channel]).select(*keys, "__into", part.alias("__part"))
    return array_sums(parts, [*keys, "__into"], "__part").select(
        *keys, F.col("__into").alias(channel), F.col("total").alias("samples")
    )


# --- resampling -----------------------------------------------------------------


@lru_cache(maxsize=16)
def lowpass_taps(up: int, down: int, half_width: int = 10) -> np.ndarray:
    """A Kaiser-windowed sinc for a rate change of up / down, gain ``up``."""
    widest = max(up, down)
    n = np.arange(-half_width * widest, half_width * widest + 1)
    taps = np.sinc(n / widest) * np.kaiser(len(n), 5.0)
    return up * taps / taps.sum()


def reach(up: int, down: int) -> int:
    """Input samples to each side of an output sample that its filter looks at."""
    return math.ceil((len(lowpass_taps(up, down)) // 2) / up) + 1


def resample_block(x: np.ndarray, first: int, start: int, stop: int, up: int, down: int) -> np.ndarray:
    """Output samples start to stop from input ``x``, whose first sample has number ``first``.

    Output m is the sum over inputs k of taps[m down - k up]; the input counts as zero
    outside ``x``.
    """
    taps = lowpass_taps(up, down)
    middle, side = len(taps) // 2, reach(up, down)
    m = np.arange(start, stop) * down
    k = m[:, None] // up + np.arange(-side, side + 1)
    at = m[:, None] - k * up + middle
    weight = np.where((at >= 0) & (at < len(taps)), taps[np.clip(at, 0, len(taps) - 1)], 0.0)
    inside = (k >= first) & (k < first + len(x))
    return (weight * np.where(inside, x[np.clip(k - first, 0, len(x) - 1)], 0.0)).sum(axis=1)


def resample_chunks(
    chunks: DataFrame, keys: Sequence[str], chunk: str, up: int, down: int, samples: str = "samples"
) -> DataFrame:
    """Resample recordings kept as chunks, by up / down, to the same values as in one piece.

    ``chunks`` has a row per recording (``keys``) and chunk, numbered from 0 without gaps;
    chunks before the last have one length of at least :func:`reach`.  A chunk borrows that
    many samples from both neighbours, so no recording is one array.  Every output sample
    is made by the chunk that holds its time; (keys, chunk, samples).
    """
    if up < 1 or down < 1:
        raise ValueError("up and down must be positive whole numbers")
    side = reach(up, down)
    size, number, place = F.size(samples), F.col(chunk), [*keys, chunk]
    # Only the edges travel to the neighbours, and by chunk: a long recording is no hot key.
    tails = chunks.select(
        *keys, (number + 1).alias(chunk), size.alias("__full"),
        F.slice(F.col(samples), F.greatest(size - side + 1, F.lit(1)), F.lit(side)).alias("__before"),
    )
    heads = chunks.select(
        *keys, (number - 1).alias(chunk),
        F.slice(F.col(samples), F.lit(1), F.lit(side)).alias("__after"),
    )

    @F.pandas_udf(DOUBLES)
    def run(x: pd.Series, lead: pd.Series, tail: pd.Series, number: pd.Series, length: pd.Series) -> pd.Series:
        out = []
        for body, head, rest, at, size in zip(x, lead, tail, number, length, strict=True):
            first = int(at) * int(size)
            parts = [p for p in (head, body, rest) if p is not None]
            start = -(-first * up // down)
            stop = -(-(first + len(body)) * up // down)
            begin = first - (0 if head is None else len(head))
            out.append(resample_block(np.concatenate(parts), begin, start, stop, up, down))
        return pd.Series(out)

    wide = chunks.join(tails, place, "left").join(heads, place, "left").withColumn(
        "__full", F.coalesce("__full", size)
    )
    return wide.select(
        *keys, chunk,
        run(F.col(samples), F.col("__before"), F.col("__after"), F.col(chunk), F.col("__full")).alias("samples"),
    )
