"""Quality scores by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample: labelled rows, and preference pairs.
MOST_ROWS = 20_000
MOST_PAIRS = 60_000
BINS = 16

#: Bytes counted by class.
CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b"!",
    b"|",
    b"#*$%&<>",
    b".,;:?",
    b"\n",
    b"@/\\_=+~^{}[]()",
    b"'\"-",
    bytes(range(128, 256)),
    b" \t\r\x0b\x0c",
)
FEATURES = len(CLASSES) + 11


def text_features(text: str | None) -> np.ndarray:
    """Shape statistics of a whole text; all are zero without words."""
    body = (text or "").encode()
    words = body.split()
    out = np.zeros(FEATURES)
    if not words:
        return out
    counts = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    solid = sum(map(len, words))
    for k, members in enumerate(CLASSES):
        out[k] = counts[list(members)].sum() / len(body)
    count = len(words)
    lines = [x for x in body.split(b"\n") if x.strip()]
    lower = [w.lower() for w in words]
    distinct = len(set(lower))
    pairs = len(set(zip(lower, lower[1:], strict=False)))
    triples = len(set(zip(lower, lower[1:], lower[2:], strict=False)))
    out[len(CLASSES) :] = (
        np.log1p(count),
        solid / count,
        distinct / count,
        distinct / np.sqrt(count),
        pairs / max(count - 1, 1),
        triples / max(count - 2, 1),
        sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / count,
        len(set(lines)) / max(len(lines), 1),
        np.log1p(count / max(len(lines), 1)),
        np.log(max(map(len, words))),
        sum(w.isupper() for w in words) / count,
    )
    return out


@dataclass(frozen=True)
class Ranking:
    """A worth for each bin of each statistic, and the score that parts the labels."""

    edges: np.ndarray
    worth: np.ndarray
    threshold: float

    def columns(self, features: np.ndarray) -> np.ndarray:
        """One place per row and statistic in ``worth``."""
        width = self.edges.shape[1] + 1
        return np.stack(
            [
                np.searchsorted(self.edges[k], features[:, k], "right") + k * width
                for k in range(features.shape[1])
            ],
            axis=1,
        )

    def scores(self, features: np.ndarray) -> np.ndarray:
        """From 0 to 1; at the threshold one half."""
        worth = self.worth[self.columns(features)].sum(axis=1)
        return 1 / (1 + np.exp(np.clip(self.threshold - worth, -500, 500)))


def fit_ranking(
    features: np.ndarray,
    good: np.ndarray,
    pairs: int = MOST_PAIRS,
    ridge: float = 1.0,
    steps: int = 12,
    seed: int = 7,
) -> Ranking:
    """Bradley-Terry worths from pairs of a good and a bad document.

    The chance that the good one is preferred is logistic in the difference of their worths.
    A worth is the sum of one value per statistic and bin, so the loss is convex; Newton
    steps minimise it with a ridge.  The threshold is the worth that the share of good
    documents in the sample exceeds: the quantile at the share of bad ones, taken halfway to
    the next document.  With one label only, all worths are zero and every score is that
    label's side of one half.
    """
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.quantile(features, quantiles, axis=0).T if len(features) else np.zeros(
        (FEATURES, BINS - 1)
    )
    width = BINS
    model = Ranking(edges, np.zeros(FEATURES * width), 0.0)
    winners, losers = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(winners) or not len(losers):
        return Ranking(edges, model.worth, 1.0 if len(losers) else -1.0)
    rng = np.random.default_rng(seed)
    most = min(pairs, len(winners) * len(losers))
    first = rng.permutation(np.resize(winners, most))
    second = rng.permutation(np.resize(losers, most))
    places = model.columns(features)
    worth = model.worth.copy()
    size = len(worth)
    for _ in range(steps):
        gap = worth[places[first]].sum(axis=1) - worth[places[second]].sum(axis=1)
        chance = 1 / (1 + np.exp(np.clip(gap, -500, 500)))  # of the wrong preference
        gradient = ridge * worth
        hessian = ridge * np.eye(size)
        for at in range(0, most, 4096):
            rows = np.arange(min(4096, most - at))
            block = np.zeros((len(rows), size))
            for k in range(FEATURES):
                block[rows, places[first[at : at + 4096], k]] += 1
                block[rows, places[second[at : at + 4096], k]] -= 1
            c = chance[at : at + 4096]
            gradient -= block.T @ c
            hessian += (block * (c * (1 - c))[:, None]).T @ block
        move = np.linalg.solve(hessian, gradient)
        worth = worth - move
        if np.abs(move).max() < 1e-6:
            break
    held = np.sort(worth[places].sum(axis=1))
    cut = min(max(len(losers), 1), len(held) - 1)
    return Ranking(edges, worth, float((held[cut - 1] + held[cut]) / 2))


def feature_rows(documents: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns and the statistics of each whole text as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(found, pa.list_(pa.float64()))],
                names=[*columns, "features"],
            )

    kinds = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns]
    return documents.select("text", *columns).mapInArrow(
        run, ", ".join([*kinds, "features array<double>"])
    )


def held_out(doc_id: Column) -> Column:
    """Rows that never train: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Ranking:
    """A ranking from labelled rows that are not held out.

    ``most_rows`` bounds the sample; it is drawn by hash, so reruns agree.  Labels other
    than 0 and 1, and ids with several labels that differ, are left out.  The sample's ids,
    at most ``most_rows``, are broadcast, so no text is shuffled to find it.
    """
    known = (
        labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("good"), F.max("quality").alias("_most"))
        .filter("good = _most")
        .select("doc_id", F.col("good").cast("int").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_rows)
    )
    rows = (
        feature_rows(
            documents.select("doc_id", "text").join(F.broadcast(known), "doc_id"),
            ["doc_id", "good"],
        )
        .orderBy(F.xxhash64("doc_id"), "doc_id", "features")
        .limit(most_rows)
        .collect()
    )
    features = np.array([r["features"] for r in rows]).reshape(-1, FEATURES)
    return fit_ranking(features, np.array([r["good"] for r in rows], int))


def score_quality(documents: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Needs doc_id and text; labels need doc_id and quality (0 or 1).  Scores use statistics of
    the whole text alone; id, language, source and labels are no inputs.  Null and empty
    texts score as texts without words do.  Rows that repeat an id are scored each, equal
    texts alike; a null id counts as not held out and never trains.  Without labels of both
    kinds every document takes the kind that is there, and 1 without any.  An empty table
    gives no rows.
    """
    ranking = train(documents, labels, most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = np.array([text_features(t) for t in texts]).reshape(-1, FEATURES)
            score = ranking.scores(found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(score, pa.float64()),
                    pa.array((score >= 0.5).astype(np.int32), pa.int32()),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def of_good_quality(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents predicted good, with all their columns; see ``score_quality``.

    Rows are filtered where they are read: nothing is joined or shuffled.
    """
    ranking = train(documents, labels, **options)
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            found = np.array([text_features(t) for t in texts]).reshape(-1, FEATURES)
            yield batch.filter(pa.array(ranking.scores(found) >= 0.5))

    return documents.mapInArrow(run, documents.schema)
