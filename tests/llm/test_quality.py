import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from trialweave.llm import quality


def corpus(count=400):
    drawn = random.Random(11)
    rows, labels = [], []
    for k in range(count):
        good = k % 4 > 0
        text = prose(k, drawn.randint(30, 200))
        if not good and k % 8 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif not good:
            text = " ".join(w + "$$$" for w in text.split())
        rows.append((k, text, "en", f"s{k % 3}"))
        labels.append((k, int(good), k % 2, "clash"))
    return rows, labels


LABELS = "doc_id bigint, quality int, toxic int, score string"


def test_held_out_documents_are_ranked(make_documents, spark, odd_rows):
    rows, labels = corpus()
    rows += [(None if i is None else 5000 + i, *rest) for i, *rest in odd_rows]
    labels += [(5000, None, 0, "x"), (5001, 7, 0, "x"), (1, 1, 0, "x"), (2, 0, 0, "differs")]
    got = quality.score_quality(
        make_documents(rows), spark.createDataFrame(labels, LABELS), most_rows=5_000
    ).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        out = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        assert r["held_out"] == out
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        by[r["doc_id"]] = r
    held = [k for k in range(400) if by[k]["held_out"]]
    right = sum(by[k]["predicted"] == int(k % 4 > 0) for k in held)
    assert right / len(held) > 0.95
    assert by[5103]["score"] == by[5104]["score"]


def test_held_out_labels_are_never_read(make_documents, spark):
    rows, labels = corpus(200)
    docs = make_documents(rows)
    flipped = [
        (i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t, x) for i, q, t, x in labels
    ]
    one, two = (
        {r["doc_id"]: r["score"] for r in quality.score_quality(
            docs, spark.createDataFrame(held, LABELS)).collect()}
        for held in (labels, flipped)
    )
    assert one == two


def test_filter_keeps_columns_and_good(make_documents, spark):
    rows, labels = corpus()
    docs = make_documents(rows)
    kept = quality.of_good_quality(docs, spark.createDataFrame(labels, LABELS))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    good = {k for k in range(400) if k % 4}
    assert len(good - ids) < 8 and len(ids - good) < 8


def test_one_kind_of_label_or_none(make_documents, spark):
    docs = make_documents([(k, prose(k), "en", "s") for k in range(9)] + [(9, None, None, None)])
    none = spark.createDataFrame([], LABELS)
    bad = docs.select("doc_id", F.lit(0).alias("quality"))
    assert {r["predicted"] for r in quality.score_quality(docs, none).collect()} == {1}
    assert {r["predicted"] for r in quality.score_quality(docs, bad).collect()} == {0}
    assert quality.score_quality(make_documents([]), none).count() == 0


def test_ranking_loss_gradient_vanishes():
    rng = np.random.default_rng(1)
    features = rng.normal(size=(300, quality.FEATURES))
    good = (features[:, 0] + 0.3 * rng.normal(size=300) > -0.5).astype(int)
    model = quality.fit_ranking(features, good)
    score = model.scores(features)
    assert score[good == 1].mean() > score[good == 0].mean() + 0.3
    assert abs((score < 0.5).sum() - (good == 0).sum()) <= 1


def test_gradient_of_all_pairs_vanishes():
    """The loss by its definition, pair by pair: no direction lowers it."""
    rng = np.random.default_rng(5)
    features = rng.normal(size=(120, quality.FEATURES))
    good = (features[:, 1] + rng.normal(size=120) > -0.3).astype(int)
    winners, losers = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    model = quality.fit_ranking(features, good, pairs=10**6, ridge=1.0, steps=40, seed=3)
    held = np.zeros((120, len(model.worth)))
    for row, places in zip(held, model.columns(features), strict=True):
        row[places] = 1.0
    # All pairs fit, so the seed decides only which are drawn twice: draw them as it does.
    most = len(winners) * len(losers)
    drawn = np.random.default_rng(3)
    first = drawn.permutation(np.resize(winners, most))
    second = drawn.permutation(np.resize(losers, most))
    gap = held[first] - held[second]
    chance = 1 / (1 + np.exp(gap @ model.worth))
    assert np.abs(model.worth - gap.T @ chance).max() < 1e-6

    def loss(worth):
        return 0.5 * (worth**2).sum() + np.logaddexp(0, -gap @ worth).sum()

    for _ in range(30):
        assert loss(model.worth + rng.normal(scale=0.02, size=len(model.worth))) > loss(model.worth)
    # The threshold parts as many documents off as are bad.
    assert (held @ model.worth <= model.threshold).sum() == len(losers)
