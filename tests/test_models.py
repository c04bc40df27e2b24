import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import adaptation, linear_models, riemann
from trialweave.session import materialise


def gradient(x, y, w, loss, c):
    rows = np.c_[x, np.ones(len(x))]
    margin = y * (rows @ w)
    slope = -1 / (1 + np.exp(margin)) if loss == "logistic" else -2 * np.maximum(0, 1 - margin)
    return np.append(w[:-1], 0.0) + c * rows.T @ (slope * y)


def objective(x, y, w, loss, c):
    margin = y * (np.c_[x, np.ones(len(x))] @ w)
    row = np.log1p(np.exp(-margin)) if loss == "logistic" else np.maximum(0, 1 - margin) ** 2
    return 0.5 * (w[:-1] ** 2).sum() + c * row.sum()


@pytest.mark.parametrize("loss", linear_models.LOSSES)
@pytest.mark.parametrize("c", [0.01, 10.0])
def test_gradient_vanishes(spark, loss, c):
    rng = np.random.default_rng(3)
    data = {}
    for g in range(4):
        x = rng.normal(size=(60, 2 + g % 2))
        y = np.where(x[:, 0] * (g + 0.5) + rng.normal(size=60) > 0.3, 1.0, -1.0)
        if g == 3:
            y = np.where(x[:, 0] > 0, 1.0, -1.0)  # separable
        data[g] = (x, y)
    rows = [(g, v.tolist(), float(s)) for g, (x, y) in data.items() for v, s in zip(x, y, strict=True)]
    df = materialise(spark.createDataFrame(rows, "g int, x array<double>, y double").repartition(3), "t")
    for r in linear_models.fit_linear(df, ["g"], "x", "y", loss, c).collect():
        x, y = data[r.g]
        w = np.array(r.weights)
        assert np.abs(gradient(x, y, w, loss, c)).max() < 1e-8 * max(1.0, c * 60)
        assert r.loss == pytest.approx(objective(x, y, w, loss, c))
        for _ in range(20):
            assert objective(x, y, w + rng.normal(scale=0.01, size=len(w)), loss, c) >= r.loss


def test_one_class_and_refusals(spark):
    rows = [("g", [1.0, k / 10], 1.0) for k in range(9)]
    df = materialise(spark.createDataFrame(rows, "g string, x array<double>, y double"), "t")
    got = linear_models.fit_linear(df, ["g"], "x", "y", "squared_hinge").first()
    assert got.weights[-1] >= 1.0 - 1e-6 and np.allclose(got.weights[:2], 0, atol=1e-6)
    for wrong in ({"loss": "hinge"}, {"c": 0.0}):
        with pytest.raises(ValueError):
            linear_models.fit_linear(df, ["g"], "x", "y", **wrong)
    assert linear_models.fit_linear(df.limit(0), ["g"], "x", "y").count() == 0


@pytest.mark.parametrize("loss", linear_models.LOSSES)
def test_predictions_use_the_other_folds_only(spark, loss):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(45, 2)) * [1.0, 30.0] + [5.0, 0.0]
    label = (x[:, 0] + rng.normal(size=45) * 0.5 > 5).astype(int)
    rows = [
        ("s", k, int(label[k]), k % 3, held, x[k].tolist()) for k in range(45) for held in range(3)
    ]
    df = materialise(spark.createDataFrame(
        rows, "subject_id string, trial_id long, class int, fold int, held int, x array<double>"), "t")
    got = {r.trial_id: r for r in linear_models.linear_predictions(df, ["subject_id"], loss).collect()}
    assert len(got) == 45
    for fold in range(3):
        train = np.arange(45) % 3 != fold
        center, scale = x[train].mean(0), x[train].std(0)
        z, y = (x - center) / scale, np.where(label == 1, 1.0, -1.0)
        one = materialise(spark.createDataFrame(
            [(1, v.tolist(), float(s)) for v, s in zip(z[train], y[train], strict=True)],
            "g int, x array<double>, y double"), "t")
        w = np.array(linear_models.fit_linear(one, ["g"], "x", "y", loss).first().weights)
        for k in np.flatnonzero(~train):
            want = z[k] @ w[:-1] + w[-1]
            assert got[k].score == pytest.approx(want, abs=1e-6)
            assert got[k].predicted == int(want > 0)
    hits = sum(got[k].predicted == label[k] for k in range(45))
    assert hits > 34


def test_recentred_sessions_have_the_identity_as_mean(spark):
    rng = np.random.default_rng(4)
    rows = []
    for session in range(3):
        mix = rng.normal(size=(3, 3)) + 2 * np.eye(3)
        for k in range(12):
            a = mix @ rng.normal(size=(3, 30))
            rows.append(("s", session, k, (a @ a.T / 30).ravel().tolist()))
    df = materialise(spark.createDataFrame(rows, "subject_id string, session_id int, trial_id int, cov array<double>"), "t")
    keys = ["subject_id", "session_id"]
    moved = materialise(adaptation.recentred(df, keys), "t")
    assert moved.count() == 36 and set(moved.columns) == set(df.columns)
    for r in riemann.matrix_means(moved, keys).collect():
        assert np.allclose(np.reshape(r["mean"], (3, 3)), np.eye(3), atol=1e-7)
    # Distances between trials of one session stay as they were.
    before = {(r.session_id, r.trial_id): np.reshape(r["cov"], (3, 3)) for r in df.collect()}
    after = {(r.session_id, r.trial_id): np.reshape(r["cov"], (3, 3)) for r in moved.collect()}
    gap = lambda m, a, b: np.sort(np.linalg.eigvals(np.linalg.solve(m[a], m[b])).real)
    assert np.allclose(gap(before, (1, 2), (1, 7)), gap(after, (1, 2), (1, 7)))


def test_coral_gives_every_session_the_targets_moments(spark):
    rng = np.random.default_rng(8)
    rows = []
    for subject in ("a", "b"):
        for session in ("one", "two", "three"):
            x = rng.normal(size=(50, 3)) @ rng.normal(size=(3, 3)) + rng.normal(size=3)
            rows += [(subject, session, k, v.tolist()) for k, v in enumerate(x)]
    rows += [("c", "two", k, [0.0, 1.0, 2.0]) for k in range(3)]  # has no target session
    df = materialise(spark.createDataFrame(rows, "subject_id string, session string, trial_id int, x array<double>"), "t")
    moved = adaptation.coral(df, ["subject_id"], "session", "one", regularization=1e-9).collect()
    assert len(moved) == 300 and {r.subject_id for r in moved} == {"a", "b"}
    for subject in ("a", "b"):
        cell = {s: np.array([r.x for r in moved if (r.subject_id, r.session) == (subject, s)]) for s in ("one", "two", "three")}
        plain = np.array([r[3] for r in rows if r[:2] == (subject, "one")])
        assert np.allclose(np.sort(cell["one"], axis=0), np.sort(plain, axis=0), atol=1e-6)
        for s in ("two", "three"):
            assert np.allclose(cell[s].mean(0), plain.mean(0))
            assert np.allclose(np.cov(cell[s].T), np.cov(plain.T), atol=1e-6)
