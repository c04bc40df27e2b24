import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialweave.functions import manifold
from trialweave.operators import decode, riemann
from trialweave.operators.sums import array_sums
from trialweave.session import materialise


def spectral(m, f):
    values, vectors = np.linalg.eigh(m)
    return (vectors * f(values)) @ vectors.T


def karcher(mats):
    """The mean by its own definition: a point from which all log maps add to nothing."""
    m = np.mean(mats, axis=0)
    for _ in range(200):
        root, back = spectral(m, np.sqrt), spectral(m, lambda v: 1 / np.sqrt(v))
        step = np.mean([spectral(back @ c @ back, np.log) for c in mats], axis=0)
        m = root @ spectral(step, np.exp) @ root
        if np.linalg.norm(step) < 1e-13:
            break
    return m


def wishart(rng, size, n=40, scale=None):
    a = rng.normal(size=(size, n)) * (1.0 if scale is None else np.asarray(scale)[:, None])
    return a @ a.T / n


def test_sums_of_arrays(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k % 3), None if k % 5 == 0 else f"s{k % 2}", rng.normal(size=4).tolist()) for k in range(200)]
    rows.append((9, "none", None))
    df = spark.createDataFrame(rows, "a int, b string, v array<double>")
    got = {(r.a, r.b): r for r in array_sums(df.repartition(7), ["a", "b"], "v").collect()}
    want = {}
    for a, b, v in rows:
        if v is not None:
            want.setdefault((a, b), []).append(v)
    assert set(got) == set(want)
    for key, own in want.items():
        assert got[key].n == len(own)
        assert np.allclose(got[key].total, np.sum(own, axis=0))
    assert array_sums(df.limit(0), ["a"], "v").count() == 0


def test_many_keys_are_sent_on_early(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") % 4100).alias("k"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    got = {r.k: r for r in array_sums(df, ["k"], "v").collect()}
    assert len(got) == 4100 and got[3].n == 2 and list(got[3].total) == [2.0, 4106.0]
    assert got[4000].n == 1


@pytest.mark.parametrize("metric", ["riemann", "logeuclid"])
def test_means_like_numpy(spark, metric):
    rng = np.random.default_rng(5)
    held = {g: [wishart(rng, 4, scale=[1, 2, 3, 0.1 * (g + 1)]) for _ in range(15)] for g in range(3)}
    rows = [(g, m.ravel().tolist()) for g, mats in held.items() for m in mats]
    df = materialise(spark.createDataFrame(rows, "g int, cov array<double>").repartition(4), "t")
    got = {r.g: np.reshape(r["mean"], (4, 4)) for r in riemann.matrix_means(df, ["g"], metric).collect()}
    for g, mats in held.items():
        if metric == "riemann":
            want = karcher(mats)
        else:
            want = spectral(np.mean([spectral(m, np.log) for m in mats], axis=0), np.exp)
        assert np.allclose(got[g], want, rtol=1e-7, atol=1e-10)


def test_shrinkage_by_its_formula():
    rng = np.random.default_rng(2)
    n, p = 20, 5
    x = rng.normal(size=(p, n))
    s = x @ x.T / n
    flat = pd.Series([(s * n).ravel(), np.zeros(p * p)])
    got = manifold.shrunk_batch(flat, pd.Series([n, n]), True)
    trace, squares = np.trace(s), (s * s).sum()
    weight = min(1, ((1 - 2 / p) * squares + trace**2) / ((n + 1 - 2 / p) * (squares - trace**2 / p)))
    want = (1 - weight) * s + weight * trace / p * np.eye(p)
    assert np.allclose(got[0].reshape(p, p), want) and got[1] is None
    assert np.allclose(manifold.shrunk_batch(flat, pd.Series([n, n]), False)[0].reshape(p, p), s)


@pytest.fixture(scope="module")
def summaries(spark):
    """Two subjects; class b has more power in the second of four channels."""
    rng = np.random.default_rng(9)
    rows = []
    for subject in range(2):
        for k in range(36):
            label = "ab"[k % 2]
            gain = np.array([1.0, 2.0 if label == "b" else 1.0, 1.0, 1.0])
            mix = np.eye(4) + 0.3 * np.tri(4)
            x = mix @ (gain[:, None] * rng.normal(size=(4, 96)))
            rows.append((f"sub-{subject}", subject * 100 + k, label, 128.0, 4, x.ravel().tolist()))
    df = spark.createDataFrame(rows, "subject_id string, trial_id long, label string, sfreq double, channels int, samples array<double>")
    return decode.summarise(df, [CANDIDATES[0]])


CANDIDATES = [
    riemann.ManifoldCandidate(f"{f}-{m}", f, 8.0, 30.0, cv_folds=3, random_seed=1, metric=m)
    for f in ("tangent_lda", "mdm") for m in ("riemann", "logeuclid")
]


def test_candidates_decode_a_planted_difference(summaries):
    got = riemann.evaluate(summaries, CANDIDATES).where("fold = -1").collect()
    assert len(got) == 8
    for r in got:
        assert r.trials == 36 and r.balanced_accuracy > 0.75, (r.subject_id, r.pipeline_id)


def test_everything_is_fitted_on_the_other_folds(spark, summaries):
    """Distances and tangent vectors of each fold follow from its training trials alone."""
    rows = decode._prepared(summaries, CANDIDATES, [(3, 1)])
    covs = materialise(riemann.shrunk_covariances(rows), "t")
    train = riemann._training_rows(covs)
    held = [r.asDict() for r in covs.where("subject_id = 'sub-1'").collect()]
    for r in held:
        r["cov"] = np.reshape(r["cov"], (4, 4))
    features = riemann.tangent_features(covs, train, "riemann").where("subject_id = 'sub-1'").collect()
    gaps = riemann.class_distances(covs, train, "riemann").where("subject_id = 'sub-1'").collect()
    assert len(features) == 3 * 36 and len(gaps) == 2 * 36
    for fold in range(3):
        point = karcher([r["cov"] for r in held if r["fold"] != fold])
        back = spectral(point, lambda v: 1 / np.sqrt(v))
        means = [karcher([r["cov"] for r in held if r["fold"] != fold and r["class"] == c]) for c in (0, 1)]
        own = {r["trial_id"]: r["cov"] for r in held}
        for f in (f for f in features if f.held == fold):
            log = spectral(back @ own[f.trial_id] @ back, np.log)
            upper = np.triu_indices(4)
            want = log[upper] * np.where(upper[0] == upper[1], 1.0, np.sqrt(2))
            assert np.allclose(f.x, want, atol=1e-6)
        for g in (g for g in gaps if g.fold == fold):
            inner = spectral(means[g.of_class], lambda v: 1 / np.sqrt(v))
            want = np.linalg.norm(spectral(inner @ own[g.trial_id] @ inner, np.log))
            assert g.distance == pytest.approx(want, abs=1e-6)


def test_unknown_settings_are_refused():
    for wrong in ({"family": "svm"}, {"metric": "flat"}, {"covariance": "sample"}):
        with pytest.raises(ValueError):
            riemann.ManifoldCandidate(**({"pipeline_id": "x", "family": "mdm", "low": 8.0, "high": 30.0} | wrong))
