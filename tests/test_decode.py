"""Decoding jobs: quality floors, refusals, and a plain numpy recomputation."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.functions import kernels
from trialweave.operators import decode

SFREQ, CHANNELS, SAMPLES = 128.0, 6, 256


def session(seed, trials=80, subject="s1", session_id="a", start=0):
    """Noise with an 11 Hz rhythm on channel 1 (label 0) or channel 4 (label 1)."""
    rng = np.random.default_rng(seed)
    t = np.arange(SAMPLES) / SFREQ
    out = []
    for i in range(trials):
        label = i % 2
        x = rng.normal(scale=0.8, size=(CHANNELS, SAMPLES))
        x[4 if label else 1] += 1.5 * np.sin(2 * np.pi * 11.0 * t + rng.uniform(0, 2 * np.pi))
        out.append((subject, session_id, start + i, str(label), SFREQ, CHANNELS, x.ravel().tolist()))
    return out


SCHEMA = "subject_id string, session_id string, trial_id long, label string, sfreq double, channels int, samples array<double>"
CANDIDATES = [
    decode.Candidate("bandpower", "bandpower_lda", 8.0, 30.0, 0, 0.1, 4, 17),
    decode.Candidate("csp", "csp_lda", 8.0, 30.0, 4, 0.1, 4, 17),
]


@pytest.fixture(scope="module")
def evaluated(spark):
    rows = session(1) + session(2, subject="s2")
    trials = spark.createDataFrame(rows, SCHEMA).repartition(5)
    summaries = decode.summarise(trials, CANDIDATES)
    return rows, summaries, decode.predictions(summaries, CANDIDATES).toPandas()


def numpy_predictions(rows, candidate):
    """The same evaluation written as loops over one subject's trials."""
    x = np.array([r[6] for r in rows]).reshape(len(rows), CHANNELS, SAMPLES)
    y = np.array([int(r[3]) for r in rows])
    ids = np.array([r[2] for r in rows])
    f = x @ kernels.zero_phase_matrix(SAMPLES, SFREQ, candidate.low, candidate.high).T
    fold = np.empty(len(rows), dtype=int)
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        order = sorted(at, key=lambda i: hashlib.sha256(f"{candidate.random_seed}:{ids[i]}".encode()).hexdigest())
        for k, part in enumerate(np.array_split(np.array(order), candidate.cv_folds)):
            fold[part] = k
    said = np.empty(len(rows), dtype=int)
    for k in range(candidate.cv_folds):
        train, held = fold != k, fold == k
        if candidate.spatial:
            c = f - f.mean(axis=2, keepdims=True)
            cov = c @ c.transpose(0, 2, 1)
            cov = cov / np.trace(cov, axis1=1, axis2=2)[:, None, None]
            w = kernels.spatial_filters(cov[train & (y == 0)].mean(axis=0), cov[train & (y == 1)].mean(axis=0), candidate.csp_components)
            v = np.var(np.einsum("kc,tcs->tks", w, f), axis=2)
            feat = np.log(v / v.sum(axis=1, keepdims=True) + 1e-12)
        else:
            feat = np.log(f.var(axis=2) + 1e-12)
        z = (feat - feat[train].mean(axis=0)) / feat[train].std(axis=0)
        means = np.stack([z[train & (y == c)].mean(axis=0) for c in (0, 1)])
        resid = np.concatenate([z[train & (y == c)] - means[c] for c in (0, 1)])
        cov = resid.T @ resid / (train.sum() - 2)
        cov = 0.9 * cov + 0.1 * np.eye(len(cov)) * np.trace(cov) / len(cov)
        inv = np.linalg.pinv(cov, hermitian=True)
        score = np.stack([z[held] @ inv @ m - 0.5 * m @ inv @ m + np.log((y[train] == c).mean()) for c, m in enumerate(means)], axis=1)
        said[held] = score.argmax(axis=1)
    return dict(zip(ids.tolist(), zip(fold.tolist(), said.tolist(), strict=True), strict=True))


def test_equals_numpy(evaluated):
    rows, _, got = evaluated
    for candidate in CANDIDATES:
        for subject in ("s1", "s2"):
            want = numpy_predictions([r for r in rows if r[0] == subject], candidate)
            mine = got[(got.subject_id == subject) & (got.pipeline_id == candidate.pipeline_id)]
            assert len(mine) == 80
            assert {r.trial_id: (r.fold, r.predicted) for r in mine.itertuples()} == want


def test_quality_floor_and_repeatability(spark, evaluated):
    _, summaries, first = evaluated
    found = decode.evaluate(summaries.repartition(13), CANDIDATES).where("fold = -1").toPandas()
    assert len(found) == 4 and (found.trials == 80).all()
    assert (found.balanced_accuracy >= 0.8).all()
    again = decode.predictions(summaries.repartition(3), CANDIDATES).toPandas()
    key = ["subject_id", "pipeline_id", "trial_id"]
    assert first.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_frozen_model_on_new_session(spark, evaluated):
    _, summaries, _ = evaluated
    models = decode.fit_models(summaries, CANDIDATES).cache()
    assert models.count() == 4 and models.select("model_sha256").distinct().count() == 4
    bands = [(8.0, 30.0)]
    new = spark.createDataFrame(session(9, session_id="b") + session(3, subject="stranger"), SCHEMA)
    held = decode.trial_summaries(new, bands)
    found = decode.evaluate_frozen(models, held, bands).toPandas()
    assert set(found.subject_id) == {"s1"}
    assert (found.balanced_accuracy >= 0.75).all()
    faults = {(r.subject_id, r.rule_id) for r in decode.frozen_faults(models, held).collect()}
    assert ("stranger", "model_of_this_subject") in faults
    slow = new.withColumn("sfreq", F.lit(100.0))
    faults = {(r.subject_id, r.rule_id) for r in decode.frozen_faults(models, decode.trial_summaries(slow, bands)).collect()}
    assert ("s1", "rate_matches_model") in faults


def test_refusals(spark):
    def rules_of(rows, candidates=CANDIDATES):
        summaries = decode.trial_summaries(spark.createDataFrame(rows, SCHEMA), decode._bands(candidates))
        return {r.rule_id for r in decode.decoding_faults(summaries, candidates).collect()}

    good = session(4, trials=12)
    assert rules_of(good) == set()
    broken = [list(r) for r in good]
    broken[3][6] = [float("nan")] + broken[3][6][1:]
    assert rules_of([tuple(r) for r in broken]) == {"samples_finite"}
    assert "two_labels" in rules_of([r[:3] + ("0",) + r[4:] for r in good])
    assert "label_has_a_trial_per_fold" in rules_of(good[:6])
    assert "band_below_nyquist" in rules_of([r[:4] + (50.0,) + r[5:] for r in good])
    short = [r[:6] + (r[6][: 6 * 20],) for r in good]
    assert "samples_cover_padding" in rules_of(short)
    mixed = good[:-1] + [good[-1][:4] + (256.0,) + good[-1][5:]]
    assert "one_signal_shape" in rules_of(mixed)
    many = [decode.Candidate("csp", "csp_lda", 8.0, 30.0, 8)]
    assert "components_within_channels" in rules_of(good, many)


def test_metrics_edges(spark):
    rows = [("a", "x", "x")] * 4 + [("b", "x", "y"), ("b", "y", "y"), ("b", "y", "z"), ("b", "z", "z")]
    got = {
        r.k: r
        for r in decode.classification_metrics(spark.createDataFrame(rows, "k string, t string, p string"), ["k"], "t", "p").collect()
    }
    assert got["a"].accuracy == 1.0 and got["a"].kappa == 0.0
    assert got["b"].balanced_accuracy == pytest.approx((0 + 0.5 + 1) / 3)
    chance = (1 * 0 + 2 * 2 + 1 * 2) / 16
    assert got["b"].kappa == pytest.approx((0.5 - chance) / (1 - chance)) == got["b"].cohen_kappa


def test_fold_sizes(spark):
    for n in (3, 10, 11, 17):
        place = spark.range(1, n + 1).withColumn("fold", decode.fold_of_place(F.col("id"), F.lit(n), 3))
        sizes = [r["count"] for r in place.groupBy("fold").count().orderBy("fold").collect()]
        assert sizes == [len(p) for p in np.array_split(np.arange(n), 3)]
