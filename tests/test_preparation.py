import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import decode, filter_bank, preparation
from trialweave.session import materialise

TRIALS = "subject_id string, trial_id long, label string, sfreq double, channels int, samples array<double>"


def test_a_planted_blink_vanishes(spark):
    rng = np.random.default_rng(1)
    rows, clean = [], {}
    for k in range(24):
        subject = f"s{k % 2}"
        brain = rng.normal(size=(4, 200 + 50 * (k % 2)))
        blink = np.zeros((2, brain.shape[1]))
        blink[0, 60:90] = 40 * np.hanning(30)
        blink[1] = np.cumsum(rng.normal(size=brain.shape[1]))
        mix = np.array([[0.5, 0.1], [0.2, 0.0], [0.0, 0.3], [1.0, -0.2]]) * (1 + k % 2)
        x = np.concatenate([brain[:2] + mix[:2] @ blink, blink, brain[2:] + mix[2:] @ blink])
        rows.append((subject, k, "a", 250.0, 6, (x + 7.0).ravel().tolist()))
        clean[k] = brain
    df = spark.createDataFrame(rows, TRIALS).repartition(3)
    weights = preparation.fit_eog(df, ["subject_id"], [2, 3])
    for r in preparation.remove_eog(df, weights, ["subject_id"], [2, 3]).collect():
        got = np.reshape(r.samples, (6, -1))
        given = np.reshape(rows[r.trial_id][-1], (6, -1))
        assert np.array_equal(got[2:4], given[2:4])
        left = got[[0, 1, 4, 5]] - got[[0, 1, 4, 5]].mean(1, keepdims=True)
        want = clean[r.trial_id] - clean[r.trial_id].mean(1, keepdims=True)
        assert np.abs(left - want).max() < 0.6 and np.abs(left[:, 60:90]).max() < 6
    # numpy's least squares over all trials of a subject
    for r in weights.collect():
        e, x = [], []
        for s, *_, flat in rows:
            if s == r.subject_id:
                m = np.reshape(flat, (6, -1))
                m = m - m.mean(1, keepdims=True)
                e.append(m[2:4])
                x.append(m[[0, 1, 4, 5]])
        want = np.linalg.lstsq(np.hstack(e).T, np.hstack(x).T, rcond=None)[0].T
        assert np.allclose(np.reshape(r.weights, (6, 2))[[0, 1, 4, 5]], want, atol=1e-6)


def test_laplacian_of_a_constant_field_is_zero(spark):
    rng = np.random.default_rng(2)
    places = {m: rng.normal(size=(9, 3)) for m in ("a", "b")}
    montage = spark.createDataFrame(
        [(m, c, *map(float, p)) for m, own in places.items() for c, p in enumerate(own)],
        "montage string, channel int, x double, y double, z double")
    weights = preparation.laplacian_weights(montage, ["montage"], "channel", neighbours=3)
    table = {}
    for r in weights.collect():
        table.setdefault((r.montage, r.channel), {})[r.neighbour] = r.weight
    for (m, c), own in table.items():
        gap = np.linalg.norm(places[m] - places[m][c], axis=1)
        near = np.argsort(gap)[1:4]
        assert set(own) == {c, *near.tolist()} and own[c] == -1.0
        assert own[int(near[0])] == pytest.approx(1 / gap[near[0]] / (1 / gap[near]).sum())
    field = {(m, k, c): (np.full(5, 3.5) if k == 0 else rng.normal(size=5)) for m in places for k in range(2) for c in range(9)}
    epochs = spark.createDataFrame(
        [(m, k, c, v.tolist()) for (m, k, c), v in field.items()],
        "montage string, trial int, channel int, samples array<double>")
    got = preparation.surface_laplacian(epochs, weights, ["montage", "trial"], "channel", on=["montage"]).collect()
    assert len(got) == 36
    for r in got:
        want = -sum(w * field[r.montage, r.trial, n] for n, w in table[r.montage, r.channel].items())
        assert np.allclose(r.samples, want)
        if r.trial == 0:
            assert np.allclose(r.samples, 0)
    with pytest.raises(ValueError):
        preparation.laplacian_weights(montage, [], "channel")


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 3), (5, 4), (1, 1)])
def test_chunked_equals_whole(spark, up, down):
    rng = np.random.default_rng(3)
    size = max(40, preparation.reach(up, down))
    held = {f"r{k}": rng.normal(size=n) for k, n in enumerate((1, size, size * 3 + 7, size * 5))}
    rows = [
        (name, at, x[lo : lo + size].tolist())
        for name, x in held.items() for at, lo in enumerate(range(0, len(x), size))
    ]
    df = spark.createDataFrame(rows, "recording string, chunk int, samples array<double>").repartition(4)
    got = {}
    for r in preparation.resample_chunks(df, ["recording"], "chunk", up, down).collect():
        got.setdefault(r.recording, {})[r.chunk] = r.samples
    for name, x in held.items():
        pieces = np.concatenate([got[name][c] for c in sorted(got[name])])
        # The definition: zeros between the samples, one filter, every down-th value.
        raised = np.zeros(len(x) * up)
        raised[::up] = x
        taps = preparation.lowpass_taps(up, down)
        whole = np.convolve(raised, taps)[len(taps) // 2 :][: len(raised)][::down]
        assert np.allclose(pieces, whole, atol=1e-12)
    with pytest.raises(ValueError):
        preparation.resample_chunks(df, ["recording"], "chunk", 0, 1)


def test_resampling_keeps_slow_waves_and_drops_fast_ones():
    t = np.arange(2000) / 200.0
    slow, fast = np.sin(2 * np.pi * 8 * t), np.sin(2 * np.pi * 80 * t)
    got = preparation.resample_block(slow + fast, 0, 0, 1000, 1, 2)
    assert np.abs(got - slow[::2])[50:-50].max() < 0.02


def information(v, y, bins):
    low, high = v.min(), v.max()
    b = np.minimum(((v - low) / (high - low) * bins).astype(int), bins - 1) if high > low else np.zeros(len(v), int)
    total = 0.0
    for i in set(b):
        for k in set(y):
            n = ((b == i) & (y == k)).sum()
            if n:
                total += n / len(v) * np.log(n * len(v) / ((b == i).sum() * (y == k).sum()))
    return total


def test_information_and_choice_by_numpy(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(90):
        y = k % 2
        x = rng.normal(size=5)
        x[2] += 2 * y
        x[4] = 1.0  # constant: no information
        x[1] = x[2] + rng.normal() * 0.5
        rows.append(("s", 0, k % 3, k, y, x.tolist()))
    df = spark.createDataFrame(rows, "subject_id string, split int, fold int, trial_id int, class int, x array<double>")
    df = df.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(2))))
    train = df.where("fold <> held")
    got = {(r.held, r.feature): r.information for r in filter_bank.mutual_information(train, ["held"], 6).collect()}
    chosen = {r.held: r.chosen for r in filter_bank.selected_features(df, ["held"], 2, 6).collect()}
    for held in range(3):
        own = [(np.array(r[5]), r[4]) for r in rows if r[2] != held]
        x, y = np.array([a for a, _ in own]), np.array([b for _, b in own])
        want = [information(x[:, f], y, 6) for f in range(5)]
        for f in range(5):
            assert got[held, f] == pytest.approx(want[f], abs=1e-9)
        assert chosen[held] == sorted(np.argsort(-np.array(want))[:2].tolist())
    # Changing held-out rows changes no choice.
    spoilt = df.withColumn("x", F.when(F.col("fold") == F.col("held"), F.transform("x", lambda v: v * 100)).otherwise(F.col("x")))
    assert {r.held: r.chosen for r in filter_bank.selected_features(spoilt, ["held"], 2, 6).collect()} == chosen


def test_the_bank_finds_the_informative_band(spark):
    rng = np.random.default_rng(5)
    t = np.arange(256) / 128.0
    rows = []
    for k in range(48):
        label = "ab"[k % 2]
        x = rng.normal(size=(4, 256))
        x[1] += (3.0 if label == "b" else 0.5) * np.sin(2 * np.pi * 20 * t + rng.uniform(0, 6))
        rows.append(("s", k, label, 128.0, 4, x.ravel().tolist()))
    bank = [decode.Candidate(f"b{int(lo)}", "csp_lda", lo, lo + 6.0, 2, 0.1, 3, 1) for lo in (6.0, 17.0, 30.0)]
    summaries = decode.summarise(spark.createDataFrame(rows, TRIALS), bank)
    said = materialise(filter_bank.bank_predictions(summaries, bank, most=2), "t").collect()
    assert len(said) == 48 and sum(r["class"] == r.predicted for r in said) >= 44
    covs = decode._prepared(summaries, bank, [(3, 1)])
    features = materialise(filter_bank.bank_features(covs, 2), "t")
    chosen = filter_bank.selected_features(features, ["subject_id", "split", "held"], 2).collect()
    assert len(chosen) == 3 and all(set(r.chosen) & {2, 3} for r in chosen)  # the second band's
    with pytest.raises(ValueError):
        filter_bank.bank_predictions(summaries, [*bank, decode.Candidate("x", "csp_lda", 8.0, 9.0, 4)])
