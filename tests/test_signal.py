"""Signal measurement on sessions with planted rhythms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import signal
from trialweave.operators.ordered import block_slice

SFREQ, SAMPLES = 128.0, 256
NAMES = ("C3", "Cz", "C4", "Pz")


def planted(seed, session_id, amplitude):
    rng = np.random.default_rng(seed)
    wave = np.sin(2 * np.pi * 10.0 * np.arange(SAMPLES) / SFREQ)
    rows, cubes = [], []
    for i in range(40):
        label = 1 + i % 2
        x = rng.normal(scale=0.7, size=(4, SAMPLES))
        x[1 if label == 2 else 2] += (amplitude if label == 2 else 0.8) * wave
        cubes.append(x)
        for c in range(4):
            rows.append(("s1", session_id, i, c, NAMES[c], str(label), SFREQ, x[c].tolist()))
    return rows, np.array(cubes)


SCHEMA = "subject_id string, session_id string, trial_idx long, channel_idx int, channel_name string, label string, sfreq double, samples array<double>"


@pytest.fixture(scope="module")
def sessions(spark):
    one, a = planted(1, "a", 1.1)
    two, b = planted(2, "b", 1.2)
    return spark.createDataFrame(one + two, SCHEMA).repartition(7).cache(), {"a": a, "b": b}


def test_quality(sessions):
    epochs, cubes = sessions
    for r in signal.signal_quality(epochs).collect():
        std = cubes[r.session_id].std(axis=(0, 2))
        assert r.finite_fraction == 1.0
        assert (r.trial_count, r.channel_count, r.sample_count) == (40, 4, 256)
        assert r.channel_std_median == pytest.approx(np.median(std))
        assert r.channel_std_iqr == pytest.approx(np.subtract(*np.percentile(std, [75, 25])))
        assert (r.flat_channels, r.outlier_channels, r.outlier_trials) == (0, 0, 0)


def test_flags(spark, sessions):
    epochs, _ = sessions
    spoilt = epochs.withColumn(
        "samples",
        F.when(F.col("channel_idx") == 3, F.transform("samples", lambda x: F.lit(1.0)))
        .when(F.col("trial_idx") == 5, F.transform("samples", lambda x: x * 1e4))
        .otherwise(F.col("samples")),
    )
    moments = signal.sample_moments(spoilt)
    flat = signal.channel_flags(signal.channel_deviation(moments)).where("flat")
    assert {(r.session_id, r.channel_idx) for r in flat.collect()} == {("a", 3), ("b", 3)}
    odd = signal.trial_flags(moments).where("outlier")
    assert {(r.session_id, r.trial_idx) for r in odd.collect()} == {("a", 5), ("b", 5)}


def test_spectrum_has_the_rhythm(sessions):
    epochs, _ = sessions
    rows = {(r.session_id, r.measure): r for r in signal.spectral_profile(epochs).collect()}
    for s in ("a", "b"):
        assert rows[s, "mu_peak"].hz == 10.0
        total = sum(rows[s, m].relative for m in ("theta_4_8", "mu_8_13", "beta_13_30"))
        assert 0.3 < total < 1.0
        assert rows[s, "motor_8_30"].power == pytest.approx(
            rows[s, "mu_8_13"].power + rows[s, "beta_13_30"].power, rel=1e-9
        )


def test_separability_finds_the_channels(sessions):
    epochs, _ = sessions
    summary, top = signal.class_separability(epochs)
    assert all(r.max_abs_effect > 0 for r in summary.collect())
    best = {r.session_id: r.channel_idx for r in top.where("band = 'mu_8_13' and place = 1").collect()}
    assert set(best.values()) <= {1, 2}
    assert top.where("band = 'mu_8_13'").groupBy("session_id").count().where("count <> 3").count() == 0


def test_stability(sessions):
    epochs, _ = sessions
    features = signal.log_band_features(signal.power_density(epochs), {"motor": (8.0, 30.0)})
    halves = signal.split_half_stability(features, block_slice("trial_idx", 8)).collect()
    assert len(halves) == 2 and all(0 < r.correlation <= 1 for r in halves)
    pairs = signal.session_pair_stability(features).collect()
    assert [(r.left_session, r.right_session) for r in pairs] == [("a", "b")]
    assert pairs[0].correlation > 0.5 and pairs[0].rms_shift < 0.5
    alone = signal.session_pair_stability(features.where("session_id = 'a'"))
    assert alone.count() == 0


def test_constant_vectors_have_no_correlation(spark):
    df = spark.createDataFrame([("k", 1.0, 2.0), ("k", 1.0, 3.0)], "k string, x double, y double")
    assert signal.guarded_correlation(df, ["k"], "x", "y").first().correlation is None


def test_pack_and_unpack(sessions):
    epochs, cubes = sessions
    trials = signal.trials_of_epochs(epochs)
    row = trials.where("session_id = 'a' and trial_idx = 3").first()
    assert np.allclose(np.reshape(row.samples, (4, SAMPLES)), cubes["a"][3])
    back = signal.epochs_of_trials(trials)
    assert back.count() == 320
    one = back.where("session_id = 'b' and trial_idx = 7 and channel_idx = 2").first()
    assert np.allclose(one.samples, cubes["b"][7, 2])


def test_spectrum_refuses_non_finite(spark, sessions):
    epochs, _ = sessions
    bad = epochs.withColumn("samples", F.transform("samples", lambda x, i: F.when(i == 0, float("inf")).otherwise(x)))
    assert signal.power_density(bad.limit(3)).where("psd is not null").count() == 0


def test_concatenation_refuses_mixed_shapes(spark):
    rows = [("s", "a", 1, 64.0, 2, 16), ("s", "b", 1, 64.0, 2, 16), ("t", "a", 1, 64.0, 2, 16), ("t", "b", 1, 32.0, 2, 16)]
    df = spark.createDataFrame(rows, "subject_id string, session_id string, trial_id long, sfreq double, channels int, samples int")
    joined, faults = signal.concatenate_sessions(df, block_slice("trial_id"))
    assert [(r.subject_id, r.field) for r in faults.collect()] == [("t", "sfreq")]
    assert sorted((r.subject_id, r.session_id, r.trial_idx) for r in joined.collect()) == [
        ("s", "a", 0), ("s", "b", 1),
    ]  # the refused subject's sessions stay apart


def test_constant_channel_at_a_high_level_is_flat(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(30):
        for c in range(4):
            x = np.full(SAMPLES, 1234567.891) if c == 2 else 1e6 + rng.normal(size=SAMPLES)
            rows.append(("s", "a", i, c, NAMES[c], "1", SFREQ, x.tolist()))
    epochs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.channel_idx: r["std"] for r in signal.channel_deviation(signal.sample_moments(epochs)).collect()}
    cubes = np.array([r[7] for r in rows]).reshape(30, 4, SAMPLES)
    want = cubes.std(axis=(0, 2))
    assert got[2] < 1e-6
    assert [got[c] for c in (0, 1, 3)] == pytest.approx([want[c] for c in (0, 1, 3)], rel=1e-6)
