"""Bracketed counting must equal numpy's linear interpolation exactly."""

import numpy as np
import pytest

from trialweave.operators.quantiles import exact_quantiles, robust_z


def shapes():
    rng = np.random.default_rng(5)
    return {
        "normal": rng.normal(size=3000),
        "heavy_tail": np.concatenate([rng.normal(size=2000), [1e300, -1e300, 1e200]]),
        "few_values": rng.integers(0, 4, size=2500).astype(float),
        "constant": np.full(700, 3.25),
        "one": np.array([4.0]),
        "two": np.array([1.0, 2.0]),
        "half_ties": np.concatenate([np.zeros(900), rng.random(900)]),
    }


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_against_numpy(spark, accuracy):
    data = [(k, float(v)) for k, values in shapes().items() for v in values]
    data += [("normal", float("nan")), ("normal", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(11)
    wanted = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99, "q100": 1.0}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", wanted, accuracy).collect()}
    assert set(got) == set(shapes())
    for k, values in shapes().items():
        for name, p in wanted.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12), (k, name)


@pytest.mark.parametrize("most", [1, 40])
def test_narrowed_brackets_against_numpy(spark, most, monkeypatch):
    """Groups far larger than what a task may rank: brackets are cut down first."""
    monkeypatch.setattr("trialweave.operators.quantiles.BINS", 8)
    shaped = shapes() | {"wide": np.random.default_rng(2).lognormal(0, 20, 4000)}
    df = spark.createDataFrame(
        [(k, float(v)) for k, values in shaped.items() for v in values], "k string, v double"
    ).repartition(5)
    wanted = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q999": 0.999}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", wanted, 20, most_inside=most).collect()}
    for k, values in shaped.items():
        for name, p in wanted.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12), (k, name)


def test_robust_z(spark):
    values = np.random.default_rng(1).normal(size=501)
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 2.0)] * 5, "k string, v double")
    got = robust_z(df, ["k"], "v", "z", accuracy=20).toPandas()
    median = np.median(values)
    scale = 1.4826 * np.median(np.abs(values - median))
    mine = got[got.k == "a"]
    assert np.allclose(mine.z, (mine.v - median) / scale)
    assert (got[got.k == "b"].z == 0).all()
