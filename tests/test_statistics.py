import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import statistics
from trialweave.operators.ordered import block_slice


def test_auc_and_f1_by_definition(spark):
    rng = np.random.default_rng(2)
    rows = [(k % 2, int(rng.integers(0, 9)), bool(rng.random() < 0.4), int(rng.integers(0, 3))) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, score long, pos boolean, said int")
    got = {r.g: r.roc_auc for r in statistics.roc_auc(df, ["g"], F.col("pos"), "score", block_slice("score", 2)).collect()}
    for g in (0, 1):
        pos = [r[1] for r in rows if r[0] == g and r[2]]
        neg = [r[1] for r in rows if r[0] == g and not r[2]]
        wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert got[g] == pytest.approx(wins / (len(pos) * len(neg)))
    f1 = {r.g: r.macro_f1 for r in statistics.macro_f1(df.withColumn("pos", F.col("pos").cast("int")), ["g"], "pos", "said").collect()}
    for g in (0, 1):
        own = [(int(r[2]), r[3]) for r in rows if r[0] == g]
        scores = []
        for c in {x for pair in own for x in pair}:
            hit = sum(a == b == c for a, b in own)
            scores.append(2 * hit / sum((a == c) + (b == c) for a, b in own))
        assert f1[g] == pytest.approx(np.mean(scores))


def test_auc_of_one_kind_is_null(spark):
    df = spark.createDataFrame([(1, 3, True)], "g int, score long, pos boolean")
    assert statistics.roc_auc(df, ["g"], F.col("pos"), "score", block_slice("score")).first().roc_auc is None


def test_permutation_and_interval_find_a_shift(spark):
    rng = np.random.default_rng(4)
    rows = [(g, u, float(rng.normal(1.0 if g else 0.0, 1.0))) for g in (0, 1) for u in range(40)]
    df = spark.createDataFrame(rows, "g int, u long, d double")
    p = {r.g: r.p_value for r in statistics.paired_permutation(df, ["g"], "u", "d", seed=3).collect()}
    assert p[1] < 0.01 < 0.1 < p[0]
    one = {r.g: r.p_value for r in statistics.paired_permutation(df, ["g"], "u", "d", seed=3, alternative="less").collect()}
    assert one[1] > 0.99
    held = {r.g: r for r in statistics.bootstrap_interval(df, ["g"], "u", "d", seed=3).collect()}
    for g in (0, 1):
        own = np.array([r[2] for r in rows if r[0] == g])
        half = 1.96 * own.std() / np.sqrt(len(own))
        assert held[g].low == pytest.approx(own.mean() - half, abs=0.12)
        assert held[g].high == pytest.approx(own.mean() + half, abs=0.12)
    with pytest.raises(ValueError):
        statistics.paired_permutation(df, ["g"], "u", "d", permutations=10)


def test_signed_rank_without_differences(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (2, 5)], "g int, d long")
    got = {r.g: r for r in statistics.signed_rank(df, ["g"], "d", block_slice("size", 2)).collect()}
    assert set(got) == {2} and got[2].w_plus == 1.0 and got[2].w_minus == 0.0


def test_plateau_and_holm(spark):
    scores = [1.0, 2.0, 2.05, 2.06, 2.07, 5.0]
    df = spark.createDataFrame([("s", k, v) for k, v in enumerate(scores)], "s string, at long, v double")
    stop = statistics.plateau_stop(df, ["s"], "at", "v", block_slice("at", 2), 2, 2, 0.1)
    assert [tuple(r) for r in stop.collect()] == [("s", 6, 4)]
    tests = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "f string, t string, p double")
    got = {r.t: round(r.adjusted_p, 9) for r in statistics.holm(tests, ["f"], "t", "p").collect()}
    assert got == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_draws_are_even_and_independent_over_units(spark):
    block = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("block")
    drawn = spark.range(1, 31).select(F.col("id").alias("unit"), block)
    bits = statistics.sign_bits(9, F.col("block"), F.col("unit"))
    rows = drawn.select("unit", "block", bits.alias("bits")).collect()
    signs = np.zeros((30, 32 * 32))
    for r in rows:
        for k in range(32):
            signs[r.unit - 1, r.block * 32 + k] = 1 - 2 * (r.bits >> k & 1)
    related = np.corrcoef(signs) - np.eye(30)
    assert np.abs(related).max() < 0.15 and related.std() < 0.04
    assert abs(signs.mean()) < 0.02
    heavy = spark.range(500).select(
        F.explode(F.array(*statistics.weights(2, F.lit(3), F.col("id")))).alias("w")
    ).collect()
    held = np.array([r.w for r in heavy])
    assert abs(held.mean() - 1) < 0.06 and abs(held.var() - 1) < 0.12 and held.max() <= 8


def test_permutation_like_full_enumeration(spark):
    rng = np.random.default_rng(7)
    rows = [(g, f"sub-{u}", float(rng.normal(0.3 * g, 1.0))) for g in range(6) for u in range(10)]
    df = spark.createDataFrame(rows, "g int, u string, d double")
    signs = 1 - 2 * ((np.arange(1024)[:, None] >> np.arange(10)) & 1)
    for alternative in ("two_sided", "greater", "less"):
        got = {
            r.g: r for r in statistics.paired_permutation(
                df, ["g"], "u", "d", 9999, seed=1, alternative=alternative
            ).collect()
        }
        for g in range(6):
            own = np.array([r[2] for r in rows if r[0] == g])
            sums, seen = signs @ own, own.sum()
            extreme = {
                "two_sided": np.abs(sums) >= abs(seen) - 1e-9,
                "greater": sums >= seen - 1e-9,
                "less": sums <= seen + 1e-9,
            }[alternative]
            assert got[g].p_value == pytest.approx(extreme.mean(), abs=0.02)
            assert got[g].statistic == pytest.approx(seen) and got[g].units == 10


@pytest.mark.parametrize("scale", [4e-7, 1.0, 3e12])
def test_p_does_not_depend_on_the_unit_of_measure(spark, scale):
    values = [0.1, 0.2, 0.3, -0.1, 0.4, 0.2, 0.3, 0.5]
    df = spark.createDataFrame([("g", k, v * scale) for k, v in enumerate(values)], "g string, u long, d double")
    one = statistics.paired_permutation(df, ["g"], "u", "d", seed=2).first()
    assert one.statistic == pytest.approx(sum(values) * scale)
    # 0.1 + 0.2 and 0.3 are equal sums: decimal fractions tie as they would on paper.
    whole = spark.createDataFrame([("g", k, round(v * 10)) for k, v in enumerate(values)], "g string, u long, d long")
    assert one.p_value == statistics.paired_permutation(whole, ["g"], "u", "d", seed=2).first().p_value < 0.2


def test_missing_differences_and_repeated_units(spark):
    nothing, infinite = float("nan"), float("inf")
    rows = [("g", "a", 1.0), ("g", "a", 2.0), ("g", "b", None), ("g", "c", nothing), ("g", "d", infinite), ("g", None, -1.0), ("h", "a", None)]
    df = spark.createDataFrame(rows, "g string, u string, d double")
    got = statistics.paired_permutation(df, ["g"], "u", "d").collect()
    assert [(r.g, r.statistic) for r in got] == [("g", 2.0)]
    # Signs: rows of "a" move together, so |3 + 1| and |3 - 1| are the only sums.
    assert 0.9 <= got[0].p_value <= 1.0
    assert statistics.bootstrap_interval(df.limit(0), ["g"], "u", "d").count() == 0


def numpy_bca(own, level, resamples, rng):
    from statistics import NormalDist

    normal = NormalDist()
    means = np.sort(own[rng.integers(0, len(own), (resamples, len(own)))].mean(1))
    bias = normal.inv_cdf(((means < own.mean()).sum() + (means == own.mean()).sum() / 2) / resamples)
    left_out = (own.sum() - own) / (len(own) - 1)
    off = left_out.mean() - left_out
    speed = (off**3).sum() / (6 * (off**2).sum() ** 1.5)
    out = []
    for share in ((1 - level) / 2, (1 + level) / 2):
        z = bias + normal.inv_cdf(share)
        out.append(np.quantile(means, normal.cdf(bias + z / (1 - speed * z))))
    return out


def test_bca_like_numpy_with_real_resampling(spark):
    rng = np.random.default_rng(11)
    rows = [(g, f"s{u}", float(np.exp(rng.normal(0, 1.0)) * (10.0**g))) for g in range(3) for u in range(60)]
    df = spark.createDataFrame(rows, "g int, u string, d double")
    got = {r.g: r for r in statistics.bootstrap_interval(df, ["g"], "u", "d", 0.9, 8000, seed=4, method="bca").collect()}
    plain = {r.g: r for r in statistics.bootstrap_interval(df, ["g"], "u", "d", 0.9, 8000, seed=4).collect()}
    for g in range(3):
        own = np.array([r[2] for r in rows if r[0] == g])
        spread = own.std() / np.sqrt(len(own))
        low, high = numpy_bca(own, 0.9, 40_000, rng)
        assert got[g].low == pytest.approx(low, abs=0.15 * spread)
        assert got[g].high == pytest.approx(high, abs=0.15 * spread)
        # Skewed values move both ends up.
        assert got[g].low > plain[g].low and got[g].high > plain[g].high
    with pytest.raises(ValueError):
        statistics.bootstrap_interval(df, ["g"], "u", "d", method="student")


def test_intervals_of_equal_values(spark):
    df = spark.createDataFrame([("g", k, 2.5) for k in range(9)], "g string, u long, d double")
    for method in ("percentile", "bca"):
        got = statistics.bootstrap_interval(df, ["g"], "u", "d", method=method).first()
        assert (got.low, got.high) == (2.5, 2.5)


def test_normal_columns(spark):
    from statistics import NormalDist

    normal = NormalDist()
    points = [-6.0, -2.3, -0.4, 0.0, 0.7, 1.96, 5.0]
    shares = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.8, 0.99, 1 - 1e-9]
    x = spark.createDataFrame([(v,) for v in points], "x double").select("x", statistics.normal_cdf(F.col("x")).alias("p"))
    for r in x.collect():
        assert r.p == pytest.approx(normal.cdf(r.x), abs=1e-7)
    p = spark.createDataFrame([(v,) for v in shares], "p double").select("p", statistics.normal_quantile(F.col("p")).alias("x"))
    for r in p.collect():
        assert r.x == pytest.approx(normal.inv_cdf(r.p), rel=1e-8, abs=1e-8)


def test_signed_rank_like_enumeration(spark):
    rng = np.random.default_rng(3)
    rows = [(n, int(d)) for n in range(1, 13) for d in rng.choice([-4, -3, -2, -1, 1, 2, 3, 4], n)]
    df = spark.createDataFrame(rows, "g int, d long")
    for alternative in ("two_sided", "greater", "less"):
        got = {r.g: r for r in statistics.signed_rank(df, ["g"], "d", block_slice("size", 2), alternative).collect()}
        for n in range(1, 13):
            own = np.array([d for g, d in rows if g == n])
            size = np.abs(own)
            ranks = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
            sums = ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1) @ ranks
            seen = ranks[own > 0].sum()
            below, above = (sums <= seen).mean(), (sums >= seen).mean()
            want = {"less": below, "greater": above, "two_sided": min(1.0, 2 * min(below, above))}[alternative]
            assert got[n].w_plus == seen and got[n].units == n and got[n].method == "exact"
            assert got[n].p_value == pytest.approx(want, abs=1e-12)


def test_signed_rank_of_large_groups_is_nearly_exact(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(g, float(rng.normal(0.15, 1.0))) for g in range(3) for _ in range(50)], "g int, d double")
    one, two = ({r.g: r for r in statistics.signed_rank(df, ["g"], "d", F.floor(F.col("size")), exact_units=n).collect()} for n in (50, 49))
    for g in range(3):
        assert (one[g].method, two[g].method) == ("exact", "normal")
        assert one[g].p_value == pytest.approx(two[g].p_value, abs=0.01)


def test_reducers_keep_small_values(spark):
    rows = [("a", 1e-9), ("a", 3e-9), ("a", 8e-9), ("b", None), ("b", 2.0), ("c", float("nan")), ("d", -1e15), ("d", 1e15)]
    df = spark.createDataFrame(rows, "g string, v double")
    mean = {r.g: r for r in statistics.reduce_units(df, ["g"], "v").collect()}
    assert mean["a"].value == pytest.approx(4e-9) and mean["d"].value == 0.0
    assert (mean["b"].status, mean["b"].value) == ("missing_values", None)
    middle = {r.g: r for r in statistics.reduce_units(df, ["g"], "v", "median", "complete_case_with_audit", 1).collect()}
    assert middle["a"].value == 3e-9 and middle["b"].value == 2.0
    assert (middle["c"].status, middle["c"].units_missing) == ("too_few_units", 1)
