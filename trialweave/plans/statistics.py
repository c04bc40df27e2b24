"""Statistics over units and plateau stopping (DX1-DX6, WN13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.operators import statistics
from trialweave.operators.ordered import block_slice
from trialweave.plans.registry import query, table

#: Digest of a unit in a block of repetitions, as in ``statistics.digest``.
def digest_sql(seed: int) -> str:
    return f"md5('{seed}|' || block::VARCHAR || '|' || unit::VARCHAR)"


def blocks_sql(repetitions: int, size: int) -> str:
    return f"range(0, {-(-repetitions // size)}) AS blocks(block)"


def cdf_sql(x: str) -> str:
    """The normal distribution by the same approximation as ``statistics.normal_cdf``."""
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {statistics.CDF_SCALE}::DOUBLE * abs({x})))"
    upper = f"(exp(-({x}) * ({x}) / 2.0::DOUBLE) / sqrt(2 * pi()) * {t} * {horner_sql(statistics.CDF[::-1], t)})"
    return f"(CASE WHEN {x} >= 0 THEN 1.0::DOUBLE - {upper} ELSE {upper} END)"


def horner_sql(coefficients, x: str) -> str:
    total = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        total = f"({total} * {x} + {c!r}::DOUBLE)"
    return total


def quantile_sql(p: str) -> str:
    far = f"sqrt(-2.0::DOUBLE * ln(least({p}, 1.0::DOUBLE - {p})))"
    tail = f"({horner_sql(statistics.TAIL_UP, far)} / {horner_sql(statistics.TAIL_DOWN, far)})"
    q = f"({p} - 0.5::DOUBLE)"
    centre = f"({q} * {horner_sql(statistics.CENTRE_UP, f'({q} * {q})')} / {horner_sql(statistics.CENTRE_DOWN, f'({q} * {q})')})"
    return f"(CASE WHEN {p} < {statistics.TAIL} THEN {tail} WHEN {p} > {1 - statistics.TAIL!r} THEN -{tail} ELSE {centre} END)"


@query(
    "dx1_macro_f1",
    """
    WITH p AS (SELECT l_linenumber AS fold, l_returnflag AS label, CASE WHEN l_quantity > 25 THEN 'N' WHEN l_tax > 0.04 THEN 'R' ELSE 'A' END AS said FROM lineitem),
    c AS (SELECT fold, label AS c FROM p UNION SELECT fold, said FROM p),
    f AS (SELECT c.fold, c.c, count_if(label = c.c AND said = c.c) AS hit, count_if(label = c.c) + count_if(said = c.c) AS n FROM c JOIN p USING (fold) GROUP BY 1, 2)
    SELECT fold, round(avg(2.0::DOUBLE * hit / n), 9) AS macro_f1 FROM f GROUP BY 1
    """,
)
def dx1_macro_f1(spark, sf):
    said = F.when(F.col("l_quantity") > 25, "N").when(F.col("l_tax") > 0.04, "R").otherwise("A")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("fold"), F.col("l_returnflag").alias("label"), said.alias("said")
    )
    found = statistics.macro_f1(rows, ["fold"], "label", "said")
    return found.withColumn("macro_f1", F.round("macro_f1", 9))


@query(
    "dx1_roc_auc",
    """
    WITH p AS (SELECT event_type, user_id % 3 = 0 AS pos, floor(value)::BIGINT AS score FROM events),
    r AS (SELECT *, (rank() OVER w + (rank() OVER w + count(*) OVER (PARTITION BY event_type, score) - 1)) / 2.0::DOUBLE AS r FROM p WINDOW w AS (PARTITION BY event_type ORDER BY score)),
    s AS (SELECT event_type, sum(CASE WHEN pos THEN r ELSE 0 END) AS s, count_if(pos) AS a, count_if(NOT pos) AS b FROM r GROUP BY 1)
    SELECT event_type, round((s - a * (a + 1) / 2.0::DOUBLE) / (a * b), 9) AS roc_auc FROM s
    """,
)
def dx1_roc_auc(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_type", "user_id", F.floor("value").cast("long").alias("score")
    )
    found = statistics.roc_auc(
        rows, ["event_type"], F.col("user_id") % 3 == 0, "score", block_slice("score", 20)
    )
    return found.withColumn("roc_auc", F.round("roc_auc", 9))


def unit_differences(spark, sf):
    """Per event type and user: mean value of even less that of odd events, whole cents."""
    side = F.col("event_id") % 2 == 0
    cents = F.round(F.col("value") * 100).cast("long")
    return (
        table(spark, sf, "events")
        .groupBy("event_type", "user_id")
        .agg((F.sum(F.when(side, cents).otherwise(-cents)) / F.lit(100.0)).alias("difference"))
    )


DIFFERENCE_SQL = """
    u AS (SELECT event_type, user_id AS unit, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2)
"""


@query(
    "dx2_paired_permutation",
    f"""
    WITH {DIFFERENCE_SQL}, b AS (SELECT event_type, cents, block, ('0x' || {digest_sql(11)}[1:8])::BIGINT AS bits FROM u, {blocks_sql(999, 32)}),
    d AS (SELECT event_type, block * 32 + k AS rep, sum(CASE WHEN (bits >> k) & 1 = 0 THEN cents ELSE -cents END) AS s FROM b, range(0, 32) AS places(k) GROUP BY 1, 2),
    o AS (SELECT event_type, sum(cents) AS seen, count(*) AS units FROM u GROUP BY 1)
    SELECT event_type, units, round(seen / 100.0::DOUBLE, 6) AS statistic, (1 + count_if(abs(s) >= abs(seen))) / 1000.0::DOUBLE AS p_value FROM d JOIN o USING (event_type) WHERE rep < 999 GROUP BY event_type, units, seen
    """,
)
def dx2_paired_permutation(spark, sf):
    found = statistics.paired_permutation(
        unit_differences(spark, sf), ["event_type"], "user_id", "difference", 999, seed=11
    )
    return found.withColumn("statistic", F.round("statistic", 6))


@query(
    "dx2_text_units",
    f"""
    WITH u AS (SELECT o_orderpriority AS family, 'sub-' || o_custkey::VARCHAR AS unit, sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * round(o_totalprice)::BIGINT)::BIGINT AS d FROM orders GROUP BY 1, 2),
    b AS (SELECT family, d, block, ('0x' || {digest_sql(3)}[1:8])::BIGINT AS bits FROM u, {blocks_sql(999, 32)}),
    r AS (SELECT family, block * 32 + k AS rep, sum(CASE WHEN (bits >> k) & 1 = 0 THEN d ELSE -d END) AS s FROM b, range(0, 32) AS places(k) GROUP BY 1, 2),
    o AS (SELECT family, sum(d) AS seen, count(*) AS units FROM u GROUP BY 1)
    SELECT family, units, seen::DOUBLE AS statistic, (1 + count_if(s >= seen)) / 1000.0::DOUBLE AS p_value FROM r JOIN o USING (family) WHERE rep < 999 GROUP BY family, units, seen
    """,
)
def dx2_text_units(spark, sf):
    """One-sided, with subjects named by text."""
    side = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    pairs = (
        table(spark, sf, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("family"),
            F.concat(F.lit("sub-"), F.col("o_custkey").cast("string")).alias("subject"),
        )
        .agg(F.sum(side * F.round("o_totalprice")).alias("difference"))
    )
    found = statistics.paired_permutation(
        pairs, ["family"], "subject", "difference", 999, seed=3, alternative="greater"
    )
    return found.withColumn("statistic", F.round("statistic", 6))


RANK_SQL = """
    r AS (SELECT {key}, d, rank() OVER w + (count(*) OVER (PARTITION BY {key}, abs(d)) - 1) / 2.0::DOUBLE AS r FROM d WINDOW w AS (PARTITION BY {key} ORDER BY abs(d))),
    t AS (SELECT {key}, sum(n * n * n - n) AS ties FROM (SELECT {key}, count(*)::DOUBLE AS n FROM d GROUP BY {key}, abs(d)) GROUP BY 1),
    s AS (SELECT {key}, count(*) AS units, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM r GROUP BY 1),
    z AS (SELECT {key}, units, w_plus, w_minus, (w_plus - units * (units + 1) / 4.0::DOUBLE) / sqrt(units * (units + 1) * (2 * units + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE) AS z FROM s JOIN t USING ({key}))
"""


@query(
    "dx3_signed_rank",
    f"""
    WITH {DIFFERENCE_SQL}, d AS (SELECT event_type, cents // 1000 AS d FROM u WHERE cents // 1000 <> 0),
    {RANK_SQL.format(key="event_type")}
    SELECT event_type, units, w_plus, w_minus, round(z, 9) AS z, round(2 * least({cdf_sql("z")}, {cdf_sql("(-z)")}), 6) AS p_value, 'normal' AS method FROM z
    """,
)
def dx3_signed_rank(spark, sf):
    tens = (F.round(F.col("difference") * 100) / 1000).cast("long")  # towards zero
    rows = unit_differences(spark, sf).withColumn("d", tens)
    # The SQL states the normal form alone, so the exact one is switched off here.
    found = statistics.signed_rank(
        rows, ["event_type"], "d", block_slice("size", 50), exact_units=0
    )
    return found.withColumns({"z": F.round("z", 9), "p_value": F.round("p_value", 6)})


@query(
    "dx3_signed_rank_exact",
    f"""
    WITH RECURSIVE p AS (SELECT l_partkey::VARCHAR || '-' || l_returnflag AS pair, o_custkey AS unit, sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * round(l_quantity)::BIGINT)::BIGINT AS d
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    d AS (SELECT pair, d FROM p WHERE d <> 0),
    {RANK_SQL.format(key="pair")},
    f AS (SELECT pair, w_plus FROM s WHERE units <= 50),
    n AS (SELECT pair, (2 * r)::BIGINT AS twice, row_number() OVER (PARTITION BY pair ORDER BY r) AS place FROM r SEMI JOIN f USING (pair)),
    dp(pair, place, total, share) AS (
      SELECT pair, 0::BIGINT, 0::BIGINT, 1.0::DOUBLE FROM f
      UNION ALL
      SELECT dp.pair, dp.place + 1, dp.total + n.twice * b.bit, sum(dp.share / 2)
      FROM dp JOIN n ON n.pair = dp.pair AND n.place = dp.place + 1, (VALUES (0), (1)) AS b(bit)
      GROUP BY 1, 2, 3),
    e AS (SELECT dp.pair, sum(CASE WHEN total <= 2 * w_plus THEN share ELSE 0 END) AS below, sum(CASE WHEN total >= 2 * w_plus THEN share ELSE 0 END) AS above
      FROM dp JOIN s USING (pair) WHERE dp.place = s.units GROUP BY 1)
    SELECT pair, units, w_plus, w_minus, round(z, 9) AS z, round(least(1.0::DOUBLE, 2 * least(below, above)), 9) AS p_value, 'exact' AS method FROM z JOIN e USING (pair)
    """,
)
def dx3_signed_rank_exact(spark, sf):
    """Exact p of many small groups: the customers of each part and return flag."""
    orders = table(spark, sf, "orders")
    side = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    pairs = (
        table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(
            F.concat(F.col("l_partkey").cast("string"), F.lit("-"), "l_returnflag").alias("pair"),
            F.col("o_custkey").alias("unit"),
        )
        .agg(F.sum(side * F.rint("l_quantity").cast("long")).alias("d"))
    )
    found = statistics.signed_rank(pairs, ["pair"], "d", block_slice("size", 50))
    return found.where("method = 'exact'").withColumns(
        {"z": F.round("z", 9), "p_value": F.round("p_value", 9)}
    )


@query(
    "dx4_holm",
    """
    WITH t AS (SELECT p_brand AS family, p_partkey AS test, (p_retailprice::BIGINT % 997) / 4000.0::DOUBLE AS p FROM part),
    s AS (SELECT *, least(1.0::DOUBLE, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, test) + 1) * p) AS step FROM t)
    SELECT family, test, round(max(step) OVER (PARTITION BY family ORDER BY p, test ROWS UNBOUNDED PRECEDING), 12) AS adjusted_p FROM s
    """,
)
def dx4_holm(spark, sf):
    whole = F.rint("p_retailprice").cast("long")
    tests = table(spark, sf, "part").select(
        F.col("p_brand").alias("family"), F.col("p_partkey").alias("test"), (whole % 997 / F.lit(4000.0)).alias("p")
    )
    found = statistics.holm(tests, ["family"], "test", "p")
    return found.select("family", "test", F.round("adjusted_p", 12).alias("adjusted_p"))


WEIGHT_SQL = " + ".join(f"(share >= {limit})::BIGINT" for limit in statistics.POISSON)


def resamples_sql(seed: int, resamples: int) -> str:
    """Means of all resamples, in cents, and each group's own mean and moments."""
    return f"""
    WITH {DIFFERENCE_SQL}, h AS (SELECT event_type, cents, block, {digest_sql(seed)} AS digest FROM u, {blocks_sql(resamples, 8)}),
    d AS (SELECT event_type, cents, block * 8 + k AS rep, ('0x' || digest[4 * k + 1:4 * k + 4])::BIGINT AS share FROM h, range(0, 8) AS places(k)),
    w AS (SELECT event_type, cents, rep, {WEIGHT_SQL} AS weight FROM d WHERE rep < {resamples}),
    m AS (SELECT event_type, sum(weight * cents)::DOUBLE / sum(weight)::DOUBLE AS m FROM w GROUP BY event_type, rep HAVING sum(weight) > 0),
    l AS (SELECT event_type, list_sort(list(m)) AS means, count(*) - 1 AS last FROM m GROUP BY 1),
    g AS (SELECT event_type, sum(cents)::DOUBLE / count(*) AS mean, max(abs(cents)) * {2.0**-statistics.TIE_BITS!r}::DOUBLE AS slack FROM u GROUP BY 1),
    j AS (SELECT event_type, any_value(mean) AS mean, any_value(slack) AS slack, sum((cents - mean) ** 3) / (6 * sum((cents - mean) ** 2) ** 1.5) AS speed FROM u JOIN g USING (event_type) GROUP BY 1)
    """


def between_sql(place: str) -> str:
    low, high = f"means[floor({place})::BIGINT + 1]", f"means[ceil({place})::BIGINT + 1]"
    return f"round(({low} + ({high} - {low}) * ({place} - floor({place}))) / 100, 6)"


@query(
    "dx5_bootstrap_interval",
    f"""
    {resamples_sql(5, 999)}
    SELECT event_type, {between_sql("(0.05::DOUBLE * last)")} AS low, {between_sql("(0.95::DOUBLE * last)")} AS high FROM l
    """,
)
def dx5_bootstrap_interval(spark, sf):
    found = statistics.bootstrap_interval(
        unit_differences(spark, sf), ["event_type"], "user_id", "difference", 0.9, 999, seed=5
    )
    return found.select("event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    "dx5_bca_interval",
    f"""
    {resamples_sql(8, 1999)},
    b AS (SELECT event_type, (count_if(m < mean - slack) + count_if(m BETWEEN mean - slack AND mean + slack) / 2.0::DOUBLE) / count(*) AS share, any_value(speed) AS speed FROM m JOIN j USING (event_type) GROUP BY 1),
    z AS (SELECT event_type, speed, {quantile_sql("share")} AS bias, {quantile_sql("0.025::DOUBLE")} AS lo, {quantile_sql("0.975::DOUBLE")} AS hi FROM b),
    x AS (SELECT event_type, bias + (bias + lo) / (1 - speed * (bias + lo)) AS a, bias + (bias + hi) / (1 - speed * (bias + hi)) AS b FROM z),
    s AS (SELECT event_type, means, {cdf_sql("a")} * last AS low_place, {cdf_sql("b")} * last AS high_place FROM x JOIN l USING (event_type))
    SELECT event_type, {between_sql("low_place")} AS low, {between_sql("high_place")} AS high FROM s
    """,
)
def dx5_bca_interval(spark, sf):
    """Bias-corrected and accelerated interval at 95 %."""
    found = statistics.bootstrap_interval(
        unit_differences(spark, sf), ["event_type"], "user_id", "difference", 0.95, 1999, seed=8,
        method="bca",
    )
    return found.select("event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    "dx6_subject_reducer",
    """
    WITH u AS (SELECT o_custkey % 40 AS protocol, o_custkey AS subject, CASE WHEN o_custkey % 13 = 1 THEN NULL ELSE max(round(o_totalprice))::DOUBLE END AS v FROM orders GROUP BY 1, 2),
    g AS (SELECT protocol, count(v) AS used, count(*) - count(v) AS missing, avg(v) AS mean, quantile_cont(v, 0.5) AS med FROM u GROUP BY 1)
    SELECT 'macro_mean' AS reducer, protocol, used AS units_used, missing AS units_missing, CASE WHEN missing > 0 THEN 'missing_values' WHEN used < 20 THEN 'too_few_units' ELSE 'ok' END AS status, CASE WHEN missing = 0 AND used >= 20 THEN round(mean, 3) END AS value FROM g
    UNION ALL SELECT 'median', protocol, used, missing, CASE WHEN used < 20 THEN 'too_few_units' ELSE 'ok' END, CASE WHEN used >= 20 THEN round(med, 3) END FROM g
    """,
)
def dx6_subject_reducer(spark, sf):
    customer = F.col("o_custkey")
    units = (
        table(spark, sf, "orders")
        .groupBy((customer % 40).alias("protocol"), customer.alias("subject"))
        .agg(F.max(F.round("o_totalprice")).alias("v"))
        .withColumn("v", F.when(F.col("subject") % 13 != 1, F.col("v")))
    )
    one = statistics.reduce_units(units, ["protocol"], "v", "macro_mean", "fail_closed", 20)
    two = statistics.reduce_units(units, ["protocol"], "v", "median", "complete_case_with_audit", 20)
    both = one.withColumn("reducer", F.lit("macro_mean")).unionByName(two.withColumn("reducer", F.lit("median")))
    return both.withColumn("value", F.round("value", 3))


@query(
    "wn13_plateau",
    """
    WITH s AS (SELECT user_id AS subject, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events),
    b AS (SELECT *, max(value) OVER (PARTITION BY subject ORDER BY place) AS best FROM s), l AS (SELECT *, lag(best, 5) OVER (PARTITION BY subject ORDER BY place) AS past FROM b)
    SELECT subject, count(*) AS candidates, min(CASE WHEN place >= 8 AND best - past < 10 THEN place END) AS stopped_at FROM l GROUP BY 1
    """,
)
def wn13_plateau(spark, sf):
    scores = table(spark, sf, "events").withColumnRenamed("user_id", "subject")
    return statistics.plateau_stop(
        scores, ["subject"], "event_id", "value", block_slice("event_id", 1000), 8, 5, 10.0
    )
