"""Sliced scans must equal plain windows whatever the slices and partitions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trialweave.operators.ordered import (
    POSITION,
    block_slice,
    hash_slice,
    ordered_position,
    ordered_scan,
    previous,
    running_max,
    running_sum,
    top_rows,
)


def rows(seed, n=400, hot=0.4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if rng.random() < hot else rng.randrange(1, 9)
        value = None if rng.random() < 0.1 else rng.randrange(-50, 50)
        out.append((key, i * rng.randrange(1, 3) * 7 + i, value, f"s{rng.randrange(5)}" if rng.random() < 0.8 else None))
    seen = {}
    return [seen.setdefault((k, t), (k, t, v, s)) for k, t, v, s in out if (k, t) not in seen]


@pytest.mark.parametrize("partitions,width", [(1, 50), (4, 1), (17, 10_000), (4, 300)])
@pytest.mark.parametrize("heavy_rows", [0, 60, 10**9])
def test_scan_equals_window(spark, partitions, width, heavy_rows):
    df = spark.createDataFrame(rows(width), "k long, t long, v long, s string").repartition(partitions)
    got = ordered_scan(
        df,
        ["k"],
        ["t"],
        block_slice("t", width),
        {"p": POSITION, "total": running_sum("v"), "top": running_max("v"), "prev": previous("s")},
        heavy_rows,
    )
    w = Window.partitionBy("k").orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "*",
        F.row_number().over(w).cast("long").alias("p"),
        F.sum("v").over(upto).alias("total"),
        F.max("v").over(upto).alias("top"),
        F.lag("s").over(w).alias("prev"),
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hash_slices_keep_the_order(spark):
    df = spark.range(500).select(F.lit("k").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("h"), F.lit(500).alias("n"))
    got = ordered_position(df, ["k"], ["h"], hash_slice("h", F.col("n"), rows=20), "p", heavy_rows=10)
    want = {r.h: i + 1 for i, r in enumerate(df.orderBy("h").collect())}
    assert {r.h: r.p for r in got.collect()} == want


def test_scan_without_keys(spark):
    df = spark.range(1000).withColumn("t", F.col("id") * 3)
    got = ordered_position(df, [], ["t"], block_slice("t", 100), "p")
    assert got.where(F.col("p") != F.col("id") + 1).count() == 0


def test_top_rows_cuts_before_the_shuffle(spark):
    df = spark.createDataFrame(rows(3), "k long, t long, v long, s string")
    plan = top_rows(df, ["k"], ["t"], 2, "place")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2
    assert plan.groupBy("k").count().where("count > 2").count() == 0
