"""Rule tables: every failed rule of every entity becomes one row.

The rules are columns that are true where the rule holds.  A null counts as failed,
since a missing value never proves a rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Column]


def holds(rules: Sequence[Rule]) -> Column:
    """True where every rule holds."""
    return reduce(lambda a, b: a & b, [F.coalesce(ok, F.lit(False)) for _, ok in rules])


def violations(df: DataFrame, entity: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """(entity..., rule_id) for every failed rule.

    One narrow pass without a shuffle; marks, explode and filter all compile into the
    same generated loop.
    """
    marks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in rules]
    exploded = df.select(*entity, F.explode(F.array(*marks)).alias("rule_id"))
    return exploded.where(F.col("rule_id").isNotNull())


def require_empty(df: DataFrame, what: str) -> None:
    """Raise when a violation table has rows; shows a few of them."""
    sample = df.take(5)
    if sample:
        raise ValueError(f"{what}: {[r.asDict() for r in sample]}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def disagreements(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Fields that do not hold one single value within ``keys`` (null is a value).

    Min and max combine map-side, so no set of values is built; the extremes of the
    text form differ exactly when the values do.
    """
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("field"), F.to_json(F.struct(F.col(f).alias("v")), {"ignoreNullFields": "false"}).alias("v"))
                for f in fields
            ]
        )
    )
    return (
        df.select(*keys, pairs.alias("p"))
        .groupBy(*keys, F.col("p.field").alias("field"))
        .agg(F.min("p.v").alias("lowest"), F.max("p.v").alias("highest"))
        .where(F.col("lowest") != F.col("highest"))
        .select(*keys, "field")
    )
