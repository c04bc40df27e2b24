"""Ordered scans inside a key that never bring a heavy key to one task.

A plain ``Window.partitionBy(key).orderBy(t)`` sorts all rows of one key in one
task.  When a key holds a large part of the table that task is the job.  Keys are
counted first (map-side combined, key columns only).  Where no key is heavy the plain
window stands.  Otherwise heavy keys are cut into slices: a non-decreasing function of
the ordering column named by the caller (a day of a timestamp, a block of a sequence
number, a part of a hash's range).  Rows are sorted inside (key, slice), and one
summary row per heavy (key, slice) carries the running state from slice to slice.  The
result equals the plain window for any slice function.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.session import materialise

SLICE = "__slice"


@dataclass(frozen=True)
class Running:
    """One output of :func:`ordered_scan`; ``kind`` is position, sum, max or previous."""

    kind: str
    column: str | None = None


POSITION = Running("position")


def running_sum(column: str) -> Running:
    return Running("sum", column)


def running_max(column: str) -> Running:
    return Running("max", column)


def previous(column: str) -> Running:
    return Running("previous", column)


HEAVY_ROWS = 1_000_000


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    outputs: dict[str, Running],
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Add running values over ``order`` (ascending, unique within ``keys``).

    ``keys`` must not be null.  ``keys`` may be empty: the scan then runs over the
    whole table and is always sliced.  The input is evaluated up to four times; write
    an expensive one down first.
    """
    keys = list(keys)
    if not keys:
        sliced = df.withColumn(SLICE, slice_by)
        return _sliced_scan(df.columns, sliced, sliced, keys, order, outputs)
    heavy = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > heavy_rows)
    if heavy.isEmpty():
        return _plain_scan(df, keys, order, outputs)
    heavy = materialise(heavy.select(*keys, F.lit(True).alias("__heavy")), "heavy-keys")
    # Light keys keep a null slice: one window each, and no summary row.
    marked = df.join(heavy, keys, "left").withColumn(SLICE, F.when(F.col("__heavy"), slice_by))
    summarised = df.join(heavy, keys, "left_semi").withColumn(SLICE, slice_by)
    return _sliced_scan(df.columns, marked, summarised, keys, order, outputs)


def _plain_scan(df: DataFrame, keys: list[str], order: Sequence[str], outputs: dict[str, Running]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    make = {
        "position": lambda c: F.row_number().over(w).cast("long"),
        "sum": lambda c: F.sum(c).over(upto),
        "max": lambda c: F.max(c).over(upto),
        "previous": lambda c: F.lag(c).over(w),
    }
    return df.select("*", *[make[o.kind](o.column).alias(name) for name, o in outputs.items()])


def _sliced_scan(
    columns: Sequence[str],
    rows: DataFrame,
    summarised: DataFrame,
    keys: list[str],
    order: Sequence[str],
    outputs: dict[str, Running],
) -> DataFrame:
    local = Window.partitionBy(*keys, SLICE).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys).orderBy(SLICE)
    before = across.rowsBetween(Window.unboundedPreceding, -1)

    here: list[Column] = [F.row_number().over(local).alias("__rn")]
    totals: list[Column] = []
    carried: list[Column] = []
    final: list[Column] = []
    for name, out in outputs.items():
        h, t, c = f"__h_{name}", f"__t_{name}", f"__c_{name}"
        if out.kind == "position":
            totals.append(F.count(F.lit(1)).alias(t))
            carried.append(F.sum(t).over(before).alias(c))
            final.append((F.col("__rn") + F.coalesce(c, F.lit(0))).cast("long").alias(name))
        elif out.kind == "sum":
            here.append(F.sum(out.column).over(upto).alias(h))
            totals.append(F.sum(out.column).alias(t))
            carried.append(F.sum(t).over(before).alias(c))
            final.append(
                F.when(F.col(h).isNull(), F.col(c))
                .when(F.col(c).isNull(), F.col(h))
                .otherwise(F.col(h) + F.col(c))
                .alias(name)
            )
        elif out.kind == "max":
            here.append(F.max(out.column).over(upto).alias(h))
            totals.append(F.max(out.column).alias(t))
            carried.append(F.max(t).over(before).alias(c))
            final.append(F.greatest(h, c).alias(name))
        elif out.kind == "previous":
            here.append(F.lag(out.column).over(local).alias(h))
            totals.append(
                F.max_by(F.struct(F.col(out.column).alias("v")), F.struct(*order)).alias(t)
            )
            carried.append(F.lag(f"{t}.v").over(across).alias(c))
            final.append(
                F.when(F.col("__rn") == 1, F.col(c)).otherwise(F.col(h)).alias(name)
            )
        else:
            raise ValueError(f"unknown running kind: {out.kind}")

    state = summarised.groupBy(*keys, SLICE).agg(*totals).select(*keys, SLICE, *carried)
    return (
        rows.select("*", *here)
        .join(state, [*keys, SLICE], "left")
        .select(*columns, *final)
    )


def ordered_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    name: str = "position",
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """``row_number`` within ``keys`` from 1."""
    return ordered_scan(df, keys, order, slice_by, {name: POSITION}, heavy_rows)


def hash_slice(hash_column: str, size: Column, rows: int = 100_000) -> Column:
    """Slice for rows ordered by a hex digest.

    The digest's range is cut evenly into as many slices as the key's ``size`` needs,
    one for a small key.
    """
    part = F.conv(F.substring(F.col(hash_column), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.floor(part * F.ceil(size / F.lit(rows)))


def block_slice(column: str, rows: int = 100_000) -> Column:
    """Slice for a dense integer order column: blocks of ``rows`` values."""
    return F.floor(F.col(column) / F.lit(rows))


def day_slice(column: str) -> Column:
    """Slice for a timestamp order column: calendar days."""
    return F.to_date(F.col(column))


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str
) -> DataFrame:
    """First ``k`` rows per key in ``order``.

    Catalyst plants a group limit before the shuffle for this filter, so each task
    sends at most ``k`` rows per key and a heavy key stays small.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
