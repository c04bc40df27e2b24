"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a word is a run of characters other than these ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def free_name(rows: DataFrame, name: str) -> str:
    """A column name like ``name`` that the caller's table does not use."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_cell(cells: int, *columns: Column | str) -> Column:
    """A cell from 0 to ``cells`` - 1, drawn by hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(cells))


def running_total(
    rows: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[Column],
    values: dict[str, str],
) -> DataFrame:
    """Sums over the rows before each row, in order of (block, *order) within keys.

    ``values`` maps a new column to the column it sums.  Blocks are summed first (with
    map-side combine), the few block sums are accumulated per key, and each block is then
    ordered on its own, so no key is ever sorted in one task.  ``rows`` is read twice: pass
    a stored table.  Keys must not hold nulls.
    """
    ahead = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    inside = (
        Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("long")
    starts = (
        rows.groupBy(*keys, block)
        .agg(*[F.sum(value).alias(f"_start_{into}") for into, value in values.items()])
        .withColumns(
            {
                f"_start_{into}": F.coalesce(F.sum(f"_start_{into}").over(ahead), zero)
                for into in values
            }
        )
    )
    held = rows.join(starts, [*keys, block])
    return held.withColumns(
        {
            into: F.col(f"_start_{into}") + F.coalesce(F.sum(value).over(inside), zero)
            for into, value in values.items()
        }
    ).drop(*[f"_start_{into}" for into in values])


def join_frequent(
    rows: DataFrame, table: DataFrame, key: str, value: str, count: str, total: int
) -> DataFrame:
    """Add ``value`` of a table with one row per key to rows, whatever the key's share.

    ``table`` holds in ``count`` how many of the ``total`` rows have each key.  Keys with
    more than a thousandth of the rows are fewer than 1000, so they are broadcast; each
    other key is small enough to be shuffled.  ``rows`` is read twice: pass a stored table.
    """
    frequent = F.col(count) * 1000 > F.lit(total)
    few = table.filter(frequent).select(key, F.col(value).alias("_few"), F.lit(1).alias("_hit"))
    many = table.filter(~frequent).select(key, value)
    marked = rows.join(F.broadcast(few), key, "left")
    hot = marked.filter("_hit is not null").withColumnRenamed("_few", value)
    rest = marked.filter("_hit is null").drop("_few", "_hit").join(many, key)
    return hot.select(*rows.columns, value).unionByName(rest.select(*rows.columns, value))
