"""Content hashes over rows: canonical text, short ids, order-free set digests.

Hash input is text built from explicitly formatted columns, so another engine can
form the same bytes.  A value is written after its length and a null as a mark of its own,
so different rows never share a text, whatever characters they hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: stands for null; a value starts with its length instead.
NULL_MARK = "~"
# All 64 hex digits of an item hash are summed in pieces of six, the last of
# four, so a sum of up to 2^39 items fits a long.
PIECES = 11
WIDTH = 6


def canonical_text(columns: Sequence[Column]) -> Column:
    """``length:value`` of each column, joined; a null is the mark alone."""
    texts = [c.cast("string") for c in columns]
    return F.concat_ws(
        "|",
        *[
            F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit(NULL_MARK))
            for t in texts
        ],
    )


def canonical_sql(*values: str) -> str:
    """The same text as an SQL expression."""
    parts = [
        f"coalesce(length(({v})::VARCHAR) || ':' || ({v})::VARCHAR, '{NULL_MARK}')" for v in values
    ]
    return f"concat_ws('|', {', '.join(parts)})"


def content_hash(columns: Sequence[Column]) -> Column:
    return F.sha2(canonical_text(columns), 256)


def short_id(prefix: str, digest: Column, digits: int) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(digest, 1, digits))


def decision_id(question: Column) -> Column:
    """Stable id of a question: case and white space do not matter."""
    text = F.trim(F.regexp_replace(F.lower(F.trim(question)), r"(?U)\s+", " "))
    return short_id("profile-decision", F.sha2(text, 256), 12)


def external_blocker_id(description: Column) -> Column:
    return short_id("external", F.sha2(F.trim(description), 256), 12)


def set_digest(df: DataFrame, keys: Sequence[str], item_hash: str, name: str) -> DataFrame:
    """Order-free digest of each key's items, with nothing collected.

    Every item digest is cut, to its last digit, into 24-bit pieces, pieces are summed, and the sums with
    the item count are hashed.  Sums combine map-side, so a key with any number of
    items costs one row per task in the shuffle.
    """
    pieces = [
        F.sum(
            F.conv(F.substring(F.col(item_hash), 1 + WIDTH * i, WIDTH), 16, 10).cast("long")
        ).alias(f"__p{i}")
        for i in range(PIECES)
    ]
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *pieces)
    text = F.concat_ws(":", "__n", *[F.col(f"__p{i}") for i in range(PIECES)])
    return sums.select(*keys, F.col("__n").alias("item_count"), F.sha2(text, 256).alias(name))


def set_digest_sql(item_hash: str) -> str:
    """The same digest as an SQL aggregate expression over one group."""
    sums = ", ".join(
        f"sum(('0x' || substr({item_hash}, {1 + WIDTH * i}, {WIDTH}))::BIGINT)::BIGINT"
        for i in range(PIECES)
    )
    return f"sha256(concat_ws(':', count(*), {sums}))"
