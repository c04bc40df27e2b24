"""Token counts from an exact histogram of encoded lengths."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import running_total
from trialweave.session import materialise

#: Fixed value: how the byte-level vocabularies split text before merging.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
MOST_VOCABULARY_BYTES = 64 << 20


def encoded_lengths(
    documents: DataFrame, vocabulary: str, pattern: str = PATTERN, keep: Sequence[str] = ()
) -> DataFrame:
    """n_tokens of every whole text, with the columns named in ``keep``.

    ``vocabulary`` is a file of base64 tokens and ranks that the driver can read; its bytes
    (bounded, checked) are sent to the workers, which need no such file.  Strings that look
    like special tokens are ordinary text.  Null and empty texts have no tokens.
    """
    held = Path(vocabulary).read_bytes()
    if len(held) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {MOST_VOCABULARY_BYTES} bytes")
    sent = documents.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {
            base64.b64decode(token): int(rank)
            for token, rank in (line.split() for line in sent.value.splitlines() if line)
        }
        encoder = tiktoken.Encoding(
            "counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        for batch in batches:
            counts = [len(encoder.encode_ordinary(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts, pa.int64()), *batch.columns[1:]], names=["n_tokens", *keep]
            )

    kinds = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep]
    return documents.select("text", *keep).mapInArrow(run, ", ".join(["n_tokens bigint", *kinds]))


def length_histogram(lengths: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n_docs per encoded length, for all documents and for each value of each ``by`` column.

    Columns scope (``all`` or a column's name), value, n_tokens, n_docs.  Null values form a
    group of their own.  Counts are combined before the shuffle.
    """
    scopes = [F.struct(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("value"))]
    scopes += [
        F.struct(F.lit(c).alias("scope"), F.col(c).cast("string").alias("value")) for c in by
    ]
    return (
        lengths.groupBy("n_tokens", *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select("n_tokens", "n", F.explode(F.array(*scopes)).alias("s"))
        .groupBy("s.scope", "s.value", "n_tokens")
        .agg(F.sum("n").alias("n_docs"))
    )


def context_table(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """What every context limit leaves of every group, by sums over longer lengths.

    One row per group and length ``n_tokens``, taken as the limit: n_docs of that length,
    docs_longer and tokens_longer (suffix sums above it), total_docs, total_tokens,
    truncated_tokens (sum of the lesser of length and limit) and share_within, the share of
    documents at or below the limit.  Between two lengths the truncated total is linear.
    """
    stored = materialise(
        histogram.withColumns({
            "group": F.concat_ws("=", "scope", F.coalesce("value", F.lit("\x00"))),
            "block": F.floor(F.col("n_tokens") / block),
            "tokens": F.col("n_tokens") * F.col("n_docs"),
        }),
        "histogram",
    )
    totals = stored.groupBy("group").agg(
        F.sum("n_docs").alias("total_docs"), F.sum("tokens").alias("total_tokens")
    )
    summed = running_total(
        stored, ["group"], "block", [F.col("n_tokens")],
        {"docs_before": "n_docs", "tokens_before": "tokens"},
    ).join(totals, "group")
    docs_longer = F.col("total_docs") - F.col("docs_before") - F.col("n_docs")
    tokens_longer = F.col("total_tokens") - F.col("tokens_before") - F.col("tokens")
    return summed.select(
        "scope", "value", "n_tokens", "n_docs",
        docs_longer.alias("docs_longer"),
        tokens_longer.alias("tokens_longer"),
        "total_docs", "total_tokens",
        (F.col("total_tokens") - tokens_longer + F.col("n_tokens") * docs_longer)
        .alias("truncated_tokens"),
        ((F.col("total_docs") - docs_longer) / F.col("total_docs")).alias("share_within"),
    )


def truncated_totals(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Tokens each group keeps under each limit: scope, value, limit, tokens."""
    limit = F.explode(F.array(*[F.lit(n).cast("long") for n in limits])).alias("limit")
    return (
        histogram.select("scope", "value", "n_tokens", "n_docs", limit)
        .groupBy("scope", "value", "limit")
        .agg(F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("tokens"))
    )


def length_quantiles(table: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The least length that the given share of each group's documents does not exceed."""
    share = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    return (
        table.select("scope", "value", "n_tokens", "share_within", share)
        .filter("share_within >= share")
        .groupBy("scope", "value", "share")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
