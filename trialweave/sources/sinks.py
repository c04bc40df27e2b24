"""Append, write-once, publish and register operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions.hashing import content_hash
from trialweave.operators.ordered import ordered_position


def sequenced_events(events: DataFrame, existing: DataFrame, run: str, order: str, slice_by: Column) -> DataFrame:
    """New events with sequences that continue each run's log, and a UTC time."""
    placed = ordered_position(events, [run], [order], slice_by, "__p")
    base = existing.groupBy(run).agg((F.max("sequence") + 1).alias("__base"))
    return (
        placed.join(base, run, "left")
        .withColumn("sequence", F.coalesce("__base", F.lit(0)) + F.col("__p") - 1)
        .withColumn("timestamp_utc", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
        .drop("__p", "__base")
    )


LOG_BUCKETS = 64


def append_events(events: DataFrame, path: str, run: str, buckets: int = LOG_BUCKETS) -> None:
    """Append JSON lines below one folder per bucket of runs.

    Buckets keep a run's lines in one folder, so reading a run is a pruned scan,
    without a folder and a file for each of many small runs.
    """
    bucket = F.pmod(F.xxhash64(run), F.lit(buckets)).cast("int")
    events.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").json(path)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, bucket int").json(path)


def write_once(df: DataFrame, path: str) -> None:
    """Write a table that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def publish(df: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Write a derived copy, read it back and return rows whose digest differs.

    An empty result means the copy equals its source.  Digests with their counts are
    compared, so repeated rows matter and nothing leaves the executors.
    """

    def digests(d: DataFrame) -> DataFrame:
        return d.groupBy(content_hash([F.col(c) for c in columns]).alias("sha256")).agg(
            F.count(F.lit(1)).alias("copies")
        )

    df.write.mode("errorifexists").parquet(path)
    copy = df.sparkSession.read.parquet(path)
    left = digests(df).withColumn("side", F.lit("source"))
    right = digests(copy).withColumn("side", F.lit("copy"))
    both = left.unionByName(right)
    return (
        both.groupBy("sha256")
        .agg(
            F.sum(F.when(F.col("side") == "source", F.col("copies")).otherwise(0)).alias("source_rows"),
            F.sum(F.when(F.col("side") == "copy", F.col("copies")).otherwise(0)).alias("copy_rows"),
        )
        .where("source_rows <> copy_rows")
    )


def publication_index(records: DataFrame, key: list[str], order: str) -> DataFrame:
    """Latest record per key (stage and name): last write wins."""
    rest = [c for c in records.columns if c not in key]
    return (
        records.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
        .select(*key, "r.*")
    )


def numbered_revisions(
    incoming: DataFrame, registered: DataFrame, dataset: str, digest: str, order: str, slice_by: Column
) -> DataFrame:
    """First copy of each content per dataset with the next revision number.

    ``registered`` has dataset and last_revision; contents already there are removed
    by the caller with :func:`unregistered`.
    """
    firsts = incoming.groupBy(dataset, digest).agg(F.min(order).alias(order))
    placed = ordered_position(firsts, [dataset], [order], slice_by, "__p")
    return (
        placed.join(registered.select(dataset, "last_revision"), dataset, "left")
        .withColumn("revision_number", (F.coalesce("last_revision", F.lit(0)) + F.col("__p")).cast("long"))
        .withColumn(
            "artifact_id",
            F.concat(
                F.lit("revision-"), F.lpad(F.col("revision_number").cast("string"), 4, "0"), F.lit("-"), F.substring(digest, 1, 12)
            ),
        )
        .drop("__p", "last_revision")
    )


def unregistered(incoming: DataFrame, registry: DataFrame, dataset: str, digest: str) -> DataFrame:
    """Incoming contents the registry does not hold."""
    return incoming.join(registry.select(dataset, digest), [dataset, digest], "left_anti")


def register_revisions(
    incoming: DataFrame, registry: DataFrame, dataset: str, digest: str, order: str, slice_by: Column
) -> DataFrame:
    """New registry rows: unknown contents, numbered after the last of their dataset."""
    last = registry.groupBy(dataset).agg(F.max("revision_number").alias("last_revision"))
    return numbered_revisions(
        unregistered(incoming, registry, dataset, digest), last, dataset, digest, order, slice_by
    )


# Fixed value: characters of an error message kept in a failure row.
ERROR_CHARS = 2000


def failure_rows(attempts: DataFrame) -> DataFrame:
    """Search failures as rows: no results, the message cut to its limit."""
    return attempts.select(
        "search_run_id",
        "query_id",
        "source",
        F.lit(0).alias("result_count"),
        F.lit("failed").alias("status"),
        F.substring("error", 1, ERROR_CHARS).alias("error"),
    )
