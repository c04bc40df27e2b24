"""A corpus pipeline of five stages, each one operator of ``trialweave.llm``.

Each stage takes the documents its predecessor kept, written as Parquet below the shared
folder and read again, and returns documents with the same columns; the last one returns
their places in shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialweave.llm import decontaminate, mixing, quality, shards, simhash
from trialweave.session import materialise, ship

#: Ranking and fingerprints have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    ship(spark)
    return docs.select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.of_good_quality(_documents(spark, docs), labels)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(_documents(spark, docs))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_contaminated(_documents(spark, docs), items)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight 5, 2, 1: 150 % of all words, no document more than twice."""
    return mixing.mixed_documents(
        _documents(spark, docs), weights=(5, 2, 1), budget=1.5, most=2
    )


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix."""
    return shards.shard_documents(_documents(spark, docs), shards=40)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_clean),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
