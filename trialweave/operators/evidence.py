"""Paper hygiene, coverage, citation and upsert operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions import text
from trialweave.operators import ordered
from trialweave.operators.checks import violations
from trialweave.session import materialise

# Work types and title words that are never evidence.
INELIGIBLE_WORK_TYPES = (
    "component",
    "supplementary-material",
    "correction",
    "retraction",
    "peer-review",
)
INELIGIBLE_TITLE = (
    r"(?i)\b(supplement(?:ary)?|supporting information|correction|corrigendum|erratum|retraction)\b"
    r"|_supp\d*"
)
# Evidence level by work type.
PUBLISHED_TYPES = ("article", "journal-article", "proceedings-article", "book-chapter")
PREPRINT_TYPES = ("posted-content",)


def evidence_level(work_type: Column) -> Column:
    return (
        F.when(work_type.isin(*PUBLISHED_TYPES), "published_metadata_only")
        .when(work_type.isin(*PREPRINT_TYPES), "preprint_metadata_only")
        .otherwise("other_metadata_only")
    )


def row_exclusion_reason(work_type: Column, title: Column, is_retracted: Column) -> Column:
    """First matching reason that needs only the row itself, else null."""
    return (
        F.when(is_retracted, "retracted")
        .when(work_type.isin(*INELIGIBLE_WORK_TYPES), "ineligible_work_type")
        .when(title.rlike(INELIGIBLE_TITLE), "supplement_correction_or_retraction_title")
    )


def with_exclusion_reason(papers: DataFrame, search: Sequence[str], rank: str) -> DataFrame:
    """Add ``title_key`` and ``reason``; only the first of equal titles has none.

    The first rank of each title is found by a combined minimum and joined back, so
    many copies of one title are never sorted in one task.
    """
    reason = row_exclusion_reason(F.col("work_type"), F.col("title"), F.col("is_retracted"))
    key = text.normalized_title(F.col("title"))
    marked = papers.withColumn("reason", reason).withColumn("title_key", key)
    return _later_copies(marked.withColumn("__key", _key_hash(key)), search, rank).drop("__key")


def _key_hash(key: Column) -> Column:
    """128 bits that stand for a title's key: whole titles are not shuffled."""
    return F.unhex(F.md5(key.cast("binary")))


def _later_copies(marked: DataFrame, search: Sequence[str], rank: str) -> DataFrame:
    """Give rows without a reason one if their ``__key`` has a lower rank in the search."""
    first = (
        marked.where(F.col("reason").isNull())
        .groupBy(*search, "__key")
        .agg(F.min(rank).alias("__first"))
    )
    copy = F.when(F.col(rank) > F.col("__first"), "duplicate_normalized_title")
    return (
        marked.join(first, [*search, "__key"], "left")
        .withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).otherwise(copy))
        .drop("__first")
    )


def hygiene_decisions(papers: DataFrame, search: Sequence[str], rank: str) -> DataFrame:
    """(search, rank, reason) of every paper; titles are read and normalised once."""
    reason = row_exclusion_reason(F.col("work_type"), F.col("title"), F.col("is_retracted"))
    key = _key_hash(text.normalized_title(F.col("title")))
    rows = materialise(
        papers.select(*search, rank, reason.alias("reason"), key.alias("__key")), "title-keys"
    )
    return _later_copies(rows, search, rank).select(*search, rank, "reason")


def exclusion_histogram(marked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return (
        marked.where(F.col("reason").isNotNull())
        .groupBy(*keys, "reason")
        .agg(F.count(F.lit(1)).alias("papers"))
    )


def short_abstract(abstract: Column) -> Column:
    """An abstract cut for reading; taken before a shuffle, whole texts stay behind."""
    cut = F.substring(F.trim(abstract), 1, ABSTRACT_CHARS)
    return F.when(cut != "", cut)


def compact_papers(papers: DataFrame, search: Sequence[str], rank: str, limit: int = 4) -> DataFrame:
    """First eligible papers of each search with short abstracts."""
    marked = with_exclusion_reason(
        papers.withColumn("abstract", short_abstract(F.col("abstract"))), search, rank
    )
    return ordered.top_rows(marked.where(F.col("reason").isNull()), search, [rank], limit, "place")


# Fixed value: characters of an abstract kept in a compact record.
ABSTRACT_CHARS = 320


# Columns an upsert never changes, and those it refreshes.
FIRST_SEEN = ("source", "source_id", "doi")


def upsert_papers(
    stored: DataFrame, incoming: DataFrame, arrival: str, refreshed: Sequence[str]
) -> DataFrame:
    """Merge incoming paper rows: the newest row's metadata, the oldest row's origin.

    ``arrival`` orders all versions of one ``stable_id``; stored rows come first.
    Both picks are aggregates with map-side combine: a paper seen a million times
    still sends one row per task.
    """
    versions = stored.unionByName(incoming)
    newest = F.max_by(F.struct(*refreshed), arrival)
    oldest = F.min_by(F.struct(*FIRST_SEEN), arrival)
    merged = versions.groupBy("stable_id").agg(oldest.alias("o"), newest.alias("n"))
    return merged.select("stable_id", "o.*", "n.*")


def search_listing(results: DataFrame, papers: DataFrame, run_id, query_id, source=None) -> DataFrame:
    """Papers of one query in rank order."""
    wanted = (F.col("search_run_id") == run_id) & (F.col("query_id") == query_id)
    if source is not None:
        wanted = wanted & (F.col("source") == source)
    return results.where(wanted).join(papers, "stable_id").orderBy("source", "rank")


def missing_searches(plan: DataFrame, attempts: DataFrame) -> DataFrame:
    """Planned (query, source) pairs nobody attempted."""
    planned = plan.select("query_id", F.explode("source_names").alias("source"))
    return planned.join(attempts, ["query_id", "source"], "left_anti")


def coverage(plan: DataFrame, attempts: DataFrame, directions: DataFrame) -> DataFrame:
    """One row: planned, attempted, missing pairs, queries without success, verdict."""
    pairs = plan.select("query_id", F.explode("source_names").alias("source")).distinct()
    tried = attempts.groupBy("query_id", "source").agg(
        F.bool_or(F.col("status") == "completed").alias("done")
    )
    per_query = attempts.groupBy("query_id").agg(
        F.bool_or(F.col("status") == "completed").alias("any_done")
    )
    counts = (
        pairs.join(tried, ["query_id", "source"], "left")
        .agg(
            F.count(F.lit(1)).alias("planned_searches"),
            F.count("done").alias("attempted_searches"),
            F.count_if(F.col("done").isNull()).alias("missing_searches"),
        )
    )
    bare = (
        pairs.select("query_id")
        .distinct()
        .join(per_query, "query_id", "left")
        .agg(
            F.count(F.lit(1)).alias("planned_queries"),
            F.count_if(~F.coalesce("any_done", F.lit(False))).alias("queries_without_success"),
        )
    )
    found = directions.agg(F.count(F.lit(1)).alias("directions"))
    complete = (
        (F.col("missing_searches") == 0)
        & (F.col("queries_without_success") == 0)
        & (F.col("directions") > 0)
    )
    # Three one-row aggregates side by side.
    one = F.lit(1).alias("one")
    return (
        counts.withColumn("one", one)
        .join(bare.withColumn("one", one), "one")
        .join(found.withColumn("one", one), "one")
        .drop("one")
        .withColumn("complete", complete)
    )


def uncited_or_unknown(
    directions: DataFrame, known: DataFrame, run: str = "search_run_id"
) -> DataFrame:
    """Citation faults: no citation at all, or a cited paper outside the same run."""
    none = directions.where(F.size(F.coalesce("supporting_papers", F.array())) == 0).select(
        run, "candidate_id", F.lit(None).cast("string").alias("stable_id"), F.lit("no_citation").alias("fault")
    )
    cited = directions.select(run, "candidate_id", F.explode("supporting_papers").alias("stable_id"))
    unknown = cited.join(known.select(run, "stable_id"), [run, "stable_id"], "left_anti").select(
        run, "candidate_id", "stable_id", F.lit("unknown_paper").alias("fault")
    )
    return none.unionByName(unknown)


def clone_run(rows: DataFrame, source_run: str, target_run: str) -> tuple[DataFrame, DataFrame]:
    """Rows of one run under a new run id, and a guard table of refusals."""
    run = F.col("search_run_id")
    clone = rows.where(run == source_run).withColumn("search_run_id", F.lit(target_run))
    facts = rows.agg(
        F.count_if(run == source_run).alias("source_rows"),
        F.count_if(run == target_run).alias("target_rows"),
    )
    guards = violations(
        facts.withColumn("target_run", F.lit(target_run)),
        ["target_run"],
        [
            ("source_and_target_differ", F.lit(source_run != target_run)),
            ("target_is_empty", F.col("target_rows") == 0),
            ("source_has_rows", F.col("source_rows") > 0),
        ],
    )
    return clone, guards
