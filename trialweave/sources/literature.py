"""Scholarly response files to paper rows.

A response is parsed once as a variant, so ``metadata_json`` holds every field of an item,
also those no column reads.  Responses that give no item list are rows of
``response_faults``, never lost unseen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions import text
from trialweave.operators.checks import violations

CROSSREF_ITEM = """
        title: array<string>, DOI: string, URL: string, type: string, abstract: string,
        published: struct<`date-parts`: array<array<int>>>,
        author: array<struct<given: string, family: string>>,
        `container-title`: array<string>,
        relation: map<string, string>
"""

OPENALEX_ITEM = """
        id: string, display_name: string, title: string, doi: string, type: string,
        publication_year: int, cited_by_count: bigint, is_retracted: boolean,
        abstract_inverted_index: map<string, array<int>>,
        authorships: array<struct<author: struct<display_name: string>>>,
        primary_location: struct<landing_page_url: string, source: struct<display_name: string>>
"""

CROSSREF_ITEMS, OPENALEX_ITEMS = "$.message.items", "$.results"


def _items(responses: DataFrame, raw: str, path: str, schema: str) -> DataFrame:
    """One row per item: the other columns, pos, the text of the item, its fields i."""
    rest = [c for c in responses.columns if c != raw]
    listed = F.try_variant_get(F.try_parse_json(raw), path, "array<variant>")
    return (
        responses.select(*rest, F.posexplode(listed).alias("pos", "item"))
        .withColumn("item", F.to_json("item"))
        .withColumn("i", F.from_json("item", f"struct<{schema.strip()}>"))
    )


def response_faults(responses: DataFrame, path: str, raw: str = "raw") -> DataFrame:
    """The other columns and rule_id of responses that are no JSON or list no items."""
    parsed = F.try_parse_json(raw)
    return violations(
        responses,
        [c for c in responses.columns if c != raw],
        [
            ("response_is_json", parsed.isNotNull()),
            (
                "response_lists_items",
                parsed.isNull() | F.try_variant_get(parsed, path, "array<variant>").isNotNull(),
            ),
        ],
    )


def crossref_papers(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Paper rows of responses in the ``message.items`` shape; untitled items drop out."""
    rest = [c for c in responses.columns if c != raw]
    items = _items(responses, raw, CROSSREF_ITEMS, CROSSREF_ITEM)
    doi = F.when(F.col("i.DOI") != "", F.col("i.DOI"))
    nobody = F.array().cast("array<struct<given:string,family:string>>")
    people = F.transform(
        F.coalesce("i.author", nobody),
        lambda p: F.struct(
            F.coalesce(p["given"], F.lit("")).alias("given"), F.coalesce(p["family"], F.lit("")).alias("family")
        ),
    )
    papers = items.select(
        *rest,
        "pos",
        F.lit("crossref").alias("source"),
        F.coalesce(doi, F.col("i.URL"), F.col("pos").cast("string")).alias("source_id"),
        doi.alias("doi"),
        text.clean_markup(text.first_of(F.col("i.title"))).alias("title"),
        text.year_of_parts(F.col("i.published.date-parts")).alias("year"),
        text.joined_names(people).alias("authors"),
        text.clean_markup(text.first_of(F.col("i.container-title"))).alias("venue"),
        F.col("i.URL").alias("url"),
        text.clean_markup(F.col("i.abstract")).alias("abstract"),
        F.col("i.type").alias("work_type"),
        F.lit(None).cast("bigint").alias("citation_count"),
        F.when(F.map_contains_key("i.relation", F.lit("is-retracted-by")), F.lit(True)).alias("is_retracted"),
        F.col("item").alias("metadata_json"),
    )
    return _identified(papers)


def openalex_papers(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Paper rows of responses in the ``results`` shape; untitled items drop out."""
    rest = [c for c in responses.columns if c != raw]
    items = _items(responses, raw, OPENALEX_ITEMS, OPENALEX_ITEM)
    names = F.filter(
        F.transform(
            F.coalesce("i.authorships", F.array().cast("array<struct<author:struct<display_name:string>>>")),
            lambda a: F.trim(F.coalesce(a["author"]["display_name"], F.lit(""))),
        ),
        lambda n: n != "",
    )
    papers = items.select(
        *rest,
        "pos",
        F.lit("openalex").alias("source"),
        F.coalesce("i.id", F.col("pos").cast("string")).alias("source_id"),
        text.bare_doi(F.when(F.col("i.doi") != "", F.col("i.doi"))).alias("doi"),
        text.clean_markup(F.coalesce(F.when(F.col("i.display_name") != "", F.col("i.display_name")), "i.title")).alias("title"),
        F.col("i.publication_year").alias("year"),
        names.alias("authors"),
        text.clean_markup(F.col("i.primary_location.source.display_name")).alias("venue"),
        F.coalesce("i.primary_location.landing_page_url", "i.id").alias("url"),
        text.abstract_from_positions(F.col("i.abstract_inverted_index")).alias("abstract"),
        F.col("i.type").alias("work_type"),
        F.col("i.cited_by_count").alias("citation_count"),
        F.col("i.is_retracted").alias("is_retracted"),
        F.col("item").alias("metadata_json"),
    )
    return _identified(papers)


def _identified(papers: DataFrame) -> DataFrame:
    stable = text.stable_paper_id(F.col("doi"), F.col("source"), F.col("source_id"))
    return papers.where(F.col("title").isNotNull()).withColumn("stable_id", stable)
