"""Scalar, text, array and hashing operators (SF1-SF12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.functions import hashing, parameters, text
from trialweave.plans.registry import query, table


def entities_sql(expr: str) -> str:
    """SQL of the same entity table.  HTML lets an ampersand's entity lack its end."""
    for entity, char in text.COMMON_ENTITIES.items():
        if entity != "&amp;":
            quoted = char.replace("'", "''")
            expr = f"replace({expr}, '{entity}', '{quoted}')"
    return f"regexp_replace({expr}, '&amp;?', '&', 'g')"



CLEAN_SQL = entities_sql("regexp_replace(html, '<[^>]+>', ' ', 'g')")
SPACES = r"[\s\x{0B}\x{85}\p{Z}]+"
TITLE_SQL = (
    "trim(regexp_replace(lower(regexp_replace("
    + entities_sql("text")
    + ", '<[^>]+>', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"
)


@query(
    "sf1_clean_markup",
    f"""
    WITH c AS (SELECT page_id, trim(regexp_replace({CLEAN_SQL}, '{SPACES}', ' ', 'g')) AS t FROM pages)
    SELECT page_id, nullif(t, '') AS plain_text FROM c
    """,
)
def sf1_clean_markup(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", text.clean_markup(F.col("html")).alias("plain_text")
    )


@query("sf2_normalized_title", f"SELECT doc_id, {TITLE_SQL} AS title_key FROM documents")
def sf2_normalized_title(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.normalized_title(F.col("text")).alias("title_key")
    )


@query(
    "sf3_stable_paper_id",
    r"""
    WITH p AS (
      SELECT page_id,
        CASE WHEN url LIKE 'https%' THEN 'https://doi.org/10.1/' || split_part(url, '/', 3) || '/' || page_id
             WHEN url LIKE '%.com%' THEN 'HTTP://DX.DOI.ORG/10.2/' || upper(split_part(url, '/', 4)) || page_id
        END AS raw FROM pages)
    SELECT page_id, regexp_replace(raw, '(?i)^https?://(?:dx\.)?doi\.org/', '') AS doi,
      coalesce(lower(regexp_replace(raw, '(?i)^https?://(?:dx\.)?doi\.org/', '')), 'pages:' || page_id) AS stable_id
    FROM p
    """,
)
def sf3_stable_paper_id(spark, sf):
    url, page = F.col("url"), F.col("page_id")
    raw = F.when(
        url.startswith("https"),
        F.concat(F.lit("https://doi.org/10.1/"), F.split_part(url, F.lit("/"), F.lit(3)), F.lit("/"), page),
    ).when(
        F.contains(url, F.lit(".com")),
        F.concat(F.lit("HTTP://DX.DOI.ORG/10.2/"), F.upper(F.split_part(url, F.lit("/"), F.lit(4))), page),
    )
    return (
        table(spark, sf, "pages")
        .withColumn("doi", text.bare_doi(raw))
        .select(
            "page_id",
            "doi",
            text.stable_paper_id(F.col("doi"), F.lit("pages"), page.cast("string")).alias("stable_id"),
        )
    )


@query(
    "sf4_abstract_rebuild",
    r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents)
    SELECT doc_id, sha256(array_to_string(words, ' ')) AS abstract_sha256,
           len(words)::BIGINT AS word_count FROM w WHERE len(words) > 0
    """,
)
def sf4_abstract_rebuild(spark, sf):
    """Each text as a word -> positions map, and back; a text never leaves its row."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    # Two steps, each read twice by the next, so nothing is computed again per reader.
    split = table(spark, sf, "documents").where(F.rlike("text", F.lit(r"\S"))).select("doc_id", words.alias("words"))
    inverted = split.select("doc_id", text.positions_of_words(F.col("words")).alias("inverted"))
    return inverted.select(
        "doc_id",
        F.sha2(text.abstract_from_positions(F.col("inverted")), 256).alias("abstract_sha256"),
        F.aggregate(
            F.map_values("inverted"), F.lit(0).cast("long"), lambda n, at: n + F.size(at)
        ).alias("word_count"),
    )


@query(
    "sf5_first_year_names",
    """
    SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS first_part,
      year(o_orderdate)::INTEGER AS year,
      CASE WHEN o_orderstatus = 'F' THEN c_mktsegment ELSE c_name || ' ' || c_mktsegment END AS names
    FROM orders JOIN customer ON o_custkey = c_custkey
    """,
)
def sf5_first_year_names(spark, sf):
    rows = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    given = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("c_name"))
    nobody = F.struct(F.lit("").alias("given"), F.lit("").alias("family"))
    people = F.array(F.struct(given.alias("given"), F.col("c_mktsegment").alias("family")), nobody)
    parts = F.array(F.array(F.year("o_orderdate"), F.month("o_orderdate")))
    return rows.select(
        "o_orderkey",
        text.first_of(F.split("o_orderpriority", "-")).alias("first_part"),
        text.year_of_parts(parts).alias("year"),
        F.array_join(text.joined_names(people), ";").alias("names"),
    )


@query(
    "sf6_identifiers",
    r"""
    SELECT page_id,
      CASE WHEN regexp_full_match(replace(lower(trim(u)), ' ', '_'), '[a-z0-9][a-z0-9_.-]{0,127}')
           THEN replace(lower(trim(u)), ' ', '_') END AS artifact_name,
      regexp_replace(u, '[^A-Za-z0-9._-]', '_', 'g') AS path_name
    FROM (SELECT page_id, CASE WHEN url LIKE 'https%' THEN url ELSE ' ' || upper(split_part(url, '/', 3)) || ' Copy ' END AS u FROM pages)
    """,
)
def sf6_identifiers(spark, sf):
    url = F.col("url")
    raw = F.when(url.startswith("https"), url).otherwise(
        F.concat(F.lit(" "), F.upper(F.split_part(url, F.lit("/"), F.lit(3))), F.lit(" Copy "))
    )
    return table(spark, sf, "pages").select(
        "page_id",
        text.artifact_identifier(raw).alias("artifact_name"),
        text.path_identifier(raw).alias("path_name"),
    )


@query(
    "sf7_bound_parameters",
    """
    WITH p AS (SELECT p_partkey, (p_size * 16)::DOUBLE AS sfreq, (p_size % 3) * 0.5::DOUBLE AS a, (p_size % 3) * 0.5 + (p_size % 7)::DOUBLE AS b FROM part),
    r AS (SELECT p_partkey, list_reverse_sort(list_distinct(list_filter([sfreq, 256.0::DOUBLE, 128.0, 100.0], lambda x: x <= sfreq AND x >= 100))) AS rates FROM p),
    w AS (SELECT p_partkey, s.s, n.n, a, b FROM p, (VALUES (0.0::DOUBLE), (0.5), (1.0)) s(s), (VALUES (1.0::DOUBLE), (2.0), (3.0), (4.0)) n(n) WHERE a + s + n <= b),
    wd AS (SELECT DISTINCT p_partkey, round(a + s, 6) AS start, round(a + s + n, 6) AS stop FROM w)
    SELECT p.p_partkey, len(rates)::BIGINT AS rate_count, coalesce(rates[1], -1) AS highest_rate,
      coalesce(count(wd.start), 0)::BIGINT AS window_count, max(stop - start) AS longest_window,
      sum(1000 * start + stop) AS window_sum
    FROM p JOIN r USING (p_partkey) LEFT JOIN wd USING (p_partkey) GROUP BY ALL
    """,
)
def sf7_bound_parameters(spark, sf):
    start = (F.col("p_size") % 3) * F.lit(0.5)
    rates = parameters.legal_resample_rates((F.col("p_size") * 16).cast("double"))
    windows = parameters.legal_windows(start, start + F.col("p_size") % 7)
    return (
        table(spark, sf, "part")
        .select("p_partkey", rates.alias("rates"), windows.alias("windows"))
        .select(
            "p_partkey",
            F.size("rates").cast("long").alias("rate_count"),
            F.coalesce(F.get("rates", F.lit(0)), F.lit(-1.0)).alias("highest_rate"),
            F.size("windows").cast("long").alias("window_count"),
            F.array_max(F.transform("windows", lambda w: w["stop"] - w["start"])).alias("longest_window"),
            F.when(
                F.size("windows") > 0,
                F.aggregate("windows", F.lit(0.0), lambda s, w: s + w["start"] * 1000 + w["stop"]),
            ).alias("window_sum"),
        )
    )


@query(
    "sf8_canonical_hash",
    f"""
    SELECT p_partkey, 'component-' || substr(h, 1, 16) AS component_id, h AS content_sha256 FROM (
      SELECT p_partkey, sha256({hashing.canonical_sql('p_name', 'p_brand', 'p_type', 'CASE WHEN p_size > 25 THEN p_size END')}) AS h FROM part)
    """,
)
def sf8_canonical_hash(spark, sf):
    digest = hashing.content_hash(
        [F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.when(F.col("p_size") > 25, F.col("p_size"))]
    )
    return table(spark, sf, "part").select(
        "p_partkey",
        hashing.short_id("component", digest, 16).alias("component_id"),
        digest.alias("content_sha256"),
    )


@query(
    "sf8_injective_hash",
    f"""
    WITH r AS (SELECT doc_id, lang || '|' || source AS a, 'x' AS b, NULL AS c FROM documents
      UNION ALL SELECT doc_id, lang, source || '|x', 'null' FROM documents UNION ALL SELECT doc_id, lang, source || '|x', NULL FROM documents)
    SELECT doc_id, count(DISTINCT sha256({hashing.canonical_sql('a', 'b', 'c')}))::BIGINT AS distinct_hashes, min(sha256({hashing.canonical_sql('a', 'b', 'c')})) AS first_hash FROM r GROUP BY 1
    """,
)
def sf8_injective_hash(spark, sf):
    """Rows that hold the separator, the text null and nulls keep different hashes."""
    docs, split = table(spark, sf, "documents"), F.concat("source", F.lit("|x"))
    none = F.lit(None).cast("string")
    joined = F.concat("lang", F.lit("|"), "source")
    forms = F.array(
        *[
            F.struct(a.alias("a"), b.alias("b"), c.alias("c"))
            for a, b, c in (
                (joined, F.lit("x"), none),
                (F.col("lang"), split, F.lit("null")),
                (F.col("lang"), split, none),
            )
        ]
    )
    rows = docs.select("doc_id", F.explode(forms).alias("r")).select("doc_id", "r.*")
    digest = hashing.content_hash([F.col("a"), F.col("b"), F.col("c")])
    return rows.groupBy("doc_id").agg(
        F.countDistinct(digest).alias("distinct_hashes"), F.min(digest).alias("first_hash")
    )


@query(
    "sf9_decision_ids",
    r"""
    WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents),
    q AS (SELECT lang, 'profile-decision-' || substr(sha256(trim(regexp_replace(lower(trim(line)), '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g'))), 1, 12) AS decision_id
          FROM l WHERE trim(line) <> '')
    SELECT lang, decision_id, count(*)::BIGINT AS asked FROM q GROUP BY ALL
    """,
)
def sf9_decision_ids(spark, sf):
    line = F.explode(F.split("text", "\n"))
    return (
        table(spark, sf, "documents")
        .select("lang", line.alias("line"))
        .where(F.trim("line") != "")
        .groupBy("lang", hashing.decision_id(F.col("line")).alias("decision_id"))
        .agg(F.count(F.lit(1)).alias("asked"))
    )


def _query_plan_sql() -> str:
    rows = ", ".join(f"('{i}', '{t}', '{s}')" for i, t, s in parameters.QUERY_TEMPLATES)
    return f"""
    WITH p AS (
      SELECT c_custkey AS dataset_id, replace(lower(c_mktsegment), ' ', '_') || '_task' AS family,
        CASE WHEN c_acctbal < 0 THEN 'biosignal' ELSE 'EEG ' || 'EOG' END AS modalities,
        count(DISTINCT year(o_orderdate)) AS sessions, count(DISTINCT o_orderpriority) - 3 AS eog
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
    t(query_id, template, kind) AS (VALUES {rows})
    SELECT dataset_id, query_id, replace(replace(template, '{{c}}', replace(family, '_', ' ') || ' ' || modalities), '{{e}}',
      CASE WHEN eog > 0 THEN '{parameters.EOG_PRESENT}' ELSE '{parameters.EOG_ABSENT}' END) AS text
    FROM p, t WHERE kind = 'any' OR (kind = 'many' AND sessions >= 2) OR (kind = 'single' AND sessions < 2)
    """


@query("sf10_literature_queries", _query_plan_sql())
def sf10_literature_queries(spark, sf):
    orders = (
        table(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(
            F.countDistinct(F.year("o_orderdate")).alias("years"),
            F.countDistinct("o_orderpriority").alias("kinds"),
        )
    )
    profiles = table(spark, sf, "customer").join(
        orders, F.col("o_custkey") == F.col("c_custkey"), "left"
    ).select(
        F.col("c_custkey").alias("dataset_id"),
        F.concat(F.replace(F.lower("c_mktsegment"), F.lit(" "), F.lit("_")), F.lit("_task")).alias("family"),
        F.when(F.col("c_acctbal") >= 0, F.array(F.lit("EEG"), F.lit("EOG"))).alias("modalities"),
        F.coalesce("years", F.lit(0)).alias("sessions_per_subject"),
        (F.coalesce("kinds", F.lit(0)) - 3).alias("eog_channel_count"),
    )
    return parameters.literature_queries(profiles)


@query(
    "sf11_candidate_grid",
    """
    WITH b(low, high) AS (VALUES (4.0::DOUBLE, 40.0::DOUBLE), (8.0, 13.0), (8.0, 30.0), (13.0, 30.0)),
    f(family) AS (VALUES ('bandpower_lda'), ('csp_lda'))
    SELECT s_suppkey AS subject_id, family || '-' || low::INT || '-' || high::INT AS pipeline_id, family, low, high,
      CASE family WHEN 'csp_lda' THEN 'csp' ELSE 'none' END AS spatial_filter,
      CASE family WHEN 'csp_lda' THEN 4 ELSE 0 END AS csp_components,
      CASE family WHEN 'csp_lda' THEN 'csp_log_variance' ELSE 'log_bandpower' END AS feature,
      'shrinkage_lda' AS model, 0.1::DOUBLE AS lda_shrinkage, 3 AS cv_folds, s_nationkey::BIGINT AS random_seed
    FROM supplier, b, f
    """,
)
def sf11_candidate_grid(spark, sf):
    grid = F.explode(parameters.candidate_grid(F.col("s_nationkey")))
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("subject_id"), grid.alias("c")
    ).select("subject_id", "c.*")


@query(
    "sf12_finite_or_null",
    """
    SELECT event_id, CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE v END AS value FROM (
      SELECT event_id, CASE event_type WHEN 'error' THEN 'nan'::DOUBLE WHEN 'view' THEN '-inf'::DOUBLE ELSE value END AS v FROM events)
    """,
)
def sf12_finite_or_null(spark, sf):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "error", F.lit(float("nan")))
        .when(kind == "view", F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    return table(spark, sf, "events").select("event_id", text.finite_or_null(raw).alias("value"))
