"""The corpus operators as named queries over the given tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm import (
    chat,
    decontaminate,
    divergence,
    licenses,
    mixing,
    outliers,
    quality,
    shards,
    simhash,
    spelling,
    substrings,
    tokens,
    urls,
)
from trialweave.session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @wraps(fn)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = shipped
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


#: Where the public vocabularies lie; another place may be named in the environment.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_fair_queue_mix",
    r"""
    WITH sized AS (
      SELECT doc_id, source,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        md5('mix|' || CAST(doc_id AS VARCHAR)) AS shuffle
      FROM documents),
    sources AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank
      FROM sized GROUP BY source),
    weighed AS (
      SELECT *, 2 * source_size AS full_size,
        CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
    placed AS (
      SELECT *, row_number() OVER by_fill AS place,
        coalesce(sum(full_size) OVER (by_fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          AS filled,
        (sum(weight) OVER ()) - coalesce(
          sum(weight) OVER (by_fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          AS weight_left,
        CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS share
      FROM weighed
      WINDOW by_fill AS (ORDER BY CAST(full_size AS DOUBLE) / CAST(weight AS DOUBLE), rank)),
    levelled AS (
      SELECT *, (share - CAST(filled AS DOUBLE)) / CAST(weight_left AS DOUBLE) AS level
      FROM placed),
    opened AS (
      SELECT place, level FROM levelled
      WHERE level * weight < CAST(full_size AS DOUBLE) ORDER BY place LIMIT 1),
    targets AS (
      SELECT source, rank, source_size,
        CASE WHEN (SELECT place FROM opened) IS NULL OR place < (SELECT place FROM opened)
          THEN CAST(full_size AS DOUBLE)
          ELSE (SELECT level FROM opened) * weight END AS target
      FROM levelled),
    ranked AS (
      SELECT s.doc_id, s.size, t.rank, t.source_size, t.target,
        sum(size) OVER w AS upto, row_number() OVER w AS ordinal
      FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
      WINDOW w AS (PARTITION BY t.rank ORDER BY shuffle, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    copies AS (
      SELECT *, CASE WHEN target > 0 AND size > 0
        THEN CAST(upto + copy * source_size AS DOUBLE) / target END AS finish
      FROM ranked, (VALUES (0), (1)) AS c(copy)),
    queued AS (
      SELECT *, sum(size) OVER (ORDER BY finish ASC NULLS LAST, rank, ordinal, copy
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ends
      FROM copies)
    SELECT doc_id, size, source_size, target, min(finish) AS first_finish,
      CAST(sum(CASE WHEN finish IS NOT NULL
        AND ends <= (SELECT sum(size) * 1.5 FROM sized) THEN size ELSE 0 END) AS BIGINT) AS taken
    FROM queued GROUP BY rank, ordinal, doc_id, size, source_size, target
    """,
)
def op1_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 5, 2, 1 by source; 150 % of all words; nothing more than twice."""
    return mixing.mix(
        table(spark, sf_dir, "documents"), weights=(5, 2, 1), budget=1.5, most=2
    ).select("doc_id", "size", "source_size", "target", "taken", "first_finish")


@query(
    "op8_chat_format",
    r"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
      UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    escaped AS (
      SELECT *, replace(replace(role, '\', '\b'), '<', '\l') AS role_in,
        replace(replace(text, '\', '\b'), '<', '\l') AS text_in,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
          replace(replace(role, '\', '\b'), '<', '\l'),
          replace(replace(text, '\', '\b'), '<', '\l')) AS place
      FROM turns),
    marked AS (
      SELECT *, CASE WHEN place > 1
        AND lag(role) OVER (PARTITION BY conv_id ORDER BY place) = role THEN 1 ELSE 0 END AS same
      FROM escaped)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
      CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
      sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY place))
        AS loss_sha256,
      CAST(sum(length(text_in) + CASE WHEN same = 1 THEN length('<and>')
        ELSE length('<turn><body></turn>') + 1 + length(role_in) END) AS BIGINT)
        AS formatted_chars
    FROM marked GROUP BY conv_id
    """,
)
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and reads turns and loss texts back from the strings."""
    said = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    formatted = chat.format_chats(turns.unionByName(probe))
    both = formatted.select(
        "conv_id",
        "formatted",
        chat.turns_of(F.col("formatted")).alias("turns"),
        chat.trained_texts(F.col("formatted"), F.col("loss_spans")).alias("texts"),
    )
    lines = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    loss = F.array_join("texts", "")
    return both.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The rules of the task, block and allow by host and start of path.
URL_RULES = (
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
)


@query(
    "op10_url_cascade",
    r"""
    WITH cut AS (
      SELECT page_id, CASE WHEN strpos(url, '://') > 0
        THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parsed AS (
      SELECT page_id,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    rules(verdict, rule_host, rule_path) AS (VALUES
      ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
      ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
    hits AS (
      SELECT p.*, r.verdict, r.rule_host || r.rule_path AS rule,
        row_number() OVER (PARTITION BY page_id, host, path
          ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS place
      FROM parsed p LEFT JOIN rules r
        ON (host = rule_host OR ends_with(host, '.' || rule_host))
          AND starts_with(path, rule_path))
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
    FROM hits WHERE place = 1
    """,
)
def op10_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page url by the rules; urls without a rule are allowed."""
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict"
    )


@query("op6_simhash_components")
def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, XXH64 seed 42, links at four or fewer differing bits."""
    return simhash.near_duplicates(
        table(spark, sf_dir, "documents"), shingle=4, radius=4, segments=3, seed=42
    ).select("doc_id", "fingerprint", "component_id")


@query("op9_suffix_array_dedup")
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes every byte of a 400-byte string that starts anywhere else too."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), depth=400)


@query("op2_simhash_decontamination")
def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a window that is 0.8 or more like a benchmark item, by 5-word shingles."""
    return decontaminate.contaminations(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=0.8, shingle=5
    )


@query("op3_token_lengths")
def op3_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every context limit's totals, for all documents, each language and each source."""
    lengths = tokens.encoded_lengths(
        table(spark, sf_dir, "documents"),
        f"{VOCABULARIES}/byte_bpe_multi_50k.tiktoken",
        keep=("lang", "source"),
    )
    return tokens.context_table(tokens.length_histogram(lengths, by=("lang", "source")))


@query("op5_preference_quality")
def op5_preference_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores learnt from preference pairs of the rows that are not held out."""
    return quality.score_quality(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


@query("op4_kd_tree_shards")
def op4_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards of near equal bytes, cut by language, source and length."""
    return shards.shard_documents(table(spark, sf_dir, "documents"), shards=40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op7_robust_outliers")
def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules, then robust distance per language and source."""
    return outliers.judge_quality(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    """The scan as SQL: every word of every text meets every equal template word."""
    templates = licenses.PHRASES + licenses.NOTICES
    compiled = licenses.compile_templates(templates)
    heads, words = [], []
    for k, t in enumerate(templates):
        must = set(compiled.mandatory[k].tolist())
        heads.append(
            f"({k}, '{t.label}', {str(t.base).lower()}, {len(compiled.numbers[k])}, "
            f"{compiled.needed[k]}, {len(must)})"
        )
        words += [
            f"({k}, '{compiled.names[n]}', {place}, {int(place in must)})"
            for place, n in enumerate(compiled.numbers[k])
        ]
    return rf"""
    WITH heads(t, label, base, size, needed, musts) AS (VALUES {', '.join(heads)}),
    template_words(t, word, place, must) AS (VALUES {', '.join(words)}),
    docs AS (
      SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
      FROM documents),
    placed AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS spot FROM docs),
    starts AS (
      SELECT rid, t, spot - place AS start, count(*) AS right_words, sum(must) AS right_musts
      FROM placed JOIN template_words USING (word) GROUP BY ALL),
    found AS (
      SELECT rid, start, label, base, right_words::DOUBLE / size::DOUBLE AS share
      FROM starts JOIN heads USING (t) WHERE right_words >= needed AND right_musts = musts)
    SELECT doc_id, CAST(len(any_value(words)) AS BIGINT) AS n_words,
      CAST(count(*) FILTER (base) AS BIGINT) AS n_base,
      min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
      coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
      coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (label IS NOT NULL), '')
        AS labels,
      coalesce(max(share), 0::DOUBLE) AS score
    FROM docs LEFT JOIN found USING (rid) GROUP BY rid, doc_id
    """


@query("op11_license_scan", _license_sql())
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the four phrases and labels of customary notices, for every text."""
    scanned = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda f: f["base"])
    starts = F.transform(base, lambda f: f["start"])

    def joined(found):
        labels = F.transform(found, lambda f: f["label"])
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    score = F.array_max(F.transform("found", lambda f: f["share"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("found")).alias("labels"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
    )


@query(
    "op12_source_divergence",
    r"""
    WITH docs AS (
      SELECT row_number() OVER () AS rid, coalesce(text, '') AS text,
        coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    words AS (
      SELECT rid, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
    kept AS (
      SELECT lang, term, count(*) AS total FROM words
      GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
    used AS (
      SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term)
      GROUP BY lang, source, term),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    sizes AS (
      SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
    group_sizes AS (
      SELECT g.lang, g.source, coalesce(any_value(v), 0) AS v,
        coalesce(any_value(lang_n), 0) AS lang_n, coalesce(sum(n), 0) AS n
      FROM groups g LEFT JOIN sizes USING (lang) LEFT JOIN used USING (lang, source)
      GROUP BY g.lang, g.source),
    cells AS (
      SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS held,
        1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 1)) // (g.n + g.v) AS p,
        1 + (1000000000::HUGEINT * (k.total + 1)) // (g.lang_n + g.v) AS lang_p
      FROM group_sizes g JOIN kept k USING (lang) LEFT JOIN used u USING (lang, source, term)),
    pair_sums AS (
      SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
      GROUP BY a.lang, a.source, b.source),
    results AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
        CAST(coalesce(s.value, 0) AS BIGINT) AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, CAST(((p - lang_p) * (p - lang_p)) // lang_p AS BIGINT)
      FROM cells WHERE held > 0 AND p > lang_p),
    ranked AS (
      SELECT *, CAST(row_number() OVER (
        PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
      FROM results)
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each language against each other and against the language, by words."""
    return divergence.audit_sources(
        table(spark, sf_dir, "documents"), least_documents=3, most_terms=200
    ).select("lang", "source", "part", "item", "value", "rank")


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of five letters found three times, with planted deletions, and their forms.

    A null doc_id stands as an empty text in the planted deletions.
    """
    runs = spelling.text_runs(table(spark, sf_dir, "documents"), r"A-Za-z\u00C0-\u00FF", least=5)
    run, size = F.col("run"), F.length("run")
    owner = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = runs.select("run", F.crc32(F.concat(owner, F.lit(":"), run)).alias("h"))
    at = (F.col("h") % size).cast("int")
    shorter = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, size))
    words = (
        drawn.select(F.when(F.col("h") % 97 == 0, shorter).otherwise(run).alias("word"))
        .filter(F.length("word") >= 5)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n >= 3")
    )
    return spelling.variant_groups(words, ratio=2)
