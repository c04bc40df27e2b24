"""Projections, filters and predicates (PF1-PF23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.functions import text
from trialweave.operators import checks, evidence, rules
from trialweave.plans.registry import query, table
from trialweave.plans.scalars import TITLE_SQL

# Recording-like paths from the event table: the user is the subject, the day the
# session; sign-ups have no session folder, errors no subject folder.
PATH_SQL = """
  CASE event_type WHEN 'error' THEN 'root/misc/' || event_id || '_events.tsv'
    WHEN 'signup' THEN 'root/sub-' || user_id || '/eeg/' || event_id || '_events.tsv'
    ELSE 'root/sub-' || user_id || '/ses-' || strftime(ts, '%Y%m%d') || '/eeg/sub-' || user_id || '_run-' || (event_id % 3) || '_events.tsv' END
"""


def event_paths(spark, sf):
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    name = F.col("event_id").cast("string")
    path = (
        F.when(kind == "error", F.concat(F.lit("root/misc/"), name, F.lit("_events.tsv")))
        .when(kind == "signup", F.concat(F.lit("root/sub-"), user, F.lit("/eeg/"), name, F.lit("_events.tsv")))
        .otherwise(
            F.concat(
                F.lit("root/sub-"), user, F.lit("/ses-"), F.date_format("ts", "yyyyMMdd"), F.lit("/eeg/sub-"), user,
                F.lit("_run-"), (F.col("event_id") % 3).cast("string"), F.lit("_events.tsv"),
            )
        )
    )
    return table(spark, sf, "events").withColumn("path", path)


@query(
    "pf1_path_identity",
    f"""
    SELECT event_id, CASE WHEN p LIKE '%/sub-%' THEN regexp_extract(p, '(?:^|/)sub-([^/]*)', 1) END AS subject,
      CASE WHEN p LIKE '%/ses-%' THEN regexp_extract(p, '(?:^|/)ses-([^/]*)', 1) ELSE 'default' END AS session
    FROM (SELECT event_id, {PATH_SQL} AS p FROM events)
    """,
)
def pf1_path_identity(spark, sf):
    path = F.col("path")
    return event_paths(spark, sf).select(
        "event_id",
        text.path_entity(path, "sub").alias("subject"),
        F.coalesce(text.path_entity(path, "ses"), F.lit("default")).alias("session"),
    )


HOST_PATTERN = r"^https?://(?P<subject>[a-z-]+)\.(?:[a-z-]+\.)*example"
LANG_PATTERN = r"example\.(?P<tld>[a-z]+)/(?P<session>[a-z]{2})/(?P<run>[0-9]+)"


@query(
    "pf2_declared_identity",
    r"""
    SELECT page_id, nullif(regexp_extract(url, '^https?://([a-z-]+)\.(?:[a-z-]+\.)*example', 1), '') AS subject,
      nullif(regexp_extract(url, 'example\.([a-z]+)/([a-z]{2})/([0-9]+)', 2), '') AS session,
      coalesce(nullif(regexp_extract(url, 'example\.([a-z]+)/([a-z]{2})/([0-9]+)', 3), ''), 'default') AS run
    FROM pages
    """,
)
def pf2_declared_identity(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        text.declared_identity(url, HOST_PATTERN, "subject").alias("subject"),
        text.declared_identity(url, LANG_PATTERN, "session").alias("session"),
        F.coalesce(text.declared_identity(url, LANG_PATTERN, "run"), F.lit("default")).alias("run"),
    )


@query(
    "pf3_identity_conflicts",
    f"""
    WITH p AS (SELECT event_id, {PATH_SQL} AS p FROM events),
    i AS (SELECT event_id, regexp_extract(p, '/sub-([0-9]+)/', 1) AS subject,
      coalesce(nullif(regexp_extract(p, '/ses-([0-9]+)/', 1), ''), 'default') AS session,
      nullif(regexp_extract(p, '/(?:sub-)?([0-9]+)_(?:run|events)', 1), '') AS a_subject,
      coalesce(nullif(regexp_extract(p, '/ses-([0-9]{{8}})/', 1), ''), 'none') AS a_session FROM p WHERE p LIKE '%/sub-%')
    SELECT event_id, 'subject' AS field, subject AS authoritative_value, a_subject AS asserted_value FROM i WHERE subject IS DISTINCT FROM a_subject
    UNION ALL
    SELECT event_id, 'session', session, a_session FROM i WHERE session IS DISTINCT FROM a_session
    """,
)
def pf3_identity_conflicts(spark, sf):
    path = F.col("path")
    ids = event_paths(spark, sf).select(
        "event_id",
        text.declared_identity(path, r"/sub-(?P<subject>[0-9]+)/", "subject").alias("subject"),
        F.coalesce(text.declared_identity(path, r"/ses-(?P<session>[0-9]+)/", "session"), F.lit("default")).alias("session"),
        text.declared_identity(path, r"/(?:sub-)?(?P<subject>[0-9]+)_(?:run|events)", "subject").alias("a_subject"),
        F.coalesce(text.declared_identity(path, r"/ses-(?P<session>[0-9]{8})/", "session"), F.lit("none")).alias("a_session"),
    ).where(F.col("subject").isNotNull())
    return identity_conflicts(ids, ["event_id"], {"subject": "a_subject", "session": "a_session"})


def identity_conflicts(ids, entity, pairs):
    """Conflict rows from an authoritative and an asserted identity."""
    found = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(field).alias("field"),
                    F.col(field).alias("authoritative_value"),
                    F.col(asserted).alias("asserted_value"),
                )
                for field, asserted in pairs.items()
            ]
        ),
        lambda c: ~c["authoritative_value"].eqNullSafe(c["asserted_value"]),
    )
    return ids.select(*entity, F.explode(found).alias("c")).select(*entity, "c.*")


@query(
    "pf4_natural_order",
    """
    WITH l AS (SELECT DISTINCT CASE WHEN p_size < 10 THEN p_brand ELSE p_size::VARCHAR END AS label FROM part)
    SELECT label, row_number() OVER (ORDER BY CASE WHEN regexp_full_match(label, '[0-9]+') THEN 0 ELSE 1 END,
      CASE WHEN regexp_full_match(label, '[0-9]+') THEN label::BIGINT END, label)::BIGINT AS place FROM l
    """,
)
def pf4_natural_order(spark, sf):
    from trialweave.operators.ordered import ordered_position

    label = F.when(F.col("p_size") < 10, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    labels = table(spark, sf, "part").select(label.alias("label")).distinct()
    kind, number, _ = text.natural_order(F.col("label"))
    keyed = labels.withColumn("kind", kind).withColumn("number", number)
    # Slice: digits by their size, other labels by first character.
    piece = F.when(F.col("kind") == 0, F.concat(F.lit("0"), F.lpad(F.length("label").cast("string"), 4, "0"))).otherwise(
        F.concat(F.lit("1"), F.substring("label", 1, 1))
    )
    return ordered_position(keyed, [], ["kind", "number", "label"], piece, "place").select("label", "place")


@query(
    "pf5_optional_double",
    """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN NULL WHEN '5-LOW' THEN NULL ELSE o_totalprice END AS frequency FROM orders
    """,
)
def pf5_optional_double(spark, sf):
    p = F.col("o_orderpriority")
    raw = (
        F.when(p == "1-URGENT", " N/A ")
        .when(p == "2-HIGH", "  ")
        .when(p == "5-LOW", "Unknown")
        .otherwise(F.col("o_totalprice").cast("string"))
    )
    return table(spark, sf, "orders").select("o_orderkey", text.optional_double(raw).alias("frequency"))


CODE_MAP = {"1": "left", "2": "right", "3": "rest", "4": "feet", "5": "tongue", "6": "left", "7": "right"}


@query(
    "pf6_event_codes",
    f"""
    WITH m(code, label) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in CODE_MAP.items())}),
    e AS (SELECT l_orderkey, CASE WHEN l_quantity > 49 THEN '8.5' WHEN l_quantity > 48 THEN 'x' ELSE l_linenumber::VARCHAR END AS code FROM lineitem)
    SELECT e.code, m.label, m.label IS NOT NULL AS mapped, count(*)::BIGINT AS events FROM e LEFT JOIN m USING (code) GROUP BY ALL
    """,
)
def pf6_event_codes(spark, sf):
    number = F.when(F.col("l_quantity") > 49, F.lit(8.5)).otherwise(F.col("l_linenumber").cast("double"))
    code = F.when((F.col("l_quantity") > 48) & (F.col("l_quantity") <= 49), F.lit("x")).otherwise(text.event_code_text(number))
    return mapped_codes(table(spark, sf, "lineitem").select(code.alias("code")), "code", CODE_MAP).groupBy(
        "code", "label", "mapped"
    ).agg(F.count(F.lit(1)).alias("events"))


def mapped_codes(events, code, mapping):
    """Declared event code mapping; the mapping is a sidecar map, so a plan literal."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return events.withColumn("label", F.try_element_at(pairs, F.col(code))).withColumn("mapped", F.col("label").isNotNull())


@query(
    "pf7_paradigm_family",
    r"""
    SELECT doc_id, CASE WHEN contains(lower(text), 'motor imagery') OR source = 'src3' THEN 'motor_imagery'
      ELSE 'bids_task_' || coalesce(nullif(replace(trim(regexp_replace(lower(CASE lang WHEN 'de' THEN '--' ELSE lang || '-' || source || ' (' || n_chars || ')' END), '[^\p{L}\p{N}]+', ' ', 'g')), ' ', '_'), ''), 'unspecified') END AS family
    FROM documents
    """,
)
def pf7_paradigm_family(spark, sf):
    task = F.when(F.col("lang") == "de", "--").otherwise(
        F.concat("lang", F.lit("-"), "source", F.lit(" ("), F.col("n_chars").cast("string"), F.lit(")"))
    )
    keywords = F.array(F.when(F.col("source") == "src3", "motor imagery").otherwise("other"))
    return table(spark, sf, "documents").select(
        "doc_id", text.paradigm_family(task, F.lower("text"), keywords).alias("family")
    )


@query(
    "pf8_keyword_flags",
    """
    SELECT doc_id, contains(lower(text), 'the') AS cue_based, contains(lower(text), 'license') AS feedback_present,
      contains(lower(text), 'separate days') AS separate_days FROM documents
    """,
)
def pf8_keyword_flags(spark, sf):
    body = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        text.mentions(body, "the").alias("cue_based"),
        text.mentions(body, "license").alias("feedback_present"),
        text.mentions(body, "separate days").alias("separate_days"),
    )


@query(
    "pf9_common_window",
    """
    WITH d AS (SELECT l_orderkey, min(l_quantity) AS shortest, count_if(l_returnflag = 'R') AS truncated,
      max(CASE WHEN l_discount = 0.1 THEN l_quantity END) AS hinted FROM lineitem GROUP BY 1)
    SELECT l_orderkey, 0.0::DOUBLE AS window_start, CASE WHEN l_orderkey % 5 = 0 THEN 4.0 WHEN hinted IS NOT NULL THEN hinted WHEN truncated > 0 THEN NULL ELSE shortest END AS window_stop,
      CASE WHEN l_orderkey % 5 = 0 THEN 'given' WHEN hinted IS NOT NULL THEN 'hinted' WHEN truncated > 0 THEN 'truncated_without_window' ELSE 'shortest_duration' END AS basis FROM d
    """,
)
def pf9_common_window(spark, sf):
    runs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_quantity").alias("shortest"),
        F.count_if(F.col("l_returnflag") == "R").alias("truncated"),
        F.max(F.when(F.col("l_discount") == 0.1, F.col("l_quantity"))).alias("hinted"),
    )
    given = F.when(F.col("l_orderkey") % 5 == 0, F.lit(4.0))
    return common_window(runs, ["l_orderkey"], given)


def common_window(runs, keys, given):
    """Safe analysis window: given, hinted, refused on truncation, or the shortest."""
    hinted, cut = F.col("hinted"), F.col("truncated") > 0
    basis = (
        F.when(given.isNotNull(), "given")
        .when(hinted.isNotNull(), "hinted")
        .when(cut, "truncated_without_window")
        .otherwise("shortest_duration")
    )
    stop = F.coalesce(given, hinted, F.when(~cut, F.col("shortest")))
    return runs.select(*keys, F.lit(0.0).alias("window_start"), stop.alias("window_stop"), basis.alias("basis"))


# Papers from the documents: the text is the title, the source the search.
WORK_TYPE_SQL = "CASE WHEN source = 'src4' THEN 'component' WHEN source = 'src7' THEN 'posted-content' WHEN lang = 'en' THEN 'journal-article' WHEN lang = 'de' THEN NULL ELSE 'dataset' END"
PAPERS_SQL = f"""
    SELECT d.doc_id, source AS search, {WORK_TYPE_SQL} AS work_type, text, n_chars,
      CASE WHEN n_chars % 11 = 0 THEN 'Erratum to ' ELSE '' END || text AS title, {TITLE_SQL} AS tkey,
      coalesce(toxic = 1, false) AS is_retracted
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
MARKED_SQL = rf"""
    WITH p AS ({PAPERS_SQL}),
    m AS (SELECT *, CASE WHEN n_chars % 11 = 0 THEN 'erratum to ' || tkey ELSE tkey END AS title_key,
      CASE WHEN is_retracted THEN 'retracted'
      WHEN work_type IN ('component', 'supplementary-material', 'correction', 'retraction', 'peer-review') THEN 'ineligible_work_type'
      WHEN regexp_matches(title, '(?i)\b(supplement(?:ary)?|supporting information|correction|corrigendum|erratum|retraction)\b|_supp\d*') THEN 'supplement_correction_or_retraction_title' END AS r0 FROM p),
    f AS (SELECT *, CASE WHEN r0 IS NOT NULL THEN r0 WHEN row_number() OVER (PARTITION BY search, title_key, r0 IS NULL ORDER BY doc_id) > 1 THEN 'duplicate_normalized_title' END AS reason FROM m)
"""


def papers(spark, sf):
    source, lang = F.col("source"), F.col("lang")
    work_type = (
        F.when(source == "src4", "component")
        .when(source == "src7", "posted-content")
        .when(lang == "en", "journal-article")
        .when(lang != "de", "dataset")
    )
    lead = F.when(F.col("n_chars") % 11 == 0, "Erratum to ").otherwise("")
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id",
        source.alias("search"),
        work_type.alias("work_type"),
        F.concat(lead, "text").alias("title"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_retracted"),
        F.col("text").alias("abstract"),
        "n_chars",
        "lang",
    )


def marked_papers(spark, sf):
    return evidence.with_exclusion_reason(papers(spark, sf), ["search"], "doc_id")


@query("pf10_hygiene_filter", f"{MARKED_SQL} SELECT doc_id, search, reason FROM f")
def pf10_hygiene_filter(spark, sf):
    return evidence.hygiene_decisions(papers(spark, sf), ["search"], "doc_id")


@query(
    "pf11_evidence_level",
    f"""
    WITH p AS ({PAPERS_SQL}) SELECT CASE WHEN work_type IN ('article', 'journal-article', 'proceedings-article', 'book-chapter') THEN 'published_metadata_only'
      WHEN work_type = 'posted-content' THEN 'preprint_metadata_only' ELSE 'other_metadata_only' END AS evidence_level, count(*)::BIGINT AS papers FROM p GROUP BY 1
    """,
)
def pf11_evidence_level(spark, sf):
    return (
        papers(spark, sf)
        .groupBy(evidence.evidence_level(F.col("work_type")).alias("evidence_level"))
        .agg(F.count(F.lit(1)).alias("papers"))
    )


# Candidate specs from the parts.
SPEC_SQL = """
    SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '  ' ELSE p_name END AS pipeline_id,
      CASE p_type WHEN 'PROMO' THEN 'csp_lda' WHEN 'STANDARD' THEN 'csp_lda' WHEN 'ECONOMY' THEN 'riemann_mdm' ELSE 'bandpower_lda' END AS family,
      CASE WHEN p_size % 4 = 0 THEN 4.0 WHEN p_size % 4 = 1 THEN 8.0 WHEN p_size % 4 = 2 THEN 13.0 ELSE 0.0 END::DOUBLE AS low,
      CASE WHEN p_size % 3 = 0 THEN 30.0 WHEN p_size % 3 = 1 THEN 13.0 ELSE 40.0 END::DOUBLE AS high,
      CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'csp' ELSE 'none' END AS spatial_filter,
      p_size % 6 AS csp_components, CASE WHEN p_type = 'PROMO' THEN 'csp_log_variance' ELSE 'log_bandpower' END AS feature,
      CASE WHEN p_brand = 'Brand#1' THEN 'svm' ELSE 'shrinkage_lda' END AS model, (p_size % 13) / 10.0::DOUBLE AS lda_shrinkage,
      p_size % 7 AS cv_folds, p_size - 3 AS random_seed FROM part
"""


def specs(spark, sf):
    size, kind = F.col("p_size"), F.col("p_type")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.when(size % 10 == 0, "  ").otherwise(F.col("p_name")).alias("pipeline_id"),
        F.when(kind.isin("PROMO", "STANDARD"), "csp_lda").when(kind == "ECONOMY", "riemann_mdm").otherwise("bandpower_lda").alias("family"),
        F.when(size % 4 == 0, 4.0).when(size % 4 == 1, 8.0).when(size % 4 == 2, 13.0).otherwise(0.0).alias("low"),
        F.when(size % 3 == 0, 30.0).when(size % 3 == 1, 13.0).otherwise(40.0).alias("high"),
        F.when(kind.isin("PROMO", "LARGE"), "csp").otherwise("none").alias("spatial_filter"),
        (size % 6).alias("csp_components"),
        F.when(kind == "PROMO", "csp_log_variance").otherwise("log_bandpower").alias("feature"),
        F.when(F.col("p_brand") == "Brand#1", "svm").otherwise("shrinkage_lda").alias("model"),
        ((size % 13) / F.lit(10.0)).alias("lda_shrinkage"),
        (size % 7).alias("cv_folds"),
        (size - 3).alias("random_seed"),
    )


def rules_sql(source: str, entity: str, failures: dict[str, str]) -> str:
    """SQL of a violation table: one branch per rule, stated as its failure."""
    return " UNION ALL ".join(
        f"SELECT {entity}, '{rule}' AS rule_id FROM {source} WHERE {bad}" for rule, bad in failures.items()
    )


@query(
    "pf13_capability",
    f"WITH s AS ({SPEC_SQL}) "
    + rules_sql(
        "s",
        "p_partkey",
        {
            "family_executable": "family NOT IN ('bandpower_lda', 'csp_lda')",
            "band_executable": "(low, high) NOT IN ((4.0, 40.0), (8.0, 13.0), (8.0, 30.0), (13.0, 30.0))",
            "components_executable": "family = 'csp_lda' AND csp_components NOT IN (2, 4, 6)",
            "shrinkage_executable": "lda_shrinkage NOT IN (0.0, 0.1, 0.3, 0.5)",
            "folds_executable": "cv_folds NOT IN (3, 4, 5)",
        },
    ),
)
def pf13_capability(spark, sf):
    return checks.violations(specs(spark, sf), ["p_partkey"], rules.capability_rules())


@query(
    "pf14_spec_rules",
    f"WITH s AS ({SPEC_SQL}) "
    + rules_sql(
        "s",
        "p_partkey",
        {
            "pipeline_id_present": "trim(pipeline_id) = ''",
            "family_known": "family NOT IN ('bandpower_lda', 'csp_lda')",
            "band_ordered": "NOT (0 < low AND low < high)",
            "bandpower_parts": "family = 'bandpower_lda' AND (spatial_filter <> 'none' OR feature <> 'log_bandpower')",
            "csp_parts": "family = 'csp_lda' AND (spatial_filter <> 'csp' OR feature <> 'csp_log_variance')",
            "csp_components_even": "family = 'csp_lda' AND (csp_components < 2 OR csp_components % 2 = 1)",
            "model_known": "model <> 'shrinkage_lda'",
            "shrinkage_in_unit_interval": "lda_shrinkage < 0 OR lda_shrinkage > 1",
            "folds_at_least_two": "cv_folds < 2",
            "seed_not_negative": "random_seed < 0",
        },
    ),
)
def pf14_spec_rules(spark, sf):
    return checks.violations(specs(spark, sf), ["p_partkey"], rules.spec_rules())


def dataset_profiles(spark, sf):
    """Profile documents from the customers and their orders."""
    per_customer = (
        table(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count(F.lit(1)).alias("trials"),
            F.countDistinct(F.year("o_orderdate")).alias("years"),
            F.sort_array(F.collect_set("o_orderstatus")).alias("labels"),
        )
    )
    c = table(spark, sf, "customer").join(per_customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    dup = F.col("c_nationkey") == 3
    named = F.when(dup, F.concat(labels, F.array(F.lit(" P")))).otherwise(labels)
    key = F.col("c_custkey")
    start = F.lit(0.0)
    stop = (F.col("c_nationkey") % 4).cast("double")
    ses = F.coalesce("years", F.lit(0))
    return c.select(
        F.col("c_custkey"),
        F.when(F.col("c_nationkey") == 7, "2.0").otherwise("1.0").alias("schema_version"),
        F.struct(F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_name")).alias("id")).alias("dataset"),
        F.struct(
            F.lower("c_mktsegment").alias("family"),
            F.transform(named, lambda v: F.struct(v.alias("label"))).alias("actions"),
        ).alias("paradigm"),
        F.struct(
            (F.col("c_nationkey") % 5).alias("channel_count"),
            F.col("c_acctbal").alias("sampling_frequency_hz"),
            F.array(F.lit("EEG")).alias("modalities"),
        ).alias("signal"),
        F.struct(F.coalesce("trials", F.lit(0)).alias("trials")).alias("volume"),
        F.struct(
            F.array(start, stop).alias("common_analysis_window_s"),
            F.map_from_entries(F.transform(labels, lambda v: F.struct(v.alias("k"), F.col("trials").alias("n")))).alias("class_counts"),
        ).alias("events"),
        F.struct(
            ses.alias("sessions_per_subject"),
            F.transform(F.filter(F.sequence(F.lit(0), ses.cast("int")), lambda i: i > 0), lambda i: F.when(F.col("c_nationkey") == 9, 1).otherwise(i)).alias("session_indices"),
        ).alias("sessions"),
        F.struct(
            F.array(F.lit("decode")).alias("allowed"),
            F.when(F.col("c_nationkey") != 11, F.array(F.lit("peek"))).alias("forbidden"),
            F.array(F.lit("split")).alias("requires_research_design_decision"),
        ).alias("constraints"),
        F.when(key % 97 == 0, F.array().cast("array<struct<source:string>>"))
        .otherwise(F.array(F.struct(F.when(key % 89 == 0, " ").otherwise(F.lit("orders")).alias("source"))))
        .alias("evidence"),
    )


PROFILE_SQL = """
    SELECT c_custkey, c_name, c_nationkey AS nk, c_acctbal, c_mktsegment, coalesce(trials, 0) AS trials, coalesce(years, 0) AS years, coalesce(labels, []::VARCHAR[]) AS labels
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS trials, count(DISTINCT year(o_orderdate)) AS years, list_sort(list(DISTINCT o_orderstatus)) AS labels FROM orders GROUP BY 1) ON o_custkey = c_custkey
"""


@query(
    "pf15_profile_rules",
    f"WITH p AS ({PROFILE_SQL}) "
    + rules_sql(
        "p",
        "c_custkey",
        {
            "schema_version": "nk = 7",
            "dataset_id": "c_acctbal < 0",
            "actions_present": "len(labels) = 0 AND nk <> 3",
            "action_labels_unique": "nk = 3 AND list_contains(labels, 'P')",
            "channels_positive": "nk % 5 = 0",
            "sampling_frequency_positive": "c_acctbal <= 0",
            "trials_positive": "trials = 0",
            "window_ordered": "nk % 4 = 0",
            "sessions_positive": "years = 0",
            "session_indices_unique": "years = 0 OR (nk = 9 AND years > 1)",
            "constraints_forbidden": "nk = 11",
            "evidence_present": "c_custkey % 97 = 0",
            "evidence_sources": "c_custkey % 89 = 0 AND c_custkey % 97 <> 0",
        },
    ),
)
def pf15_profile_rules(spark, sf):
    return checks.violations(dataset_profiles(spark, sf), ["c_custkey"], rules.profile_rules())


def sidecars(spark, sf):
    n, size = F.col("p_partkey"), F.col("p_size")
    kind = (
        F.when(size % 4 == 0, "mne_raw").when(size % 4 == 1, "declarative").when(size % 4 == 2, "mat_epochs").otherwise("zip")
    )
    axes = (
        F.when(size % 3 == 0, F.array(F.lit("trial"), F.lit("channel"), F.lit("sample")))
        .when(size % 3 == 1, F.array(F.lit("channel"), F.lit("sample")))
        .otherwise(F.array(F.lit("channel"), F.lit("channel"), F.lit("trial")))
    )
    words = F.split("p_name", " ")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_brand") == "Brand#2", "0.9").otherwise("1.0").alias("schema_version"),
        kind.alias("adapter_kind"),
        F.when(size % 11 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("**/*.npz"))).alias("source_globs"),
        F.when(size % 13 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("1"), F.lit("left"))).alias("event_code_mapping"),
        F.when(size % 17 == 0, "sub-([0-9]+)").otherwise("sub-(?P<subject>[0-9]+)").alias("subject_regex"),
        F.when(size % 19 == 0, "ses-([0-9]+)").otherwise("ses-(?P<session>[0-9]+)").alias("session_regex"),
        F.when(size % 5 == 0, "run-(?P<run>[0-9]+)").alias("run_regex"),
        F.when(size % 7 == 0, "run(?P<run>[0-9]+)").alias("run_assertion_regex"),
        axes.alias("axis_order"),
        (size - 6).cast("double").alias("sampling_frequency_hz"),
        F.when(size % 9 == 0, F.concat(words, words)).otherwise(words).alias("channel_names"),
        F.when(F.col("p_type") == "PROMO", "").otherwise("data").alias("signal_key"),
        F.lit("labels").alias("label_key"),
        F.when(F.col("p_type") == "SMALL", " ").otherwise("uV").alias("channel_units"),
        F.when(F.col("p_type") == "LARGE", " ").otherwise("declared").alias("data_role_policy"),
        F.when(n % 10 == 0, "").otherwise(F.col("p_brand")).alias("hint_dataset_id"),
        F.lower("p_type").alias("hint_family"),
    )


@query(
    "pf16_sidecar_rules",
    "WITH s AS (SELECT *, p_size % 4 AS k, string_split(p_name, ' ') AS w FROM part) "
    + rules_sql(
        "s",
        "p_partkey",
        {
            "schema_version": "p_brand = 'Brand#2'",
            "adapter_kind": "k = 3",
            "source_globs": "p_size % 11 = 0",
            "event_mapping": "p_size % 13 = 0",
            "raw_subject_regex": "k = 0 AND p_size % 17 = 0",
            "raw_session_regex": "k = 0 AND p_size % 19 = 0",
            "declared_axes": "k = 1 AND p_size % 3 = 2",
            "declared_signal": "k = 1 AND p_type = 'PROMO'",
            "declared_roles": "k = 1 AND p_type = 'LARGE'",
            "epoch_axes": "k = 2 AND p_size % 3 <> 0",
            "epoch_subject_regex": "k = 2 AND p_size % 17 = 0",
            "epoch_session_regex": "k = 2 AND p_size % 19 = 0",
            "epoch_run_assertion": "k = 2 AND p_size % 7 = 0 AND p_size % 5 <> 0",
            "epoch_sampling_frequency": "k = 2 AND p_size <= 6",
            "epoch_channel_names": "k = 2 AND (p_size % 9 = 0 OR len(list_distinct(w)) < len(w))",
            "epoch_texts": "k = 2 AND p_type IN ('PROMO', 'SMALL', 'LARGE')",
            "epoch_dataset_id": "k = 2 AND p_partkey % 10 = 0",
        },
    ),
)
def pf16_sidecar_rules(spark, sf):
    return checks.violations(sidecars(spark, sf), ["p_partkey"], rules.sidecar_rules())


EVENT_SCHEMA = {
    "type": "object",
    "required": ["kind", "k", "tags"],
    "additionalProperties": False,
    "properties": {
        "kind": {"type": "string", "enum": ["click", "view", "purchase"]},
        "k": {"type": "integer"},
        "value": {"type": "number"},
        "tags": {"type": "array", "items": {"type": "string"}},
        "user": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}}},
    },
}


@query(
    "pf17_json_conformance",
    """
    WITH e AS (SELECT event_id, event_type AS t, user_id AS u, (props->>'$.k')::INT AS k FROM events)
    SELECT event_id, 'value.kind' AS location, 'not_in_enum' AS fault FROM e WHERE t IN ('signup', 'error')
    UNION ALL SELECT event_id, 'value', 'missing_tags' FROM e WHERE u % 7 = 0
    UNION ALL SELECT event_id, 'value', 'unknown_debug' FROM e WHERE t = 'error'
    UNION ALL SELECT event_id, 'value.k', 'not_integer' FROM e WHERE k % 10 = 0
    UNION ALL SELECT event_id, 'value.value', 'not_number' FROM e WHERE u % 5 = 0
    UNION ALL SELECT event_id, 'value.tags[1]', 'not_string' FROM e WHERE u % 7 <> 0 AND k > 50
    UNION ALL SELECT event_id, 'value.user', 'missing_id' FROM e WHERE t = 'view'
    """,
)
def pf17_json_conformance(spark, sf):
    user, kind = F.col("user_id"), F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    doc = F.concat(
        F.lit('{"kind":"'), kind, F.lit('","k":'), F.when(k % 10 == 0, F.concat(k.cast("string"), F.lit(".5"))).otherwise(k.cast("string")),
        F.lit(',"value":'), F.when(user % 5 == 0, "true").otherwise(F.col("value").cast("string")),
        F.when(user % 7 != 0, F.concat(F.lit(',"tags":["a",'), F.when(k > 50, "3").otherwise('"b"'), F.lit("]"))).otherwise(""),
        F.lit(',"user":'), F.when(kind == "view", "{}").otherwise(F.concat(F.lit('{"id":'), user.cast("string"), F.lit("}"))),
        F.when(kind == "error", ',"debug":1').otherwise(""), F.lit("}"),
    )
    faults = rules.conformance_faults(F.col("doc"), EVENT_SCHEMA)
    return (
        table(spark, sf, "events")
        .select("event_id", F.try_parse_json(doc).alias("doc"))
        .select("event_id", F.explode(faults).alias("f"))
        .select("event_id", "f.*")
    )


QUALITY_SQL = """
    SELECT l_orderkey AS policy_id, CASE WHEN l_linenumber = 7 THEN '' ELSE 'r' || l_linenumber END AS rule_id,
      CASE WHEN l_quantity > 45 THEN 'like' WHEN l_quantity > 20 THEN 'gt' ELSE 'is_unknown' END AS op,
      CASE WHEN l_discount = 0 THEN '' ELSE 'std' END AS field,
      CASE l_returnflag WHEN 'R' THEN 'logical_exclude' WHEN 'A' THEN 'retain_and_flag' ELSE 'drop' END AS action,
      CASE WHEN l_tax = 0 THEN ' ' ELSE 'noise' END AS reason, l_linestatus = 'O' AS has_ref FROM lineitem
"""
POLICY_SQL = "SELECT o_orderkey AS policy_id, o_orderstatus AS s, o_orderpriority AS p FROM orders"


@query(
    "pf18_quality_policy_rules",
    f"""
    WITH r AS ({QUALITY_SQL}), p AS ({POLICY_SQL}), j AS (SELECT r.*, s <> 'F' AS allowed FROM r JOIN p USING (policy_id))
    SELECT policy_id, 'policy' AS subject, 'policy_version' AS rule_id FROM p WHERE p = '1-URGENT'
    UNION ALL SELECT policy_id, 'policy', 'default_retains' FROM p WHERE p = '5-LOW'
    UNION ALL SELECT policy_id, 'policy', 'exclusions_audited' FROM p WHERE s = 'P'
    UNION ALL SELECT policy_id, 'policy', 'rules_present' FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.policy_id = p.policy_id)
    UNION ALL SELECT policy_id, rule_id, 'rule_id_present' FROM j WHERE rule_id = ''
    UNION ALL SELECT policy_id, rule_id, 'operator_known' FROM j WHERE op = 'like'
    UNION ALL SELECT policy_id, rule_id, 'field_present' FROM j WHERE field = ''
    UNION ALL SELECT policy_id, rule_id, 'action_known' FROM j WHERE action = 'drop'
    UNION ALL SELECT policy_id, rule_id, 'exclusion_authorised' FROM j WHERE action = 'logical_exclude' AND NOT allowed
    UNION ALL SELECT policy_id, rule_id, 'reason_present' FROM j WHERE trim(reason) = ''
    UNION ALL SELECT policy_id, rule_id, 'evidence_present' FROM j WHERE NOT has_ref
    UNION ALL SELECT policy_id, rule_id, 'rule_id_unique' FROM (SELECT policy_id, rule_id FROM r WHERE rule_id <> '' GROUP BY ALL HAVING count(*) > 1)
    """,
)
def pf18_quality_policy_rules(spark, sf):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    policies = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("policy_id"),
        F.when(priority == "1-URGENT", "0.1").otherwise("1.0").alias("policy_version"),
        F.lit("block_dependent_operation").alias("unknown_metadata_action"),
        F.when(priority == "5-LOW", "drop").otherwise("retain_and_flag").alias("default_action"),
        (status != "P").alias("exclusions_require_audit_record"),
        (status != "F").alias("logical_exclusions_allowed"),
    )
    quantity, flag = F.col("l_quantity"), F.col("l_returnflag")
    line = F.col("l_linenumber")
    policy_rules = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("policy_id"),
        F.when(line == 7, "").otherwise(F.concat(F.lit("r"), line.cast("string"))).alias("rule_id"),
        F.when(quantity > 45, "like").when(quantity > 20, "gt").otherwise("is_unknown").alias("operator"),
        F.when(F.col("l_discount") == 0, "").otherwise("std").alias("field"),
        F.when(flag == "R", "logical_exclude").when(flag == "A", "retain_and_flag").otherwise("drop").alias("action"),
        F.when(F.col("l_tax") == 0, " ").otherwise("noise").alias("reason_code"),
        F.when(F.col("l_linestatus") == "O", F.array(F.lit("ref"))).otherwise(F.array(F.lit(" "))).alias("evidence_refs"),
    )
    return rules.quality_policy_violations(policies, policy_rules)


QUALITY_POLICY = (
    rules.QualityRule("long_run", "l_quantity", "gt", 45, "logical_exclude", "too_many_trials"),
    rules.QualityRule("no_price", "price", "is_unknown", None, "retain_and_flag", "metadata_missing"),
    rules.QualityRule("cheap", "price", "lt", 2000.0, "retain_and_flag", "low_amplitude"),
    rules.QualityRule("returned", "l_returnflag", "in", ("R", "A"), "retain_and_flag", "resent"),
    rules.QualityRule("taxed", "l_tax", "gte", 0.08, "fail_stage", "limit_reached"),
)


@query(
    "pf18_quality_policy_applied",
    """
    WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity > 45 AS long_run, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_extendedprice END AS price, l_returnflag IN ('R', 'A') AS returned, l_tax >= 0.08 AS taxed FROM lineitem),
    m AS (SELECT *, price IS NULL AS no_price, coalesce(price < 2000, false) AS cheap FROM p),
    a AS (SELECT l_orderkey, l_linenumber, long_run, unnest(['long_run', 'no_price', 'cheap', 'returned', 'taxed']) AS rule_id, unnest([long_run, no_price, cheap, returned, taxed]) AS met FROM m)
    SELECT 'kept' AS side, l_orderkey, l_linenumber, concat_ws(';', CASE WHEN no_price THEN 'no_price' END, CASE WHEN cheap THEN 'cheap' END, CASE WHEN returned THEN 'returned' END, CASE WHEN taxed THEN 'taxed' END) AS detail FROM m WHERE NOT long_run
    UNION ALL SELECT 'audit', l_orderkey, l_linenumber, rule_id FROM a WHERE met
    """,
)
def pf18_quality_policy_applied(spark, sf):
    """A policy run over rows: what is kept with its flags, and the audit."""
    price = F.when(F.col("l_linenumber") % 5 != 0, F.col("l_extendedprice"))
    rows = table(spark, sf, "lineitem").withColumn("price", price)
    key = ["l_orderkey", "l_linenumber"]
    kept, audit = rules.apply_quality_policy(rows, key, QUALITY_POLICY, exclusions_allowed=True)
    return kept.select(
        F.lit("kept").alias("side"), *key, F.array_join("quality_flags", ";").alias("detail")
    ).unionByName(audit.select(F.lit("audit").alias("side"), *key, F.col("rule_id").alias("detail")))


@query(
    "pf19_redaction",
    """
    SELECT event_id, '{"props": ' || props || ', "headers": {"Authorization": "<redacted>", "path": "' || event_type || '"}, "pass_word": 1, "user": {"API-Key": "<redacted>"}, "secret": '
      || CASE WHEN event_type = 'error' THEN '"<redacted>"' ELSE '"<redacted>"' END || ', "n": ' || user_id || '}' AS payload FROM events
    """,
)
def pf19_redaction(spark, sf):
    secret = F.when(F.col("event_type") == "error", F.lit('{"token": [1, 2]}')).otherwise(F.col("value").cast("string"))
    payload = F.concat(
        F.lit('{"props": '), "props", F.lit(', "headers": {"Authorization": "Bearer \\"'), F.col("event_id").cast("string"),
        F.lit('\\"", "path": "'), "event_type", F.lit('"}, "pass_word": 1, "user": {"API-Key": "k'), F.col("user_id").cast("string"),
        F.lit('"}, "secret": '), secret, F.lit(', "n": '), F.col("user_id").cast("string"), F.lit("}"),
    )
    return table(spark, sf, "events").select("event_id", rules.redact_json(payload).alias("payload"))


@query(
    "pf20_leaf_catalogue",
    f"""
    WITH p AS ({PROFILE_SQL})
    SELECT c_custkey, 'volume.trials' AS path, trials::VARCHAR AS value FROM p
    UNION ALL SELECT c_custkey, 'dataset.id', CASE WHEN c_acctbal < 0 THEN '" "' ELSE '"' || c_name || '"' END FROM p
    UNION ALL SELECT c_custkey, 'sessions.sessions_per_subject', years::VARCHAR FROM p
    UNION ALL SELECT c_custkey, 'sessions.session_indices', '[' || coalesce(array_to_string([CASE WHEN nk = 9 THEN 1 ELSE x END FOR x IN range(1, years + 1)], ','), '') || ']' FROM p
    UNION ALL SELECT c_custkey, 'events.common_analysis_window_s', '[0.0,' || (nk % 4)::DOUBLE || ']' FROM p
    UNION ALL SELECT c_custkey, 'events.class_counts.' || unnest(labels), trials::VARCHAR FROM p
    UNION ALL SELECT c_custkey, 'events.class_counts', '{{}}' FROM p WHERE len(labels) = 0
    """,
)
def pf20_leaf_catalogue(spark, sf):
    return rules.leaf_catalogue(
        dataset_profiles(spark, sf), ["c_custkey"], ["dataset", "events", "sessions", "volume"]
    )


@query(
    "pf21_reference_grammar",
    """
    WITH r AS (SELECT l_orderkey AS claim_id, CASE l_linenumber WHEN 1 THEN 'pipeline_lock#score' WHEN 2 THEN 'frozen_protocol#' WHEN 3 THEN 'pipeline_lock' WHEN 4 THEN 'confirmation_result#a#b'
      WHEN 5 THEN 'other_file#x' ELSE 'subject_profile#f' || l_linenumber END AS ref FROM lineitem)
    SELECT claim_id, ref FROM r WHERE ref NOT LIKE 'pipeline_lock#_%' AND ref NOT LIKE 'frozen_protocol#_%' AND ref NOT LIKE 'confirmation_result#_%' AND ref NOT LIKE 'subject_profile#_%'
    UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey NOT IN (SELECT claim_id FROM r)
    """,
)
def pf21_reference_grammar(spark, sf):
    n = F.col("l_linenumber")
    ref = (
        F.when(n == 1, "pipeline_lock#score").when(n == 2, "frozen_protocol#").when(n == 3, "pipeline_lock")
        .when(n == 4, "confirmation_result#a#b").when(n == 5, "other_file#x")
        .otherwise(F.concat(F.lit("subject_profile#f"), n.cast("string")))
    )
    claims = (
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"))
        .join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.array(ref).alias("refs")), "claim_id", "left")
    )
    return rules.invalid_references(claims, ["claim_id"], "refs")


@query(
    "pf22_probe_status",
    """
    WITH p AS (SELECT o_custkey AS dataset, o_orderpriority AS adapter, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE round(o_totalprice / 500000, 2) END AS c, o_orderpriority = '5-LOW' AS known FROM orders),
    r AS (SELECT dataset, adapter, c, row_number() OVER (PARTITION BY dataset ORDER BY c DESC, adapter) AS rn, lead(c) OVER (PARTITION BY dataset ORDER BY c DESC, adapter) AS nx FROM p WHERE c > 0),
    d AS (SELECT dataset, bool_or(known) AS known, count_if(c > 0) AS viable FROM p GROUP BY 1)
    SELECT d.dataset, CASE WHEN abs(c - nx) < 0.05 THEN NULL ELSE adapter END AS selected_adapter,
      CASE WHEN abs(c - nx) < 0.05 THEN 'adapter_ambiguous_requires_review' WHEN adapter IS NOT NULL THEN 'adapter_selected' WHEN known THEN 'recognized_format_requires_semantic_mapping' ELSE 'unsupported_requires_new_adapter' END AS status,
      viable::BIGINT AS viable FROM d LEFT JOIN r ON d.dataset = r.dataset AND rn = 1
    """,
)
def pf22_probe_status(spark, sf):
    probes = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("dataset"),
        F.col("o_orderpriority").alias("adapter_id"),
        F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.round(F.col("o_totalprice") / 500000, 2)).alias("confidence"),
        (F.col("o_orderpriority") == "5-LOW").alias("known_format"),
    )
    return rules.probe_decision(probes, ["dataset"], "known_format")


ROLE_SQL = "SELECT user_id AS unit_id, CASE substr(sha256(user_id::VARCHAR), 1, 1) WHEN '0' THEN 'frozen_confirmation' WHEN '1' THEN 'frozen_confirmation' WHEN '2' THEN 'profiling_and_calibration' ELSE 'pipeline_search_and_lock' END AS role FROM (SELECT DISTINCT user_id FROM events)"


def user_roles(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id").alias("unit_id")).distinct()
    digit = F.substring(F.sha2(F.col("unit_id").cast("string"), 256), 1, 1)
    return users.withColumn(
        "role",
        F.when(digit.isin("0", "1"), "frozen_confirmation").when(digit == "2", "profiling_and_calibration").otherwise("pipeline_search_and_lock"),
    )


@query(
    "pf23_role_authorisation",
    f"""
    WITH r AS ({ROLE_SQL})
    SELECT event_id, true AS readable FROM events WHERE user_id IN (SELECT unit_id FROM r WHERE role = 'pipeline_search_and_lock')
    UNION ALL SELECT DISTINCT user_id, false FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT unit_id FROM r WHERE role = 'pipeline_search_and_lock')
    """,
)
def pf23_role_authorisation(spark, sf):
    roles = user_roles(spark, sf)
    events = table(spark, sf, "events").withColumn("unit_id", F.col("user_id"))
    role = "pipeline_search_and_lock"
    readable = rules.authorised(events, roles, role, ["unit_id"]).select("event_id", F.lit(True).alias("readable"))
    refused = rules.unauthorised(events.where(F.col("event_type") == "error"), roles, role, ["unit_id"])
    return readable.unionByName(refused.select(F.col("unit_id").alias("event_id"), F.lit(False).alias("readable")))
