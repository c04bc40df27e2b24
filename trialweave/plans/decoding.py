"""Decoding jobs over the embedding table (AG20-AG24, WN7, GJ1-GJ7, GJ10, GJ11, DX7).

Each vector is one trial of two channels with 32 samples at 128 Hz.  The label's last
digit modulo five is the subject, its half (below five or not) the class, so every
vector takes part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.functions import kernels, parameters
from trialweave.operators import (
    adaptation,
    decode,
    filter_bank,
    linear_models,
    preparation,
    riemann,
    search,
    signal,
)
from trialweave.plans import decoding_sql
from trialweave.plans.registry import query, table
from trialweave.session import materialise, shared_dir
from trialweave.sources.sinks import write_once

CANDIDATES = decode.default_candidates(seed=7, components=2, folds=3)
BANDS = [(c.low, c.high) for c in CANDIDATES]

TRIAL_SQL = """
    t AS (SELECT vec_id AS trial_id, label % 5 AS subject_id, CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS label, list_transform(embedding, lambda x: x::DOUBLE) AS s FROM embeddings),
    ch AS (SELECT trial_id, subject_id, label, s[1:32] AS x0, s[33:64] AS x1 FROM t)
"""


def trials(spark, sf):
    return table(spark, sf, "embeddings").select(
        (F.col("label") % 5).alias("subject_id"),
        (F.col("vec_id") % 2).alias("session_id"),
        F.col("vec_id").alias("trial_id"),
        F.when(F.col("label") < 5, "a").otherwise("b").alias("label"),
        F.lit(128.0).alias("sfreq"),
        F.lit(2).alias("channels"),
        F.col("embedding").cast("array<double>").alias("samples"),
    )


COV_SQL = f"""
    {TRIAL_SQL}, ex AS (SELECT trial_id, subject_id, label, c.c AS ch, unnest(CASE c.c WHEN 0 THEN x0 ELSE x1 END) AS v, unnest(range(32)) AS k FROM ch, (VALUES (0), (1)) c(c)),
    cn AS (SELECT *, v - avg(v) OVER (PARTITION BY trial_id, ch) AS z FROM ex),
    cv AS (SELECT a.subject_id, a.label, a.trial_id, a.ch AS i, b.ch AS j, sum(a.z * b.z) AS c FROM cn a JOIN cn b ON a.trial_id = b.trial_id AND a.k = b.k GROUP BY ALL)
"""


@query(
    "ag20_class_covariance",
    f"""
    WITH {COV_SQL}, tr AS (SELECT trial_id, greatest(sum(c), 2.220446049250313e-16) AS tr FROM cv WHERE i = j GROUP BY 1)
    SELECT subject_id, label, i, j, round(avg(c / tr), 9) AS mean_covariance FROM cv JOIN tr USING (trial_id) GROUP BY ALL
    """,
)
def ag20_class_covariance(spark, sf):
    means = decode.mean_covariances(decode.covariance_rows(trials(spark, sf)), ["subject_id", "label"])
    cells = means.select("subject_id", "label", F.posexplode("mean_covariance").alias("at", "c"))
    return cells.select(
        "subject_id", "label", F.floor(F.col("at") / 2).cast("int").alias("i"), (F.col("at") % 2).alias("j"),
        F.round("c", 9).alias("mean_covariance"),
    )


@query(
    "ag21_log_variances",
    f"""
    WITH {COV_SQL}, v AS (SELECT trial_id, i AS channel, c / 32 AS v FROM cv WHERE i = j), s AS (SELECT trial_id, sum(v) AS s FROM v GROUP BY 1)
    SELECT trial_id, channel, round(ln(v + 1e-12), 9) AS log_variance, round(ln(v / s + 1e-12), 9) AS log_share FROM v JOIN s USING (trial_id)
    """,
)
def ag21_log_variances(spark, sf):
    rows = raw_features(spark, sf).select("trial_id", F.posexplode(F.arrays_zip("x", "share")).alias("channel", "f"))
    return rows.select(
        "trial_id", "channel", F.round("f.x", 9).alias("log_variance"), F.round("f.share", 9).alias("log_share")
    )


def raw_features(spark, sf):
    """Log variances (x) and log shares of the channels of the unfiltered trials."""
    cov, channels, width = F.col("cov"), F.col("channels"), F.col("width")
    return decode.covariance_rows(trials(spark, sf)).select(
        "subject_id", "trial_id", "label", (F.col("label") == "b").cast("int").alias("class"),
        decode.log_variances(cov, channels, width).alias("x"), decode.log_shares(cov, channels).alias("share"),
    )


FOLD_SQL = f"""
    {TRIAL_SQL}, fd AS (SELECT trial_id, ntile(3) OVER (PARTITION BY subject_id, label ORDER BY sha256('7:' || trial_id)) - 1 AS fold FROM t)
"""


def folded_trials(spark, sf):
    rows = trials(spark, sf).select("subject_id", "trial_id", "label")
    sizes = rows.groupBy("subject_id", "label").agg(F.count(F.lit(1)).alias("size"))
    folds = decode.stratified_folds(
        rows.join(sizes, ["subject_id", "label"]), ["subject_id", "label"], "trial_id", "size", 3, 7
    )
    return folds.select("subject_id", "label", "trial_id", "fold")


@query("wn7_stratified_folds", f"WITH {FOLD_SQL} SELECT t.subject_id, t.label, t.trial_id, fold::INTEGER AS fold FROM t JOIN fd USING (trial_id)")
def wn7_stratified_folds(spark, sf):
    return folded_trials(spark, sf)


FEATURE_SQL = f"""
    {FOLD_SQL}, ex AS (SELECT trial_id, ch.subject_id, ch.label, c.c AS channel, ln(list_var_pop(CASE c.c WHEN 0 THEN x0 ELSE x1 END) + 1e-12) AS x FROM ch, (VALUES (0), (1)) c(c)),
    ff AS (SELECT ex.*, fold FROM ex JOIN fd USING (trial_id))
"""


def fold_features(spark, sf):
    folds = folded_trials(spark, sf).select("trial_id", "fold")
    return raw_features(spark, sf).join(folds, "trial_id")


@query(
    "ag22_standardised",
    f"""
    WITH {FEATURE_SQL}, st AS (SELECT h.h AS held, subject_id, channel, avg(x) AS m, stddev_pop(x) AS sd FROM ff, (VALUES (0), (1), (2)) h(h) WHERE fold <> h.h GROUP BY ALL)
    SELECT ff.trial_id, ff.channel, fold::INTEGER AS fold, round((x - m) / CASE WHEN sd <= 1e-12 THEN 1 ELSE sd END, 6) AS z FROM ff JOIN st ON st.held = ff.fold AND st.subject_id = ff.subject_id AND st.channel = ff.channel
    """,
)
def ag22_standardised(spark, sf):
    """Held-out features scaled by the training side of their fold."""
    scaled = decode.standardised_features(fold_features(spark, sf), ["subject_id"])
    return scaled.select("trial_id", "fold", F.posexplode("z").alias("channel", "z")).select(
        "trial_id", "channel", "fold", F.round("z", 6).alias("z")
    )


@query(
    "ag23_classifier_statistics",
    f"""
    WITH {FEATURE_SQL}, st AS (SELECT subject_id, channel, avg(x) AS m, stddev_pop(x) AS sd FROM ff GROUP BY ALL),
    z AS (SELECT ff.subject_id, ff.label, trial_id, ff.channel, (x - m) / sd AS z FROM ff JOIN st ON st.subject_id = ff.subject_id AND st.channel = ff.channel),
    cm AS (SELECT subject_id, label, channel, avg(z) AS cm, count(*) AS n FROM z GROUP BY ALL),
    r AS (SELECT z.subject_id, z.label, trial_id, z.channel, z - cm AS r FROM z JOIN cm ON z.subject_id = cm.subject_id AND z.label = cm.label AND z.channel = cm.channel),
    pc AS (SELECT a.subject_id, a.channel AS i, b.channel AS j, sum(a.r * b.r) / greatest(1, count(DISTINCT a.trial_id) - 2) AS c FROM r a JOIN r b ON a.trial_id = b.trial_id GROUP BY ALL),
    tr AS (SELECT subject_id, sum(c) AS tr FROM pc WHERE i = j GROUP BY 1)
    SELECT pc.subject_id, i, j, round(0.9 * c + CASE WHEN i = j THEN 0.1 * tr / 2 ELSE 0 END, 6) AS covariance, round(a.cm, 6) AS mean_a, round(b.cm, 6) AS mean_b, round(a.n / (a.n + b.n), 9) AS prior_a
    FROM pc JOIN tr USING (subject_id) JOIN cm a ON a.subject_id = pc.subject_id AND a.label = 'a' AND a.channel = i JOIN cm b ON b.subject_id = pc.subject_id AND b.label = 'b' AND b.channel = i
    """,
)
def ag23_classifier_statistics(spark, sf):
    """Class means, priors and shrunk pooled covariance, all from one set of sums."""
    rows = raw_features(spark, sf).withColumn("fold", F.lit(-1))
    moments = decode.class_moments(rows, ["subject_id"]).withColumn("shrinkage", F.lit(0.1))
    found = decode.classifier_statistics(moments, ["subject_id"], holdout=False)
    cells = found.select("*", F.posexplode("covariance").alias("at", "c"))
    i, j = F.floor(F.col("at") / 2).cast("int"), F.col("at") % 2
    return cells.select(
        "subject_id", i.alias("i"), j.alias("j"), F.round("c", 6).alias("covariance"),
        F.round(F.get("means", i), 6).alias("mean_a"), F.round(F.get("means", i + 2), 6).alias("mean_b"),
        F.round(F.get("priors", F.lit(0)), 9).alias("prior_a"),
    )


@query(
    "ag24_metrics",
    """
    WITH p AS (SELECT l_suppkey AS subject_id, l_returnflag AS truth, CASE WHEN l_quantity > 20 THEN l_returnflag WHEN l_discount > 0.05 THEN 'A' ELSE 'X' END AS said FROM lineitem),
    n AS (SELECT subject_id, count(*) AS n, avg((truth = said)::INT) AS acc FROM p GROUP BY 1),
    r AS (SELECT subject_id, avg(rec) AS bal FROM (SELECT subject_id, truth, avg((truth = said)::INT) AS rec FROM p GROUP BY 1, 2) GROUP BY 1),
    m AS (SELECT subject_id, v, sum(t) AS t, sum(s) AS s FROM (SELECT subject_id, truth AS v, 1 AS t, 0 AS s FROM p UNION ALL SELECT subject_id, said, 0, 1 FROM p) GROUP BY 1, 2),
    e AS (SELECT subject_id, sum(t * s)::DOUBLE AS ts FROM m GROUP BY 1)
    SELECT subject_id, n::BIGINT AS trials, round(acc, 9) AS accuracy, round(bal, 9) AS balanced_accuracy, round((acc - ts / (n * n)) / (1 - ts / (n * n)), 9) AS kappa FROM n JOIN r USING (subject_id) JOIN e USING (subject_id)
    """,
)
def ag24_metrics(spark, sf):
    said = F.when(F.col("l_quantity") > 20, F.col("l_returnflag")).when(F.col("l_discount") > 0.05, "A").otherwise("X")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("subject_id"), F.col("l_returnflag").alias("truth"), said.alias("said")
    )
    found = decode.classification_metrics(rows, ["subject_id"], "truth", "said")
    return found.select(
        "subject_id", "trials", *[F.round(c, 9).alias(c) for c in ("accuracy", "balanced_accuracy", "kappa")]
    )


@query(
    "gj1_bandpass",
    f"""
    WITH {TRIAL_SQL}, {decoding_sql.bands_cte([(8.0, 30.0)])},
    y AS (SELECT trial_id, c.c AS channel_idx, list_transform(mat, lambda w: list_dot_product(w, CASE c.c WHEN 0 THEN x0 ELSE x1 END)) AS v FROM ch, fm, (VALUES (0), (1)) c(c))
    SELECT trial_id AS trial_idx, channel_idx, unnest(range(32))::INTEGER AS sample, round(unnest(v), 9) + 0.0 AS value FROM y
    """,
)
def gj1_bandpass(spark, sf):
    rows = signal.epochs_of_trials(trials(spark, sf).withColumnRenamed("trial_id", "trial_idx"))
    out = decode.bandpass(rows, 8.0, 30.0)
    return out.select("trial_idx", "channel_idx", F.posexplode("filtered").alias("sample", "value")).withColumn(
        "value", F.round("value", 9) + 0.0
    )


@query(
    "gj3_linear_scores",
    """
    WITH s AS (SELECT l_suppkey AS subject_id, avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS m1, avg(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) AS m0, var_pop(l_quantity) AS v, avg((l_returnflag = 'R')::INT) AS p FROM lineitem GROUP BY 1)
    SELECT l_suppkey AS subject_id, l_orderkey, l_linenumber, l_partkey, round(l_quantity * m0 / v - 0.5 * m0 * m0 / v + ln(greatest(1 - p, 1e-12)), 6) AS score_0, round(l_quantity * m1 / v - 0.5 * m1 * m1 / v + ln(greatest(p, 1e-12)), 6) AS score_1 FROM lineitem JOIN s ON s.subject_id = l_suppkey
    """,
)
def gj3_linear_scores(spark, sf):
    """Linear scores given the inverse covariance (one feature: its reciprocal)."""
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "subject_id")
    hit = F.col("l_returnflag") == "R"
    stats = lines.groupBy("subject_id").agg(
        F.avg(F.when(hit, F.col("l_quantity"))).alias("m1"),
        F.avg(F.when(~hit, F.col("l_quantity"))).alias("m0"),
        F.var_pop("l_quantity").alias("v"),
        F.avg(hit.cast("int")).alias("p"),
    )

    def bias(m, p):
        return F.lit(-0.5) * F.col(m) * F.col(m) / F.col("v") + F.log(F.greatest(p, F.lit(decode.FLOOR)))

    models = stats.select(
        "subject_id",
        F.array(F.col("m0") / F.col("v"), F.col("m1") / F.col("v")).alias("weights"),
        F.array(bias("m0", 1 - F.col("p")), bias("m1", F.col("p"))).alias("bias"),
    )
    a, b = decode.discriminant_scores(F.array("l_quantity"), F.col("weights"), F.col("bias"))
    return lines.join(models, "subject_id").select(
        "subject_id", "l_orderkey", "l_linenumber", "l_partkey", F.round(a, 6).alias("score_0"), F.round(b, 6).alias("score_1")
    )


# Pairs of trial and held-out fold, over all trials or over one session's.
PAIRS_SQL = """
    te AS (SELECT trial_id, h.h AS held, fold <> h.h AS is_train FROM fd, (VALUES (0), (1), (2)) h(h))
"""
METRICS = ("accuracy", "balanced_accuracy", "kappa")


def sweep_sql(bands, families: str) -> str:
    """Metrics of every candidate per fold and pooled (fold -1)."""
    return f"""
    WITH {FOLD_SQL}, {decoding_sql.bands_cte(bands)}, {PAIRS_SQL}, {decoding_sql.predictions_ctes("ch", "te")},
    bo AS (SELECT subject_id, family || '-' || band AS pipeline_id, f.f::INTEGER AS fold, label, said FROM pr, LATERAL (SELECT held AS f UNION ALL SELECT -1) f WHERE family IN ({families}))
    {decoding_sql.metrics_sql("bo", "subject_id, pipeline_id, fold")}
    """


def rounded(metrics):
    return metrics.drop("cohen_kappa").withColumns({c: F.round(c, 9) for c in METRICS})


@query(
    "gj2_spatial_filters",
    f"""
    WITH {FOLD_SQL}, {decoding_sql.bands_cte(sorted(set(BANDS)))}, {PAIRS_SQL}, {decoding_sql.predictions_ctes("ch", "te")}
    SELECT subject_id, band, held::INTEGER AS held, 0 AS component, round(u0 * u0 / un, 6) + 0.0 AS w00, round(u0 * u1 / un, 6) + 0.0 AS w01, round(u1 * u1 / un, 6) + 0.0 AS w11 FROM en
    UNION ALL SELECT subject_id, band, held::INTEGER, 1, round(v0 * v0 / vn, 6) + 0.0, round(v0 * v1 / vn, 6) + 0.0, round(v1 * v1 / vn, 6) + 0.0 FROM en
    """,
)
def gj2_spatial_filters(spark, sf):
    """Filters of every fold; products of weights, as a filter's sign is arbitrary."""
    rows = decode.accepted(decode.trial_summaries(trials(spark, sf), BANDS), CANDIDATES)
    fitted = decode.fit_spatial_filters(decode.band_rows(decode.with_folds(rows, [(3, 7)])), [2])
    names = F.array(*[F.lit(f"{int(lo)}-{int(hi)}") for lo, hi in sorted(set(BANDS))])
    w = fitted.select(
        "subject_id", F.get(names, F.col("band")).alias("band"), "held", "filters", F.explode(F.array(F.lit(0), F.lit(1))).alias("component")
    )
    x, y = F.get("filters", F.col("component") * 2), F.get("filters", F.col("component") * 2 + 1)
    return w.select(
        "subject_id", "band", "held", "component",
        *[(F.round(v, 6) + 0.0).alias(n) for n, v in (("w00", x * x), ("w01", x * y), ("w11", y * y))],
    )


@query("gj4_evaluate_candidate", sweep_sql([(8.0, 30.0)], "'csp_lda'"))
def gj4_evaluate_candidate(spark, sf):
    one = [c for c in CANDIDATES if c.pipeline_id == "csp_lda-8-30"]
    return rounded(decode.evaluate(decode.summarise(trials(spark, sf), one), one))


@query("gj5_candidate_sweep", sweep_sql(sorted(set(BANDS)), "'bandpower_lda', 'csp_lda'"))
def gj5_candidate_sweep(spark, sf):
    return rounded(decode.evaluate(decode.summarise(trials(spark, sf), CANDIDATES), CANDIDATES))


@query(
    "gj6_fit_models",
    f"""
    WITH {TRIAL_SQL}, {decoding_sql.bands_cte(sorted(set(BANDS)))}, al AS (SELECT trial_id, 0 AS held, true AS is_train FROM t), {decoding_sql.predictions_ctes("ch", "al")}
    SELECT s.subject_id, s.family || '-' || s.band AS pipeline_id, x.cls AS class, round(g0, 6) AS center_0, round(g1, 6) AS center_1, round(d0, 6) AS scale_0, round(d1, 6) AS scale_1,
      round(w0 / d0, 5) + 0.0 AS weight_0, round(w1 / d1, 5) + 0.0 AS weight_1, round(b - w0 / d0 * g0 - w1 / d1 * g1, 5) + 0.0 AS bias
    FROM st s JOIN ws x ON s.subject_id = x.subject_id AND s.band = x.band AND s.family = x.family AND s.held = x.held
    """,
)
def gj6_fit_models(spark, sf):
    """Frozen models on all trials, one row per class."""
    models = decode.fit_models(decode.summarise(trials(spark, sf), CANDIDATES), CANDIDATES)
    each = models.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    k = F.col("k")
    return each.select(
        "subject_id",
        "pipeline_id",
        F.when(k == 0, F.col("class_0")).otherwise(F.col("class_1")).alias("class"),
        *[F.round(F.get(n, F.lit(i)), 6).alias(f"{n}_{i}") for n in ("center", "scale") for i in (0, 1)],
        *[(F.round(F.get("weights", k * 2 + i), 5) + 0.0).alias(f"weight_{i}") for i in (0, 1)],
        (F.round(F.get("bias", k), 5) + 0.0).alias("bias"),
    )


FROZEN_PAIRS_SQL = "fz AS (SELECT trial_id, 0 AS held, trial_id % 2 = 0 AS is_train FROM t)"
FROZEN_SQL = f"{FROZEN_PAIRS_SQL}, {decoding_sql.predictions_ctes('ch', 'fz', 'z_')}, fb AS (SELECT subject_id, family || '-' || band AS pipeline_id, label, said FROM z_pr)"


@query(
    "gj7_apply_frozen",
    f"""
    WITH {TRIAL_SQL}, {decoding_sql.bands_cte(sorted(set(BANDS)))}, {FROZEN_SQL}
    {decoding_sql.metrics_sql("fb", "subject_id, pipeline_id")}
    """,
)
def gj7_apply_frozen(spark, sf):
    summaries = decode.summarise(trials(spark, sf), CANDIDATES)
    models = materialise(decode.fit_models(summaries.where("session_id = 0"), CANDIDATES), "models")
    return rounded(decode.evaluate_frozen(models, summaries.where("session_id = 1"), BANDS)).drop("model_sha256")


ORDER_SQL = "[" + ", ".join(f"'{c.pipeline_id}'" for c in CANDIDATES) + "]"


@query(
    "gj11_confirmation",
    f"""
    WITH {TRIAL_SQL}, {decoding_sql.bands_cte(sorted(set(BANDS)))}, sr AS (SELECT * FROM ch WHERE trial_id % 2 = 0),
    fd AS (SELECT trial_id, ntile(3) OVER (PARTITION BY subject_id, label ORDER BY sha256('7:' || trial_id)) - 1 AS fold FROM sr), {PAIRS_SQL},
    {decoding_sql.predictions_ctes("sr", "te")}, {FROZEN_SQL},
    so AS (SELECT subject_id, family || '-' || band AS pipeline_id, label, said FROM pr),
    sm AS ({decoding_sql.metrics_sql("so", "subject_id, pipeline_id")}), fs AS ({decoding_sql.metrics_sql("fb", "subject_id, pipeline_id")}),
    be AS (SELECT subject_id, arg_max(pipeline_id, (balanced_accuracy, -list_position({ORDER_SQL}, pipeline_id))) AS pipeline_id, max(balanced_accuracy) AS search_score FROM sm GROUP BY 1)
    SELECT 'lock-' || subject_id AS lock_id, subject_id, pipeline_id, search_score, balanced_accuracy AS confirmation_score, round(balanced_accuracy - search_score, 6) + 0.0 AS confirmation_minus_search, 'completed_one_shot' AS status
    FROM be JOIN fs USING (subject_id, pipeline_id)
    """,
)
def gj11_confirmation(spark, sf):
    """Search on one session, lock the best, fit it, then score it once on the other.

    The held-out session is read only after models and access records are written.
    """
    rows = trials(spark, sf)
    search_rows = decode.summarise(rows.where("session_id = 0"), CANDIDATES)
    searched = rounded(decode.evaluate(search_rows, CANDIDATES).where("fold = -1"))
    order = F.array_position(F.array(*[F.lit(c.pipeline_id) for c in CANDIDATES]), F.col("pipeline_id"))
    best = search.arg_max(
        searched.withColumn("at", order), ["subject_id"], "pipeline_id", "balanced_accuracy", "at"
    )
    locks = materialise(
        best.select(
            F.concat_ws("-", F.lit("lock"), F.col("subject_id").cast("string")).alias("lock_id"),
            "subject_id",
            F.col("best_candidate").alias("pipeline_id"),
            F.col("best_score").alias("search_score"),
        ),
        "locks",
    )
    fitted = decode.fit_models(search_rows, CANDIDATES)
    models = materialise(
        fitted.join(locks.select("subject_id", "pipeline_id"), ["subject_id", "pipeline_id"], "left_semi"), "models"
    )
    earlier = locks.select("lock_id").where(F.lit(False))
    write_once(
        locks.join(models.select("subject_id", "model_sha256"), "subject_id").withColumn("status", F.lit("consumed")),
        shared_dir(spark, "confirmation-access"),
    )
    held_out = decode.summarise(rows.where("session_id = 1"), CANDIDATES)
    scored = decode.evaluate_frozen(models, held_out, BANDS)
    evaluated = scored.select("subject_id", "pipeline_id", F.col("balanced_accuracy").alias("score"))
    found = search.confirm(locks, evaluated, earlier)
    return found.withColumns(
        {
            "search_score": F.round("search_score", 9),
            "confirmation_score": F.round("confirmation_score", 9),
            "confirmation_minus_search": F.round("confirmation_minus_search", 6) + 0.0,
        }
    )


GUIDED_SQL = f"""
    {TRIAL_SQL}, ex AS (SELECT trial_id, subject_id, label, c.c AS ch, unnest(range(32)) AS i, unnest(CASE c.c WHEN 0 THEN x0 ELSE x1 END) AS v FROM ch, (VALUES (0), (1)) c(c)),
    ct AS (SELECT *, (v - avg(v) OVER (PARTITION BY trial_id, ch)) * (0.5 - 0.5 * cos(2 * pi() * i / 32)) AS z FROM ex),
    ft AS (SELECT trial_id, subject_id, label, ch, b.b AS bin, sum(z * cos(2 * pi() * b.b * i / 32)) AS re, sum(z * sin(2 * pi() * b.b * i / 32)) AS im FROM ct, (SELECT range AS b FROM range(2, 8)) b GROUP BY ALL),
    ps AS (SELECT *, 2 * (re * re + im * im) / (128.0 * (SELECT sum((0.5 - 0.5 * cos(2 * pi() * range / 32)) ** 2) FROM range(32))) AS p FROM ft),
    bd(band, lo, hi) AS (VALUES ('mu', 2, 3), ('beta', 4, 7)),
    bp AS (SELECT trial_id, subject_id, label, ch, band, ln((sum(p) - (sum(CASE WHEN bin IN (lo, hi) THEN p END)) / 2) * 4.0 + 1e-12) AS f FROM ps JOIN bd ON bin BETWEEN lo AND hi GROUP BY ALL),
    ms AS (SELECT subject_id, band, ch, label, avg(f) AS m, var_pop(f) AS v FROM bp GROUP BY ALL),
    ef AS (SELECT a.subject_id, a.band, a.ch, abs((b.m - a.m) / sqrt((a.v + b.v) / 2 + 1e-12)) AS e FROM ms a JOIN ms b ON a.subject_id = b.subject_id AND a.band = b.band AND a.ch = b.ch AND a.label = 'a' AND b.label = 'b'),
    sm AS (SELECT subject_id, band, quantile_cont(e, 0.5) AS med, max(e) AS mx FROM ef GROUP BY 1, 2),
    ch2 AS (SELECT m.subject_id, m.mx >= b.mx AS mu_first, CASE WHEN m.mx >= b.mx THEN m.med / m.mx ELSE b.med / b.mx END AS ratio FROM sm m JOIN sm b ON m.subject_id = b.subject_id AND m.band = 'mu' AND b.band = 'beta'),
    pl(pb, k) AS (VALUES (0, 'first'), (1, '8-30'), (2, '4-40'), (3, 'second'))
    SELECT subject_id, (2 * pb + j.j + 1)::INTEGER AS place, CASE WHEN (ratio >= 0.55) = (j.j = 0) THEN 'bandpower_lda-' ELSE 'csp_lda-' END || CASE k WHEN 'first' THEN CASE WHEN mu_first THEN '8-13' ELSE '13-30' END WHEN 'second' THEN CASE WHEN mu_first THEN '13-30' ELSE '8-13' END ELSE k END AS pipeline_id, round(ratio, 6) AS effect_ratio
    FROM ch2, pl, (VALUES (0), (1)) j(j)
"""


@query("gj10_guided_order", f"WITH {GUIDED_SQL}")
def gj10_guided_order(spark, sf):
    """Measured profile of each subject to its eight ranked candidates."""
    rows = (
        trials(spark, sf)
        .withColumn("session_id", F.lit(0))
        .withColumnRenamed("trial_id", "trial_idx")
    )
    epochs = signal.epochs_of_trials(rows)
    spectrum = signal.spectral_profile(epochs)
    peaks = spectrum.groupBy("subject_id").agg(
        F.max(F.when(F.col("measure") == "mu_peak", F.col("power"))).alias("mu_power"),
        F.max(F.when(F.col("measure") == "beta_peak", F.col("power"))).alias("beta_power"),
    )
    summary, _ = signal.class_separability(epochs)
    names = {"motor_8_30": "broad", "mu_8_13": "mu", "beta_13_30": "beta"}
    aggs = []
    for band, short in names.items():
        mine = F.col("band") == band
        aggs += [
            F.max(F.when(mine, F.col("median_abs_effect"))).alias(f"{short}_median"),
            F.max(F.when(mine, F.col("max_abs_effect"))).alias(f"{short}_max"),
        ]
    profiles = summary.groupBy("subject_id").agg(*aggs).join(peaks, "subject_id")
    prefs = search.guided_preferences(profiles)
    grid = profiles.select(
        "subject_id", F.explode(parameters.candidate_grid(F.lit(7))).alias("c")
    ).select("subject_id", "c.family", "c.low", "c.high", "c.pipeline_id")
    return prefs.join(grid, ["subject_id", "family", "low", "high"]).select(
        "subject_id", "place", "pipeline_id", F.round("effect_ratio", 6).alias("effect_ratio")
    )


# Trial summaries from events: users are subjects, and some break a rule of the executor.
SUMMARY_SQL = """
    t AS (SELECT user_id AS subject_id, CASE WHEN user_id % 11 = 3 OR event_id % 2 = 0 THEN 'a' ELSE 'b' END AS label, user_id % 23 <> 7 OR event_id % 5 <> 0 AS finite,
      CASE WHEN user_id % 13 = 4 AND event_id % 2 = 0 THEN 128.0 WHEN user_id % 17 = 5 THEN 20.0 ELSE 250.0 END AS sfreq, CASE WHEN user_id % 19 = 6 THEN 2 ELSE 8 END AS channels,
      CASE WHEN user_id % 7 = 2 THEN 10 ELSE 300 END AS width FROM events),
    l AS (SELECT subject_id, label, count(*) AS n FROM t GROUP BY 1, 2),
    c AS (SELECT subject_id, count(*) AS labels, min(n) AS fewest FROM l GROUP BY 1),
    f AS (SELECT subject_id, bool_and(finite) AS finite, min(sfreq) AS s0, max(sfreq) AS s1, min(channels) AS c0, max(channels) AS c1, min(width) AS w0, max(width) AS w1 FROM t GROUP BY 1)
"""


def event_summaries(spark, sf):
    user, event = F.col("user_id"), F.col("event_id")
    finite = (user % 23 != 7) | (event % 5 != 0)
    return table(spark, sf, "events").select(
        user.alias("subject_id"),
        F.when((user % 11 == 3) | (event % 2 == 0), "a").otherwise("b").alias("label"),
        F.when(finite, F.array(F.lit(1.0))).alias("covs"),
        F.when((user % 13 == 4) & (event % 2 == 0), 128.0).when(user % 17 == 5, 20.0).otherwise(250.0).alias("sfreq"),
        F.when(user % 19 == 6, 2).otherwise(8).alias("channels"),
        F.when(user % 7 == 2, 10).otherwise(300).alias("width"),
    )


@query(
    "gj4_refusals",
    f"""
    WITH {SUMMARY_SQL}
    SELECT subject_id, 'two_labels' AS rule_id FROM c WHERE labels <> 2
    UNION ALL SELECT subject_id, 'label_has_a_trial_per_fold' FROM c WHERE fewest < {max(c.cv_folds for c in CANDIDATES)}
    UNION ALL SELECT subject_id, 'samples_finite' FROM f WHERE NOT finite
    UNION ALL SELECT subject_id, 'one_signal_shape' FROM f WHERE s0 <> s1 OR c0 <> c1 OR w0 <> w1
    UNION ALL SELECT subject_id, 'band_below_nyquist' FROM f WHERE NOT s0 / 2 > {max(c.high for c in CANDIDATES)}
    UNION ALL SELECT subject_id, 'samples_cover_padding' FROM f WHERE NOT w0 > {kernels.PAD}
    UNION ALL SELECT subject_id, 'components_within_channels' FROM f WHERE c0 < {max(c.csp_components for c in CANDIDATES)}
    """,
)
def gj4_refusals(spark, sf):
    """Subjects no candidate is run for, with every reason."""
    return decode.decoding_faults(event_summaries(spark, sf), CANDIDATES)


@query(
    "gj7_refusals",
    f"""
    WITH {SUMMARY_SQL}, m AS (SELECT *, subject_id % 5 <> 0 AS known FROM f)
    SELECT subject_id, 'model_of_this_subject' AS rule_id FROM m WHERE NOT known
    UNION ALL SELECT subject_id, 'rate_matches_model' FROM m WHERE NOT known OR s0 <> 250 OR s1 <> 250
    UNION ALL SELECT subject_id, 'channels_match_model' FROM m WHERE NOT known OR c0 <> 8 OR c1 <> 8
    UNION ALL SELECT subject_id, 'samples_finite' FROM m WHERE NOT finite
    """,
)
def gj7_refusals(spark, sf):
    """Evaluation rows a frozen model is not applied to."""
    rows = event_summaries(spark, sf)
    models = (
        rows.where("subject_id % 5 <> 0")
        .select("subject_id", F.lit(250.0).alias("sfreq"), F.lit(8).alias("channels"))
        .distinct()
    )
    return decode.frozen_faults(models, rows)


MANIFOLD = [
    riemann.ManifoldCandidate(f"{family}-{metric}-{int(low)}-{int(high)}", family, low, high,
                              cv_folds=3, random_seed=7, metric=metric)
    for low, high in ((8.0, 13.0), (8.0, 30.0))
    for family in ("tangent_lda", "mdm")
    for metric in ("riemann", "logeuclid")
]


@query("dx7_manifold_sweep")
def dx7_manifold_sweep(spark, sf):
    """Tangent-space and nearest-mean candidates, all bands and both metrics, by fold.

    The means are iterated, which SQL does not state; tests compare them with numpy.
    """
    return rounded(riemann.evaluate(decode.summarise(trials(spark, sf), MANIFOLD), MANIFOLD))


@query("dx7_tangent_space")
def dx7_tangent_space(spark, sf):
    """Tangent vectors of all trials at the Karcher mean of each fold's training trials."""
    one = [c for c in MANIFOLD if c.pipeline_id == "tangent_lda-riemann-8-30"]
    rows = decode._prepared(decode.summarise(trials(spark, sf), one), one, [(3, 7)])
    covs = materialise(riemann.shrunk_covariances(rows), "positive-covariances")
    found = riemann.tangent_features(covs, riemann._training_rows(covs), "riemann")
    return found.select(
        "subject_id", "held", "fold", "trial_id",
        *[F.round(F.get("x", F.lit(k)), 6).alias(f"x{k}") for k in range(3)],
    )


LINEAR = [c for c in CANDIDATES if c.pipeline_id == "bandpower_lda-8-30"]


def log_variance_rows(spark, sf, splits):
    """Log variances of the 8-30 Hz band of every trial, with class and fold."""
    rows = decode._prepared(decode.summarise(trials(spark, sf), LINEAR), LINEAR, splits)
    x = decode.log_variances(F.col("cov"), F.col("channels"), F.col("width"))
    return rows.withColumn("x", x).drop("cov")


@query("dx7_linear_models")
def dx7_linear_models(spark, sf):
    """Logistic and margin classifiers on log variances: metrics per fold and pooled.

    Their minima are sought by iteration, which SQL does not state; tests check the
    gradients and compare held-out scores with numpy.
    """
    rows = log_variance_rows(spark, sf, [(3, 7)])
    features = materialise(
        rows.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(2)))), "features"
    )
    parts = []
    for loss in linear_models.LOSSES:
        said = linear_models.linear_predictions(features, ["subject_id"], loss, c=0.1)
        parts.append(said.withColumn("pipeline_id", F.lit(f"{loss}-8-30")))
    both = parts[0].unionByName(parts[1]).withColumn(
        "fold", F.explode(F.array(F.col("fold"), F.lit(-1)))
    )
    return rounded(
        decode.classification_metrics(both, ["subject_id", "pipeline_id", "fold"], "class", "predicted")
    )


@query("dx7_cross_session")
def dx7_cross_session(spark, sf):
    """Each session is decoded from the other by class means, as it is and recentred."""
    one = [c for c in MANIFOLD if c.pipeline_id == "mdm-riemann-8-30"]
    summaries = decode.summarise(trials(spark, sf), one)
    rows = decode.band_rows(decode.accepted(summaries, one)).select(
        "subject_id", "trial_id", "class", "channels", "width", F.lit(0).alias("split"),
        F.col("session_id").cast("int").alias("fold"), "band", "cov",
    )
    covs = materialise(riemann.shrunk_covariances(rows).where("cov is not null"), "session-covariances")
    aligned = materialise(adaptation.recentred(covs, ["subject_id", "band", "fold"]), "recentred")
    parts = []
    for name, held in (("plain", covs), ("recentred", aligned)):
        gaps = riemann.class_distances(held, riemann._training_rows(held), "riemann")
        best = gaps.groupBy("subject_id", "fold", "trial_id", "class").agg(
            F.min(F.struct("distance", "of_class")).alias("best")
        )
        parts.append(best.select(
            "subject_id", F.col("fold").alias("session_id"), F.lit(name).alias("alignment"),
            "class", F.col("best.of_class").alias("predicted"),
        ))
    return rounded(decode.classification_metrics(
        parts[0].unionByName(parts[1]), ["subject_id", "session_id", "alignment"], "class", "predicted"
    ))


@query(
    "dx7_coral_features",
    f"""
    WITH {TRIAL_SQL}, {decoding_sql.bands_cte([(8.0, 30.0)])},
    y AS (SELECT trial_id, subject_id, trial_id % 2 AS session, list_transform(mat, lambda w: list_dot_product(w, x0)) AS a, list_transform(mat, lambda w: list_dot_product(w, x1)) AS b FROM ch, fm),
    f AS (SELECT trial_id, subject_id, session, ln(list_var_pop(a) + 1e-12) AS u, ln(list_var_pop(b) + 1e-12) AS v FROM y),
    m AS (SELECT subject_id, session, avg(u) AS mu, avg(v) AS mv, var_pop(u) + 0.001 AS p, covar_pop(u, v) AS q, var_pop(v) + 0.001 AS r FROM f GROUP BY 1, 2),
    k AS (SELECT *, sqrt(p * r - q * q) AS d, sqrt(p + r + 2 * sqrt(p * r - q * q)) AS t FROM m),
    w AS (SELECT *, (p + d) / t AS sp, q / t AS sq, (r + d) / t AS sr FROM k),
    j AS (SELECT o.subject_id, o.session, o.mu, o.mv, g.mu AS gu, g.mv AS gv, o.sr / o.d AS ip, -o.sq / o.d AS iq, o.sp / o.d AS ir, g.sp, g.sq, g.sr FROM w o JOIN w g ON o.subject_id = g.subject_id AND g.session = 0),
    z AS (SELECT trial_id, f.session, gu, gv, sp, sq, sr, (u - mu) * ip + (v - mv) * iq AS e, (u - mu) * iq + (v - mv) * ir AS g FROM f JOIN j ON f.subject_id = j.subject_id AND f.session = j.session)
    SELECT trial_id, session::BIGINT AS session_id, round(e * sp + g * sq + gu, 5) + 0.0 AS x0, round(e * sq + g * sr + gv, 5) + 0.0 AS x1 FROM z
    """,
)
def dx7_coral_features(spark, sf):
    """Log variances of both sessions aligned to the first one's moments."""
    rows = log_variance_rows(spark, sf, []).join(
        trials(spark, sf).select("trial_id", F.col("session_id").cast("long").alias("session_id")), "trial_id"
    )
    held = materialise(rows.select("subject_id", "session_id", "trial_id", "x"), "session-features")
    moved = adaptation.coral(held, ["subject_id"], "session_id", 0)
    return moved.select(
        "trial_id", "session_id",
        *[(F.round(F.get("x", F.lit(k)), 5) + 0.0).alias(f"x{k}") for k in range(2)],
    )


BANK = [
    decode.Candidate(f"bank-{int(low)}", "csp_lda", low, low + 8.0, 2, 0.1, 3, 7)
    for low in (8.0, 16.0, 24.0, 32.0)
]


@query("dx7_filter_bank")
def dx7_filter_bank(spark, sf):
    """Four sub-bands, two filters each, of which each fold's training trials choose four.

    The filters of short trials are chained eigenproblems; tests compare the information
    and the choice with numpy and check that no held-out trial takes part.
    """
    said = filter_bank.bank_predictions(decode.summarise(trials(spark, sf), BANK), BANK, most=4)
    both = said.withColumn("fold", F.explode(F.array(F.col("fold"), F.lit(-1))))
    return rounded(decode.classification_metrics(both, ["subject_id", "fold"], "class", "predicted"))


@query(
    "dx7_feature_information",
    """
    WITH f AS (SELECT l_returnflag AS class, l_linestatus AS grp, unnest([l_quantity, l_discount, l_extendedprice]) AS v, unnest([0, 1, 2]) AS feature FROM lineitem),
    r AS (SELECT grp, feature, min(v) AS low, max(v) AS high FROM f GROUP BY 1, 2),
    c AS (SELECT grp, feature, class, least(floor((v - low) / (high - low) * 8), 7) AS bin, count(*) AS n FROM f JOIN r USING (grp, feature) GROUP BY 1, 2, 3, 4),
    t AS (SELECT grp, feature, n, sum(n) OVER (PARTITION BY grp, feature) AS total, sum(n) OVER (PARTITION BY grp, feature, bin) AS b, sum(n) OVER (PARTITION BY grp, feature, class) AS k FROM c)
    SELECT grp, feature, round(sum(n * ln(n * total / (b * k)) / total), 9) AS information FROM t GROUP BY 1, 2
    """,
)
def dx7_feature_information(spark, sf):
    """Information of three line values about the return flag, by line status."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("grp"), F.col("l_returnflag").alias("class"),
        F.array("l_quantity", "l_discount", "l_extendedprice").alias("x"),
    )
    found = filter_bank.mutual_information(rows, ["grp"], bins=8)
    return found.withColumn("information", F.round("information", 9) + 0.0)


@query(
    "dx7_eog_regression",
    f"""
    WITH {TRIAL_SQL}, e AS (SELECT trial_id, subject_id, unnest(range(32)) AS k, unnest(x0) AS x, unnest(x1) AS e FROM ch),
    c AS (SELECT *, x - avg(x) OVER (PARTITION BY trial_id) AS cx, e - avg(e) OVER (PARTITION BY trial_id) AS ce FROM e),
    w AS (SELECT subject_id, sum(cx * ce) / sum(ce * ce) AS w FROM c GROUP BY 1)
    SELECT trial_id, k::INTEGER AS sample, round(x - w * ce, 6) + 0.0 AS eeg, round(e, 6) + 0.0 AS eog FROM c JOIN w USING (subject_id)
    """,
)
def dx7_eog_regression(spark, sf):
    """The second channel taken as the eyes' and regressed out of the first."""
    rows = trials(spark, sf)
    weights = preparation.fit_eog(rows, ["subject_id"], [1])
    clean = preparation.remove_eog(rows, weights, ["subject_id"], [1])
    both = F.arrays_zip(
        F.slice("samples", 1, 32).alias("eeg"), F.slice("samples", 33, 32).alias("eog")
    )
    return clean.select("trial_id", F.posexplode(both).alias("sample", "v")).select(
        "trial_id", "sample",
        *[(F.round(F.col("v")[n], 6) + 0.0).alias(n) for n in ("eeg", "eog")],
    )


# Eight channels of eight samples per vector, on a line with a gap: place, and the weights of
# the two nearest others by inverse distance.
PLACES = (0.0, 1.0, 2.0, 4.0, 5.0, 7.0, 8.0, 9.0)


def _laplacian_sql() -> str:
    rows = []
    for c, at in enumerate(PLACES):
        near = sorted((abs(at - b), n) for n, b in enumerate(PLACES) if n != c)[:2]
        whole = sum(1 / gap for gap, _ in near)
        rows += [f"({c}, {n}, {1 / gap / whole!r}::DOUBLE)" for gap, n in near]
    return f"w(channel, neighbour, weight) AS (VALUES {', '.join(rows)})"


@query(
    "dx7_surface_laplacian",
    f"""
    WITH {_laplacian_sql()}, t AS (SELECT vec_id AS trial_idx, i // 8 AS channel_idx, i % 8 AS sample, v::DOUBLE AS v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings))
    SELECT a.trial_idx, a.channel_idx::INTEGER AS channel_idx, a.sample::INTEGER AS sample, round(any_value(a.v) - sum(weight * b.v), 7) + 0.0 AS value
    FROM t a JOIN w ON w.channel = a.channel_idx JOIN t b ON b.trial_idx = a.trial_idx AND b.channel_idx = w.neighbour AND b.sample = a.sample GROUP BY 1, 2, 3
    """,
)
def dx7_surface_laplacian(spark, sf):
    rows = trials(spark, sf).withColumn("channels", F.lit(8)).withColumnRenamed("trial_id", "trial_idx")
    epochs = signal.epochs_of_trials(rows).withColumn("montage", F.lit("line"))
    montage = spark.createDataFrame(
        [("line", c, at, 0.0, 0.0) for c, at in enumerate(PLACES)],
        "montage string, channel_idx int, x double, y double, z double",
    )
    weights = preparation.laplacian_weights(montage, ["montage"], "channel_idx", neighbours=2)
    done = preparation.surface_laplacian(epochs, weights, ["trial_idx"], "channel_idx", on=["montage"])
    return done.select("trial_idx", "channel_idx", F.posexplode("samples").alias("sample", "value")).withColumn(
        "value", F.round("value", 7) + 0.0
    )


def _taps_sql(up: int, down: int) -> str:
    taps = preparation.lowpass_taps(up, down)
    middle = len(taps) // 2
    return "h(off, tap) AS (VALUES " + ", ".join(
        f"({k - middle}, {t!r}::DOUBLE)" for k, t in enumerate(taps.tolist())
    ) + ")"


@query(
    "dx7_resampled_chunks",
    f"""
    WITH {_taps_sql(2, 3)}, t AS (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings),
    m AS (SELECT unnest(range(43)) AS m)
    SELECT vec_id AS recording, m::BIGINT AS sample, round(sum(tap * v), 7) + 0.0 AS value FROM m, t JOIN h ON h.off = m.m * 3 - t.k * 2 GROUP BY 1, 2
    """,
)
def dx7_resampled_chunks(spark, sf):
    """Vectors as recordings in chunks of 17 samples, resampled by two thirds."""
    x = F.col("embedding").cast("array<double>")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.slice(x, c * 17 + 1, 17))
    chunks = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("recording"), F.posexplode(pieces).alias("chunk", "samples")
    )
    done = preparation.resample_chunks(chunks, ["recording"], "chunk", 2, 3)
    first = F.ceil(F.col("chunk") * 17 * 2 / F.lit(3)).cast("long")
    return done.select("recording", first.alias("first"), F.posexplode("samples").alias("at", "value")).select(
        "recording", (F.col("first") + F.col("at")).alias("sample"), (F.round("value", 7) + 0.0).alias("value")
    )
