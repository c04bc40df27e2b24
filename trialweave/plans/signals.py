"""Signal measurement over the embedding table (AG11-AG19, WN6, WN10, TK2).

Each vector of 64 numbers is one trial of four channels with 16 samples at 64 Hz; three
sessions; the label's parity is the class.  Every vector takes part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.operators import inventory, signal
from trialweave.operators.ordered import block_slice
from trialweave.operators.quantiles import exact_quantiles, robust_z
from trialweave.plans.registry import query, table
from trialweave.session import materialise

TRIAL_SQL = """
    t AS (SELECT vec_id AS trial_idx, vec_id % 3 AS session_id, 'c' || label % 2 AS label, list_transform(embedding, lambda x: x::DOUBLE) AS s FROM embeddings),
    ep AS (SELECT trial_idx, session_id, label, c.c AS channel_idx, s[c.c * 16 + 1 : c.c * 16 + 16] AS x FROM t, (VALUES (0), (1), (2), (3)) c(c))
"""


def trials(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.lit("s1").alias("subject_id"),
        (F.col("vec_id") % 3).alias("session_id"),
        F.col("vec_id").alias("trial_idx"),
        F.concat(F.lit("c"), (F.col("label") % 2).cast("string")).alias("label"),
        F.lit(64.0).alias("sfreq"),
        F.lit(4).alias("channels"),
        F.col("embedding").cast("array<double>").alias("samples"),
    )


def epochs(spark, sf):
    return signal.epochs_of_trials(trials(spark, sf))


def spoilt(spark, sf):
    """Epochs with some missing, infinite and constant samples planted."""
    trial, channel = F.col("trial_idx"), F.col("channel_idx")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return epochs(spark, sf).withColumn(
        "samples",
        F.transform(
            "samples",
            lambda x, i: F.when((trial % 50 == 0) & (i == 3), nan)
            .when((trial % 70 == 0) & (i == 5), inf)
            .when((channel == 2) & (F.col("session_id") == 1), F.lit(0.25))
            .otherwise(x),
        ),
    )


SPOILT_SQL = f"""
    {TRIAL_SQL}, e0 AS (SELECT trial_idx, session_id, label, channel_idx, unnest(x) AS v, unnest(range(16)) AS i FROM ep),
    e AS (SELECT trial_idx, session_id, label, channel_idx, i, CASE WHEN trial_idx % 50 = 0 AND i = 3 THEN 'nan'::DOUBLE WHEN trial_idx % 70 = 0 AND i = 5 THEN 'inf'::DOUBLE WHEN channel_idx = 2 AND session_id = 1 THEN 0.25 ELSE v END AS v FROM e0)
"""


@query(
    "ag11_array_checks",
    f"""
    WITH {SPOILT_SQL}, c AS (SELECT trial_idx % 20 AS run, channel_idx, bool_and(NOT isnan(v) AND NOT isinf(v)) AS f, max(v) AS hi, min(v) AS lo FROM e GROUP BY 1, 2)
    SELECT run, bool_and(f) AS all_finite, count_if(hi - lo = 0)::BIGINT AS flat_channel_count FROM c GROUP BY 1
    """,
)
def ag11_array_checks(spark, sf):
    rows = spoilt(spark, sf).withColumn("run", F.col("trial_idx") % 20)
    return inventory.array_checks(rows, ["run"], "channel_idx", "samples")


QUALITY_SQL = f"""
    {TRIAL_SQL}, e0 AS (SELECT trial_idx, session_id, label, channel_idx, unnest(x) AS v, unnest(range(16)) AS i FROM ep),
    e AS (SELECT trial_idx, session_id, channel_idx, i, CASE WHEN trial_idx % 50 = 0 AND i = 3 THEN NULL WHEN channel_idx = 2 AND session_id = 1 THEN 0.25 WHEN trial_idx % 41 = 0 THEN v * 1e6 ELSE v END AS v FROM e0),
    cs AS (SELECT session_id, channel_idx, stddev_pop(v) AS std FROM e GROUP BY 1, 2),
    cq AS (SELECT session_id, quantile_cont(std, 0.5) AS med, quantile_cont(std, 0.75) - quantile_cont(std, 0.25) AS iqr, quantile_cont(ln(std + 1e-12), 0.5) AS lm FROM cs GROUP BY 1),
    cm AS (SELECT session_id, quantile_cont(abs(ln(std + 1e-12) - lm), 0.5) AS mad FROM cs JOIN cq USING (session_id) GROUP BY 1),
    cf AS (SELECT cs.*, std <= greatest(2.220446049250313e-16, med * 1e-4) AS flat, CASE WHEN 1.4826 * mad <= 2.220446049250313e-16 THEN false ELSE abs((ln(std + 1e-12) - lm) / (1.4826 * mad)) > 6 END AS outlier FROM cs JOIN cq USING (session_id) JOIN cm USING (session_id)),
    tp AS (SELECT session_id, trial_idx, max(abs(v)) AS peak FROM e GROUP BY 1, 2),
    tm AS (SELECT session_id, quantile_cont(ln(peak + 1e-12), 0.5) AS lm FROM tp GROUP BY 1),
    td AS (SELECT session_id, quantile_cont(abs(ln(peak + 1e-12) - lm), 0.5) AS mad FROM tp JOIN tm USING (session_id) GROUP BY 1),
    tf AS (SELECT tp.*, abs((ln(peak + 1e-12) - lm) / (1.4826 * mad)) > 6 AS outlier FROM tp JOIN tm USING (session_id) JOIN td USING (session_id))
"""


def loud(spark, sf):
    """Epochs with missing samples, a constant channel and a few loud trials."""
    trial, channel = F.col("trial_idx"), F.col("channel_idx")
    return epochs(spark, sf).withColumn(
        "samples",
        F.transform(
            "samples",
            lambda x, i: F.when((trial % 50 == 0) & (i == 3), F.lit(float("nan")))
            .when((channel == 2) & (F.col("session_id") == 1), F.lit(0.25))
            .when(trial % 41 == 0, x * 1e6)
            .otherwise(x),
        ),
    )


@query(
    "ag12_signal_quality",
    f"""
    WITH {QUALITY_SQL}, b AS (SELECT session_id, count(v) / count(*) AS ff FROM e GROUP BY 1), c AS (SELECT session_id, count(*) AS n, count_if(flat) AS fl, count_if(outlier) AS o FROM cf GROUP BY 1), tt AS (SELECT session_id, count(*) AS n, count_if(outlier) AS o FROM tf GROUP BY 1)
    SELECT session_id, round(ff, 9) AS finite_fraction, 16 AS sample_count, c.n::BIGINT AS channel_count, round(med, 6) AS channel_std_median, round(iqr, 6) AS channel_std_iqr, fl::BIGINT AS flat_channels, c.o::BIGINT AS outlier_channels, tt.n::BIGINT AS trial_count, tt.o::BIGINT AS outlier_trials
    FROM b JOIN c USING (session_id) JOIN tt USING (session_id) JOIN cq USING (session_id)
    """,
)
def ag12_signal_quality(spark, sf):
    q = signal.signal_quality(loud(spark, sf)).drop("subject_id")
    return q.withColumns(
        {
            "finite_fraction": F.round("finite_fraction", 9),
            "channel_std_median": F.round("channel_std_median", 6),
            "channel_std_iqr": F.round("channel_std_iqr", 6),
        }
    )


@query(
    "ag12_trial_flags",
    f"WITH {QUALITY_SQL} SELECT session_id, trial_idx, round(peak, 6) AS peak, outlier FROM tf",
)
def ag12_trial_flags(spark, sf):
    flags = signal.trial_flags(materialise(signal.sample_moments(loud(spark, sf)), "sample-moments"))
    return flags.select("session_id", "trial_idx", F.round("peak", 6).alias("peak"), "outlier")


@query(
    "ag12_group_quantiles",
    """
    SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75 FROM lineitem GROUP BY 1, 2
    """,
)
def ag12_group_quantiles(spark, sf):
    """Six groups share all lines; a coarse sketch leaves wide brackets to count."""
    return exact_quantiles(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice",
        {"median": 0.5, "q25": 0.25, "q75": 0.75}, accuracy=200,
    ).withColumns({c: F.round(c, 6) for c in ("median", "q25", "q75")})


@query(
    "ag13_robust_z",
    """
    WITH s AS (SELECT l_suppkey, l_returnflag, stddev_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), m AS (SELECT l_returnflag, quantile_cont(v, 0.5) AS m FROM s GROUP BY 1),
    d AS (SELECT l_returnflag, quantile_cont(abs(v - m), 0.5) AS mad FROM s JOIN m USING (l_returnflag) GROUP BY 1)
    SELECT l_suppkey, l_returnflag, round(CASE WHEN 1.4826 * mad <= 2.220446049250313e-16 THEN 0 ELSE (v - m) / (1.4826 * mad) END, 6) AS z FROM s JOIN m USING (l_returnflag) JOIN d USING (l_returnflag)
    """,
)
def ag13_robust_z(spark, sf):
    spread = materialise(
        table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.stddev_pop("l_extendedprice").alias("v")),
        "spread",
    )
    scored = robust_z(spread, ["l_returnflag"], "v", "z")
    return scored.select("l_suppkey", "l_returnflag", F.round("z", 6).alias("z"))


# Welch with one segment of 16 samples: periodic Hann, density, one-sided.
PSD_SQL = f"""
    {TRIAL_SQL}, w AS (SELECT range AS i, 0.5 - 0.5 * cos(2 * pi() * range / 16) AS w FROM range(16)),
    dm AS (SELECT trial_idx, session_id, label, channel_idx, x, list_avg(x) AS m FROM ep),
    sm AS (SELECT trial_idx, session_id, label, channel_idx, unnest(range(16)) AS i, unnest(x) - m AS v FROM dm),
    k AS (SELECT range AS bin FROM range(9)),
    ft AS (SELECT trial_idx, session_id, label, channel_idx, bin, sum(v * w * cos(2 * pi() * bin * sm.i / 16)) AS re, sum(v * w * sin(2 * pi() * bin * sm.i / 16)) AS im FROM sm JOIN w ON w.i = sm.i, k GROUP BY ALL),
    psd AS (SELECT trial_idx, session_id, label, channel_idx, bin, bin * 4.0 AS hz, (re * re + im * im) / (64.0 * (SELECT sum(w * w) FROM w)) * CASE WHEN bin IN (0, 8) THEN 1 ELSE 2 END AS p FROM ft)
"""


@query(
    "ag14_power_density",
    f"WITH {PSD_SQL} SELECT trial_idx, channel_idx, bin::INTEGER AS bin, round(p, 12) AS power FROM psd",
)
def ag14_power_density(spark, sf):
    rows = signal.power_density(epochs(spark, sf)).select(
        "trial_idx", "channel_idx", F.posexplode("psd").alias("bin", "power")
    )
    return rows.withColumn("power", F.round("power", 12) + 0.0)


BAND_SQL = """
    bd(band, lo, hi) AS (VALUES ('theta_4_8', 4, 8), ('mu_8_13', 8, 13), ('beta_13_30', 13, 30), ('motor_8_30', 8, 30)),
    tz AS (SELECT trial_idx, session_id, label, channel_idx, band, (p + lag(p) OVER (PARTITION BY trial_idx, channel_idx, band ORDER BY bin)) / 2 * 4.0 AS a FROM psd JOIN bd ON hz >= lo AND hz <= hi),
    bp AS (SELECT trial_idx, session_id, label, channel_idx, band, sum(a) AS power FROM tz GROUP BY ALL)
"""


@query(
    "ag15_band_power",
    f"WITH {PSD_SQL}, {BAND_SQL} SELECT trial_idx, channel_idx, band, round(power, 11) AS power FROM bp",
)
def ag15_band_power(spark, sf):
    dens = signal.power_density(epochs(spark, sf))
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("band"), signal.band_power(F.col("psd"), F.col("bin_hz"), lo, hi).alias("power"))
                for n, (lo, hi) in signal.BANDS.items()
            ]
        )
    )
    return dens.select("trial_idx", "channel_idx", rows.alias("r")).select(
        "trial_idx", "channel_idx", "r.band", F.round("r.power", 11).alias("power")
    )


@query(
    "wn10_adjacent_bins",
    f"""
    WITH {PSD_SQL}, s AS (SELECT session_id, bin, avg(p) AS p FROM psd GROUP BY 1, 2), ar AS (SELECT session_id, bin, (p + lag(p) OVER (PARTITION BY session_id ORDER BY bin)) / 2 * 4.0 AS area FROM s)
    SELECT session_id, bin::INTEGER AS bin, round(area, 11) AS area FROM ar
    """,
)
def wn10_adjacent_bins(spark, sf):
    """Trapezoid between neighbouring bins of the mean spectrum; a session has as many
    rows as bins."""
    spectrum = signal.mean_spectrum(signal.power_density(epochs(spark, sf)))
    return signal.adjacent_areas(spectrum).select(
        "session_id", "bin", F.round("area", 11).alias("area")
    )


@query(
    "ag16_spectral_profile",
    f"""
    WITH {PSD_SQL}, s AS (SELECT session_id, hz, avg(p) AS p FROM psd GROUP BY 1, 2),
    bd(band, lo, hi) AS (VALUES ('theta_4_8', 4, 8), ('mu_8_13', 8, 13), ('beta_13_30', 13, 30), ('motor_8_30', 8, 30), ('total', 1, 45)),
    tz AS (SELECT session_id, band, (p + lag(p) OVER (PARTITION BY session_id, band ORDER BY hz)) / 2 * 4.0 AS a FROM s JOIN bd ON hz >= lo AND hz <= hi),
    bp AS (SELECT session_id, band, sum(a) AS power FROM tz GROUP BY 1, 2),
    pk(peak, lo, hi) AS (VALUES ('mu_peak', 7, 15), ('beta_peak', 15, 30))
    SELECT b.session_id, b.band AS measure, NULL::DOUBLE AS hz, round(b.power, 11) AS power, round(b.power / t.power, 9) AS relative FROM bp b JOIN bp t ON t.session_id = b.session_id AND t.band = 'total' WHERE b.band <> 'total'
    UNION ALL SELECT session_id, peak, arg_max(hz, (p, -hz))::DOUBLE, round(max(p), 11), NULL FROM s JOIN pk ON hz >= lo AND hz <= hi GROUP BY 1, 2
    """,
)
def ag16_spectral_profile(spark, sf):
    rows = signal.spectral_profile(epochs(spark, sf)).drop("subject_id")
    return rows.withColumns({"power": F.round("power", 11), "relative": F.round("relative", 9)})


EFFECT_SQL = f"""
    {PSD_SQL}, {BAND_SQL}, ft2 AS (SELECT *, ln(power + 1e-12) AS f FROM bp WHERE band <> 'theta_4_8'),
    ms AS (SELECT session_id, band, channel_idx, label, avg(f) AS m, var_pop(f) AS v FROM ft2 GROUP BY ALL),
    ef AS (SELECT l.session_id, l.band, l.channel_idx, (r.m - l.m) / sqrt((l.v + r.v) / 2 + 1e-12) AS effect FROM ms l JOIN ms r ON l.session_id = r.session_id AND l.band = r.band AND l.channel_idx = r.channel_idx AND l.label = 'c0' AND r.label = 'c1')
"""


@query(
    "ag17_band_effects",
    f"WITH {EFFECT_SQL} SELECT session_id, band, channel_idx, round(effect, 6) AS effect FROM ef",
)
def ag17_band_effects(spark, sf):
    bands = {n: b for n, b in signal.BANDS.items() if n != "theta_4_8"}
    features = signal.log_band_features(signal.power_density(epochs(spark, sf)), bands)
    effects = signal.class_effects(features, ["session_id", "band"], "channel_idx", "label", "feature")
    return effects.select("session_id", "band", "channel_idx", F.round("effect", 6).alias("effect"))


@query(
    "ag18_separability",
    f"WITH {EFFECT_SQL} SELECT session_id, band, round(quantile_cont(abs(effect), 0.5), 6) AS median_abs_effect, round(max(abs(effect)), 6) AS max_abs_effect FROM ef GROUP BY 1, 2",
)
def ag18_separability(spark, sf):
    summary, _ = signal.class_separability(epochs(spark, sf))
    return summary.select(
        "session_id", "band", F.round("median_abs_effect", 6).alias("median_abs_effect"), F.round("max_abs_effect", 6).alias("max_abs_effect")
    )


# The event table as features: the day's user groups are channels, engaged events
# against all others are the classes.
EVENT_EFFECT_SQL = """
    f AS (SELECT year(ts) * 100 + month(ts) AS session_id, user_id AS channel, CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 'engaged' ELSE 'other' END AS label, ln(value + 1e-12) AS x FROM events),
    m AS (SELECT session_id, channel, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM f GROUP BY ALL),
    ef AS (SELECT l.session_id, l.channel, l.n AS left_n, r.n AS right_n, (r.m - l.m) / sqrt((l.v + r.v) / 2 + 1e-12) AS effect FROM m l JOIN m r ON l.session_id = r.session_id AND l.channel = r.channel AND l.label = 'engaged' AND r.label = 'other')
"""


def event_effects(spark, sf):
    features = table(spark, sf, "events").select(
        (F.year("ts") * 100 + F.month("ts")).cast("long").alias("session_id"),
        F.col("user_id").alias("channel"),
        F.when(F.col("event_type").isin("click", "purchase", "signup"), "engaged").otherwise("other").alias("label"),
        F.log(F.col("value") + 1e-12).alias("x"),
    )
    return signal.class_effects(features, ["session_id"], "channel", "label", "x")


@query(
    "ag17_class_effect",
    f"WITH {EVENT_EFFECT_SQL} SELECT session_id, channel, left_n::BIGINT AS left_n, right_n::BIGINT AS right_n, round(effect, 6) AS effect FROM ef",
)
def ag17_class_effect(spark, sf):
    return event_effects(spark, sf).select("session_id", "channel", "left_n", "right_n", F.round("effect", 6).alias("effect"))


@query(
    "tk2_top_effects",
    f"WITH {EVENT_EFFECT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY abs(effect) DESC, channel) AS place FROM ef) SELECT session_id, channel, place::INTEGER AS place, round(effect, 6) AS effect FROM r WHERE place <= 10",
)
def tk2_top_effects(spark, sf):
    top = signal.top_effects(event_effects(spark, sf), ["session_id"], "channel", 10)
    return top.select("session_id", "channel", "place", F.round("effect", 6).alias("effect"))


MOTOR_SQL = f"""
    {PSD_SQL}, {BAND_SQL}, g AS (SELECT trial_idx, session_id, label, channel_idx, ln(power + 1e-12) AS f FROM bp WHERE band = 'motor_8_30')
"""


def motor_features(spark, sf):
    return signal.written_features(epochs(spark, sf), {"motor_8_30": signal.BANDS["motor_8_30"]})


@query(
    "wn6_alternate_halves",
    f"WITH {TRIAL_SQL} SELECT session_id, trial_idx, label, ((row_number() OVER (PARTITION BY session_id, label ORDER BY trial_idx) - 1) % 2)::BIGINT AS half FROM t",
)
def wn6_alternate_halves(spark, sf):
    rows = trials(spark, sf).select("subject_id", "session_id", "trial_idx", "label")
    return signal.alternate_halves(rows, block_slice("trial_idx")).select("session_id", "trial_idx", "label", "half")


@query(
    "ag19_split_half",
    f"""
    WITH {MOTOR_SQL}, h AS (SELECT trial_idx, session_id, label, (row_number() OVER (PARTITION BY session_id, label ORDER BY trial_idx) - 1) % 2 AS half FROM t),
    m AS (SELECT g.session_id, half, channel_idx, g.label, avg(f) AS m, var_pop(f) AS v FROM g JOIN h USING (trial_idx) GROUP BY ALL),
    ef AS (SELECT l.session_id, l.half, l.channel_idx, (r.m - l.m) / sqrt((l.v + r.v) / 2 + 1e-12) AS effect FROM m l JOIN m r ON l.session_id = r.session_id AND l.half = r.half AND l.channel_idx = r.channel_idx AND l.label = 'c0' AND r.label = 'c1')
    SELECT a.session_id, round(corr(a.effect, b.effect), 6) AS correlation FROM ef a JOIN ef b ON a.session_id = b.session_id AND a.channel_idx = b.channel_idx AND a.half = 0 AND b.half = 1 GROUP BY 1
    """,
)
def ag19_split_half(spark, sf):
    found = signal.split_half_stability(motor_features(spark, sf), block_slice("trial_idx"))
    return found.select("session_id", F.round("correlation", 6).alias("correlation"))


@query(
    "ag19_session_pairs",
    f"""
    WITH {MOTOR_SQL}, m AS (SELECT session_id, channel_idx, label, avg(f) AS m, var_pop(f) AS v FROM g GROUP BY ALL), lv AS (SELECT session_id, channel_idx, avg(f) AS level FROM g GROUP BY ALL),
    ef AS (SELECT l.session_id, l.channel_idx, level, (r.m - l.m) / sqrt((l.v + r.v) / 2 + 1e-12) AS effect FROM m l JOIN m r ON l.session_id = r.session_id AND l.channel_idx = r.channel_idx AND l.label = 'c0' AND r.label = 'c1' JOIN lv ON lv.session_id = l.session_id AND lv.channel_idx = l.channel_idx)
    SELECT a.session_id AS left_session, b.session_id AS right_session, round(corr(a.effect, b.effect), 6) AS correlation, round(sqrt(avg((a.level - b.level) ** 2)), 9) AS rms_shift FROM ef a JOIN ef b ON a.channel_idx = b.channel_idx AND a.session_id < b.session_id GROUP BY 1, 2
    """,
)
def ag19_session_pairs(spark, sf):
    pairs = signal.session_pair_stability(motor_features(spark, sf))
    return pairs.select(
        "left_session", "right_session", F.round("correlation", 6).alias("correlation"), F.round("rms_shift", 9).alias("rms_shift")
    )
