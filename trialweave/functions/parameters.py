"""Parameter values and query texts bound to a dataset profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Resampling rates offered beside the native one, and their floor.
STANDARD_RATES = (256.0, 128.0, 100.0)
LOWEST_RATE = 100.0
# Window starts after the bound's start, and window lengths (seconds).
WINDOW_STARTS = (0.0, 0.5, 1.0)
WINDOW_LENGTHS = (1.0, 2.0, 3.0, 4.0)


def legal_resample_rates(sfreq: Column) -> Column:
    """Native and standard rates not above the native one, highest first."""
    offered = F.array_distinct(F.array(sfreq, *[F.lit(r) for r in STANDARD_RATES]))
    legal = F.filter(offered, lambda r: (r <= sfreq) & (r >= LOWEST_RATE))
    return F.sort_array(legal, asc=False)


def legal_windows(start: Column, stop: Column) -> Column:
    """Sorted (start, stop) windows that lie inside the bound."""
    grid = [
        F.struct(
            F.round(start + s, 6).alias("start"), F.round(start + s + n, 6).alias("stop")
        )
        for s in WINDOW_STARTS
        for n in WINDOW_LENGTHS
    ]
    return F.array_sort(
        F.array_distinct(F.filter(F.array(*grid), lambda w: w["stop"] <= stop))
    )


# The finite candidate grid.
BANDS = ((4.0, 40.0), (8.0, 13.0), (8.0, 30.0), (13.0, 30.0))
FAMILIES = ("bandpower_lda", "csp_lda")


def candidate_grid(seed: Column, components: int = 4, shrinkage: float = 0.1, folds: int = 3) -> Column:
    """Array of candidate structs, bands outermost; explode it next to any table.

    The grid has a fixed eight entries, so it is a literal of the plan and no join.
    """
    entries = []
    for low, high in BANDS:
        for family in FAMILIES:
            spatial = family == "csp_lda"
            entries.append(
                F.struct(
                    F.lit(f"{family}-{int(low)}-{int(high)}").alias("pipeline_id"),
                    F.lit(family).alias("family"),
                    F.lit(low).alias("low"),
                    F.lit(high).alias("high"),
                    F.lit("csp" if spatial else "none").alias("spatial_filter"),
                    F.lit(components if spatial else 0).alias("csp_components"),
                    F.lit("csp_log_variance" if spatial else "log_bandpower").alias("feature"),
                    F.lit("shrinkage_lda").alias("model"),
                    F.lit(shrinkage).alias("lda_shrinkage"),
                    F.lit(folds).alias("cv_folds"),
                    seed.cast("long").alias("random_seed"),
                )
            )
    return F.array(*entries)


# Literature queries derived from a profile.  {c} is paradigm and
# modalities; sessions says when the query applies.
QUERY_TEMPLATES = (
    ("paradigm_method_landscape", "{c} decoding systematic review analysis pipeline methods", "any"),
    ("cross_session_nonstationarity", "{c} longitudinal multi-session nonstationarity session drift domain adaptation", "many"),
    ("individual_motor_rhythms", "{c} subject-specific neural signature frequency spatial channel feature selection", "any"),
    ("artifact_without_auxiliary_eog", "{c} artifact removal {e} robust trial quality", "any"),
    ("adaptive_bci_learning", "{c} repeated session learning adaptive decoder calibration transfer", "many"),
    ("data_efficient_representation", "{c} self-supervised pretraining meta-learning transfer learning data efficient decoding", "any"),
    ("test_time_adaptation", "{c} test-time adaptation source-free domain adaptation cross-session", "many"),
    ("riemannian_alignment", "{c} covariance geometry alignment recentering transfer learning session", "any"),
    ("automated_pipeline_discovery", "{c} AutoML automated pipeline selection agent scientific discovery reproducible", "any"),
    ("uncertainty_and_explainability", "{c} uncertainty calibration explainable decoding reliability subject-specific", "any"),
    ("within_session_nonstationarity", "{c} within-session nonstationarity robust decoding calibration drift", "single"),
    ("calibration_efficient_decoding", "{c} calibration-efficient few-shot subject-specific decoding", "single"),
)
EOG_ABSENT = "without EOG"
EOG_PRESENT = "with auxiliary channels"


def literature_queries(profiles: DataFrame) -> DataFrame:
    """One row per profile and applicable query template.

    Needs dataset_id, family, modalities (array), sessions_per_subject and
    eog_channel_count.  Templates are plan literals exploded per profile.
    """
    context = F.concat_ws(
        " ",
        F.replace(F.col("family"), F.lit("_"), F.lit(" ")),
        F.array_join(F.coalesce("modalities", F.array(F.lit("biosignal"))), " "),
    )
    aux = F.when(F.col("eog_channel_count") > 0, EOG_PRESENT).otherwise(EOG_ABSENT)
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("query_id"), F.lit(t).alias("template"), F.lit(s).alias("sessions"))
            for i, t, s in QUERY_TEMPLATES
        ]
    )
    many = F.col("sessions_per_subject") >= 2
    applies = (
        (F.col("q.sessions") == "any")
        | ((F.col("q.sessions") == "many") & many)
        | ((F.col("q.sessions") == "single") & ~many)
    )
    text = F.replace(F.replace(F.col("q.template"), F.lit("{c}"), context), F.lit("{e}"), aux)
    return (
        profiles.withColumn("q", F.explode(rows))
        .where(applies)
        .select("dataset_id", F.col("q.query_id").alias("query_id"), text.alias("text"))
    )
