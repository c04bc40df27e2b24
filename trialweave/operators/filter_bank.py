"""Filter bank: spatial features of many sub-bands, selected by mutual information."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.operators import decode
from trialweave.session import materialise

KEYS = ["subject_id", "split"]


def bank_features(covs: DataFrame, components: int) -> DataFrame:
    """Every trial once per held-out fold with ``x``: the log variance shares of all bands.

    Filters of each band are fitted on the folds that are not held out.  ``covs`` has
    subject_id, split, fold, trial_id, class, band, channels and cov.
    """
    filters = materialise(decode.fit_spatial_filters(covs, [components]), "bank-filters")
    spatial = decode.spatial_features(covs, filters, ["subject_id", "band", "split"])
    per_trial = spatial.groupBy(*KEYS, "held", "fold", "trial_id", "class").agg(
        F.array_sort(F.collect_list(F.struct("band", "x"))).alias("__bands")  # one per band
    )
    return per_trial.select(
        *KEYS, "held", "fold", "trial_id", "class",
        F.flatten(F.transform("__bands", lambda b: b["x"])).alias("x"),
    )


def mutual_information(features: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """(keys, feature, information): of each feature with the class, in nats.

    ``features`` has an array ``x`` and ``class``; give training rows only.  A feature is
    cut into ``bins`` equal bins of its own range; rows are counted map-side, so a group is
    ``bins`` x classes rows per feature whatever its number of trials.
    """
    keys = list(keys)
    each = features.select(*keys, "class", F.posexplode("x").alias("feature", "v"))
    place = [*keys, "feature"]
    ranges = each.groupBy(*place).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    part = (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))
    bin_ = F.when(
        F.col("high") > F.col("low"), F.least(F.floor(part * bins), F.lit(bins - 1))
    ).otherwise(0)
    cells = each.join(ranges, place).groupBy(*place, bin_.alias("bin"), "class").agg(
        F.count(F.lit(1)).alias("n")
    )
    total = lambda *by: F.sum("n").over(Window.partitionBy(*place, *by))
    share = F.col("n") * F.log(F.col("n") * total() / (total("bin") * total("class")))
    return (
        cells.select(*place, (share / total()).alias("term"))
        .groupBy(*place)
        # Rounded, so that the order of adding does not break ties between features.
        .agg(F.round(F.sum("term"), 12).alias("information"))
    )


def selected_features(features: DataFrame, keys: Sequence[str], most: int, bins: int = 10) -> DataFrame:
    """(keys, chosen): places of the ``most`` most informative features, in order; of equals
    the first.  Only rows whose fold is not held out are read."""
    found = mutual_information(features.where("fold <> held"), keys, bins)
    best = Window.partitionBy(*keys).orderBy(F.desc("information"), "feature")
    return (
        found.withColumn("__place", F.row_number().over(best)).where(F.col("__place") <= most)
        .groupBy(*keys).agg(F.array_sort(F.collect_list("feature")).alias("chosen"))
    )


def bank_predictions(
    summaries: DataFrame,
    candidates: Sequence[decode.Candidate],
    most: int = 4,
    bins: int = 10,
) -> DataFrame:
    """Out-of-fold predictions of a shrinkage discriminant on the chosen features.

    ``candidates`` are one csp candidate per sub-band with equal folds, seed, components and
    shrinkage.  (subject_id, fold, trial_id, class, predicted)
    """
    first = candidates[0]
    same = {(c.cv_folds, c.random_seed, c.csp_components, c.lda_shrinkage) for c in candidates}
    if len(same) != 1 or not first.spatial:
        raise ValueError("the bands of a filter bank share their settings")
    covs = decode._prepared(summaries, candidates, decode._splits(candidates))
    features = materialise(bank_features(covs, first.csp_components), "bank-features")
    chosen = selected_features(features, [*KEYS, "held"], most, bins)
    x = F.transform("chosen", lambda i: F.get("x", i))
    kept = materialise(
        features.join(chosen, [*KEYS, "held"]).withColumn("x", x).drop("chosen"), "chosen-features"
    )
    learnt = kept.where("fold <> held").drop("fold").withColumnRenamed("held", "fold")
    moments = decode.class_moments(learnt, KEYS).withColumn("shrinkage", F.lit(float(first.lda_shrinkage)))
    models = decode.fit_classifier(moments, KEYS, holdout=False).select(*KEYS, "fold", "weights", "bias")
    said = decode.predicted_class(F.col("x"), F.col("weights"), F.col("bias"))
    return kept.where("fold = held").join(models, [*KEYS, "fold"]).select(
        "subject_id", "fold", "trial_id", "class", said.alias("predicted")
    )
