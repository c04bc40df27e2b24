"""Component registry rows and the rules about them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (id, category, requirements) of the default registry.
EEG = {"modalities_any": ["EEG"]}
DEFAULT_COMPONENTS = (
    ("reference_original", "referencing", EEG),
    ("reference_car", "referencing", {**EEG, "min_channels": 4}),
    ("reference_surface_laplacian", "referencing", {**EEG, "min_channels": 16, "requires_montage": True}),
    ("filter_bandpass", "temporal_filtering", EEG),
    ("filter_filterbank", "temporal_filtering", {**EEG, "paradigms": ["motor_imagery"]}),
    ("notch_powerline", "temporal_filtering", EEG),
    ("resample", "sampling", EEG),
    ("epoch_crop", "segmentation", EEG),
    ("bad_channel_robust", "quality_control", {**EEG, "min_channels": 4}),
    ("trial_quality_robust", "quality_control", EEG),
    ("artifact_eog_regression", "artifact_handling", {**EEG, "requires_eog": True}),
    ("ica_eeg_only", "artifact_handling", {**EEG, "min_channels": 16, "min_trials": 100}),
    ("feature_resting_iaf", "features", {**EEG, "requires_resting_state": True}),
    ("feature_xdawn", "features", {**EEG, "paradigms": ["erp"]}),
    ("feature_log_bandpower", "features", EEG),
    ("feature_csp", "features", {"paradigms": ["motor_imagery"], "binary_classes": True, "min_channels": 4}),
    ("feature_fbcsp", "features", {"paradigms": ["motor_imagery"], "binary_classes": True, "min_channels": 4, "min_trials": 100}),
    ("feature_covariance", "features", {**EEG, "min_channels": 4}),
    ("feature_covariance_tangent", "features", {**EEG, "min_channels": 4}),
    ("feature_time_frequency", "features", {**EEG, "min_trials": 100}),
    ("model_lda", "models", {"min_trials": 20}),
    ("model_logistic", "models", {"min_trials": 20}),
    ("model_linear_svm", "models", {"min_trials": 20}),
    ("model_kernel_svm", "models", {"min_trials": 100}),
    ("model_tree_ensemble", "models", {"min_trials": 100}),
    ("model_shallow_convnet", "models", {**EEG, "min_trials": 300}),
    ("model_mdm", "models", {**EEG, "min_channels": 4}),
    ("model_eegnet", "models", {**EEG, "min_trials": 300}),
    ("adapt_none", "session_adaptation", {}),
    ("adapt_covariance_recenter", "session_adaptation", {**EEG, "multiple_sessions": True}),
    ("adapt_coral", "session_adaptation", {"multiple_sessions": True, "min_trials": 100}),
)
# Components whose requirements wait for a downstream decision.
DEFERRED_COMPONENTS = (
    "bad_channel_robust",
    "trial_quality_robust",
    "ica_eeg_only",
    "model_tree_ensemble",
    "model_shallow_convnet",
    "model_eegnet",
    "adapt_coral",
)
# Keys every registry entry carries.
REQUIRED_KEYS = (
    "id",
    "category",
    "family",
    "description",
    "maturity",
    "cost_tier",
    "requirements",
    "parameters",
)
#: Columns of a registry as a table.
FLAGS = ("binary_classes", "multiple_sessions", "requires_montage", "requires_eog", "requires_resting_state")
TABLE = (
    "id string, category string, modalities_any array<string>, paradigms array<string>, "
    "min_channels int, min_trials int, " + ", ".join(f"{f} boolean" for f in FLAGS) + ", deferred boolean"
)


def default_components() -> list[dict]:
    return [{"id": i, "category": c, "requirements": dict(r)} for i, c, r in DEFAULT_COMPONENTS]


def component_table(spark: SparkSession, entries: Sequence[dict], deferred: Sequence[str] = ()) -> DataFrame:
    """Registry entries of a program as a table."""
    rows = []
    for entry in entries:
        req = entry.get("requirements") or {}
        rows.append((
            entry["id"], entry["category"], req.get("modalities_any", []), req.get("paradigms", []),
            int(req.get("min_channels", 0)), int(req.get("min_trials", 0)),
            *[bool(req.get(f, False)) for f in FLAGS], entry["id"] in deferred,
        ))
    return spark.createDataFrame(rows, TABLE)


def read_components(spark: SparkSession, path: str, deferred: Sequence[str] = ()) -> DataFrame:
    """A registry file of any size as a table; missing requirements bind nothing."""
    req = (
        "struct<modalities_any: array<string>, paradigms: array<string>, min_channels: int, "
        "min_trials: int, " + ", ".join(f"{f}: boolean" for f in FLAGS) + ">"
    )
    schema = f"components array<struct<id: string, category: string, requirements: {req}>>"
    found = spark.read.schema(schema).option("multiLine", True).json(path)
    c = found.select(F.inline("components"))
    none = F.array().cast("array<string>")
    texts = [F.coalesce(f"requirements.{t}", none).alias(t) for t in ("modalities_any", "paradigms")]
    numbers = [F.coalesce(f"requirements.{n}", F.lit(0)).alias(n) for n in ("min_channels", "min_trials")]
    flags = [F.coalesce(f"requirements.{f}", F.lit(False)).alias(f) for f in FLAGS]
    late = F.col("id").isin(*deferred) if deferred else F.lit(False)
    return c.select("id", "category", *texts, *numbers, *flags, late.alias("deferred"))
