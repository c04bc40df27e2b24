"""Validity rules of candidates, profiles, sidecars, policies and evidence rows."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.functions.parameters import BANDS, FAMILIES
from trialweave.operators.checks import Rule, violations

def has_text(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def implied(condition: Column, ok: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False)) | F.coalesce(ok, F.lit(False))


# --- candidates -----------------------------------------------------------------

# What the executor can run.
EXECUTABLE_COMPONENTS = (2, 4, 6)
EXECUTABLE_SHRINKAGES = (0.0, 0.1, 0.3, 0.5)
EXECUTABLE_FOLDS = (3, 4, 5)


def spec_rules() -> list[Rule]:
    """Rules one candidate row must meet."""
    power = F.col("family") == "bandpower_lda"
    csp = F.col("family") == "csp_lda"
    plain = (F.col("spatial_filter") == "none") & (F.col("feature") == "log_bandpower")
    spatial = (F.col("spatial_filter") == "csp") & (F.col("feature") == "csp_log_variance")
    even = (F.col("csp_components") >= 2) & (F.col("csp_components") % 2 == 0)
    return [
        ("pipeline_id_present", has_text(F.col("pipeline_id"))),
        ("family_known", F.col("family").isin(*FAMILIES)),
        ("band_ordered", (F.col("low") > 0) & (F.col("low") < F.col("high"))),
        ("bandpower_parts", implied(power, plain)),
        ("csp_parts", implied(csp, spatial)),
        ("csp_components_even", implied(csp, even)),
        ("model_known", F.col("model") == "shrinkage_lda"),
        ("shrinkage_in_unit_interval", F.col("lda_shrinkage").between(0, 1)),
        ("folds_at_least_two", F.col("cv_folds") >= 2),
        ("seed_not_negative", F.col("random_seed") >= 0),
    ]


def capability_rules() -> list[Rule]:
    """Membership of a candidate row in the executable sets, which are literals."""
    bands = [(F.col("low") == low) & (F.col("high") == high) for low, high in BANDS]
    in_band = bands[0] | bands[1] | bands[2] | bands[3]
    csp = F.col("family") == "csp_lda"
    return [
        ("family_executable", F.col("family").isin(*FAMILIES)),
        ("band_executable", in_band),
        ("components_executable", implied(csp, F.col("csp_components").isin(*EXECUTABLE_COMPONENTS))),
        ("shrinkage_executable", F.col("lda_shrinkage").isin(*EXECUTABLE_SHRINKAGES)),
        ("folds_executable", F.col("cv_folds").isin(*EXECUTABLE_FOLDS)),
    ]


# --- dataset profiles -----------------------------------------------------------


def profile_rules() -> list[Rule]:
    """Machine contract of a dataset profile row (nested columns)."""
    labels = F.transform("paradigm.actions", lambda a: F.trim(a["label"]))
    unique = F.size(F.array_distinct(labels)) == F.size(labels)
    window = F.col("events.common_analysis_window_s")
    indices = F.col("sessions.session_indices")

    def text_list(c: Column) -> Column:
        return c.isNotNull() & F.forall(c, lambda x: x.isNotNull())

    return [
        ("schema_version", F.col("schema_version") == "1.0"),
        ("dataset_id", has_text(F.col("dataset.id"))),
        ("paradigm_family", has_text(F.col("paradigm.family"))),
        ("actions_present", F.size("paradigm.actions") > 0),
        ("action_labels_present", F.forall(labels, lambda v: F.coalesce(v != "", F.lit(False)))),
        ("action_labels_unique", unique),
        ("channels_positive", F.col("signal.channel_count") > 0),
        ("sampling_frequency_positive", F.col("signal.sampling_frequency_hz") > 0),
        ("trials_positive", F.col("volume.trials") > 0),
        ("window_ordered", (F.size(window) == 2) & (F.get(window, F.lit(0)) < F.get(window, F.lit(1)))),
        ("sessions_positive", F.col("sessions.sessions_per_subject") > 0),
        ("session_indices_unique", (F.size(indices) > 0) & (F.size(F.array_distinct(indices)) == F.size(indices))),
        ("constraints_allowed", text_list(F.col("constraints.allowed"))),
        ("constraints_forbidden", text_list(F.col("constraints.forbidden"))),
        ("design_decisions", text_list(F.col("constraints.requires_research_design_decision"))),
        ("evidence_present", F.size("evidence") > 0),
        ("evidence_sources", F.forall("evidence", lambda e: F.coalesce(F.trim(e["source"]) != "", F.lit(False)))),
    ]


# --- semantic sidecars ----------------------------------------------------------

# Sidecar kinds and the axes of an epoch array.
SIDECAR_KINDS = ("mne_raw", "declarative", "mat_epochs")
EPOCH_AXES = ("channel", "sample", "trial")


def sidecar_rules() -> list[Rule]:
    """Rules over parsed sidecars; rules of one kind hold for the other kinds."""
    kind = F.col("adapter_kind")
    raw, declared, epochs = (kind == k for k in SIDECAR_KINDS)
    axes = F.col("axis_order")
    axes_unique = F.size(F.array_distinct(axes)) == F.size(axes)
    named_axes = F.size(F.array_intersect(axes, F.array(F.lit("channel"), F.lit("sample")))) == 2
    exact_axes = F.array_sort(axes) == F.array(*[F.lit(a) for a in EPOCH_AXES])
    names = F.col("channel_names")
    names_ok = (
        (F.size(names) > 0)
        & (F.size(F.array_distinct(names)) == F.size(names))
        & F.forall(names, lambda n: F.trim(n) != "")
    )
    codes_present = F.coalesce(F.size(F.map_keys("event_code_mapping")) > 0, F.lit(False))
    globs = F.col("source_globs")
    return [
        ("schema_version", F.col("schema_version") == "1.0"),
        ("adapter_kind", kind.isin(*SIDECAR_KINDS)),
        ("source_globs", (F.size(globs) > 0) & F.forall(globs, lambda g: F.trim(g) != "")),
        ("event_mapping", codes_present),
        ("raw_subject_regex", implied(raw, _names_group("subject_regex", "subject"))),
        ("raw_session_regex", implied(raw & F.col("session_regex").isNotNull(), _names_group("session_regex", "session"))),
        ("declared_axes", implied(declared, (F.size(axes) >= 2) & axes_unique & named_axes)),
        ("declared_signal", implied(declared, has_text(F.col("signal_key")))),
        ("declared_roles", implied(declared, has_text(F.col("data_role_policy")))),
        ("epoch_axes", implied(epochs, exact_axes)),
        ("epoch_subject_regex", implied(epochs, _names_group("subject_regex", "subject"))),
        ("epoch_session_regex", implied(epochs, _names_group("session_regex", "session"))),
        ("epoch_run_assertion", implied(epochs & F.col("run_assertion_regex").isNotNull(), F.col("run_regex").isNotNull())),
        ("epoch_sampling_frequency", implied(epochs, F.col("sampling_frequency_hz") > 0)),
        ("epoch_channel_names", implied(epochs, names_ok)),
        ("epoch_texts", implied(
            epochs,
            has_text(F.col("signal_key")) & has_text(F.col("label_key"))
            & has_text(F.col("channel_units")) & has_text(F.col("data_role_policy")),
        )),
        ("epoch_dataset_id", implied(epochs, has_text(F.col("hint_dataset_id")))),
        ("epoch_family", implied(epochs, has_text(F.col("hint_family")))),
    ]


def _names_group(pattern: str, group: str) -> Column:
    return F.coalesce(F.contains(F.col(pattern), F.lit(f"(?P<{group}>")), F.lit(False))


# --- policies and protocols -----------------------------------------------------

# Registered metrics, tests, predicate operators and actions.
METRICS = ("accuracy", "balanced_accuracy", "cohen_kappa", "macro_f1", "roc_auc")
STATISTICAL_TESTS = ("paired_permutation", "wilcoxon_signed_rank")
ALTERNATIVES = ("two_sided", "greater", "less")
CORRECTIONS = ("none", "holm")
AGGREGATION_UNITS = ("subject", "subject_session")
REDUCERS = ("macro_mean", "median")
MISSING_POLICIES = ("fail_closed", "complete_case_with_audit")
INTERVALS = ("bootstrap_percentile", "bootstrap_bca")
MINIMUM_RESAMPLES = 999
QUALITY_OPERATORS = ("eq", "gt", "gte", "lt", "lte", "in", "is_unknown")
QUALITY_ACTIONS = ("retain_and_flag", "logical_exclude", "fail_stage")


def quality_rule_rules(exclusions_allowed: Column) -> list[Rule]:
    """Rules over single quality rules (one row each)."""
    return [
        ("rule_id_present", has_text(F.col("rule_id"))),
        ("operator_known", F.col("operator").isin(*QUALITY_OPERATORS)),
        ("field_present", has_text(F.col("field"))),
        ("action_known", F.col("action").isin(*QUALITY_ACTIONS)),
        ("exclusion_authorised", implied(F.col("action") == "logical_exclude", exclusions_allowed)),
        ("reason_present", has_text(F.col("reason_code"))),
        ("evidence_present", F.size(F.filter("evidence_refs", lambda r: F.trim(r) != "")) > 0),
    ]


def quality_policy_violations(policies: DataFrame, rules: DataFrame) -> DataFrame:
    """(policy_id, subject, rule_id) over policies and their rules.

    ``policies`` has the policy columns, ``rules`` one row per quality rule with its
    ``policy_id``.  A policy without rules and a repeated rule id are found by counts.
    """
    heads = violations(
        policies,
        ["policy_id"],
        [
            ("policy_version", F.col("policy_version") == "1.0"),
            ("unknown_metadata_blocks", F.col("unknown_metadata_action") == "block_dependent_operation"),
            ("default_retains", F.col("default_action") == "retain_and_flag"),
            ("exclusions_audited", F.col("exclusions_require_audit_record")),
        ],
    ).select("policy_id", F.lit("policy").alias("subject"), "rule_id")
    joined = rules.join(policies.select("policy_id", "logical_exclusions_allowed"), "policy_id")
    single = violations(
        joined.withColumn("__rule", F.coalesce("rule_id", F.lit(""))),
        ["policy_id", F.col("__rule").alias("subject")],
        quality_rule_rules(F.col("logical_exclusions_allowed")),
    )
    empty = policies.join(rules, "policy_id", "left_anti").select(
        "policy_id", F.lit("policy").alias("subject"), F.lit("rules_present").alias("rule_id")
    )
    repeated = (
        rules.where(has_text(F.col("rule_id")))
        .groupBy("policy_id", "rule_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("policy_id", F.col("rule_id").alias("subject"), F.lit("rule_id_unique").alias("rule_id"))
    )
    return heads.unionByName(single).unionByName(empty).unionByName(repeated)


@dataclass(frozen=True)
class QualityRule:
    """When ``field`` meets ``operator`` and ``value``, ``action`` is taken."""

    rule_id: str
    field: str
    operator: str
    value: object
    action: str
    reason_code: str

    def met(self) -> Column:
        """A missing field meets ``is_unknown`` only."""
        column = F.col(self.field)
        tests = {
            "eq": lambda: column == F.lit(self.value),
            "gt": lambda: column > F.lit(self.value),
            "gte": lambda: column >= F.lit(self.value),
            "lt": lambda: column < F.lit(self.value),
            "lte": lambda: column <= F.lit(self.value),
            "in": lambda: column.isin(*self.value),
            "is_unknown": column.isNull,
        }
        return F.coalesce(tests[self.operator](), F.lit(False))


def apply_quality_policy(
    rows: DataFrame, entity: Sequence[str], policy: Sequence[QualityRule], exclusions_allowed: bool
) -> tuple[DataFrame, DataFrame]:
    """Rows kept with their ``quality_flags``, and the audit of every rule that was met.

    Rows are kept and flagged unless a rule excludes them and exclusions are allowed; the
    audit (entity..., rule_id, reason_code, action) names each excluded row and each
    ``fail_stage`` too, which ``checks.require_empty`` may turn into a refusal.  One narrow
    pass gives each side.
    """
    met = F.filter(
        F.array(
            *[
                F.when(
                    r.met(),
                    F.struct(
                        F.lit(r.rule_id).alias("rule_id"),
                        F.lit(r.reason_code).alias("reason_code"),
                        F.lit(r.action).alias("action"),
                    ),
                )
                for r in policy
            ]
        ),
        lambda m: m.isNotNull(),
    )
    marked = rows.withColumn("__met", met)
    out = F.exists("__met", lambda m: m["action"] == "logical_exclude") & F.lit(exclusions_allowed)
    kept = marked.where(~out).withColumn(
        "quality_flags", F.transform("__met", lambda m: m["rule_id"])
    )
    audit = marked.select(*entity, F.explode("__met").alias("m")).select(*entity, "m.*")
    return kept.drop("__met"), audit


def evaluation_rules() -> list[Rule]:
    """Metric, aggregation and interval rules of one protocol row."""
    secondary = F.col("secondary_metrics")
    return [
        ("primary_metric", F.col("primary_metric").isin(*METRICS)),
        ("secondary_metrics", F.forall(secondary, lambda m: m.isin(*METRICS) & (m != F.col("primary_metric")))),
        ("secondary_unique", F.size(F.array_distinct(secondary)) == F.size(secondary)),
        ("aggregation_unit", F.col("aggregation_unit").isin(*AGGREGATION_UNITS)),
        ("aggregation_reducer", F.col("aggregation_reducer").isin(*REDUCERS)),
        ("missing_policy", F.col("missing_value_policy").isin(*MISSING_POLICIES)),
        ("minimum_units", F.col("minimum_evaluable_units") >= 2),
        ("interval_method", F.col("interval_method").isin(*INTERVALS)),
        ("interval_level", (F.col("interval_level") > 0) & (F.col("interval_level") < 1)),
        ("interval_resamples", F.col("interval_resamples") >= MINIMUM_RESAMPLES),
        ("interval_seed", F.col("interval_seed").isNotNull()),
    ]


def analysis_rules() -> list[Rule]:
    """Rules over single statistical analyses (one row each)."""
    return [
        ("analysis_id_present", has_text(F.col("analysis_id"))),
        ("test_known", F.col("test_id").isin(*STATISTICAL_TESTS)),
        ("alternative_known", F.col("alternative").isin(*ALTERNATIVES)),
        ("alpha_in_interval", (F.col("alpha") > 0) & (F.col("alpha") < 1)),
        ("permutations_enough", F.col("permutations") >= MINIMUM_RESAMPLES),
        ("seed_present", F.col("random_seed").isNotNull()),
        ("correction_known", F.col("correction").isin(*CORRECTIONS)),
        ("family_present", has_text(F.col("family_id"))),
    ]


def stopping_rules() -> list[Rule]:
    return [
        ("stopping_version", F.col("stopping_version") == "1.0"),
        ("stop_on_budget", F.col("stop_on_budget_exhaustion")),
        ("stop_on_universe", F.col("stop_on_candidate_universe_exhaustion")),
        ("plateau_declared", F.col("plateau_enabled").isNotNull()),
        ("plateau_minimum", F.col("plateau_minimum_candidates") >= 1),
        ("plateau_patience", F.col("plateau_patience") >= 1),
        ("plateau_improvement", F.col("plateau_minimum_improvement") >= 0),
    ]


def threshold_rules() -> list[Rule]:
    unit = [
        (f"{name}_in_unit_interval", F.col(name).between(0, 1))
        for name in (
            "chance_level",
            "minimum_confirmation_score",
            "maximum_search_to_confirmation_drop",
        )
    ]
    return [
        *unit,
        ("confirmation_above_chance", F.col("minimum_confirmation_score") > F.col("chance_level")),
        ("distinct_candidates", F.col("minimum_distinct_search_candidates") >= 2),
        ("units_shared", (F.col("decision_minimum_units") >= 2) & (F.col("decision_minimum_units") == F.col("minimum_evaluable_units"))),
        ("success_needs_all", F.col("success_requires_all_thresholds")),
        ("below_chance_refuses", F.col("below_chance_outcome") == "refuse"),
        ("otherwise_inconclusive", F.col("otherwise_outcome") == "inconclusive"),
        ("failure_refuses", F.col("confirmation_failure_outcome") == "refuse"),
    ]


def protocol_violations(protocols: DataFrame, analyses: DataFrame) -> DataFrame:
    """(protocol_id, subject, rule_id): protocol rules and per-analysis rules."""
    heads = violations(
        protocols, ["protocol_id"], [*evaluation_rules(), *stopping_rules(), *threshold_rules()]
    ).select("protocol_id", F.lit("protocol").alias("subject"), "rule_id")
    single = violations(
        analyses.withColumn("subject", F.coalesce("analysis_id", F.lit(""))),
        ["protocol_id", "subject"],
        analysis_rules(),
    )
    none = protocols.join(analyses, "protocol_id", "left_anti").select(
        "protocol_id", F.lit("protocol").alias("subject"), F.lit("analyses_present").alias("rule_id")
    )
    repeated = (
        analyses.where(has_text(F.col("analysis_id")))
        .groupBy("protocol_id", "analysis_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("protocol_id", F.col("analysis_id").alias("subject"), F.lit("analysis_id_unique").alias("rule_id"))
    )
    return heads.unionByName(single).unionByName(none).unionByName(repeated)


# --- JSON conformance -----------------------------------------------------------

# Variant type names accepted per schema type.  Booleans have their
# own variant type, so they never pass as numbers.
VARIANT_TYPES = {
    "string": r"^STRING$",
    "integer": r"^BIGINT$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": r"^BOOLEAN$",
    "array": r"^ARRAY",
    "object": r"^OBJECT",
    "null": r"^VOID$",
}


def conformance_faults(value: Column, schema: dict, location: str = "value") -> Column:
    """Array of (location, fault) structs of a variant against a schema.

    The walk runs over the schema, not the data: it writes one expression, and rows
    are checked where they are.  Absent values must be sent as null.
    """
    loc = F.lit(location)
    return _faults(value, schema, loc)


def _fault(condition: Column, location: Column, fault: Column | str) -> Column:
    text = F.lit(fault) if isinstance(fault, str) else fault
    return F.when(condition, F.struct(location.alias("location"), text.alias("fault")))


def _faults(value: Column, schema: dict, location: Column) -> Column:
    parts: list[Column] = []
    own: list[Column] = []
    present = value.isNotNull()
    if "type" in schema:
        matches = F.schema_of_variant(value).rlike(VARIANT_TYPES[schema["type"]])
        own.append(_fault(present & ~matches, location, f"not_{schema['type']}"))
    if "enum" in schema:
        allowed = [str(v) for v in schema["enum"]]
        text = F.try_variant_get(value, "$", "string")
        own.append(_fault(present & ~F.coalesce(text.isin(*allowed), F.lit(False)), location, "not_in_enum"))
    members = F.try_variant_get(value, "$", "map<string,variant>")
    for name in schema.get("required", ()):
        gone = members.isNotNull() & ~F.map_contains_key(members, F.lit(name))
        own.append(_fault(gone, location, f"missing_{name}"))
    if own:
        parts.append(F.filter(F.array(*own), lambda x: x.isNotNull()))
    if schema.get("additionalProperties") is False:
        known = F.array(*[F.lit(k) for k in schema.get("properties", {})]).cast("array<string>")
        unknown = F.array_except(F.map_keys(members), known)
        parts.append(
            F.coalesce(
                F.transform(unknown, lambda k: F.struct(location.alias("location"), F.concat(F.lit("unknown_"), k).alias("fault"))),
                EMPTY_FAULTS(),
            )
        )
    for name, nested in schema.get("properties", {}).items():
        child = F.try_variant_get(value, f"$.{name}", "variant")
        parts.append(_faults(child, nested, F.concat(location, F.lit(f".{name}"))))
    if "items" in schema:
        items = F.try_variant_get(value, "$", "array<variant>")
        each = F.transform(
            items,
            lambda x, i: _faults(
                x, schema["items"], F.concat(location, F.lit("["), i.cast("string"), F.lit("]"))
            ),
        )
        parts.append(F.coalesce(F.flatten(each), EMPTY_FAULTS()))
    return F.concat(*parts) if parts else EMPTY_FAULTS()


def EMPTY_FAULTS() -> Column:  # noqa: N802 - a typed constant that needs a session
    return F.array().cast("array<struct<location:string,fault:string>>")


# --- redaction ------------------------------------------------------------------

# Credential-shaped keys (dash and underscore alike) and the mask.
CREDENTIAL_KEYS = ("api_key", "apikey", "authorization", "access_token", "secret", "password")
MASK = "<redacted>"


def redact_map(payload: Column) -> Column:
    def masked(key: Column, value: Column) -> Column:
        hit = F.replace(F.lower(key), F.lit("-"), F.lit("_")).isin(*CREDENTIAL_KEYS)
        return F.when(hit, F.lit(MASK)).otherwise(value)

    return F.transform_values(payload, masked)


def redact_json(payload: Column) -> Column:
    """Mask credential values at any depth of JSON text.

    Scalar values are masked by one pattern in the JVM.  Rows whose credential key
    holds an object or array go through the JSON parser in an Arrow batch; where their text
    is no JSON it is masked whole.
    """
    names = "|".join(k.replace("_", "[-_]") for k in CREDENTIAL_KEYS)
    key = rf'(?i)("(?:{names})"\s*:\s*)'
    scalar = rf'{key}("(?:[^"\\]|\\.)*"|[^\s,\[\]{{}}"]+)'
    masked = F.regexp_replace(payload, scalar, rf'$1"{MASK}"')
    nested = payload.rlike(rf"{key}[\[{{]")

    @F.pandas_udf("string")
    def parsed(batch: pd.Series) -> pd.Series:
        return batch.map(_redact_text, na_action="ignore")

    return F.coalesce(parsed(F.when(nested, payload)), masked)


def _redact_text(text: str) -> str:
    def walk(v):
        if isinstance(v, dict):
            return {
                k: MASK if k.lower().replace("-", "_") in CREDENTIAL_KEYS else walk(x)
                for k, x in v.items()
            }
        return [walk(x) for x in v] if isinstance(v, list) else v

    try:
        return json.dumps(walk(json.loads(text)), ensure_ascii=False)
    except ValueError:  # broken JSON that names a credential: nothing of it is shown
        return json.dumps(MASK)


# --- leaf catalogue -------------------------------------------------------------


def leaf_catalogue(profiles: DataFrame, entity: Sequence[str], roots: Sequence[str]) -> DataFrame:
    """(entity..., path, value) per leaf; value as JSON text.

    Structs are walked by schema, maps by their entries.  Empty maps are leaves.
    """
    leaves: list[Column] = []

    def as_json(c: Column) -> Column:
        wrapped = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        # {"v":<value>} without its wrapper; the closing brace goes in leaf().
        return F.substring(wrapped, 6, 1 << 30)

    def leaf(path: Column, c: Column) -> Column:
        text = as_json(c)
        return F.struct(path.alias("path"), F.substring(text, F.lit(1), F.length(text) - 1).alias("value"))

    def visit(path: str, c: Column, dtype: T.DataType) -> None:
        if isinstance(dtype, T.StructType) and len(dtype):
            for field in dtype.fields:
                visit(f"{path}.{field.name}", c[field.name], field.dataType)
        elif isinstance(dtype, T.MapType):
            entries = F.transform(
                F.map_entries(c),
                lambda e: leaf(F.concat(F.lit(f"{path}."), e["key"]), e["value"]),
            )
            empty = F.coalesce(F.size(c), F.lit(0)) <= 0
            leaves.append(F.when(empty, F.array(leaf(F.lit(path), c))).otherwise(entries))
        else:
            leaves.append(F.array(leaf(F.lit(path), c)))

    for root in roots:
        visit(root, F.col(root), profiles.schema[root].dataType)
    return profiles.select(*entity, F.explode(F.flatten(F.array(*leaves))).alias("leaf")).select(
        *entity, "leaf.path", "leaf.value"
    )


# --- references, probes, roles --------------------------------------------------

# Documents an evidence reference may point into.
EVIDENCE_PREFIXES = (
    "subject_profile",
    "pipeline_lock",
    "pipeline_lock_critique",
    "confirmation_result",
    "frozen_protocol",
    "autonomy_envelope",
    "deterministic_decision",
)


def valid_reference(ref: Column) -> Column:
    return F.coalesce(ref.rlike(rf"(?s)^({'|'.join(EVIDENCE_PREFIXES)})#.+"), F.lit(False))


def invalid_references(claims: DataFrame, entity: Sequence[str], refs: str) -> DataFrame:
    """One row per malformed reference; claims without any reference give a null."""
    listed = claims.select(*entity, F.explode_outer(refs).alias("ref"))
    return listed.where(F.col("ref").isNull() | ~valid_reference(F.col("ref")))


# Fixed value: confidence gap below which two adapters tie.
AMBIGUITY_GAP = 0.05


def probe_decision(probes: DataFrame, keys: Sequence[str], recognised: str) -> DataFrame:
    """Selected adapter and status per dataset.

    ``probes``: keys, adapter_id, confidence, and ``recognised`` (any known format).
    The best two are kept by combined aggregates instead of sorting the group.
    """
    viable = F.col("confidence") > 0
    best = probes.groupBy(*keys).agg(
        F.max(F.when(viable, F.col("confidence"))).alias("top"),
        F.bool_or(recognised).alias("recognised"),
        F.count_if(viable).alias("viable"),
    )
    at_top = (
        probes.where(viable)
        .join(best.select(*keys, "top"), keys)
        .groupBy(*keys)
        .agg(
            F.min(F.when(F.col("confidence") == F.col("top"), F.col("adapter_id"))).alias("chosen"),
            F.count_if(F.col("confidence") == F.col("top")).alias("ties"),
            F.max(F.when(F.col("confidence") < F.col("top"), F.col("confidence"))).alias("next"),
        )
    )
    second = F.when(F.col("ties") > 1, F.col("top")).otherwise(F.col("next"))
    ambiguous = F.coalesce(F.col("top") - second < AMBIGUITY_GAP, F.lit(False))
    return (
        best.join(at_top, keys, "left")
        .withColumn(
            "status",
            F.when(ambiguous, "adapter_ambiguous_requires_review")
            .when(F.col("chosen").isNotNull(), "adapter_selected")
            .when(F.col("recognised"), "recognized_format_requires_semantic_mapping")
            .otherwise("unsupported_requires_new_adapter"),
        )
        .select(*keys, F.when(~ambiguous, F.col("chosen")).alias("selected_adapter"), "status", "viable")
    )


def authorised(rows: DataFrame, roles: DataFrame, role: str, unit: Sequence[str]) -> DataFrame:
    """Rows of units the role may read."""
    return rows.join(roles.where(F.col("role") == role), list(unit), "left_semi")


def unauthorised(requested: DataFrame, roles: DataFrame, role: str, unit: Sequence[str]) -> DataFrame:
    """Requested units outside the role; must be empty."""
    return (
        requested.select(*unit)
        .distinct()
        .join(roles.where(F.col("role") == role), list(unit), "left_anti")
    )


# --- component applicability ----------------------------------------------------


#: Registry entries that stand together in one row while they are matched.
REGISTRY_BLOCK = 256


def applicability(profiles: DataFrame, components: DataFrame) -> DataFrame:
    """Verdict of every registry component for every profile row.

    ``components`` is a registry table of any size (``functions.components``).  Every pair is
    a row of the result, so the registry is packed into blocks, each profile is sent once
    per block, and the pairs unfold where they meet; Catalyst broadcasts a small registry.
    Needs family, n_actions, modalities, channel_count, trials, sessions_per_subject,
    montage_verified, placement_scheme, eog_channel_count and rest_present.
    """
    count = max(1, -(-components.count() // REGISTRY_BLOCK))
    place = F.pmod(F.xxhash64("id"), F.lit(count).cast("long"))
    blocks = components.groupBy(place.alias("__block")).agg(
        F.collect_list(F.struct(*components.columns)).alias("__entries")
    )
    spread = profiles.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    req = F.col("component")
    montage = F.coalesce(
        F.col("montage_verified"), has_text(F.col("placement_scheme"))
    )
    tests = [
        ("required signal modality is unavailable", (F.size(req["modalities_any"]) > 0) & ~F.arrays_overlap("modalities", req["modalities_any"])),
        ("component does not support the detected paradigm", (F.size(req["paradigms"]) > 0) & ~F.array_contains(req["paradigms"], F.col("family"))),
        ("insufficient channel count", F.col("channel_count") < req["min_channels"]),
        ("insufficient trial count", F.col("trials") < req["min_trials"]),
        ("component requires exactly two action classes", req["binary_classes"] & (F.col("n_actions") != 2)),
        ("component requires multiple sessions", req["multiple_sessions"] & (F.col("sessions_per_subject") < 2)),
        ("component requires verified electrode geometry/montage", req["requires_montage"] & ~montage),
        ("component requires EOG channels", req["requires_eog"] & (F.col("eog_channel_count") <= 0)),
        ("component requires independent resting-state data", req["requires_resting_state"] & ~F.col("rest_present")),
    ]
    reasons = F.filter(
        F.array(*[F.when(bad, F.lit(reason)) for reason, bad in tests]), lambda r: r.isNotNull()
    )
    excluded = reduce(lambda a, b: a | b, [bad for _, bad in tests])
    return (
        spread.join(blocks, "__block")
        .select(*profiles.columns, F.explode("__entries").alias("component"))
        .withColumn("reasons", reasons)
        .withColumn(
            "verdict",
            F.when(excluded, "excluded")
            .when(F.col("component.deferred"), "deferred")
            .otherwise("applicable"),
        )
    )
