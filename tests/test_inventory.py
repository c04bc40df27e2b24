"""Collection counts, grid gaps, identities, rules."""

import pytest
from pyspark.sql import functions as F

from trialweave.functions import parameters, text
from trialweave.functions.components import (
    DEFERRED_COMPONENTS,
    component_table,
    default_components,
    read_components,
)
from trialweave.operators import checks, inventory, reconcile, rules
from trialweave.plans.filters import identity_conflicts, mapped_codes


def test_run_counts(spark):
    runs = [("alpha", "day-a", 4), ("alpha", "day-b", 4), ("beta", "day-a", 4), ("beta", "day-b", 3)]
    df = spark.createDataFrame([(s, d, f"{s}/{d}", n, i) for i, (s, d, n) in enumerate(runs)], "subject string, session string, run string, trials long, at long")
    total = inventory.volume(df.withColumn("size", F.lit(10)), "subject", "session", "trials", "size").first()
    assert (total.subjects, total.runs, total.trials, total.subject_sessions, total.signal_bytes) == (2, 4, 15, 4, 40)
    odd = inventory.trial_anomalies(df, "trials", "at").collect()
    assert [(r.run, r.nominal_trials, r.difference, r.missing_trials) for r in odd] == [("beta/day-b", 4, -1, 1)]


def test_first_seen_mode_breaks_ties(spark):
    df = spark.createDataFrame([(7, 0), (5, 1), (5, 2), (7, 3), (9, 4)], "v long, at long")
    assert inventory.first_seen_mode(df, "v", "at").first().nominal == 7


@pytest.mark.parametrize(
    "pairs,gaps",
    [
        ([("one", "a"), ("one", "b"), ("two", "a")], {("two", "b")}),
        ([("x", "1"), ("y", "2"), ("z", "3")], {("x", "2"), ("x", "3"), ("y", "1"), ("y", "3"), ("z", "1"), ("z", "2")}),
        ([("x", "1"), ("x", "2")], set()),
    ],
)
def test_grid_gaps(spark, pairs, gaps):
    df = spark.createDataFrame(pairs * 3, "u string, c string")
    got = inventory.grid_gaps(df, "u", "c", F.substring("c", 1, 1))
    assert {tuple(r) for r in got.collect()} == gaps


def test_blank_labels_count_but_are_not_listed(spark):
    df = spark.createDataFrame([("left", "1"), ("", "9"), ("right", "2")], "trial_type string, value string")
    got = {r.trial_type: r for r in inventory.event_counts(df, "trial_type", "value").collect()}
    assert sum(r.events for r in got.values()) == 3
    assert {k for k, r in got.items() if r.listed} == {"left", "right"}


def test_runs_per_session_modes(spark):
    df = spark.createDataFrame([("s", "1", "a"), ("s", "1", "b"), ("t", "1", "a")], "s string, n string, r string")
    assert inventory.runs_per_session(df, "s", "n", "r", "max").first().runs == 2
    assert inventory.runs_per_session(df, "s", "n", "r").first().agrees is False


def test_channel_signature_is_ordered(spark):
    rows = [("f1", 0, "C3"), ("f1", 1, "C4"), ("f2", 0, "C3"), ("f2", 1, "C4"), ("f3", 0, "C4"), ("f3", 1, "C3")]
    df = spark.createDataFrame(rows, "f string, pos long, name string").repartition(5)
    got = {r.f: r.signature for r in inventory.channel_signatures(df, "f", ["pos", "name"]).collect()}
    assert got["f1"] == got["f2"] != got["f3"]


def test_identity_conflict(spark):
    df = spark.createDataFrame([("sub-one/x_two.npz", 1), ("sub-two/x_two.npz", 2)], "path string, k long")
    path = F.col("path")
    ids = df.select(
        "k",
        text.declared_identity(path, r"sub-(?P<subject>[a-z]+)/", "subject").alias("subject"),
        text.declared_identity(path, r"/x_(?P<subject>[a-z]+)\.npz", "subject").alias("asserted"),
    )
    got = identity_conflicts(ids, ["k"], {"subject": "asserted"}).collect()
    assert [tuple(r) for r in got] == [(1, "subject", "one", "two")]


def test_group_position_in_pattern(spark):
    df = spark.createDataFrame([("a-b-c",)], "p string")
    pattern = r"(?:x|(a))-(?P<mid>[(]?b)-(?P<subject>c)"
    row = df.select(text.declared_identity(F.col("p"), pattern, "mid").alias("m"), text.declared_identity(F.col("p"), pattern, "subject").alias("s")).first()
    assert (row.m, row.s) == ("b", "c")


def test_event_codes(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,)], "v double").select(text.event_code_text(F.col("v")).alias("code"))
    got = {r.code: r.label for r in mapped_codes(df, "code", {"1": "left", "2": "right"}).collect()}
    assert got == {"1": "left", "2": "right", "2.5": None}


@pytest.mark.parametrize(
    "raw,title", [("<b>A</b>&amp;lt; b", "a lt b"), ("Caf&eacute;  <i>x</i>", "caf x"), ("&copy;2024 &unknown;", "2024 unknown")]
)
def test_titles(spark, raw, title):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.normalized_title(F.col("t")).alias("k")).first().k == title


def test_markup(spark):
    rows = ["<p>a&nbsp;&nbsp;b</p>\n c", "&amp;lt;", "&#8211; &eacute;&amp;", "<br>", ""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    got = [r.k for r in df.select("i", text.clean_markup(F.col("t")).alias("k")).orderBy("i").collect()]
    assert got == ["a b c", "&lt;", "– é&", None, None]


def test_paradigm(spark):
    df = spark.createDataFrame([("Visual Oddball (P3)", "", ["x"]), ("t", "uses motor imagery", []), ("t", "", ["motor imagery"]), ("--", "", [])], "t string, s string, k array<string>")
    got = [r.f for r in df.select(text.paradigm_family(F.col("t"), F.col("s"), F.col("k")).alias("f")).collect()]
    assert got == ["bids_task_visual_oddball_p3", "motor_imagery", "motor_imagery", "bids_task_unspecified"]


PROFILE = dict(dataset_id="d", family="motor_imagery", n_actions=2, modalities=["EEG"], channel_count=22, trials=7200, sessions_per_subject=6, montage_verified=None, placement_scheme="10-20", eog_channel_count=0, rest_present=False)
PROFILE_SCHEMA = "dataset_id string, family string, n_actions int, modalities array<string>, channel_count int, trials int, sessions_per_subject int, montage_verified boolean, placement_scheme string, eog_channel_count int, rest_present boolean"


def verdicts(spark, **changes):
    df = spark.createDataFrame([tuple({**PROFILE, **changes}.values())], PROFILE_SCHEMA)
    judged = rules.applicability(df, component_table(spark, default_components(), DEFERRED_COMPONENTS))
    return {r.component.id: r.verdict for r in judged.collect()}


def test_applicability(spark):
    base = verdicts(spark)
    assert {c for c, v in base.items() if v == "excluded"} == {"artifact_eog_regression", "feature_resting_iaf", "feature_xdawn"}
    assert sum(v != "excluded" for v in base.values()) >= 20
    assert verdicts(spark, montage_verified=False)["reference_surface_laplacian"] == "excluded"
    assert verdicts(spark, sessions_per_subject=1)["adapt_coral"] == "excluded"
    assert verdicts(spark, eog_channel_count=3)["artifact_eog_regression"] == "applicable"


def test_a_registry_of_any_size_is_a_table(spark, tmp_path):
    import json

    entries = default_components() + [
        {"id": f"extra-{k}", "category": "models", "requirements": {"min_trials": k} if k % 2 else {}, "cost": k}
        for k in range(3000)
    ]
    path = tmp_path / "registry.json"
    path.write_text(json.dumps({"version": 1, "components": entries}))
    read = read_components(spark, str(path), DEFERRED_COMPONENTS)
    made = component_table(spark, entries, DEFERRED_COMPONENTS)
    assert sorted(map(str, read.collect())) == sorted(map(str, made.collect()))
    df = spark.createDataFrame([tuple({**PROFILE, "trials": 1500}.values())], PROFILE_SCHEMA)
    judged = {r.component.id: r.verdict for r in rules.applicability(df, read).collect()}
    assert len(judged) == len(entries)
    assert sum(judged[f"extra-{k}"] == "excluded" for k in range(3000)) == sum(k > 1500 for k in range(1, 3000, 2))


def test_bound_parameters(spark):
    row = spark.range(1).select(
        parameters.legal_resample_rates(F.lit(512.0)).alias("r"), parameters.legal_windows(F.lit(0.0), F.lit(4.0)).alias("w")
    ).first()
    assert row.r == [512.0, 256.0, 128.0, 100.0]
    windows = [(w.start, w.stop) for w in row.w]
    assert (0.0, 4.0) in windows and windows == sorted(windows) and all(b <= 4 for _, b in windows)


def test_query_templates_follow_sessions(spark):
    df = spark.createDataFrame([("many", "motor_imagery", ["EEG"], 6, 0), ("one", "motor_imagery", ["EEG"], 1, 2)], "dataset_id string, family string, modalities array<string>, sessions_per_subject int, eog_channel_count int")
    rows = parameters.literature_queries(df).collect()
    ids = {d: {r.query_id for r in rows if r.dataset_id == d} for d in ("many", "one")}
    assert "cross_session_nonstationarity" in ids["many"] and "within_session_nonstationarity" not in ids["many"]
    assert ids["one"].isdisjoint({"cross_session_nonstationarity", "adaptive_bci_learning", "test_time_adaptation"})
    texts = {(r.dataset_id, r.query_id): r.text for r in rows}
    assert texts["many", "artifact_without_auxiliary_eog"] == "motor imagery EEG artifact removal without EOG robust trial quality"


def test_inventory_status(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "p string, d string")
    now = spark.createDataFrame([("a", "1"), ("b", "x")], "p string, d string")
    assert {r.p: r.status for r in reconcile.inventory_status(stored, now, "p", "d").collect()} == {"a": "ok", "b": "changed", "c": "missing"}


def test_partition_faults(spark):
    units = spark.createDataFrame([("d", str(i)) for i in range(4)], "d string, u string")
    good = [("d", "0", "profiling_and_calibration"), ("d", "1", "pipeline_search_and_lock"), ("d", "2", "pipeline_search_and_lock"), ("d", "3", "frozen_confirmation")]
    schema = "d string, u string, role string"
    assert reconcile.partition_faults(spark.createDataFrame(good, schema), units, ["d"], "u").count() == 0
    bad = [*good[:3], ("d", "1", "profiling_and_calibration"), ("d", "9", "pipeline_search_and_lock")]
    got = {(r.subject, r.rule_id) for r in reconcile.partition_faults(spark.createDataFrame(bad, schema), units, ["d"], "u").collect()}
    assert got == {("1", "roles_disjoint"), ("3", "unit_assigned"), ("9", "unit_in_catalogue"), ("roles", "frozen_confirmation_not_empty")}


def test_disagreement_sees_null(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, 2.0, "x")], "k int, a double, b string")
    assert [(r.k, r.field) for r in checks.disagreements(df, ["k"], ["a", "b"]).collect()] == [(1, "a")]


def test_require_empty(spark):
    with pytest.raises(ValueError, match="what"):
        checks.require_empty(spark.range(1), "what")
    checks.require_empty(spark.range(0), "nothing")


def test_redaction_of_broken_json_shows_nothing(spark):
    broken = '{"secret": {"a": "s3cret'
    df = spark.createDataFrame([(broken,), ('{"n": 1}',)], "p string")
    got = [r[0] for r in df.select(rules.redact_json(F.col("p"))).collect()]
    assert got == ['"<redacted>"', '{"n": 1}']


def test_redaction(spark):
    rows = ['{"a": {"API-KEY": "k", "n": [1, {"secret": 5}]}}', '{"password": {"x": [1]}, "ok": "é"}', '{"apikey": "a\\"b", "access_token": null}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p string")
    got = [r.p for r in df.select("i", rules.redact_json(F.col("p")).alias("p")).orderBy("i").collect()]
    assert got == [
        '{"a": {"API-KEY": "<redacted>", "n": [1, {"secret": "<redacted>"}]}}',
        '{"password": "<redacted>", "ok": "é"}',
        '{"apikey": "<redacted>", "access_token": "<redacted>"}',
    ]
    m = spark.createDataFrame([({"Api-Key": "k", "n": "1"},)], "m map<string,string>")
    assert m.select(rules.redact_map(F.col("m")).alias("m")).first().m == {"Api-Key": "<redacted>", "n": "1"}


def test_conformance(spark):
    schema = {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {"n": {"type": "integer"}, "l": {"type": "array", "items": {"type": "object", "properties": {"x": {"type": "number"}}}}}}
    rows = ['{"n": 1}', '{"n": true}', '{"n": 1.0}', "{}", '{"n": 1, "z": 2}', '{"n": 1, "l": [{"x": 1.5}, {"x": "y"}, 3]}', "[]"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").withColumn("v", F.try_parse_json("t"))
    got = df.select("i", F.explode(rules.conformance_faults(F.col("v"), schema)).alias("f")).collect()
    assert sorted((r.i, r.f.location, r.f.fault) for r in got) == [
        (1, "value.n", "not_integer"), (2, "value.n", "not_integer"), (3, "value", "missing_n"), (4, "value", "unknown_z"),
        (5, "value.l[1].x", "not_number"), (5, "value.l[2]", "not_object"), (6, "value", "not_object"),
    ]


@pytest.mark.parametrize("partitions", [1, 8, 200])
def test_mode_is_the_same_for_any_partitioning(spark, partitions):
    rows = spark.createDataFrame([(1, 4, 7), (1, 6, 7), (1, 5, 9)], "k long, v long, pos long")
    got = inventory.first_seen_mode(rows.repartition(partitions), "v", "pos", ["k"])
    assert [tuple(r) for r in got.collect()] == [(1, 6)]
