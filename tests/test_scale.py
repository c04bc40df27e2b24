"""Plans that must not grow faster than their input."""

import os

import pytest

import __spark_entry__ as entry
from trialweave.functions import text
from trialweave.operators import reconcile

SF = "/root/testdata/sf0.001"


def exchanges(df):
    """Shuffles of a plan; one that is used again counts once."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line and "Reused" not in line and "Broadcast" not in line for line in plan.split("\n"))


def test_positions_of_words_and_back(spark):
    lists = [["b", "a", "b", "é", "b"], ["x"], ["a"] * 300, [], None, ["", "a", ""]]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "id int, words array<string>")
    placed = df.select("id", "words", text.positions_of_words(df.words).alias("at"))
    rows = {r.id: r for r in placed.select("*", text.abstract_from_positions(placed["at"]).alias("back")).collect()}
    for i, words in enumerate(lists):
        if not words:
            assert rows[i]["at"] is None and rows[i].back is None
            continue
        want = {}
        for k, w in enumerate(words):
            want.setdefault(w, []).append(k)
        assert rows[i]["at"] == want
        assert rows[i].back == " ".join(words)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_abstracts_are_rebuilt_without_a_shuffle(spark):
    assert exchanges(entry.queries()["sf4_abstract_rebuild"](spark, SF)) == 0


def test_locks_against_traces_with_odd_rows(spark):
    search, balanced = "pipeline_search_and_lock", "balanced_accuracy"
    trace = [
        (1, "a", "s1", 0.5, search, False), (1, "b", "s2", 0.7, search, False),
        (2, "a", "s1", 0.5, search, True), (3, "c", None, None, search, False),
        # An experiment recorded twice: one record agrees with the lock, the other does not.
        (5, "a", "s1", 0.5, search, False), (5, "a", "s9", 0.5, search, False),
    ]
    locks = [
        (1, "b", "s2", balanced, 0.7, ["a", "b"], 2, 2), (2, "a", "s1", balanced, 0.5, ["a", "z"], 1, 1),
        (3, "c", "s1", balanced, 0.1, None, 1, 1), (4, None, None, balanced, None, [None], 0, 0),
        (5, "a", "s1", balanced, 0.5, ["a"], 2, 2),
    ]
    got = reconcile.lock_faults(
        spark.createDataFrame(locks, "lock_id long, selected_experiment_id string, pipeline_sha256 string, primary_metric string, selected_search_score double, evidence_experiment_ids array<string>, candidate_executions long, research_cycles long"),
        spark.createDataFrame(trace, "lock_id long, experiment_id string, pipeline_sha256 string, score double, data_role string, confirmation_data_accessed boolean"),
        spark.createDataFrame([(k, balanced, 6) for k in range(1, 6)], "lock_id long, primary_metric string, authorised long"),
    )
    found = {}
    for r in got.collect():
        found.setdefault(r.lock_id, []).append(r.rule_id)
    assert {k: sorted(v) for k, v in found.items()} == {
        2: ["citations_in_trace", "trace_is_search_only"],
        3: ["pipeline_hash_matches", "score_matches", "selection_cited"],
        4: sorted([
            "selection_in_trace", "pipeline_hash_matches", "score_matches", "selection_cited", "citations_in_trace",
            "trace_is_search_only", "executions_match_trace", "cycles_match_trace", "within_authorised_budget",
        ]),
        5: ["pipeline_hash_matches"],
    }


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_lock_reconciliation_deals_its_tables_few_times(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # Lines and orders for the locks, which are read twice, the trace and the limits.
        assert exchanges(entry.queries()["jn13_lock_reconciliation"](spark, SF)) <= 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
