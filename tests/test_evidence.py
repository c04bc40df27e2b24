"""Papers, coverage, citations, logs, replays, decisions, stream."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.functions.hashing import content_hash
from trialweave.operators import evidence, logs, search
from trialweave.operators.ordered import block_slice
from trialweave.session import shared_dir
from trialweave.streaming import budget_stream


def test_paper_hygiene(spark):
    rows = [("s", 1, "Paper", "journal-article", None), ("s", 2, "PAPER!", "journal-article", None), ("s", 3, "Vision", "posted-content", False), ("s", 4, "Other", "component", None), ("s", 5, "Gone", "article", True), ("s", 6, "Erratum: x", "article", None)]
    df = spark.createDataFrame(rows, "q string, rank long, title string, work_type string, is_retracted boolean")
    marked = evidence.with_exclusion_reason(df, ["q"], "rank")
    assert {r.title for r in marked.where("reason is null").collect()} == {"Paper", "Vision"}
    assert {r.reason: r.papers for r in evidence.exclusion_histogram(marked).collect()} == {
        "duplicate_normalized_title": 1, "ineligible_work_type": 1, "retracted": 1, "supplement_correction_or_retraction_title": 1,
    }


def test_an_excluded_paper_never_shadows_a_later_one(spark):
    df = spark.createDataFrame([("s", 1, "Same", "component", None), ("s", 2, "same", "article", None)], "q string, rank long, title string, work_type string, is_retracted boolean")
    marked = evidence.with_exclusion_reason(df, ["q"], "rank")
    assert [r.rank for r in marked.where("reason is null").collect()] == [2]


def test_upsert_keeps_origin(spark):
    schema = "stable_id string, source string, source_id string, doi string, title string, at long"
    stored = spark.createDataFrame([("p", "crossref", "1", "10.1", "old", 1)], schema)
    new = spark.createDataFrame([("p", "openalex", "W1", None, "new", 2), ("q", "openalex", "W2", None, "q", 3)], schema)
    got = {r.stable_id: r for r in evidence.upsert_papers(stored, new, "at", ["title", "at"]).collect()}
    assert (got["p"].source, got["p"].doi, got["p"].title) == ("crossref", "10.1", "new") and len(got) == 2


def test_coverage_complete(spark):
    plan = spark.createDataFrame([("q", ["crossref"])], "query_id string, source_names array<string>")
    done = spark.createDataFrame([("q", "crossref", "completed")], "query_id string, source string, status string")
    one = evidence.coverage(plan, done, spark.range(1)).first()
    assert one.complete and one.missing_searches == 0
    failed = evidence.coverage(plan, done.withColumn("status", F.lit("failed")), spark.range(1)).first()
    assert not failed.complete and failed.queries_without_success == 1
    assert evidence.missing_searches(plan, done.limit(0)).count() == 1


def test_citations_stay_in_their_run(spark):
    known = spark.createDataFrame([("r1", "p1"), ("r2", "p2")], "search_run_id string, stable_id string")
    directions = spark.createDataFrame([("r1", "a", ["p1"]), ("r1", "b", ["p2"]), ("r1", "c", [])], "search_run_id string, candidate_id string, supporting_papers array<string>")
    got = {(r.candidate_id, r.fault) for r in evidence.uncited_or_unknown(directions, known).collect()}
    assert got == {("b", "unknown_paper"), ("c", "no_citation")}


def test_clone_guards(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "search_run_id string, v int")
    clone, guards = evidence.clone_run(rows, "a", "c")
    assert [tuple(r) for r in clone.collect()] == [("c", 1)] and guards.count() == 0
    assert {r.rule_id for r in evidence.clone_run(rows, "a", "b")[1].collect()} == {"target_is_empty"}
    assert {r.rule_id for r in evidence.clone_run(rows, "x", "x")[1].collect()} == {"source_and_target_differ", "source_has_rows"}


# --- logs -----------------------------------------------------------------------

HASHED = ["run", "sequence", "event_type", "previous_event_sha256", "delta"]


def chained(spark, deltas, run="r"):
    import hashlib

    rows, previous = [], None
    for i, d in enumerate(deltas):
        kind = "ledger_opened" if i == 0 else "usage_recorded"
        fields = [run, str(i), kind, previous, str(d)]
        text = "|".join("~" if f is None else f"{len(f)}:{f}" for f in fields)
        own = hashlib.sha256(text.encode()).hexdigest()
        rows.append((run, i, kind, previous, d, own))
        previous = own
    return rows


CHAIN = "run string, sequence long, event_type string, previous_event_sha256 string, delta long, event_sha256 string"


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_chain(spark, width):
    rows = chained(spark, [0, 80, 5, 7, 9])

    def faults(rows):
        df = spark.createDataFrame(rows, CHAIN)
        return {(r.sequence, r.rule_id) for r in logs.chain_faults(df, "run", "sequence", block_slice("sequence", width), HASHED).collect()}

    assert faults(rows) == set()
    edited = [list(r) for r in rows]
    edited[2][4] = 6
    assert faults([tuple(r) for r in edited]) == {(2, "own_hash_recomputes")}
    gone = rows[:2] + rows[3:]
    assert faults(gone) == {(3, "previous_hash_matches"), (3, "sequence_contiguous"), (4, "sequence_contiguous")}
    assert (1, "first_event_opens") in faults(rows[1:])


def test_precheck(spark):
    ops = [("r", 0, "usage", 80, 0), ("r", 1, "precheck", 0, 921), ("r", 2, "precheck", 0, 920), ("r", 3, "usage", 920, 0), ("r", 4, "usage", 1, 0)]
    df = spark.createDataFrame(ops, "run string, sequence long, event_type string, used long, requested long")
    totals = logs.running_totals(df, "run", ["sequence"], block_slice("sequence", 2), ["used"]).withColumn("limit", F.lit(1000))
    got = [r.verdict for r in logs.precheck(totals, "total_used", "requested", "limit").orderBy("sequence").collect()]
    assert got == ["usage_recorded", "precheck_rejected", "precheck_passed", "usage_recorded", "post_account_exceeded"]


def test_snapshot_and_deltas(spark):
    events = spark.createDataFrame([("r", 0, {}, "h0"), ("r", 1, {"api_total_tokens": 80.0}, "h1"), ("r", 2, {"bogus": -1.0}, "h2")], "run string, sequence long, delta map<string,double>, event_sha256 string")
    limits = spark.createDataFrame([("r", "api_total_tokens", 1000.0), ("r", "paid_cost", 1.0)], "run string, field string, limit double")
    got = {r.field: r for r in logs.budget_snapshot(events, limits, "run", "sequence", "delta").collect()}
    assert got["api_total_tokens"].remaining == 920.0 and got["paid_cost"].total == 0.0
    assert got["paid_cost"].event_count == 3 and got["paid_cost"].last_event_sha256 == "h2"
    assert {(r.sequence, r.rule_id) for r in logs.delta_faults(events, "run", "sequence", "delta").collect()} == {(2, "counters_known"), (2, "amounts_not_negative")}


def test_token_cost(spark):
    prices = {"prompt": 2.0, "cached": 0.5, "completion": 4.0}
    df = spark.createDataFrame([(40, 10, 5), (10, 0, 50), (-1, -1, -1)], "p int, c int, h int")
    got = [r.v for r in df.select(logs.token_cost(F.col("p"), F.col("c"), F.col("h"), prices).alias("v")).collect()]
    assert got == pytest.approx([(35 * 2 + 5 * 0.5 + 40) / 1e6, 10 * 0.5 / 1e6, 0.0])


def test_stages(spark):
    def record(at, stage, upstream, n=0):
        _, kind, status = next(s for s in logs.STAGES if s[0] == stage)
        return ("d", at, stage, kind, status, f"sha{at}", upstream)

    schema = "d string, at long, stage string, artifact_type string, artifact_status string, sha256 string, upstream_sha256 array<string>"
    good = [record(0, "dataset_inspection", []), record(1, "dataset_profile", ["sha0"])]
    df = spark.createDataFrame(good, schema)
    assert logs.stage_faults(df, "d", "at", block_slice("at", 1)).count() == 0
    assert logs.next_stage(df, "d").first().next_stage == "canonical_search_space"
    wrong = spark.createDataFrame([record(0, "dataset_profile", [])], schema)
    assert {r.rule_id for r in logs.stage_faults(wrong, "d", "at", block_slice("at", 1)).collect()} == {"stage_in_order"}
    loose = spark.createDataFrame([good[0], record(1, "dataset_profile", ["other"])], schema)
    assert {r.rule_id for r in logs.stage_faults(loose, "d", "at", block_slice("at", 1)).collect()} == {"upstream_binding"}


# --- search ---------------------------------------------------------------------


def python_replay(scores, tolerance, low, high, stop):
    best, near, locked, at = scores[0], None, high, 0
    top = max(scores)
    for i, s in enumerate(scores, start=1):
        if s > best:
            best, at = s, i - 1
        if near is None and top - best <= tolerance:
            near = i
        if i >= low and (best >= stop or i >= high):
            locked = i
            break
    return at, best, locked, near


def test_replay_against_loop(spark):
    rng = np.random.default_rng(4)
    cases = {f"k{i}": [float(x) for x in rng.choice([0.5, 0.6, 0.7, 0.74, 0.75, 0.9], size=1 + i % 9)] for i in range(60)}
    rows = [(k, i, f"c{i}", s) for k, v in cases.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, cycle long, c string, score double").repartition(9)
    got = {r.k: r for r in search.replay(df, ["k"], "cycle", "c", "score", 0.02, 2, 4, 0.75).collect()}
    for k, scores in cases.items():
        at, best, locked, near = python_replay(scores, 0.02, 2, 4, 0.75)
        r = got[k]
        assert (r.locked_candidate, r.locked_score, r.locked_cycle, r.cycles_to_near_best) == (f"c{at}", best, locked, near), k


def test_guided_orders(spark):
    schema = "subject_id string, mu_power double, beta_power double, broad_median double, broad_max double, mu_median double, mu_max double, beta_median double, beta_max double"
    df = spark.createDataFrame([("m", 2.0, 1.0, 0.2, 1.0, 0.6, 1.0, 0.1, 0.5), ("b", 1.0, 2.0, 0.6, 1.0, 0.1, 0.5, 0.1, 1.0)], schema)

    def order(policy):
        rows = search.guided_preferences(df, policy).orderBy("subject_id", "place").collect()
        return {s: [(r.family, r.low, r.high) for r in rows if r.subject_id == s] for s in ("m", "b")}

    band = order("bandwise")
    assert band["m"][:3] == [("bandpower_lda", 8.0, 13.0), ("csp_lda", 8.0, 13.0), ("bandpower_lda", 8.0, 30.0)]
    assert band["b"][0] == ("csp_lda", 13.0, 30.0) and band["b"][-1] == ("bandpower_lda", 8.0, 13.0)
    mean = order("mean_spectrum")
    assert mean["m"][0] == ("csp_lda", 8.0, 13.0) and mean["b"][0] == ("bandpower_lda", 13.0, 30.0)
    assert all(len(set(v)) == 8 for v in [*band.values(), *mean.values()])


def test_decisions(spark):
    schema = "lock_id string, confirmation_status string, distinct_candidates int, search_score double, confirmation_score double, chance_level double, minimum_confirmation_score double, maximum_search_to_confirmation_drop double, minimum_distinct_search_candidates int, policy_version string"
    cases = [("ok", "completed_one_shot", 2, 0.8, 0.75), ("few", "completed_one_shot", 1, 0.8, 0.75), ("low", "completed_one_shot", 2, 0.8, 0.4), ("drop", "completed_one_shot", 2, 0.95, 0.7), ("bad", "failed", 2, 0.8, None)]
    df = spark.createDataFrame([(*c, 0.5, 0.6, 0.15, 2, "2.0") for c in cases], schema)
    assert {r.lock_id: r.outcome for r in search.decide(df).collect()} == {"ok": "success", "few": "inconclusive", "low": "refuse", "drop": "inconclusive", "bad": "refuse"}


def test_single_use_confirmation(spark):
    locks = spark.createDataFrame([("l1", "s1", "p", 0.8), ("l2", "s2", "p", 0.7), ("l3", "s3", "p", 0.7)], "lock_id string, subject_id string, pipeline_id string, search_score double")
    scored = spark.createDataFrame([("s1", "p", 0.75), ("s2", "p", 0.7)], "subject_id string, pipeline_id string, score double")
    used = spark.createDataFrame([("l2",)], "lock_id string")
    got = {r.lock_id: r.status for r in search.confirm(locks, scored, used).collect()}
    assert got == {"l1": "completed_one_shot", "l3": "failed"}


def test_trace_refuses_equal_configurations(spark):
    spec = "family string, low double, high double, spatial_filter string, csp_components int, feature string, model string, lda_shrinkage double, cv_folds int, random_seed long"
    row = ("csp_lda", 8.0, 30.0, "csp", 4, "csp_log_variance", "shrinkage_lda", 0.1, 3, 1)
    from trialweave.operators.decode import configuration_hash

    rows = [("s", 0, "a", *row), ("s", 1, "renamed", *row), ("s", 2, "b", *row[:-1], 2), ("s", 3, "c", *row[:-1], 3)]
    df = spark.createDataFrame(rows, f"k string, at long, pipeline_id string, {spec}").withColumn("cfg", configuration_hash())
    got = [r.verdict for r in search.admitted_trace(df, ["k"], "at", "cfg", 2).orderBy("at").collect()]
    assert got == ["admitted", "duplicate_configuration", "admitted", "budget_exhausted"]


# --- stream ---------------------------------------------------------------------


def test_stream_equals_batch_with_early_arrivals(spark, tmp_path):
    rng = np.random.default_rng(8)
    names = ("paid_cost", "api_total_tokens", "provider_retries")
    ops = []
    for run in range(5):
        for seq in range(40 if run else 200):
            ask = bool(rng.random() < 0.3)
            amounts = {n: float(rng.integers(0, 30)) / 8 for n in names}
            ops.append({
                "run": run, "sequence": seq, "event_type": "precheck" if ask else "usage",
                "used": {} if ask else amounts, "requested": amounts if ask else {},
                "limits": {"paid_cost": 40.0 + run, "provider_retries": 90.0} if seq == 0 else None,
                "event_sha256": f"{run}-{seq}",
            })
    order = rng.permutation(len(ops))
    log = tmp_path / "log"
    log.mkdir()
    repeated = []
    for n, part in enumerate(np.array_split(order, 12)):
        lines = [json.dumps(ops[i]) for i in part]
        if n:  # a second line of a sequence seen before, with another amount
            again = dict(ops[order[n]], used={"paid_cost": 1e6}, event_sha256="zz")
            repeated.append((again["run"], again["sequence"]))
            lines.append(json.dumps(again))
        (log / f"part-{n:02d}.json").write_text("\n".join(lines))
    base = shared_dir(spark, "stream-test")
    got = budget_stream.account_files(spark, str(log), f"{base}/out", f"{base}/progress", files_per_batch=2).collect()
    assert sorted((r.run, r.sequence) for r in got if r.verdict == "sequence_repeated") == sorted(repeated)
    want = {}
    for run in range(5):
        totals, limits = dict.fromkeys(names, 0.0), {"paid_cost": 40.0 + run, "provider_retries": 90.0}
        for op in (o for o in ops if o["run"] == run):
            for n, v in op["used"].items():
                totals[n] += v
            over = [n for n in ("api_total_tokens", "paid_cost", "provider_retries")
                    if totals[n] + op["requested"].get(n, 0.0) > limits.get(n, 1e99)]
            if op["event_type"] == "precheck":
                verdict = "precheck_rejected" if over else "precheck_passed"
            else:
                verdict = "post_account_exceeded" if over else "usage_recorded"
            want[run, op["sequence"]] = (verdict, over, [totals[n] for n in names], op["event_sha256"])
    place = [logs.COUNTERS.index(n) for n in names]
    seen = {
        (r.run, r.sequence): (r.verdict, r.exceeded, [r.totals[p] for p in place], r.last_event_sha256)
        for r in got if r.verdict != "sequence_repeated"
    }
    assert seen == want


@pytest.mark.parametrize("heavy_rows", [10, 1_000_000])
def test_fractional_totals_do_not_depend_on_slices(spark, heavy_rows):
    amounts = [round(0.1 + (i * 7919 % 1000) / 997, 6) for i in range(3000)]
    recorded, total = [], 0.0
    for a in amounts:
        total += a
        recorded.append(total)
    recorded[1500] += 1e-6
    rows = [("r", i, a, t) for i, (a, t) in enumerate(zip(amounts, recorded, strict=True))]
    df = spark.createDataFrame(rows, "run string, sequence long, used double, recorded double").repartition(5)
    totals = logs.running_totals(
        df, "run", ["sequence"], block_slice("sequence", 37), ["used"], heavy_rows
    ).withColumn("limit", F.lit(None).cast("double"))
    got = {r.sequence: r.total_used for r in totals.collect()}
    from decimal import Decimal

    exact = Decimal(0)
    for i, a in enumerate(amounts):
        exact += Decimal(str(a))
        assert got[i] == float(exact)
    faults = logs.total_faults(totals, "run", "sequence", {"total_used": "recorded"}, {"total_used": "limit"})
    assert [(r.sequence, r.rule_id) for r in faults.collect()] == [(1500, "total_used_recorded")]


def test_partition_counts_do_not_matter(spark):
    rows = [(k, i, f"c{i % 3}", float((i * 7) % 11)) for k in range(3) for i in range(50)]
    base = spark.createDataFrame(rows, "k long, cycle long, c string, score double")
    results = []
    for n in (1, 4, 17):
        df = base.repartition(n)
        hashed = content_hash([F.col("k"), F.col("c")])
        results.append(
            (
                sorted(map(str, search.replay(df, ["k"], "cycle", "c", "score", 0.5, 2, 8, 9.5).collect())),
                sorted(map(str, df.select(hashed.alias("h")).distinct().collect())),
            )
        )
    assert all(a == b for a, b in itertools.pairwise(results))


@pytest.mark.parametrize("turned", [False, True])
def test_a_tied_selection_names_the_earliest_cycle(spark, turned):
    trace = [("s", 11, 0.5, 1, "a", True), ("s", 12, 0.7, 2, "b", True), ("s", 13, 0.7, 3, "c", True),
             ("s", 14, 0.9, 4, "d", False), ("t", 21, None, 1, "a", True), ("t", 22, 0.4, 2, "b", False)]
    df = spark.createDataFrame(
        trace[::-1] if turned else trace,
        "k string, experiment_id long, score double, research_cycle int, configuration string, chosen boolean",
    ).coalesce(1)
    got = {r.k: r for r in search.lock_best(df, ["k"], "chosen").collect()}
    assert got["s"].selected_experiment == 12 and got["s"].selected_score == 0.7
    assert got["t"].selected_experiment is None and got["t"].status == "selection_not_in_trace"
