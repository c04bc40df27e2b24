"""Waiting events of the budget stream: gaps, timers, restarts, fractional limits."""

import json
import time

from trialweave.operators import logs
from trialweave.session import shared_dir
from trialweave.streaming import budget_stream


def event(run, sequence, cost=1.0, limits=None, sha=None):
    return {
        "run": run, "sequence": sequence, "event_type": "usage", "used": {"paid_cost": cost},
        "requested": None, "limits": limits if sequence == 0 else None,
        "event_sha256": sha or f"{run}-{sequence}",
    }


def write(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(e) for e in events))


def verdicts(rows):
    return sorted((r.run, r.sequence, r.verdict) for r in rows)


def test_gaps_at_the_end_of_a_log_and_a_later_run_that_closes_them(spark, tmp_path):
    log, base = tmp_path / "log", shared_dir(spark, "stream-test")
    write(log, "a.json", [event(1, k) for k in (0, 1, 3, 4)] + [event(2, 1), event(3, 0)])
    places = (str(log), f"{base}/out", f"{base}/progress")
    got = budget_stream.account_files(spark, *places).collect()
    assert verdicts(got) == [
        (1, 0, "usage_recorded"), (1, 1, "usage_recorded"), (1, 3, "sequence_gap"),
        (1, 4, "sequence_gap"), (2, 1, "sequence_gap"), (3, 0, "usage_recorded"),
    ]
    # A gap row names the event the log stands at.
    assert {r.sequence: r.last_event_sha256 for r in got if r.run == 1 and r.verdict == "sequence_gap"} == {
        3: "1-1", 4: "1-1"
    }
    write(log, "b.json", [event(1, 2)])
    again = budget_stream.account_files(spark, *places).collect()
    assert verdicts(again) == [
        *[(1, k, "usage_recorded") for k in range(5)], (2, 1, "sequence_gap"), (3, 0, "usage_recorded"),
    ]


def test_a_timer_reports_what_waits_and_a_late_event_still_counts(spark, tmp_path):
    log, base = tmp_path / "log", shared_dir(spark, "stream-test")
    write(log, "a.json", [event(1, 0), event(1, 2), event(1, 3), event(2, 0), event(2, 1)])
    run = budget_stream.account_stream(
        spark, str(log), f"{base}/out", f"{base}/progress", patience_ms=300, processingTime="500 milliseconds"
    )

    def wait_for(check, seconds=90):
        until = time.time() + seconds
        while time.time() < until:
            time.sleep(1)
            try:
                rows = spark.read.schema(budget_stream.OUTPUT_SCHEMA).parquet(f"{base}/out").collect()
            except Exception:  # noqa: BLE001  nothing written yet
                continue
            if check(rows):
                return verdicts(rows)
        raise AssertionError("the stream did not get there")

    try:
        first = wait_for(lambda rows: any(r.verdict == "sequence_gap" for r in rows))
        assert first == [
            (1, 0, "usage_recorded"), (1, 2, "sequence_gap"), (1, 3, "sequence_gap"),
            (2, 0, "usage_recorded"), (2, 1, "usage_recorded"),
        ]
        write(log, "b.json", [event(1, 5), event(1, 1)])
        final = wait_for(lambda rows: sum(r.verdict == "sequence_gap" for r in rows) == 3)
    finally:
        run.stop()
    gaps = [(1, 2, "sequence_gap"), (1, 3, "sequence_gap"), (1, 5, "sequence_gap")]
    assert final == sorted(
        gaps + [(1, k, "usage_recorded") for k in range(4)] + [(2, k, "usage_recorded") for k in range(2)]
    )
    # Reported once by the timer, so not again from the state.
    assert budget_stream.waiting_events(spark, f"{base}/progress").count() == 0


def test_a_limit_reached_by_tenths(spark, tmp_path):
    """Ten times 0.1 is one, in any order; doubles would make it less, three times more."""
    log, base = tmp_path / "log", shared_dir(spark, "stream-test")
    tenths = [event(1, k, 0.1, {"paid_cost": 1.0}) for k in range(11)]
    thirds = [event(2, k, 0.1, {"paid_cost": 0.3}) for k in range(4)]
    write(log, "a.json", [*tenths[::-1], *thirds[::-1]])
    got = budget_stream.account_files(spark, str(log), f"{base}/out", f"{base}/progress").collect()
    seen = {(r.run, r.sequence): r.verdict for r in got}
    assert seen[1, 9] == seen[2, 2] == "usage_recorded"
    assert seen[1, 10] == seen[2, 3] == "post_account_exceeded"
    cost = logs.COUNTERS.index("paid_cost")
    assert {r.totals[cost] for r in got if r.run == 2} == {0.1, 0.2, 0.3, 0.4}


def test_waiting_rows_lie_in_blocks_under_few_keys(spark, tmp_path):
    """Work per micro-batch is by bucket and block, not by run and row."""
    log, base = tmp_path / "log", shared_dir(spark, "stream-test")
    size, runs = 3 * budget_stream.BLOCK, 3 * budget_stream.BUCKETS
    late = [event(0, k) for k in range(1, size)]
    write(log, "a.json", [*late[::2], *[event(r, 0) for r in range(1, runs)]])
    places = (str(log), f"{base}/out", f"{base}/progress")
    first = budget_stream.account_files(spark, *places).collect()
    assert len(first) == len(late[::2]) + runs - 1
    assert {r.verdict for r in first if r.run == 0} == {"sequence_gap"}

    def state(name):
        return spark.read.format("statestore").option("stateVarName", name).load(places[2])

    assert state("account").select("key").distinct().count() <= budget_stream.BUCKETS
    assert state("early").count() == 3
    # Half of the rest and some repeats, then the first row: all blocks drain in one batch.
    write(log, "b.json", [*late[1::4], *[event(0, k, 5.0) for k in (1, 301, 601)]])
    second = budget_stream.account_files(spark, *places).collect()
    assert [v for v in verdicts(second) if v[2] == "sequence_repeated"] == [
        (0, k, "sequence_repeated") for k in (1, 301, 601)
    ]
    write(log, "c.json", [event(0, 0), *late[3::4]])
    final = [r for r in budget_stream.account_files(spark, *places).collect() if r.run == 0]
    cost = logs.COUNTERS.index("paid_cost")
    used = {r.sequence: r.totals[cost] for r in final if r.verdict == "usage_recorded"}
    assert used == {k: k + 1.0 for k in range(size)}
    assert len(final) == size + 3
    assert state("early").count() == 0
