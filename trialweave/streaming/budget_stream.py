"""Incremental budget accounting over a stream of log files.

Per run the state holds the next sequence, the total and limit of each counter and the hash
of the last event.  Rows that arrive ahead of their turn wait in a keyed map state, on disk,
in blocks of neighbouring sequence numbers, and are fetched by the block when their turn
comes.  Runs are dealt by hash over a fixed number of buckets, one state key each, so the
Python worker is called once per bucket and micro-batch and not once per run.  A timer
reports rows that have waited too long behind a gap.  Totals are decimals, as in the batch
twin (the running-total scan of the same log), so both give the same verdicts at any limit
and in any order.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import Context, Decimal
from itertools import groupby

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trialweave.operators.logs import COUNTERS, TOLERANCE

# The state worker starts without shipped files, so the processor travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Amounts and limits by counter name; the first event of a run carries its limits.
EVENT_SCHEMA = (
    "run long, sequence long, event_type string, used map<string, double>, "
    "requested map<string, double>, limits map<string, double>, event_sha256 string"
)
OUTPUT_SCHEMA = (
    "run long, sequence long, verdict string, exceeded array<string>, totals array<double>, "
    "last_event_sha256 string"
)
#: Amounts travel as text: a decimal with twelve places per counter between commas, nothing
#: for a missing limit or an amount of zero.
ROW = (
    "sequence long, event_type string, used string, requested string, limits string, "
    "sha string, told boolean"
)
ACCOUNT = "next_sequence long, totals string, limits string, sha string, waiting long"
GAP = "sequence_gap"
#: State keys of a stream; neighbouring sequence numbers of a block; rows of one output frame.
BUCKETS, BLOCK, FRAME = 1024, 256, 10_000
#: Sums of decimal(38,12) amounts stay exact.
EXACT = Context(prec=60)


class BudgetAccount(StatefulProcessor):
    """Totals of the runs of a bucket, all counters at once, against the limits of the first
    event of each run."""

    def __init__(self, counters: tuple[str, ...], tolerance: float, patience_ms: int | None) -> None:
        self.counters, self.tolerance = counters, Decimal(repr(tolerance))
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getMapState("account", "run long", ACCOUNT)
        self.early = handle.getMapState("early", "run long, block long", f"held array<struct<{ROW}>>")
        if self.patience_ms is not None:
            self.due = handle.getMapState("due", "run long", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["run", "sequence", "sha"], kind="stable")
        values = zip(*[batch[c].tolist() for c in ("run", "sequence", "event_type", "used", "requested", "limits", "sha")], strict=True)
        out: list = []
        for run, events in groupby(values, key=lambda v: v[0]):
            for done in self._account(int(run), events, timerValues):
                out.append(done)
                if len(out) >= FRAME:
                    yield self._frame(out)
                    out = []
        if out:
            yield self._frame(out)

    def _account(self, run: int, events: Iterator[tuple], timerValues) -> Iterator[tuple]:  # noqa: N803
        """Rows of one run, in the order of their sequence."""
        ahead, totals, limits, sha, waiting = self.account.getValue((run,)) or (0, "", "", None, 0)
        before, totals, caps = ahead, self._numbers(totals), self._caps(limits)
        shown = [float(t) for t in totals]
        held = Blocks(self.early, run, waiting > 0)
        for _, at, *event in events:
            at = int(at)
            if at < ahead or (at > ahead and waiting and at in held.of(at, ahead)):
                yield run, at, "sequence_repeated", [], None, sha
                continue
            if at > ahead:
                held.put(at, ahead, (at, *event, False))
                waiting += 1
                continue
            while event is not None:
                kind, used, requested, given, sha = event
                if ahead == 0:
                    limits = given
                    caps = self._caps(limits)
                for i, amount in self._amounts(used):
                    totals[i] = EXACT.add(totals[i], amount)
                    shown[i] = float(totals[i])
                yield run, ahead, *self._judge(kind, totals, requested, caps), list(shown), sha
                ahead, event = ahead + 1, None
                if waiting and ahead in held.of(ahead, ahead):
                    event = held.take(ahead)[1:6]
                    waiting -= 1
        held.write()
        self.account.updateValue((run,), (ahead, ",".join(map(str, totals)), limits, sha, waiting))
        if self.patience_ms is not None:
            due = self.due.containsKey((run,))
            # A gap that closed takes its time along; the next one starts its own.
            if due and (not waiting or ahead > before):
                self.due.removeKey((run,))
                due = False
            if waiting and not due:
                at = int(timerValues.getCurrentProcessingTimeInMs()) + self.patience_ms
                self.due.updateValue((run,), (at,))
                self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """One fault row per event still waiting; it stays, in case the gap closes later."""
        now = expiredTimerInfo.getExpiryTimeInMs()
        late = {run for (run,), (at,) in self.due.iterator() if at <= now}
        if not late:
            return
        blocks = sorted(
            tuple(place) for place, (rows,) in self.early.iterator()
            if place[0] in late and not all(row[6] for row in rows)
        )
        out: list = []
        for run, places in groupby(blocks, key=lambda place: place[0]):
            sha = self.account.getValue((run,))[3]
            for place in places:
                (rows,) = self.early.getValue(place)
                out += [(run, row[0], GAP, [], None, sha) for row in rows if not row[6]]
                self.early.updateValue(place, ([(*row[:6], True) for row in rows],))
                if len(out) >= FRAME:
                    yield self._frame(out)
                    out = []
        for run in late:
            self.due.removeKey((run,))
        if out:
            yield self._frame(out)

    def _frame(self, out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["run", "sequence", "verdict", "exceeded", "totals", "last_event_sha256"])

    def _numbers(self, text: str) -> list[Decimal]:
        return [Decimal(t) for t in text.split(",")] if text else [Decimal(0)] * len(self.counters)

    def _amounts(self, text: str | None) -> list[tuple[int, Decimal]]:
        return [(i, Decimal(t)) for i, t in enumerate(text.split(",")) if t] if text else []

    def _caps(self, limits: str | None) -> list[tuple[int, str, Decimal]]:
        """Index, name and largest admitted total of the counters with a limit."""
        return [(i, self.counters[i], EXACT.add(limit, self.tolerance)) for i, limit in self._amounts(limits)]

    def _judge(self, kind, totals, requested, caps) -> tuple:
        asks = kind == "precheck"
        more = dict(self._amounts(requested)) if asks else {}
        names = [
            c for i, c, cap in caps
            if (EXACT.add(totals[i], more[i]) if i in more else totals[i]) > cap
        ]
        if asks:
            verdict = "precheck_rejected" if names else "precheck_passed"
        else:
            verdict = "post_account_exceeded" if names else "usage_recorded"
        return verdict, names

    def close(self) -> None:
        pass


class Blocks:
    """Waiting rows of one run: at most the block in hand and the next turn's in memory.

    Rows come in the order of their sequence, so a block left behind is written at once.
    """

    def __init__(self, early, run: int, stored: bool) -> None:
        self.early, self.run, self.stored = early, run, stored
        self.blocks: dict[int, dict[int, tuple]] = {}
        self.known: set[int] = set()
        self.changed: set[int] = set()

    def of(self, at: int, ahead: int) -> dict[int, tuple]:
        number = at // BLOCK
        if number not in self.blocks:
            for other in [b for b in self.blocks if b != ahead // BLOCK]:
                self._write(other)
            found = self.early.getValue((self.run, number)) if self.stored else None
            if found is not None:
                self.known.add(number)
            self.blocks[number] = {row[0]: tuple(row) for row in found[0]} if found is not None else {}
        return self.blocks[number]

    def put(self, at: int, ahead: int, row: tuple) -> None:
        self.of(at, ahead)[at] = row
        self.changed.add(at // BLOCK)

    def take(self, at: int) -> tuple:
        self.changed.add(at // BLOCK)
        return self.blocks[at // BLOCK].pop(at)

    def write(self) -> None:
        for number in list(self.blocks):
            self._write(number)

    def _write(self, number: int) -> None:
        rows = self.blocks.pop(number)
        if number in self.changed:
            if rows:
                self.early.updateValue((self.run, number), ([rows[at] for at in sorted(rows)],))
                self.stored = True
            elif number in self.known:
                self.early.removeKey((self.run, number))
        self.known.discard(number)
        self.changed.discard(number)


def _as_text(amounts: str, keep_zero: bool) -> Column:
    """Decimals of all counters between commas."""
    cells = []
    for c in COUNTERS:
        cell = F.col(amounts)[c].cast("decimal(38,12)")
        kept = cell if keep_zero else F.when(cell != 0, cell)
        cells.append(F.coalesce(kept.cast("string"), F.lit("")))
    return F.when(F.col(amounts).isNotNull(), F.concat_ws(",", *cells))


def budget_verdicts(events: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """Stateful transformation of a streaming (or batch) event table.

    One row per event, with the counters beyond their limits and the totals in the order of
    ``COUNTERS``.  A sequence number seen before is a broken log: its row comes out as
    ``sequence_repeated`` and moves no total.  With ``patience_ms`` (streams only) events
    that have waited that long, by processing time, behind a missing one come out as
    ``sequence_gap``, once each; should the gap close later, their verdicts follow.
    """
    rows = events.select(
        F.pmod(F.xxhash64("run"), F.lit(BUCKETS)).cast("int").alias("bucket"),
        "run",
        "sequence",
        "event_type",
        _as_text("used", False).alias("used"),
        F.when(F.col("event_type") == "precheck", _as_text("requested", False)).alias("requested"),
        F.when(F.col("sequence") == 0, _as_text("limits", True)).alias("limits"),
        F.col("event_sha256").alias("sha"),
    )
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=BudgetAccount(COUNTERS, TOLERANCE, patience_ms),
        outputStructType=OUTPUT_SCHEMA,
        outputMode="Append",
        timeMode="None" if patience_ms is None else "ProcessingTime",
    )


ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def waiting_events(spark: SparkSession, checkpoint: str) -> DataFrame:
    """A ``sequence_gap`` row for every event the state of a stopped stream still holds
    and no timer has reported."""
    held = (
        spark.read.format("statestore").option("stateVarName", "early").load(checkpoint)
        .select(F.col("user_map_key.run").alias("run"), F.explode("user_map_value.held").alias("row"))
        .select("run", "row.sequence", "row.told")
    )
    account = (
        spark.read.format("statestore").option("stateVarName", "account").load(checkpoint)
        .select(F.col("user_map_key.run").alias("run"), F.col("user_map_value.sha").alias("last_event_sha256"))
    )
    return held.where("not told").join(account, "run").select(
        "run", "sequence", F.lit(GAP).alias("verdict"),
        F.array().cast("array<string>").alias("exceeded"),
        F.lit(None).cast("array<double>").alias("totals"),
        "last_event_sha256",
    )


def account_stream(
    spark: SparkSession, source: str, target: str, checkpoint: str, patience_ms: int | None = None,
    files_per_batch: int = 64, **trigger,
):
    """Start the accounting over the log files of a folder; returns the streaming query.

    Progress and state live in ``checkpoint``, so a restart goes on where it stopped.
    ``trigger`` is passed on, such as ``processingTime="1 minute"`` or ``availableNow=True``.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    events = (
        spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(source)
    )
    return (
        budget_verdicts(events, patience_ms)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )


def account_files(
    spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 64
) -> DataFrame:
    """Run the accounting over all log files present, in bounded micro-batches.

    A finite log has no later events, so what waits at its end is behind a gap that never
    closes: those rows come from the state when the stream has ended.  A later run over
    more files goes on from the checkpoint, and may still close the gap.
    """
    run = account_stream(
        spark, source, target, checkpoint, files_per_batch=files_per_batch, availableNow=True
    )
    run.awaitTermination()
    verdicts = spark.read.schema(OUTPUT_SCHEMA).parquet(target)
    return verdicts.unionByName(waiting_events(spark, checkpoint))
