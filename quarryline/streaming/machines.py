"""Keyed machines over streams, in the order of event time.

Events of a key are kept as state until the watermark has passed them, and are
then folded in the order of (time, order); so the result is that of the batch
fold over the same events, whatever order they arrive in, as long as they are
not later than the watermark. A key holds the events of the lateness alone, one
timer, and the machine's own state. Rows of a batch are taken one by one, never
as a group. State is kept by RocksDB, which ``transformWithState`` asks for.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from quarryline.operators.state import JOB_MOVES, KEEP_SECONDS
from quarryline.sources.sinks import RETRIES, RETRY_SECONDS

LATENESS = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that machines need; to be set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InOrder(StatefulProcessor):
    """Folds a key's events in order. ``step(state, event)`` gives the next state (a tuple, or None to forget) and rows; ``ends(state)`` the time in µs at which a state is forgotten, or None."""

    def __init__(self, event: str, state: str, out: tuple[str, ...], step: Callable, ends: Callable = lambda state: None):
        self.schemas, self.out, self.step, self.ends = (event, state), out, step, ends
        self.columns = StructType.fromDDL(event).names

    def init(self, handle) -> None:
        self.handle = handle
        event, state = self.schemas
        self.waiting, self.state = handle.getMapState("waiting", "at long, place long", event), handle.getValueState("state", state)

    def handleInputRows(self, key, rows, timerValues):
        for row in rows:
            self.waiting.updateValue((row["__at"], row["__place"]), tuple(row[c] for c in self.columns))
        return self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self._advance(key, timerValues)

    def close(self) -> None:
        pass

    def _advance(self, key, times):
        from pyspark.sql import Row

        now, made = times.getCurrentWatermarkInMs() * 1000, []
        waiting = sorted(tuple(k) for k in self.waiting.keys())
        due = [k for k in waiting if k[0] <= now]
        state = tuple(self.state.get()) if self.state.exists() else None
        for k in due:
            state, rows = self.step(state, self.waiting.getValue(k))
            made += rows
            self.waiting.removeKey(k)
        end = None if state is None else self.ends(state)
        if end is not None and end < now and len(due) == len(waiting):
            state, end = None, None
        if state is None:
            self.state.clear()
        elif due:
            self.state.update(state)
        ahead = [k[0] for k in waiting[len(due) :][:1]] + ([end + 1] if end is not None else [])
        wanted = min(ahead, default=None)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if wanted is not None:
            self.handle.registerTimer(max(-(-wanted // 1000), times.getCurrentWatermarkInMs() + 1))
        for values in made:
            yield Row(**dict(zip(self.out, (*key, *values), strict=True)))


def in_order(events: DataFrame, *, key: str, ts: str, place: str, event: tuple[Column, ...], state: str, out: str, step: Callable[[tuple | None, tuple], tuple[tuple | None, list[tuple]]], ends: Callable[[tuple], Any] = lambda state: None, lateness: str = LATENESS) -> DataFrame:
    """The rows that ``step`` gives for each event of the stream, in order of ``ts``, then ``place`` (a long, different for each event of a key).

    event: the columns that ``step`` gets; out: the schema of the result, the
    key first. Rows without a key, time or place are left out.
    """
    named = events.withWatermark(ts, lateness).select(
        F.col(key).alias("__key"), F.col(ts).alias("__ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("__at"), F.col(place).cast("long").alias("__place"), *[c.alias(f"e{i}") for i, c in enumerate(event)]
    )
    known = named.where("__key IS NOT NULL AND __at IS NOT NULL AND __place IS NOT NULL")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema.fields[4:])
    processor = InOrder(schema, state, tuple(StructType.fromDDL(out).names), step, ends)
    return known.groupBy("__key").transformWithState(processor, out, "Append", "EventTime")


# ---------------------------------------------------------------- jobs


def job_transitions(events: DataFrame, *, key: str = "job_id", ts: str = "ts", place: str = "event_id", move: str = "move", report: str = "report", keep_seconds: int = KEEP_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """job_id, event_id, move, legal, status, report: each event with the job's state after it; the batch form is ``state.job_transitions``.

    A move that the state does not allow leaves it and comes out with legal =
    false. Finished jobs are forgotten after ``keep_seconds``.
    """
    keep = keep_seconds * 1_000_000

    def step(state, event):
        at, place, move, report = event
        if state is not None and state[2] is not None and at - state[2] > keep:
            state = None
        status = None if state is None else state[0]
        after = JOB_MOVES.get((status, move))
        if after is None:
            return state, [(place, move, False, status, None if state is None else state[1])]
        new = (after, report if report is not None else (None if state is None else state[1]), at if after != "pending" else None)
        return new, [(place, move, True, new[0], new[1])]

    at = F.unix_micros(F.col(ts).cast("timestamp"))
    event = (at, F.col(place).cast("long"), F.col(move), F.col(report))
    out = "job_id long, event_id long, move string, legal boolean, status string, report string"
    return in_order(events, key=key, ts=ts, place=place, event=event, state="status string, report string, finished long", out=out, step=step, ends=lambda s: None if s[2] is None else s[2] + keep, lateness=lateness)


# ---------------------------------------------------------------- quota


def quota(events: DataFrame, *, user: str, key: str, ts: str, is_scan: Column, premium: Column, used: Column, pays: Column | None = None, limit: int, lateness: str = LATENESS) -> DataFrame:
    """user, key, accepted of each request in the order of event time; ``pays`` marks events that make their user premium from then on, and are no requests."""

    def step(state, event):
        scan, premium, used, pays, key = event
        count, paid = (used or 0, False) if state is None else state
        if pays:
            return (count, True), []
        ok = not scan or premium or paid or count < limit
        return (count + ok, paid), [(key, ok)]

    event = (is_scan, premium, used.cast("long"), F.lit(False) if pays is None else pays, F.col(key).cast("long"))
    # of events at one instant payments come first, as in an as-of join
    order = F.col(key).cast("long") if pays is None else F.when(pays, F.col(key).cast("long") - F.lit(1 << 62)).otherwise(F.col(key).cast("long"))
    return in_order(events.withColumn("__order", order), key=user, ts=ts, place="__order", event=event, state="count long, paid boolean", out="user long, key long, accepted boolean", step=step, lateness=lateness)


# ---------------------------------------------------------------- retries


class Retrying(StatefulProcessor):
    """The tries of a job. Results come in; the next try of a job that failed for a passing reason goes out by a timer, other ends at once."""

    OUT = "job_id long, what string, attempt int, at timestamp, error string"

    def __init__(self, retries: int, seconds: int):
        self.retries, self.delay = retries, seconds * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "due long, attempt int, error string")
        self.seen = handle.getValueState("seen", "attempt int, ended boolean")

    def handleInputRows(self, key, rows, timerValues):
        from datetime import datetime, timezone

        when = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc)
        attempt, ended = self.seen.get() if self.seen.exists() else (-1, False)
        for row in sorted(rows, key=lambda r: r["attempt"]):
            if ended or row["attempt"] <= attempt:
                continue  # a result that was delivered again
            attempt, at = row["attempt"], row["ms"]
            if row["error"] is None:
                ended, end = True, "done"
            elif not row["transient"]:
                ended, end = True, "rejected"
            elif attempt >= self.retries:
                ended, end = True, "dead"
            else:
                self.open.appendValue((at + self.delay, attempt + 1, row["error"]))
                self.handle.registerTimer(max(at + self.delay, timerValues.getCurrentWatermarkInMs() + 1))
                continue
            yield self._row(key, end, attempt, when(at), row["error"])
        self.seen.update((attempt, ended))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        from datetime import datetime, timezone

        now, left = timerValues.getCurrentWatermarkInMs(), []
        for due, attempt, error in [tuple(x) for x in self.open.get()] if self.open.exists() else []:
            if due <= now:
                yield self._row(key, "try", attempt, datetime.fromtimestamp(due / 1000, timezone.utc), error)
            else:
                left.append((due, attempt, error))
        if left:
            self.open.put(left)
        else:
            self.open.clear()

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, what, attempt, at, error):
        from pyspark.sql import Row

        return Row(job_id=key[0], what=what, attempt=attempt, at=at, error=error)


def retries(results: DataFrame, *, key: str = "job_id", ts: str = "ts", retries: int = RETRIES, seconds: int = RETRY_SECONDS, lateness: str = "0 seconds") -> DataFrame:
    """job_id, what, attempt, at, error from results of tries (job_id, ts, attempt, error, transient), attempt 0 first.

    what: ``try`` (this attempt is due at that time), ``done``, ``rejected``
    (an error that no further try mends) or ``dead`` (the last try failed too).
    A result that is delivered twice counts once; the stream's clock is its
    watermark, so a restart loses no timer.
    """
    rows = results.withWatermark(ts, lateness).select(F.col(key).cast("long").alias("__key"), F.col(ts).alias("__ts"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), F.col("attempt").cast("int").alias("attempt"), "error", F.coalesce("transient", F.lit(False)).alias("transient"))
    return rows.where("__key IS NOT NULL AND ms IS NOT NULL AND attempt IS NOT NULL").groupBy("__key").transformWithState(Retrying(retries, seconds), Retrying.OUT, "Append", "EventTime")
