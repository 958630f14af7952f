"""Keyed state machines: rate limits, circuit breakers, retry deadlines.

Each micro-batch hands a key its rows of that batch; they are put in time order there. State is
small by construction: accepted timestamps of one window, one breaker, one delivery.

Where event-time timers forget state, a row at or behind the watermark cannot be put in order any
more. It is not dropped: it leaves the state as it is and comes out marked as late.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

MICROS = 1_000_000


def _ordered(rows: Iterable[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


def _split_late(rows: pd.DataFrame, watermark_ms: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(rows in time, rows at or behind the watermark)."""
    late = rows["at"] <= watermark_ms * 1000
    return rows[~late], rows[late]


def _unfiltered(rows: DataFrame, delay: str, *columns: str) -> DataFrame:
    """``columns`` and ``at`` (microseconds) of every row, with a watermark on ``ts``.

    Only a column that carries the watermark makes Spark drop late rows before the processor sees
    them, so that column is left out; the watermark itself still moves and fires timers.
    """
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.select(*columns, F.unix_micros("ts").alias("at"))


# ---- sliding-window rate limit -------------------------------------------------------------


def admit(accepted: list[int], at: int, limit: int, window: int) -> bool:
    """Forget what left the window, then admit while at most ``limit`` remain (so limit + 1 pass)."""
    while accepted and accepted[0] <= at - window:
        accepted.pop(0)
    if len(accepted) <= limit:
        insort(accepted, at)
        return True
    return False


class RateLimiter(StatefulProcessor):
    def __init__(self, limit: int, window_s: int) -> None:
        self.limit, self.window = limit, window_s * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("accepted", "at bigint")

    def _keep(self, accepted: list[int]) -> None:
        """Store the window and wake up when its newest entry has left it."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if accepted:
            self.state.put([(t,) for t in accepted])
            self.handle.registerTimer((accepted[-1] + self.window) // 1000 + 1)
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        accepted = [r[0] for r in self.state.get()]
        batch, late = _split_late(_ordered(rows, ["at", "event_id"]), timerValues.getCurrentWatermarkInMs())
        allowed = [admit(accepted, int(t), self.limit, self.window) for t in batch["at"]]
        if len(batch):
            self._keep(accepted)
        ids = [*batch["event_id"], *late["event_id"]]
        yield pd.DataFrame({"key": [key[0]] * len(ids), "event_id": ids, "allowed": pd.Series([*allowed, *[None] * len(late)], dtype="object")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing in the window any more: forget the key."""
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit(events: DataFrame, limit: int, window_s: int, delay: str = "10 minutes") -> DataFrame:
    """``(key, event_id, allowed)`` for every event. ``events(key, event_id, ts)``; rejected events do not count.

    ``allowed`` is null for an event more than ``delay`` behind the newest one of earlier batches: it comes too late to be judged.
    """
    return _unfiltered(events, delay, "key", "event_id").groupBy("key").transformWithStateInPandas(
        statefulProcessor=RateLimiter(limit, window_s), outputStructType=StructType.fromDDL("key long, event_id long, allowed boolean"),
        outputMode="Append", timeMode="EventTime")


# ---- circuit breaker -----------------------------------------------------------------------

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


def advance(state: tuple[str, int, int, int], at: int, ok: bool, failures: int, successes: int, timeout: int):
    """Next (state, failures, successes, changed_at) and the state changes this outcome causes.

    Successes while closed do not reset the failure count. An open breaker lets nothing through
    until the timeout has passed, so outcomes before that are not recorded.
    """
    name, bad, good, since = state
    changes: list[str] = []
    if name == OPEN:
        if at - since <= timeout:
            return state, changes
        name, good, since = HALF_OPEN, 0, at
        changes.append(HALF_OPEN)
    if ok:
        good += 1
        if name == HALF_OPEN and good >= successes:
            name, bad, since = CLOSED, 0, at
            changes.append(CLOSED)
    else:
        bad += 1
        if name == HALF_OPEN or (name == CLOSED and bad >= failures):
            name, since = OPEN, at
            changes.append(OPEN)
    return (name, bad, good, since), changes


class Breaker(StatefulProcessor):
    def __init__(self, failures: int, successes: int, timeout_s: int) -> None:
        self.failures, self.successes, self.timeout = failures, successes, timeout_s * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "name string, bad int, good int, since bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        current = tuple(self.state.get()) if self.state.exists() else (CLOSED, 0, 0, 0)
        out = []
        for row in _ordered(rows, ["at", "event_id"]).itertuples():
            current, changes = advance(current, int(row.at), bool(row.ok), self.failures, self.successes, self.timeout)
            out += [(key[0], int(row.event_id), change) for change in changes]
        self.state.update(current)
        yield pd.DataFrame(out, columns=["key", "event_id", "state"]).astype({"key": "int64", "event_id": "int64", "state": "object"})

    def close(self) -> None:
        pass


def circuit_breaker(outcomes: DataFrame, failures: int = 5, successes: int = 3, timeout_s: int = 60) -> DataFrame:
    """State changes ``(key, event_id, state)``. ``outcomes(key, event_id, ts, ok)``."""
    keyed = outcomes.select("key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "ok")
    return keyed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Breaker(failures, successes, timeout_s), outputStructType=StructType.fromDDL("key long, event_id long, state string"),
        outputMode="Append", timeMode="None")


# ---- retry deadlines -----------------------------------------------------------------------


def attempt(state: tuple[int, int], at: int, ok: bool, waits: Sequence[int], max_retries: int):
    """Next (attempts, due) after an outcome, and what it makes known.

    ``due`` is the moment of the pending retry in microseconds, 0 without one. A retry that became
    due before this outcome is reported first; success or exhaustion starts afresh.
    """
    attempts, due = state
    known = [(attempts, due, "retry_due")] if due and due <= at else []
    if ok:
        return (0, 0), known
    attempts += 1
    if attempts > max_retries:
        return (0, 0), [*known, (attempts, at, "exhausted")]
    return (attempts, at + waits[min(attempts - 1, len(waits) - 1)] * MICROS), known


class RetryTimer(StatefulProcessor):
    def __init__(self, waits_s: Sequence[int], max_retries: int) -> None:
        self.waits, self.max_retries = list(waits_s), max_retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("delivery", "attempts int, due bigint")

    @staticmethod
    def _rows(key, known) -> pd.DataFrame:
        rows = [(key[0], n, due // MICROS, what) for n, due, what in known]
        return pd.DataFrame(rows, columns=["key", "attempt", "due_s", "what"]).astype({"key": "int64", "attempt": "int32", "due_s": "int64", "what": "object"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        current = tuple(self.state.get()) if self.state.exists() else (0, 0)
        batch, late = _split_late(_ordered(rows, ["at", "event_id"]), timerValues.getCurrentWatermarkInMs())
        known = [(current[0], int(at), "late") for at in late["at"]]
        if batch.empty:
            yield self._rows(key, known)
            return
        for row in batch.itertuples():
            current, more = attempt(current, int(row.at), bool(row.ok), self.waits, self.max_retries)
            known += more
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if current[1]:
            self.state.update(current)
            self.handle.registerTimer(current[1] // 1000)
        else:
            self.state.clear()
        yield self._rows(key, known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, due = self.state.get() if self.state.exists() else (0, 0)
        if due:
            self.state.update((attempts, 0))
            yield self._rows(key, [(attempts, due, "retry_due")])

    def close(self) -> None:
        pass


def retry_deadlines(attempts: DataFrame, waits_s: Sequence[int] = (60, 300, 900, 3600), max_retries: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Failed deliveries come back when their wait is over in event time, until retries run out.

    ``attempts(key, event_id, ts, ok)``; output ``(key, attempt, due_s, what)`` with what = retry_due, exhausted or late.
    A late outcome, more than ``delay`` behind the newest one of earlier batches, changes nothing; its row
    holds the attempts so far and its own time as due_s.
    """
    return _unfiltered(attempts, delay, "key", "event_id", "ok").groupBy("key").transformWithStateInPandas(
        statefulProcessor=RetryTimer(waits_s, max_retries), outputStructType=StructType.fromDDL("key long, attempt int, due_s long, what string"),
        outputMode="Append", timeMode="EventTime")
