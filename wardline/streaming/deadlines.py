"""Deadlines that are armed anew, limits of what is held, and a cap on what runs: as a batch replay and, for deadlines, as a
stream with timers. The steps are the same functions in both."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wardline.operators.windows import walk

TIMEOUT_S, MOST_KEYS, MOST_RUNNING, LIMIT, WINDOW_S = 600, 10_000, 2, 5, 3600
ENDED = ("complete", "timeout")


def advance(phase: str, deadline: int, t: int, kind: str, timeout: int) -> tuple[str, int]:
    """A job's phase and deadline after an event at t: start and resume arm the clock, wait and done stop it, and what comes at
    or after the deadline of a running job finds it timed out. Events out of turn change nothing."""
    if phase == "running" and t >= deadline:
        phase = "timeout"
    if phase in ENDED:
        return phase, deadline
    if (kind, phase) in (("start", "none"), ("resume", "waiting")):
        return "running", t + timeout
    if phase == "running" and kind in ("wait", "done"):
        return {"wait": "waiting", "done": "complete"}[kind], deadline
    return phase, deadline


def replay(events: DataFrame, job: str, ts: str, order: str, kind: str, timeout_s: int = TIMEOUT_S) -> DataFrame:
    """(job, order, t, phase, deadline) after each event of a job, in (ts, order); times in microseconds. Null kinds change nothing."""
    def step(state: tuple[str, int], t: int, k: str | None):
        state = advance(*state, t, k or "", timeout_s * 1_000_000)
        return state, {"phase": state[0], "deadline": state[1]}

    d = events.select(job, order, F.col(kind).alias("__k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("__t"))
    walked = walk(d, [job], ["__t", order], ["__t", "__k"], lambda: ("none", 0), step, "__x", "struct<phase:string,deadline:bigint>")
    return walked.select(job, order, F.col("__t").alias("t"), F.col("__x.phase").alias("phase"), F.col("__x.deadline").alias("deadline"))


def outcomes(replayed: DataFrame, job: str, order: str, now: int) -> DataFrame:
    """(job, phase, at) as it stands at ``now`` (microseconds): a running job whose deadline has passed is timed out at it."""
    last = replayed.groupBy(job).agg(F.max_by(F.struct("phase", "deadline", "t"), F.struct("t", order)).alias("x"), F.min(F.when(F.col("phase") == "complete", F.col("t"))).alias("done"))
    late = (F.col("x.phase") == "running") & (F.col("x.deadline") <= now)
    phase = F.when(late, "timeout").otherwise(F.col("x.phase"))
    return last.select(job, phase.alias("phase"), F.when(phase == "timeout", F.col("x.deadline")).when(phase == "complete", F.col("done")).alias("at"))


class Deadlines(StatefulProcessor):
    """One timer for each running job; an armed clock replaces the one before. Says once how a job ended."""

    def __init__(self, ts: str, order: str, kind: str, timeout_s: int, job: str):
        self.ts, self.order, self.kind, self.timeout, self.job = ts, order, kind, timeout_s * 1_000_000, job

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "phase string, deadline bigint")

    def _put(self, phase: str, deadline: int) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if phase == "running":
            self.handle.registerTimer(-(-deadline // 1000))
        self.state.update((phase, deadline))

    def _said(self, key, phase: str, at: int) -> pd.DataFrame:
        return pd.DataFrame({self.job: [key], "phase": [phase], "at": [at]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        phase, deadline = self.state.get() if self.state.exists() else ("none", 0)
        for r in pd.concat(list(rows)).sort_values([self.ts, self.order]).itertuples(index=False):
            t = int(getattr(r, self.ts).value // 1000)
            before, (phase, deadline) = phase, advance(phase, deadline, t, getattr(r, self.kind) or "", self.timeout)
            if phase in ENDED and before not in ENDED:
                yield self._said(key[0], phase, deadline if phase == "timeout" else t)
        self._put(phase, deadline)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        phase, deadline = self.state.get()
        if phase == "running" and expiredTimerInfo.getExpiryTimeInMs() * 1000 >= deadline:
            self._put("timeout", deadline)
            yield self._said(key[0], "timeout", deadline)

    def close(self) -> None:
        pass


def stream(events: DataFrame, job: str, ts: str, order: str, kind: str, timeout_s: int = TIMEOUT_S, delay: str = "1 minute") -> DataFrame:
    """(job, phase, at) of each job as it ends, on a stream whose events of a job arrive in order. Timers run on event time: a timeout
    is said once the watermark passes the deadline. Needs the RocksDB state store."""
    key = events.schema[job].dataType.simpleString()
    return events.withWatermark(ts, delay).groupBy(job).transformWithStateInPandas(Deadlines(ts, order, kind, timeout_s, job), f"{job} {key}, phase string, at bigint", "append", "eventTime")


def limit_bounded(events: DataFrame, instance: str, key: str, ts: str, order: str, limit: int = LIMIT, window_s: int = WINDOW_S, most: int = MOST_KEYS) -> DataFrame:
    """(instance, order, allowed): fixed windows of each key, of which an instance holds at most ``most``: a new one drops the
    oldest. Windows that are over go first, at most once a minute. What an instance holds depends on all its events, so its
    events are walked in order; instances are independent."""
    window, sweep = window_s * 1_000_000, 60_000_000

    def step(state, t: int, k):
        windows, swept = state
        if swept is None or t - swept >= sweep:
            for old in [x for x, (_, start) in windows.items() if t - start >= window]:
                del windows[old]
            swept = t
        n, start = windows.get(k, (0, None))
        if start is None or t - start >= window:
            windows.pop(k, None)
            while len(windows) >= most:
                windows.popitem(last=False)
            windows[k] = (1, t)
            return (windows, swept), True
        if n >= limit:
            return (windows, swept), False
        windows[k] = (n + 1, start)  # keeps its place
        return (windows, swept), True

    d = events.select(instance, key, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("__t"))
    return walk(d, [instance], ["__t", order], ["__t", key], lambda: (OrderedDict(), None), step, "allowed", "boolean").select(instance, order, "allowed")


def admitted(events: DataFrame, instance: str, job: str, ts: str, order: str, starts: str, ends: str, most: int = MOST_RUNNING) -> DataFrame:
    """(instance, order, admitted, running): a start is admitted while fewer than ``most`` jobs of its instance run; an end lets
    its job go. A start of a running job is not admitted again; other events say how many run. starts, ends: boolean columns."""
    def step(running: frozenset, j, begins: bool | None, over: bool | None):
        new = bool(begins) and j not in running and len(running) < most
        after = running | {j} if new else running - {j} if over else running
        return after, {"admitted": new, "running": len(after)}

    d = events.select(instance, job, order, starts, ends, F.unix_micros(F.col(ts).cast("timestamp")).alias("__t"))
    walked = walk(d, [instance], ["__t", order], [job, starts, ends], frozenset, step, "__x", "struct<admitted:boolean,running:int>")
    return walked.select(instance, order, "__x.admitted", "__x.running")
