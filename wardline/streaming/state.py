"""Stateful operators: each as a batch replay in event order and, where it is one, as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardline.operators.windows import in_ranges, running_sums, walk

LIMIT, WINDOW_S = 5, 3600


def _walk(times: list[float], start: float | None, n: int, limit: int, window: float) -> tuple[list[bool], list[float], float | None, int]:
    """Fixed windows that begin at the first event after the last one ended."""
    allowed, starts = [], []
    for t in times:
        if start is None or t >= start + window:
            start, n = t, 0
        allowed.append(n < limit)
        n += n < limit
        starts.append(start)
    return allowed, starts, start, n


def limit_events(events: DataFrame, key: str, ts: str, order: str, limit: int = LIMIT, window_s: int = WINDOW_S) -> DataFrame:
    """(key, order, allowed): the first ``limit`` events of each window of a key pass. Windows are anchored at events, so
    each key's times are walked in (ts, order), with the window's start and count as all that is held."""
    def step(state: tuple[int | None, int], t: int) -> tuple[tuple[int | None, int], bool]:
        start, n = state
        if start is None or t >= start + window_s * 1_000_000:
            start, n = t, 0
        return (start, n + (n < limit)), n < limit

    d = events.select(key, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("__t"))
    return walk(d, [key], ["__t", order], ["__t"], lambda: (None, 0), step, "allowed", "boolean").select(key, order, "allowed")


def limit_stream(events: DataFrame, key: str, ts: str, order: str, limit: int = LIMIT, window_s: int = WINDOW_S) -> DataFrame:
    """The same over a stream of events that arrive in order for each key. A key's state goes when the watermark
    passes the end of its window, where the next event would begin a new one anyway."""
    kinds = events.schema[key].dataType.simpleString(), events.schema[order].dataType.simpleString()

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values([ts, order])
        allowed, _, start, n = _walk([t.timestamp() for t in rows[ts]], start, n, limit, window_s)
        state.update((start, n))
        state.setTimeoutTimestamp(max(int((start + window_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], order: rows[order].values, "allowed": allowed})

    return events.withWatermark(ts, "1 hour").groupBy(key).applyInPandasWithState(update, f"{key} {kinds[0]}, {order} {kinds[1]}, allowed boolean", "start double, n int", "append", GroupStateTimeout.EventTimeTimeout)


def distinct_calls(events: DataFrame, identity: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """An event of an identity once. On a stream the state of an identity lasts as long as the watermark lets it."""
    if events.isStreaming:
        return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(identity)
    w = Window.partitionBy(*identity).orderBy(ts)
    return events.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def furthest_stage(events: DataFrame, job: str, stage_rank: str, terminal: str) -> DataFrame:
    """(job, stage_rank, done): a job's stage only moves forward, and once done it stays so."""
    return events.groupBy(job).agg(F.max(stage_rank).alias(stage_rank), F.bool_or(terminal).alias("done"))


def live_entries(updates: DataFrame, key: str, ts: str, now: str, ttl_s: int = 3600) -> DataFrame:
    """Keys whose last update is within the time to live at ``now``."""
    return updates.groupBy(key).agg(F.max(ts).alias("updated")).where(F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros("updated") <= ttl_s * 1_000_000)


def active_jobs(events: DataFrame, job: str, ts: str, terminal: str) -> DataFrame:
    """(job, ts, active): how many jobs have begun and not ended as each event comes."""
    first = F.row_number().over(Window.partitionBy(job).orderBy(ts)) == 1
    ends = F.col(terminal) & (F.sum(F.col(terminal).cast("int")).over(Window.partitionBy(job).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)) == 1)
    d = events.withColumn("__delta", F.when(first, 1).otherwise(0) - F.when(ends, 1).otherwise(0))
    # the running total over all jobs is summed by ranges of time: no task walks all events
    total = running_sums(in_ranges(d, [], [ts, job], "active"), [ts, job], {"x": F.col("__delta").cast("bigint")})
    return total.select(job, ts, (F.col("x_before") + F.col("__delta")).alias("active"))
