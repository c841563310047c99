"""Deadlines, held windows and caps: batch against plain loops, stream against batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from wardline.streaming import deadlines as D

T0 = dt.datetime(2024, 1, 1)


def rows_of(rng, n):
    kinds = ["start", "resume", "wait", "done", "progress", None]
    return [(rng.randrange(12), i, T0 + dt.timedelta(seconds=rng.randrange(6000)), rng.choice(kinds)) for i in range(n)]


def us(t):
    return int((t - T0).total_seconds()) * 1_000_000 + 1704067200 * 1_000_000


def test_phases():
    m = 600 * 1_000_000
    assert D.advance("none", 0, 5, "start", m) == ("running", 5 + m) and D.advance("running", 9, 9, "done", m) == ("timeout", 9) and D.advance("running", 9, 8, "done", m) == ("complete", 9)
    assert D.advance("waiting", 9, 10**12, "resume", m) == ("running", 10**12 + m) and D.advance("waiting", 9, 10**12, "done", m) == ("waiting", 9) and D.advance("timeout", 9, 10, "resume", m) == ("timeout", 9)


def plain(rows, now):
    found = {}
    for job in {r[0] for r in rows}:
        phase, deadline, at = "none", 0, None
        for _, _, t, kind in sorted((r for r in rows if r[0] == job), key=lambda r: (r[2], r[1])):
            before, (phase, deadline) = phase, D.advance(phase, deadline, us(t), kind or "", 600 * 1_000_000)
            if phase == "complete" != before:
                at = us(t)
        if phase == "running" and deadline <= now:
            phase = "timeout"
        found[job] = (phase, deadline if phase == "timeout" else at)
    return found


def test_batch_and_stream_agree(spark, tmp_path):
    rows = rows_of(random.Random(8), 150)
    kind = "job long, id long, ts timestamp, kind string"
    events = spark.createDataFrame(rows, kind)
    end = T0 + dt.timedelta(seconds=9000)
    got = {r.job: (r.phase, r.at) for r in D.outcomes(D.replay(events, "job", "ts", "id", "kind"), "job", "id", us(end)).collect()}
    want = plain(rows, us(end))
    assert got == want and {p for p, _ in want.values()} >= {"timeout", "complete"}
    # the stream gets the same events in order, then one of another job that moves the watermark on
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        ordered = sorted(rows, key=lambda r: (r[2], r[1]))
        parts = [ordered[:70], ordered[70:], [(99, 1000, T0 + dt.timedelta(seconds=20000), "progress")], [(99, 1001, T0 + dt.timedelta(seconds=20001), "progress")]]
        for i, part in enumerate(parts):
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={i}"))
        source = spark.readStream.schema("job long, id long, ts timestamp, kind string").option("maxFilesPerTrigger", 1).option("latestFirst", "false").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = D.stream(source, "job", "ts", "id", "kind").writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        said = [(r.job, (r.phase, r.at)) for r in spark.table("ended").collect()]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(said) == sorted((j, x) for j, x in want.items() if x[0] in D.ENDED)


def test_held_windows(spark):
    rng = random.Random(3)
    rows = [(i % 2, rng.randrange(30), i, T0 + dt.timedelta(seconds=rng.randrange(9000))) for i in range(600)]
    got = {r.id: r.allowed for r in D.limit_bounded(spark.createDataFrame(rows, "i int, k int, id long, ts timestamp"), "i", "k", "ts", "id", limit=2, most=5).collect()}
    want = {}
    for i in (0, 1):
        held, swept = {}, None
        for _, k, n, t in sorted((r for r in rows if r[0] == i), key=lambda r: (r[3], r[2])):
            s = us(t) // 1_000_000
            if swept is None or s - swept >= 60:
                held, swept = {x: v for x, v in held.items() if s - v[1] < 3600}, s
            if k not in held or s - held[k][1] >= 3600:
                held.pop(k, None)
                while len(held) >= 5:
                    del held[next(iter(held))]
                held[k] = [1, s]
                want[n] = True
            else:
                want[n] = held[k][0] < 2
                held[k][0] += want[n]
    assert got == want and False in want.values()


def test_cap(spark):
    rows = [("a", 1, 0, True, False), ("a", 2, 1, True, False), ("a", 3, 2, True, False), ("a", 1, 3, True, False), ("a", 1, 4, False, True), ("a", 3, 5, True, False), ("a", 9, 6, False, True), ("b", 3, 7, True, None), ("b", 3, 8, None, False)]
    d = spark.createDataFrame([(i, j, n, T0 + dt.timedelta(seconds=n), s, e) for i, j, n, s, e in rows], "i string, job int, id int, ts timestamp, s boolean, e boolean")
    got = {r.id: (r.admitted, r.running) for r in D.admitted(d, "i", "job", "ts", "id", "s", "e").collect()}
    assert got == {0: (True, 1), 1: (True, 2), 2: (False, 2), 3: (False, 2), 4: (False, 1), 5: (True, 2), 6: (False, 2), 7: (True, 1), 8: (False, 1)}
    assert D.admitted(d.where(F.lit(False)), "i", "job", "ts", "id", "s", "e").count() == 0
