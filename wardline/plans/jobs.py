"""Jobs and requests over time: events are what jobs of a user and day do."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import advisories, model
from wardline.plans.registry import facts, pick, query
from wardline.streaming import deadlines

HOURS = 6
JOBS = """SELECT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS job, event_id, ts, CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'wait' WHEN 'signup' THEN 'resume' WHEN 'purchase' THEN 'done' ELSE 'progress' END AS kind FROM events"""
RUNNING = "p.phase = 'running' AND e.t >= p.deadline"
PHASE = f"CASE WHEN {RUNNING} THEN 'timeout' ELSE p.phase END"


@query(f"""WITH RECURSIVE e AS (SELECT job, kind, epoch_us(ts) AS t, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS n FROM ({JOBS})),
w(job, n, phase, deadline, done) AS (SELECT job, n, CASE kind WHEN 'start' THEN 'running' ELSE 'none' END, CASE kind WHEN 'start' THEN t + {HOURS * 3_600_000_000} ELSE 0 END, CAST(NULL AS BIGINT) FROM e WHERE n = 1
UNION ALL SELECT e.job, e.n, CASE WHEN {PHASE} = 'none' AND e.kind = 'start' OR {PHASE} = 'waiting' AND e.kind = 'resume' THEN 'running' WHEN {PHASE} = 'running' AND e.kind = 'wait' THEN 'waiting' WHEN {PHASE} = 'running' AND e.kind = 'done' THEN 'complete' ELSE {PHASE} END,
  CASE WHEN {PHASE} = 'none' AND e.kind = 'start' OR {PHASE} = 'waiting' AND e.kind = 'resume' THEN e.t + {HOURS * 3_600_000_000} ELSE p.deadline END, CASE WHEN {PHASE} = 'running' AND e.kind = 'done' THEN e.t ELSE p.done END FROM w p JOIN e ON e.job = p.job AND e.n = p.n + 1),
l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY job ORDER BY n DESC) = 1), m AS (SELECT max(t) AS now FROM e)
SELECT job, CASE WHEN phase = 'running' AND deadline <= now THEN 'timeout' ELSE phase END AS phase, CASE WHEN phase = 'timeout' OR phase = 'running' AND deadline <= now THEN deadline WHEN phase = 'complete' THEN done END AS at FROM l, m""")
def deadline_outcomes(spark, sf_dir):
    """How the jobs of each user and day stand at the time of the last event."""
    e = facts(spark, sf_dir, JOBS, "events")
    now = e.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    return deadlines.outcomes(deadlines.replay(e, "job", "ts", "event_id", "kind", HOURS * 3600), "job", "event_id", now)


RUNS = f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS instance, user_id, event_id, ts, event_type IN ('view', 'signup') AS begins, event_type IN ('purchase', 'error') AS over, {pick('event_id', ('a', 'b'))} AS half FROM events"""


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY ts, event_id) AS n FROM ({RUNS})),
w(instance, n, event_id, running, admitted) AS (SELECT DISTINCT instance, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]), false FROM e
UNION ALL SELECT e.instance, e.n, e.event_id, CASE WHEN begins AND NOT list_contains(running, user_id) AND len(running) < 2 THEN list_append(running, user_id) WHEN over THEN list_filter(running, lambda u: u <> user_id) ELSE running END,
  begins AND NOT list_contains(running, user_id) AND len(running) < 2 FROM w JOIN e ON e.instance = w.instance AND e.n = w.n + 1)
SELECT instance, event_id, admitted, CAST(len(running) AS INT) AS running FROM w WHERE n > 0""")
def jobs_admitted(spark, sf_dir):
    """At most two users' jobs run at a time on each day's instance."""
    return deadlines.admitted(facts(spark, sf_dir, RUNS, "events"), "instance", "user_id", "ts", "event_id", "begins", "over")


@query()
def limiter_bounded(spark, sf_dir):
    """Requests of users on each day's instance, which holds twenty windows; the oldest goes. Tested against a plain loop."""
    return deadlines.limit_bounded(facts(spark, sf_dir, RUNS, "events"), "instance", "user_id", "ts", "event_id", limit=2, most=20)


#: Orders are batches of questions, their lines what is asked; some answers lack their last result, some orders have none.
ASKED = "SELECT l_orderkey AS batch, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS pos, 'p' || l_partkey AS name, CAST(l_linenumber AS VARCHAR(9)) AS version, l_partkey, l_suppkey FROM lineitem"
VULNS = "CASE WHEN l_partkey % 4 = 0 THEN 0 WHEN l_partkey % 4 = 1 THEN 2 ELSE 1 END"


@query(f"""WITH q AS ({ASKED}), b AS (SELECT batch, count(*) AS asked FROM q GROUP BY batch), ok AS (SELECT batch FROM b WHERE batch % 11 > 0 AND batch % 13 > 0)
SELECT batch, CAST(pos AS INT) AS pos, name, 'V-' || l_suppkey || '-' || i AS id FROM q JOIN ok USING (batch), range(2) r(i) WHERE i < {VULNS}
UNION ALL SELECT batch, NULL, 'failed', CASE WHEN batch % 13 = 0 THEN '-1' ELSE CAST(asked - 1 AS VARCHAR) END || ' of ' || asked FROM b WHERE batch % 11 = 0 OR batch % 13 = 0""")
def answers_zipped(spark, sf_dir):
    q = facts(spark, sf_dir, ASKED, "lineitem").withColumn("pos", F.col("pos").cast("int"))
    ids = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), F.expr(VULNS)), lambda i: F.struct(F.concat_ws("-", F.lit("V"), "l_suppkey", i).alias("id")))
    odd = F.when(F.col("l_partkey") % 4 == 0, F.array(F.struct(F.lit("../x").alias("id")))).otherwise(ids)
    results = q.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", odd.alias("vulns")))), lambda x: F.struct(x["vulns"].alias("vulns"))).alias("results"))
    results = results.withColumn("results", F.when(F.col("batch") % 11 == 0, F.slice("results", F.lit(1), F.size("results") - 1)).otherwise(F.col("results")))
    found, failed = advisories.zip_answers(q.select("batch", "pos", "name", "version"), results.where("batch % 13 > 0").select("batch", F.to_json(F.struct("results")).alias("body")))
    return found.select("batch", "pos", "name", "id").unionByName(failed.select("batch", F.lit(None).cast("int").alias("pos"), F.lit("failed").alias("name"), F.concat_ws(" of ", F.col("got").cast("string"), F.col("asked").cast("string")).alias("id")))


#: Suppliers are components of their nation, parts flows from them; a batch holds three.
SOURCES = "SELECT 'n' || s_nationkey AS run_id, 's' || s_suppkey AS component_id FROM supplier"
OUT_FLOWS = "SELECT 'n' || s_nationkey AS run_id, 'f' || p_partkey AS flow_id, CASE WHEN p_partkey % 9 = 0 THEN 'gone' ELSE 's' || s_suppkey END AS source FROM part JOIN supplier ON p_partkey % 10 + 1 = s_suppkey"


@query(f"""WITH RECURSIVE c AS ({SOURCES}), f AS ({OUT_FLOWS}), x AS (SELECT run_id, 0 AS late, component_id AS unit, 0 AS behind, component_id AS element_id FROM c UNION ALL SELECT f.run_id, 0, source, 1, flow_id FROM f JOIN c ON c.run_id = f.run_id AND c.component_id = f.source UNION ALL SELECT run_id, 1, flow_id, 0, flow_id FROM f WHERE source = 'gone'),
k AS (SELECT *, (row_number() OVER (PARTITION BY run_id, late, unit ORDER BY behind, element_id) - 1) // 3 AS chunk FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY late, unit, chunk) AS i FROM (SELECT run_id, late, unit, chunk, count(*) AS n FROM k GROUP BY ALL)),
w(run_id, i, rooms, batch) AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM z
UNION ALL SELECT z.run_id, z.i, CASE WHEN len(list_filter(rooms, lambda r: r >= n)) = 0 THEN list_append(rooms, 3 - n) ELSE list_transform(rooms, lambda r, j: CASE WHEN j = list_position(list_transform(rooms, lambda q: q >= n), true) THEN r - n ELSE r END) END,
  CASE WHEN len(list_filter(rooms, lambda r: r >= n)) = 0 THEN len(rooms) ELSE list_position(list_transform(rooms, lambda q: q >= n), true) - 1 END FROM w JOIN z ON z.run_id = w.run_id AND z.i = w.i + 1)
SELECT k.run_id, element_id, CAST(batch AS INT) AS batch FROM k JOIN z ON z.run_id = k.run_id AND z.late = k.late AND z.unit = k.unit AND z.chunk = k.chunk JOIN w ON w.run_id = z.run_id AND w.i = z.i""")
def elements_batched(spark, sf_dir):
    return model.batches(facts(spark, sf_dir, SOURCES, "supplier"), facts(spark, sf_dir, OUT_FLOWS, "part", "supplier"), 3)
