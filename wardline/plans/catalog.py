"""The engine's operators applied to the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import guards, paths, text, versions
from wardline.functions import scoring as S
from wardline.operators import evaluation as ev
from wardline.operators import history, scoring, views, windows
from wardline.plans.registry import QUERIES, SQL, query, table
from wardline.streaming import state

# --- findings and evidence in the shape of the scorer, from orders and lineitem ---


def threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding for each order; a third of them claim a CWE, every fourth has an assumption."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("threat_id"), (k % 5 + 1).cast("int").alias("impact"), (k % 7 % 5 + 1).cast("int").alias("likelihood"), (k % 4 == 0).cast("int").alias("assumptions"),
        F.when(k % 3 == 0, F.array(F.lit("CWE-1"))).otherwise(F.array().cast("array<string>")).alias("cwe"),
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evidence item for each line: its kind from the flags, its place from part and line number."""
    li = table(spark, sf_dir, "lineitem")
    r, s = F.col("l_returnflag"), F.col("l_linestatus")
    kind = F.when(r == "A", "code").when((r == "N") & (s == "O"), "scanner").when(r == "N", "inference").otherwise("gap")
    return li.select(
        F.col("l_orderkey").cast("string").alias("threat_id"), F.col("l_linenumber").alias("pos"), kind.alias("kind"),
        F.when(kind == "scanner", "semgrep").otherwise("detector").alias("source"), F.when(kind == "gap", "gap:authz_missing").otherwise("rule").alias("rule_id"),
        (F.col("l_partkey") % 10).cast("string").alias("file"), (F.col("l_linenumber") % 3).alias("line"),
        F.when(kind == "gap", (F.col("l_suppkey") % 101) / F.lit(100.0)).alias("certainty"), F.when(kind == "gap", F.array(F.lit("CWE-1"))).alias("gap_cwe"),
    )


SCORED_SQL = """
WITH t AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS threat_id, CAST(o_orderkey % 5 + 1 AS INT) AS impact, CAST(o_orderkey % 7 % 5 + 1 AS INT) AS likelihood,
    CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS assumptions, o_orderkey % 3 = 0 AS claims FROM orders
), c AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS threat_id, l_linenumber AS pos,
    CASE WHEN l_returnflag = 'A' THEN 'code' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'scanner' WHEN l_returnflag = 'N' THEN 'inference' ELSE 'gap' END AS cat,
    l_partkey % 10 AS file, l_linenumber % 3 AS line, (l_suppkey % 101) / 100.0::DOUBLE AS certainty FROM lineitem
), p AS (
  SELECT *, CASE cat WHEN 'code' THEN 350 WHEN 'scanner' THEN 250 WHEN 'gap' THEN CAST(floor(certainty * 300 + 0.5) AS INT) ELSE 0 END AS points FROM c
), k AS (
  SELECT * FROM p QUALIFY cat = 'gap' OR row_number() OVER (PARTITION BY threat_id, cat = 'gap', file, line ORDER BY points DESC, pos) = 1
), g AS (
  SELECT threat_id, coalesce(max(points) FILTER (cat = 'code'), 0) + coalesce(max(points) FILTER (cat = 'scanner'), 0) + coalesce(max(points) FILTER (cat = 'gap'), 0) AS total,
    count(DISTINCT CASE WHEN cat <> 'inference' THEN cat END) AS n, bool_or(cat = 'gap') AS has_gap, bool_or(cat = 'inference') AS has_inf, bool_or(cat IN ('code', 'scanner')) AS observed,
    coalesce(sum(floor(certainty * 1000 + 0.5)) FILTER (cat = 'gap'), 0) AS cs
  FROM k GROUP BY threat_id
), m AS (
  SELECT t.*, coalesce(n, 0) AS n, coalesce(observed, false) AS observed, has_gap, cs,
    greatest(0, least(1000, coalesce(total, 0) + CASE WHEN coalesce(n, 0) >= 2 THEN 100 ELSE 0 END + CASE WHEN coalesce(n, 0) = 0 AND coalesce(has_inf, false) THEN 200 ELSE 0 END - 150 * assumptions)) AS clamped
  FROM t LEFT JOIN g USING (threat_id)
), f AS (
  SELECT *, CAST(CASE WHEN n = 1 AND has_gap AND cs >= 800 AND claims AND clamped < 400 THEN 400 ELSE clamped END AS INT) AS milli,
    CASE WHEN impact * likelihood >= 20 THEN 'critical' WHEN impact * likelihood >= 12 THEN 'high' WHEN impact * likelihood >= 6 THEN 'medium' ELSE 'low' END AS severity FROM m
), scored AS (
  SELECT threat_id, impact, likelihood, milli, CASE WHEN observed THEN 'observed' ELSE 'inferred' END AS basis, severity,
    CASE WHEN milli >= 700 THEN 'high' WHEN milli >= 400 THEN 'medium' ELSE 'low' END AS confidence_label,
    CASE WHEN severity = 'critical' OR severity = 'high' AND milli >= 500 THEN 'fix_now' WHEN severity = 'high' OR severity = 'medium' AND milli >= 500 THEN 'fix_soon' ELSE 'monitor' END AS priority,
    milli >= 250 AS visible
  FROM f
)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(threats(spark, sf_dir), citations(spark, sf_dir))


@query(SCORED_SQL + "SELECT threat_id, milli, basis, severity, confidence_label, priority, visible FROM scored")
def confidence_points(spark, sf_dir):
    return scored(spark, sf_dir).select("threat_id", "milli", "basis", "severity", "confidence_label", "priority", "visible")


@query(SCORED_SQL + """SELECT CAST(row_number() OVER (ORDER BY CASE priority WHEN 'fix_now' THEN 0 WHEN 'fix_soon' THEN 1 ELSE 2 END, impact * likelihood DESC, milli DESC, threat_id) AS BIGINT) AS place, threat_id
FROM scored WHERE visible ORDER BY place LIMIT 100""")
def visible_ranked(spark, sf_dir):
    """A page of the ranked view: the limit is the feature."""
    from pyspark.sql import Window

    page = views.ranked(scored(spark, sf_dir).where("visible")).limit(100)
    w = Window.orderBy(S.rank(F.col("priority"), S.PRIORITIES), F.desc(F.col("impact") * F.col("likelihood")), F.desc("milli"), "threat_id")
    return page.select(F.row_number().over(w).cast("bigint").alias("place"), "threat_id")


@query(SCORED_SQL + "SELECT threat_id, severity, milli FROM scored WHERE priority = 'fix_now' ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, milli DESC, threat_id LIMIT 5")
def fix_now_topk(spark, sf_dir):
    return views.fix_now(scored(spark, sf_dir)).select("threat_id", "severity", "milli")


@query(SCORED_SQL + "SELECT severity, priority, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY ALL")
def priority_matrix(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("severity", "priority").agg(F.count("*").alias("n"))


@query("""SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_linenumber, CASE WHEN r >= 20 THEN 'critical' WHEN r >= 12 THEN 'high' WHEN r >= 6 THEN 'medium' ELSE 'low' END AS severity
FROM (SELECT *, (l_linenumber % 5 + 1) * (l_partkey % 5 + 1) AS r FROM lineitem)""")
def severity_bands(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.severity(F.col("l_linenumber") % 5 + 1, F.col("l_partkey") % 5 + 1).alias("severity"))


@query("""WITH c AS (SELECT CAST(l_orderkey AS VARCHAR) AS threat_id, l_linenumber AS pos, l_partkey % 10 AS file, l_linenumber % 3 AS line,
  CASE WHEN l_returnflag = 'A' THEN 350 WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 250 WHEN l_returnflag = 'N' THEN 0 ELSE CAST(floor((l_suppkey % 101) / 100.0::DOUBLE * 300 + 0.5) AS INT) END AS points,
  l_returnflag = 'R' AS gap FROM lineitem)
SELECT threat_id, pos, points FROM c QUALIFY gap OR row_number() OVER (PARTITION BY threat_id, gap, file, line ORDER BY points DESC, pos) = 1""")
def best_per_location(spark, sf_dir):
    c = citations(spark, sf_dir)
    cat = S.category(F.col("kind"), F.col("source"), F.col("rule_id"))
    points = F.when(cat == "gap", S.gap_points(F.col("certainty"))).otherwise(F.coalesce(*(F.when(cat == k, v) for k, v in S.CATEGORY_POINTS.items()), F.lit(0)))
    return scoring.best_per_location(c.withColumn("category", cat).withColumn("points", points.cast("int"))).select("threat_id", "pos", "points")


# --- views ---


@query("""SELECT c_custkey, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AND r_name IN ('ASIA', 'EUROPE')""")
def facet_filter(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return views.facet_filter(c, {"c_mktsegment": ["BUILDING", "AUTOMOBILE"], "r_name": ["ASIA", "EUROPE"], "n_name": []}).select("c_custkey", "c_mktsegment", "n_name")


@query("SELECT DISTINCT o_orderpriority AS value, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 ELSE 5 END AS INT) AS rank FROM orders")
def facet_options(spark, sf_dir):
    return views.facet_options(table(spark, sf_dir, "orders"), "o_orderpriority", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(chr(10), text, source)), 'the hea')")
def fulltext_contains(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(views.contains(["text", "source"], "  The HEA ")).select("doc_id")


@query("""SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS n_o, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS n_f,
CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS n_p, CAST(count(*) FILTER (o_orderstatus = 'X') AS BIGINT) AS n_x FROM orders GROUP BY 1""")
def severity_pivot_zero_filled(spark, sf_dir):
    return views.pivot_counts(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ("O", "F", "P", "X"))


@query("""WITH t AS (SELECT o_custkey, (o_orderkey % 5 + 1) * (o_orderkey % 7 % 5 + 1) AS r FROM orders),
s AS (SELECT o_custkey, count(*) AS n, min(CASE WHEN r >= 20 THEN 0 WHEN r >= 12 THEN 1 WHEN r >= 6 THEN 2 ELSE 3 END) AS k FROM t GROUP BY 1)
SELECT c_custkey AS component_id, CAST(coalesce(n, 0) AS BIGINT) AS threat_count, CASE k WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END AS max_severity
FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def node_stats_max_rank(spark, sf_dir):
    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select(F.array("o_custkey").alias("component_ids"), S.severity(k % 5 + 1, k % 7 % 5 + 1).alias("severity"))
    return views.node_stats(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("component_id")), t)


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers and customers as components by key, a flow from supplier to customer nation for each line's order."""
    s = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("id"), F.when(F.col("s_suppkey") % 5 == 0, "actor").when(F.col("s_suppkey") % 7 == 0, "external_service").otherwise("backend").alias("type"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 11 == 0, "frontend").when(F.col("c_custkey") % 13 == 0, "auth_provider").otherwise("api").alias("type"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    f = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((-F.col("l_suppkey")).alias("source"), F.col("o_custkey").alias("target"))
    return s.unionByName(c), f


GRAPH_SQL = """WITH comp AS (
  SELECT -s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'actor' WHEN s_suppkey % 7 = 0 THEN 'external_service' ELSE 'backend' END AS type FROM supplier
  UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'frontend' WHEN c_custkey % 13 = 0 THEN 'auth_provider' ELSE 'api' END FROM customer
), flow AS (SELECT -l_suppkey AS source, o_custkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


@query(GRAPH_SQL + """SELECT id, type, CASE WHEN type IN ('external_service', 'auth_provider') THEN 'external' WHEN type IN ('actor', 'frontend') OR id IN (SELECT target FROM flow JOIN comp a ON a.id = source WHERE a.type = 'actor') THEN 'edge' ELSE 'internal' END AS exposure FROM comp""")
def exposure_class(spark, sf_dir):
    return views.exposure(*graph(spark, sf_dir))


@query(GRAPH_SQL + """, core AS (SELECT id FROM comp WHERE type IN ('external_service', 'auth_provider'))
SELECT id FROM core UNION SELECT target FROM flow WHERE source IN (SELECT id FROM core) UNION SELECT source FROM flow WHERE target IN (SELECT id FROM core)""")
def external_neighbours(spark, sf_dir):
    return views.neighbours(*graph(spark, sf_dir))


@query("""WITH f AS (SELECT o_orderkey AS pos, o_custkey % 25 AS source, o_orderkey % 25 AS target FROM orders), r AS (SELECT source, target, min(pos) AS first FROM f GROUP BY ALL)
SELECT f.pos, f.source, f.target, coalesce(r.first < f.pos, false) AS reverse FROM f LEFT JOIN r ON r.source = f.target AND r.target = f.source""")
def reverse_edge_flag(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 25).alias("source"), (F.col("o_orderkey") % 25).alias("target"))
    return views.reverse_edges(f)


# --- runs ---


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over customers: those with orders before and from 1995, the confidence from the number of orders."""
    o = table(spark, sf_dir, "orders")
    run = lambda d: d.groupBy(F.col("o_custkey").alias("key")).agg((F.count("*") * 100).alias("milli"))
    return run(o.where("o_orderdate < '1995-01-01'")), run(o.where("o_orderdate >= '1995-01-01'"))


RUNS_SQL = """WITH b AS (SELECT o_custkey AS key, count(*) * 100 AS milli FROM orders WHERE o_orderdate < '1995-01-01' GROUP BY 1),
a AS (SELECT o_custkey AS key, count(*) * 100 AS milli FROM orders WHERE o_orderdate >= '1995-01-01' GROUP BY 1),
st AS (SELECT c_custkey AS key, CASE c_custkey % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'false_positive' ELSE 'accepted' END AS status FROM customer WHERE c_custkey % 5 < 4)
"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where(k % 5 < 4).select(k.alias("key"), F.when(k % 4 == 0, "fixed").when(k % 4 == 1, "false_positive").otherwise("accepted").alias("status"))


@query(RUNS_SQL + """SELECT * FROM (SELECT coalesce(b.key, a.key) AS key, CASE WHEN a.milli >= 250 AND coalesce(b.milli >= 250, false) THEN 'persisting' WHEN a.milli >= 250 THEN 'new' WHEN b.milli >= 250 AND a.key IS NULL THEN 'not_found' WHEN b.milli >= 250 THEN 'dropped_below_cutoff' END AS status
FROM b FULL JOIN a ON b.key = a.key) WHERE status IS NOT NULL""")
def snapshot_diff(spark, sf_dir):
    return history.diff(*_runs(spark, sf_dir))


@query(RUNS_SQL + "SELECT b.key, CAST(b.milli AS BIGINT) AS milli FROM b LEFT JOIN st ON st.key = b.key WHERE b.milli >= 250 AND b.key NOT IN (SELECT key FROM a) AND coalesce(st.status, 'open') NOT IN ('fixed', 'false_positive')")
def carry_forward(spark, sf_dir):
    return history.carry_forward(*_runs(spark, sf_dir), _statuses(spark, sf_dir))


@query(RUNS_SQL + "SELECT coalesce(st.status, 'open') AS status, CAST(count(*) AS BIGINT) AS n FROM a LEFT JOIN st ON st.key = a.key GROUP BY 1")
def status_counts(spark, sf_dir):
    _, after = _runs(spark, sf_dir)
    return history.with_status(after, _statuses(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def first_wins_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key"))
    return history.first_of_key(d, "key", "doc_id").select("doc_id", "source")


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus = 'F' AS handled, CASE WHEN o_orderpriority IS NOT DISTINCT FROM lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AND row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 THEN 0 ELSE 1 END AS c FROM orders),
y AS (SELECT *, sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS band FROM x)
SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY band, handled, o_orderkey) AS INT) AS place FROM y""")
def stable_band_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").alias("handled"))
    return history.band_order(o, ["o_custkey"], "o_orderpriority", "handled", "o_orderkey").select("o_custkey", "o_orderkey", "place")


# --- windows, prefixes, ranges, similarity ---


@query("""WITH e AS (SELECT user_id, CAST(epoch_us(ts) // 60000000 AS BIGINT) AS lo, CAST(epoch_us(ts) // 60000000 + event_id % 600 AS BIGINT) AS hi FROM events),
s AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS st FROM e),
i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT user_id, min(lo) AS lo, max(hi) AS hi, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY user_id, island""")
def interval_merge(spark, sf_dir):
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("bigint")
    e = table(spark, sf_dir, "events").select("user_id", minute.alias("lo"), (minute + F.col("event_id") % 600).alias("hi"))
    return windows.merge_intervals(e, ["user_id"], "lo", "hi")


@query("""WITH RECURSIVE d AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
w AS (SELECT source, n, doc_id, CASE WHEN n_chars <= 20000 THEN n_chars ELSE 0 END AS used, n_chars <= 20000 AS taken FROM d WHERE n = 1
UNION ALL SELECT d.source, d.n, d.doc_id, CASE WHEN w.used + d.n_chars <= 20000 THEN w.used + d.n_chars ELSE w.used END, w.used + d.n_chars <= 20000 FROM w JOIN d ON d.source = w.source AND d.n = w.n + 1)
SELECT doc_id, source, taken FROM w""")
def skip_fit_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return windows.skip_fit(d, ["source"], "n_chars", ["doc_id"], 20_000).select("doc_id", "source", "taken")


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages),
o AS (SELECT DISTINCT split_part(path, '/', 1) AS prefix FROM p UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM p WHERE page_id % 2 = 0 AND contains(path, '/')),
h AS (SELECT page_id, prefix, len(string_split(prefix, '/')) AS depth FROM p JOIN o ON path = prefix OR starts_with(path, prefix || '/'))
SELECT page_id, prefix AS owner, CAST(depth AS INT) AS depth FROM h QUALIFY depth = max(depth) OVER (PARTITION BY page_id)""")
def longest_prefix_bind(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", "").alias("path"))
    parts = F.split("path", "/")
    hosts = p.select(F.get(parts, F.lit(0)).alias("prefix"))
    firsts = p.where((F.col("page_id") % 2 == 0) & F.col("path").contains("/")).select(F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("prefix"))
    owners = hosts.unionByName(firsts).distinct().withColumn("owner", F.col("prefix"))
    return windows.longest_prefix(p, "page_id", "path", owners, "owner", "prefix")


@query("""WITH r AS (SELECT p_partkey, p_size, p_size - 10 AS lo, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS hi FROM part)
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN r ON l_partkey = p_partkey AND l_quantity >= lo AND (hi IS NULL OR l_quantity < hi)""")
def range_join_versions(spark, sf_dir):
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") - 10).alias("lo"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("hi"))
    return windows.range_join(table(spark, sf_dir, "lineitem"), r, "l_partkey", "l_quantity", "lo", "hi").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))


WORDS_SQL = """WITH w AS (SELECT doc_id, lang, source, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) AS w FROM documents),
r AS (SELECT *, min(doc_id) OVER (PARTITION BY lang, source, w) AS rep FROM w WHERE len(w) > 0), u AS (SELECT * FROM r WHERE doc_id = rep)
"""


@query(WORDS_SQL + """SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE, 9) AS jaccard
FROM u a JOIN u b ON a.lang = b.lang AND a.source = b.source AND a.doc_id < b.doc_id
WHERE len(list_intersect(a.w, b.w)) >= 0.6 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))""")
def near_duplicate_docs(spark, sf_dir):
    """Pairs of different word sets, each under its representative; near_duplicate_classes says who has which."""
    return windows.similar_pairs(table(spark, sf_dir, "documents"), "doc_id", "text", ["lang", "source"]).withColumn("jaccard", F.round("jaccard", 9))


@query(WORDS_SQL + "SELECT doc_id, rep AS representative FROM r")
def near_duplicate_classes(spark, sf_dir):
    return windows.word_sets(table(spark, sf_dir, "documents"), "doc_id", "text", ["lang", "source"]).select(F.col("id").alias("doc_id"), "representative")


@query("""WITH RECURSIVE e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id),
r AS (SELECT a AS node, min(b) AS m FROM e GROUP BY 1) SELECT node, least(node, m) AS root FROM r""")
def connected_components(spark, sf_dir):
    """Copies as a graph: each text's documents in a chain by id."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    chain = d.withColumn("b", F.lead("doc_id").over(Window.partitionBy("h").orderBy("doc_id"))).where("b is not null")
    return windows.components(chain.select(F.col("doc_id").alias("a"), "b"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_gap(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""WITH g AS (SELECT s_nationkey AS file, s_suppkey % 6 AS kind, CASE WHEN s_suppkey % 50 = 0 THEN 'repository' ELSE 'file' END AS scope FROM supplier)
SELECT DISTINCT c_custkey, c_custkey % 6 AS kind, c_nationkey AS file FROM customer JOIN g ON g.kind = c_custkey % 6 AND (g.file = c_nationkey OR g.scope = 'repository')""")
def or_join_falsify(spark, sf_dir):
    g = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file"), (F.col("s_suppkey") % 6).alias("kind"), F.when(F.col("s_suppkey") % 50 == 0, "repository").otherwise("file").alias("scope"))
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 6).alias("kind"), F.col("c_nationkey").alias("file"))
    return ev.falsified_controls(g, c)


# --- evaluation ---


@query("""WITH k AS (SELECT DISTINCT CAST(epoch_us(ts) // 604800000000 AS BIGINT) AS run, user_id AS key FROM events), s AS (SELECT run, count(*) AS n FROM k GROUP BY 1),
c AS (SELECT x.run AS a, y.run AS b, count(*) AS c FROM k x JOIN k y ON x.key = y.key AND x.run < y.run GROUP BY ALL)
SELECT p.run AS a, q.run AS b, round(coalesce(c, 0) / (p.n + q.n - coalesce(c, 0))::DOUBLE, 9) AS jaccard FROM s p JOIN s q ON p.run < q.run LEFT JOIN c ON c.a = p.run AND c.b = q.run""")
def pairwise_jaccard_runs(spark, sf_dir):
    return ev.pairwise_jaccard(_weeks(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 9))


def _weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 604_800_000_000).cast("bigint").alias("run"), F.col("user_id").alias("key"), "event_type")


@query("SELECT runs, CAST(count(*) AS BIGINT) AS keys FROM (SELECT user_id, count(DISTINCT epoch_us(ts) // 604800000000) AS runs FROM events GROUP BY 1) GROUP BY 1")
def presence_histogram(spark, sf_dir):
    return ev.presence(_weeks(spark, sf_dir))


@query("""WITH k AS (SELECT user_id, count(DISTINCT epoch_us(ts) // 604800000000) AS r, count(DISTINCT event_type) AS v FROM events GROUP BY 1), n AS (SELECT count(DISTINCT epoch_us(ts) // 604800000000) AS n FROM events)
SELECT CAST(count(*) AS BIGINT) AS keys, CAST(count(*) FILTER (v = 1) AS BIGINT) AS same, CASE WHEN count(*) > 0 THEN count(*) FILTER (v = 1) / count(*)::DOUBLE END AS share FROM k, n WHERE r = n""")
def agreement_all_runs(spark, sf_dir):
    w = _weeks(spark, sf_dir)
    return ev.agreement(w, w.select("run").distinct().count(), "event_type")


@query("""WITH p AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), t AS (SELECT sum(n) AS t, sum(n) FILTER (a = b) AS s FROM p),
c AS (SELECT sum(x * y) AS c FROM (SELECT a, sum(n) AS x FROM p GROUP BY 1) l JOIN (SELECT b, sum(n) AS y FROM p GROUP BY 1) r ON a = b)
SELECT CAST(t AS BIGINT) AS n, round(s / t::DOUBLE, 9) AS agreement, round((s / t::DOUBLE - c / (t * t)::DOUBLE) / (1 - c / (t * t)::DOUBLE), 9) AS kappa FROM t, c""")
def cohen_kappa(spark, sf_dir):
    return ev.kappa(table(spark, sf_dir, "labels"), "quality", "toxic").select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


@query("""WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 1 AND quality = 1) AS fn, count(*) FILTER (toxic = 0 AND quality = 1) AS tn FROM labels)
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END AS recall, CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE END AS false_rate FROM c""")
def confusion_rates(spark, sf_dir):
    return ev.confusion(table(spark, sf_dir, "labels"), F.col("toxic") == 1, F.col("quality") == 0)


@query("""SELECT event_type, CAST(count(*) FILTER (user_id % 3 = 0) AS BIGINT) AS run_0, CAST(count(*) FILTER (user_id % 3 = 1) AS BIGINT) AS run_1, CAST(count(*) FILTER (user_id % 3 = 2) AS BIGINT) AS run_2 FROM events GROUP BY 1""")
def crosstab_code_run(spark, sf_dir):
    return ev.crosstab(table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("run")), "event_type", "run", [0, 1, 2])


@query("""WITH u AS (SELECT text, source, 1 AS a, 0 AS b FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT text, source, 0, 1 FROM documents WHERE doc_id % 2 = 1)
SELECT sha256(text) AS h, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b FROM u GROUP BY text HAVING sum(a) <> sum(b)""")
def multiset_equal(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256))
    return ev.multiset_difference(d.where("doc_id % 2 = 0").select("h"), d.where("doc_id % 2 = 1").select("h"))


@query("""SELECT CAST(l_orderkey % 10 AS BIGINT) AS analysis_id, CAST(count(*) AS BIGINT) AS calls, CAST(sum(l_quantity) AS BIGINT) AS input_tokens, CAST(sum(l_partkey) AS BIGINT) AS output_tokens,
round((sum(CAST(l_quantity AS BIGINT)) * 3.0 + sum(l_suppkey) * 0.3 + sum(l_linenumber) * 3.75 + sum(l_partkey) * 15.0) / 1000000, 6) AS cost FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem) GROUP BY 1""")
def usage_cost_rollup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    ledger = li.select(
        (F.col("l_orderkey") % 10).alias("analysis_id"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("call_id"), F.lit(1).alias("attempt"),
        F.col("l_quantity").cast("bigint").alias("input_tokens"), F.col("l_partkey").alias("output_tokens"), F.col("l_suppkey").alias("cache_read_tokens"), F.col("l_linenumber").cast("bigint").alias("cache_write_tokens"),
    )
    cost = S.token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read_tokens"), F.col("cache_write_tokens"), 3.0, 15.0)
    return ev.usage_totals(ledger).select("analysis_id", "calls", "input_tokens", "output_tokens", F.round(cost, 6).alias("cost"))


@query("""SELECT c_nationkey AS "group", round(max(c_custkey % 4 + 1) * (1 - avg((c_custkey % 1000) / 1000.0::DOUBLE)) * log2(1 + count(*)), 6) AS value FROM customer GROUP BY 1""")
def question_value(spark, sf_dir):
    g = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("group"), (F.col("c_custkey") % 4 + 1).alias("weight"), (F.col("c_custkey") % 1000 / F.lit(1000.0)).alias("confidence"))
    return ev.question_value(g).withColumn("value", F.round("value", 6))


@query("""SELECT s_nationkey, CAST(sum(s_suppkey) AS BIGINT) AS planted, CAST(sum(s_suppkey % 7) AS BIGINT) AS found FROM supplier GROUP BY ROLLUP (s_nationkey)""")
def pooled_totals(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias("planted"), (F.col("s_suppkey") % 7).alias("found"))
    return ev.pooled(s, "s_nationkey", ["planted", "found"])


@query("""WITH m AS (SELECT l_orderkey AS finding, l_partkey AS issue FROM lineitem), f AS (SELECT *, min(finding) OVER (PARTITION BY issue) AS f FROM m)
SELECT finding, bool_and(f < finding) AS duplicate FROM f GROUP BY 1""")
def duplicate_findings(spark, sf_dir):
    return ev.duplicate_findings(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding"), F.col("l_partkey").alias("issue")))


MATCH_SQL = """SELECT l_orderkey AS finding, p_partkey AS issue FROM lineitem JOIN part ON l_suppkey = p_partkey % 100 + 1 WHERE p_size % 2 = 0 AND l_returnflag || l_linestatus = 'AF'
UNION SELECT l_orderkey, p_partkey FROM lineitem JOIN part ON l_suppkey = p_partkey % 100 + 1 WHERE p_size % 3 = 0 AND l_returnflag || l_linestatus = 'RF'"""


@query(MATCH_SQL)
def match_findings(spark, sf_dir):
    """The findings of all orders against the issues of all parts."""
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding"), F.col("l_suppkey").alias("file"), F.concat("l_returnflag", "l_linestatus").alias("kind"))
    i = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("issue"), (F.col("p_partkey") % 100 + 1).alias("file"), F.when(F.col("p_size") % 2 == 0, "AF").alias("gap_kind"), F.when(F.col("p_size") % 3 == 0, "RF").alias("rule_id"))
    return ev.match_findings(f, i)


@query(MATCH_SQL)
def match_findings_all(spark, sf_dir):
    """The same; the name under which it was registered while match_findings read a part of the orders."""
    return match_findings(spark, sf_dir)


# --- text ---


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<script\b[^>]*>')) AS BIGINT) AS scripts, CAST(len(regexp_extract_all(html, '(?i)<script\b[^>]*\bsrc\s*=\s*["''][^"'']+')) AS BIGINT) AS external, regexp_matches(html, '(?i)<meta[^>]+content-security-policy') AS csp FROM pages""")
def script_tags(spark, sf_dir):
    from wardline.operators import extract

    return extract.script_summary(table(spark, sf_dir, "pages"), "html").select("page_id", "scripts", "external", "csp")


@query(r"""WITH p AS (SELECT page_id, lower(regexp_replace(regexp_replace(url, '^https?://[^/]*/?', ''), '[?#].*$', '')) || CASE page_id % 6 WHEN 0 THEN '/src/auth.ts' WHEN 1 THEN '/docs/readme.md' WHEN 2 THEN '/logo.png' WHEN 3 THEN '/package.json' WHEN 4 THEN '/lib/util.py' ELSE '/notes' END AS path FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'ignore' WHEN 3 THEN 'high' WHEN 4 THEN 'medium' ELSE 'low' END AS tier,
CASE page_id % 6 WHEN 0 THEN 'authentication or administration' WHEN 1 THEN 'docs/' WHEN 2 THEN 'binary or media (.png)' WHEN 3 THEN 'package manifest' WHEN 4 THEN 'source in lib/' ELSE 'other' END AS reason FROM p""")
def path_classify(spark, sf_dir):
    m = F.col("page_id") % 6
    end = F.when(m == 0, "/src/auth.ts").when(m == 1, "/docs/readme.md").when(m == 2, "/logo.png").when(m == 3, "/package.json").when(m == 4, "/lib/util.py").otherwise("/notes")
    path = F.concat(F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]*/?", ""), r"[?#].*$", ""), end)
    c = paths.classify(path, F.lit(None).cast("bigint"))
    return table(spark, sf_dir, "pages").select("page_id", c["tier"].alias("tier"), c["reason"].alias("reason"))


@query(r"""SELECT doc_id, sha256(regexp_replace(text, '(?i)\b((?:password|token|secret|api_key)\s*[:=]\s*)[^\s]+', '\1[REDACTED]', 'g')) AS redacted FROM documents""")
def keyword_assignment_redact(spark, sf_dir):
    """The part of redaction that a pattern without lookbehind can say."""
    out = F.regexp_replace("text", r"(?i)\b((?:password|token|secret|api_key)\s*[:=]\s*)[^\s]+", "$1[REDACTED]")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(out, 256).alias("redacted"))


@query()
def secret_redaction(spark, sf_dir):
    """All vendor shapes; lookbehind keeps it from the oracle, tests hold it against fixtures."""
    out = guards.redact(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", guards.secret_kinds(F.col("text")).alias("kinds"), F.sha2(out, 256).alias("redacted"))


@query(r"""SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM documents""")
def norm_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.norm(F.col("text")).alias("norm"))


@query("""WITH m(a, b) AS (VALUES ('A01:2021', 'A01:2025'), ('A02:2021', 'A04:2025'), ('A03:2021', 'A05:2025'), ('A04:2021', 'A06:2025'), ('A05:2021', 'A02:2025'), ('A06:2021', 'A03:2025'), ('A07:2021', 'A07:2025'), ('A08:2021', 'A08:2025'), ('A09:2021', 'A09:2025'), ('A10:2021', 'A01:2025'))
SELECT s_suppkey, list_sort(list_distinct([b, 'A07:2025'])) AS codes FROM supplier JOIN m ON a = 'A' || lpad(CAST(s_suppkey % 10 + 1 AS VARCHAR), 2, '0') || ':2021'""")
def owasp_tag_map(spark, sf_dir):
    tag = F.concat(F.lit("owasp-a"), F.lpad((F.col("s_suppkey") % 10 + 1).cast("string"), 2, "0"), F.lit(":2021 - Name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.owasp_codes(F.array(tag, F.lit("A07:2025"), F.lit("A03"))).alias("codes"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_extract_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'A' WHEN 2 THEN 'L' ELSE 'P' END AS av, CASE p_size % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'L' ELSE 'N' END AS c, CASE p_partkey % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'L' ELSE 'N' END AS i, p_partkey % 2 = 0 AS ch FROM part),
w AS (SELECT *, CASE av WHEN 'N' THEN 0.85 WHEN 'A' THEN 0.62 WHEN 'L' THEN 0.55 ELSE 0.2 END::DOUBLE AS wav, CASE c WHEN 'H' THEN 0.56 WHEN 'L' THEN 0.22 ELSE 0 END::DOUBLE AS wc, CASE i WHEN 'H' THEN 0.56 WHEN 'L' THEN 0.22 ELSE 0 END::DOUBLE AS wi FROM s),
x AS (SELECT *, 1 - (1 - wc) * (1 - wi) AS iss, 8.22::DOUBLE * wav * 0.77::DOUBLE * (CASE WHEN ch THEN 0.68 ELSE 0.62 END)::DOUBLE * 0.85::DOUBLE AS ex FROM w),
y AS (SELECT *, CASE WHEN ch THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS im FROM x),
z AS (SELECT *, floor(least(CASE WHEN ch THEN 1.08::DOUBLE * (im + ex) ELSE im + ex END, 10) * 100000 + 0.5) AS sc FROM y),
q AS (SELECT p_partkey, CASE WHEN im <= 0 THEN 0.0::DOUBLE WHEN CAST(sc AS BIGINT) % 10000 = 0 THEN sc / 100000 ELSE (floor(sc / 10000) + 1) / 10 END AS score FROM z)
SELECT p_partkey, round(score, 4) AS score, CASE WHEN score >= 9 THEN 'CRITICAL' WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' WHEN score > 0 THEN 'LOW' END AS label FROM q""")
def cvss_scores(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    pick = lambda x, a, b, c: F.when(x % 3 == 0, a).when(x % 3 == 1, b).otherwise(c)
    vector = F.concat(F.lit("CVSS:3.1/AV:"), F.when(k % 4 == 0, "N").when(k % 4 == 1, "A").when(k % 4 == 2, "L").otherwise("P"), F.lit("/AC:L/PR:L/UI:N/S:"), F.when(k % 2 == 0, "C").otherwise("U"), F.lit("/C:"), pick(s, "H", "L", "N"), F.lit("/I:"), pick(k, "H", "L", "N"), F.lit("/A:N"))
    score = versions.cvss_score(vector)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 4).alias("score"), versions.severity_label(score).alias("label"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN (a.p_size, a.p_partkey % 10, a.p_partkey % 3) < (b.p_size, b.p_partkey % 10, b.p_partkey % 3) THEN -1 WHEN (a.p_size, a.p_partkey % 10, a.p_partkey % 3) > (b.p_size, b.p_partkey % 10, b.p_partkey % 3) THEN 1 ELSE 0 END AS cmp
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def version_order(spark, sf_dir):
    """Each part's size and key as a version, against the next part's."""
    v = lambda p: F.concat_ws(".", f"{p}.p_size", F.col(f"{p}.p_partkey") % 10, F.col(f"{p}.p_partkey") % 3)
    p = table(spark, sf_dir, "part")
    j = p.alias("a").join(p.alias("b"), F.col("b.p_partkey") == F.col("a.p_partkey") + 1)
    ka, kb = versions.version_key(v("a")), versions.version_key(v("b"))
    return j.select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), F.when(ka < kb, -1).when(ka > kb, 1).otherwise(0).alias("cmp"))


# --- state ---


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, n, event_id, t AS start, 1 AS used, true AS allowed FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN e.t >= w.start + 3600000000 THEN e.t ELSE w.start END,
  CASE WHEN e.t >= w.start + 3600000000 THEN 1 WHEN w.used < 5 THEN w.used + 1 ELSE w.used END, e.t >= w.start + 3600000000 OR w.used < 5 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id, allowed FROM w""")
def fixed_window_limiter(spark, sf_dir):
    return state.limit_events(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_idempotent(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return state.distinct_calls(e, ["user_id", "event_type"], "at").select("user_id", "event_type", "event_id")


@query("SELECT user_id, CAST(max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END) AS INT) AS stage, bool_or(event_type = 'error') AS done FROM events GROUP BY 1")
def stage_tracker(spark, sf_dir):
    stages = ("view", "click", "signup", "purchase")
    e = table(spark, sf_dir, "events").select("user_id", S.rank(F.col("event_type"), stages).alias("stage"), (F.col("event_type") == "error").alias("ends"))
    return state.furthest_stage(e, "user_id", "stage", "ends")


@query("""SELECT p_partkey, (p_size, p_partkey % 10) >= (10, 5) AND (p_size, p_partkey % 10) < (30, 0) AS hit FROM part""")
def version_ranges(spark, sf_dir):
    v = versions.version_key(F.concat_ws(".", "p_size", F.col("p_partkey") % 10, F.lit("0")))
    lo, hi = versions.version_key(F.lit("10.5")), versions.version_key(F.lit("v30.0.0"))
    return table(spark, sf_dir, "part").select("p_partkey", versions.in_range(v, lo, hi, versions.version_key(F.lit(None).cast("string"))).alias("hit"))


@query("""SELECT c_custkey, CASE WHEN n LIKE '-%' THEN chr(39) || n ELSE n END AS cell FROM (SELECT c_custkey, CAST(c_nationkey - 12 AS VARCHAR) AS n FROM customer)""")
def csv_cells(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.csv_guard((F.col("c_nationkey") - 12).cast("string")).alias("cell"))


@query("""SELECT source AS repo, lang AS language, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS INT) AS place FROM documents GROUP BY source, lang""")
def language_histogram(spark, sf_dir):
    from wardline.operators import intake

    d = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.concat(F.lit("src/x."), "lang").alias("path"), F.col("doc_id").alias("pos"))
    return intake.language_histogram(d)


@query("""SELECT o_orderkey % 50 AS run_id, o_orderkey, 'ev-' || o_orderstatus || '-' || row_number() OVER (PARTITION BY o_orderkey % 50, o_orderstatus ORDER BY o_custkey, o_orderkey) AS id FROM orders""")
def evidence_ids_by_order(spark, sf_dir):
    from wardline.operators import intake

    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("run_id"), F.col("o_orderstatus").alias("prefix"), F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("line"), F.lit("").alias("summary"), "o_orderkey")
    return intake.evidence_ids(o).select("run_id", "o_orderkey", "id")


@query(r"""SELECT doc_id, CAST(ceil(length(text) / 3.5::DOUBLE) AS BIGINT) AS tokens, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;')) AS escaped,
CASE WHEN length(t) > 80 THEN substr(t, 1, 79) || '…' ELSE t END AS line FROM (SELECT *, trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS t FROM documents)""")
def text_forms(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(t).cast("bigint").alias("tokens"), F.sha2(text.html_escape(t), 256).alias("escaped"), text.one_line(t, 80).alias("line"))


@query("""SELECT l_orderkey AS threat_id FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag = 'R')""")
def gap_only_findings(spark, sf_dir):
    from wardline.operators import labels

    c = citations(spark, sf_dir).select("threat_id", F.concat_ws(":", "threat_id", "pos", "file", "line", "kind").alias("id"), "rule_id")
    t = c.groupBy("threat_id").agg(F.collect_set("id").alias("evidence_ids"))
    return labels.gap_only(t, c.select("id", "rule_id").distinct()).select(F.col("threat_id").cast("bigint").alias("threat_id"))


@query("""SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS repo, 'site/' || page_id || '.html' AS file, CAST(len(string_split(split_part(lower(html), '<script', 1), chr(10))) AS INT) AS line, 0.7::DOUBLE AS certainty
FROM pages WHERE regexp_matches(html, '(?i)<script\\b') AND NOT regexp_matches(html, '(?i)<meta[^>]+content-security-policy')""")
def page_header_gaps(spark, sf_dir):
    """Each host as a repository of static pages."""
    from wardline.operators import rules

    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("repo"), F.format_string("site/%d.html", "page_id").alias("path"), F.col("html").alias("content"))
    none = spark.createDataFrame([], "repo string, category string, dev boolean")
    return rules.page_headers_missing(p, none).select("repo", "file", "line", "certainty")


@query("""WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS ch FROM benchmark), n AS (SELECT item_id, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY ALL), t AS (SELECT item_id, sum(k) AS t FROM n GROUP BY 1)
SELECT item_id, round(-sum(k / t::DOUBLE * log2(k / t::DOUBLE)), 6) AS bits FROM n JOIN t USING (item_id) GROUP BY 1""")
def entropy_bits(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(guards.entropy(F.col("text")), 6).alias("bits"))


@query("""WITH m AS (SELECT l_orderkey AS threat_id, l_partkey % 20 AS c, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey), g AS (SELECT c, count(DISTINCT threat_id) AS n FROM m GROUP BY 1)
SELECT CAST(c AS VARCHAR) AS unknown_id, CAST(n AS BIGINT) AS n, round(v, 6) AS value FROM (SELECT c, count(*) AS n, max(w) * (1 - avg(cf)) * log2(1 + count(*)) AS v FROM (SELECT DISTINCT c, threat_id, threat_id % 4 + 1 AS w, (threat_id % 100) / 100.0::DOUBLE AS cf FROM m) GROUP BY c)""")
def question_candidates(spark, sf_dir):
    """Orders as findings of one run, parts by residue as components, one unknown for each component."""
    from wardline.operators import model

    li = table(spark, sf_dir, "lineitem")
    t = li.groupBy(F.col("l_orderkey").alias("threat_id")).agg(F.collect_set((F.col("l_partkey") % 20).cast("string")).alias("component_ids"))
    t = t.select(F.lit("r").alias("run_id"), "threat_id", (F.col("threat_id") % 4 + 1).alias("weight"), (F.col("threat_id") % 100 / F.lit(100.0)).alias("confidence"), "component_ids", F.array().cast("array<string>").alias("unknown_ids"))
    u = li.select(F.lit("r").alias("run_id"), (F.col("l_partkey") % 20).cast("string").alias("id")).distinct().withColumn("component_ids", F.array("id"))
    return model.question_candidates(u, t).select("unknown_id", "n", F.round("value", 6).alias("value"))


from wardline.plans import code, jobs, models, repositories, reviews  # noqa: E402, F401  (they register their queries)

__all__ = ["QUERIES", "SQL"]
