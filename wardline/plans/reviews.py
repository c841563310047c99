"""What people add to a run: answers, labels, second labels, issues. Orders are findings, lines their evidence, customers ask and answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import answers, sheets
from wardline.plans.registry import facts, pick, query
from wardline.sources import issues

# --- answers ---
# order and number name no single line: an item of evidence stands for all of one number

FOUND = """SELECT 't' || o_orderkey AS threat_id, CAST(o_orderkey % 5 + 1 AS INT) AS impact, CAST(o_orderkey % 7 % 5 + 1 AS INT) AS likelihood, o_orderkey % 3 = 0 AS claims, o_custkey AS c,
  CASE o_orderkey % 4 WHEN 0 THEN 'as unknown-' || o_custkey || ' says' WHEN 1 THEN 'as unknown-' || o_custkey || '1 says' ELSE '' END AS guess FROM orders"""
ITEMS = """SELECT 'e' || l_orderkey || '-' || l_linenumber AS id, 't' || l_orderkey AS threat_id, l_orderkey AS o, l_linenumber AS n, CASE WHEN l_returnflag = 'R' OR l_orderkey % 6 = 0 THEN 'gap' ELSE 'code' END AS cat,
  CAST(l_suppkey % 101 AS DOUBLE) / 100.0 AS certainty FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) u"""
#: A question for each customer about that customer's orders; the first line of the customer's first order is the gap it is about.
ASKED = """SELECT c_custkey AS q, c_custkey % 11 <> 0 AS known, CASE WHEN c_custkey % 3 = 0 THEN -2 ELSE 0 END AS yes_by, CASE WHEN c_custkey % 3 = 1 THEN 1 ELSE 0 END AS no_by, CAST(c_custkey % 2 AS INT) AS none_by,
  first_o FROM customer LEFT JOIN (SELECT o_custkey AS k, min(o_orderkey) AS first_o FROM orders GROUP BY o_custkey) f ON k = c_custkey"""
#: Copies of one answer, conflicts, skips, options that are not there, answers without an option, questions without an answer.
GIVEN = f"""SELECT 'q' || c_custkey AS question_id, {pick('c_custkey % 8', ('answered', 'answered', 'skipped', 'answered', 'answered', 'unsure', 'answered', 'answered'))} AS status, CAST({pick('c_custkey % 8', ('0', '1', None, '0', '9', None, None, '0'))} AS INT) AS option_index FROM customer WHERE c_custkey % 9 <> 4
UNION ALL SELECT 'q' || c_custkey, 'answered', CAST(c_custkey % 2 AS INT) FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'z' || s_suppkey, 'skipped', CAST(NULL AS INT) FROM supplier"""
ANSWERED_SQL = f"""WITH t AS ({FOUND}), e AS ({ITEMS}), q AS ({ASKED}), g AS ({GIVEN}),
d AS (SELECT question_id, count(*) AS n, any_value(status) AS status, any_value(option_index) AS o FROM (SELECT DISTINCT * FROM g) GROUP BY 1),
r AS (SELECT q.*, d.n, d.status, d.o, CASE WHEN NOT known THEN NULL WHEN n = 1 AND status = 'answered' AND o IN (0, 1) THEN o ELSE -1 END AS did FROM q LEFT JOIN d ON d.question_id = 'q' || q.q),
x AS (SELECT t.*, r.did, CASE r.did WHEN 0 THEN yes_by WHEN 1 THEN no_by WHEN -1 THEN none_by ELSE 0 END AS by_, CASE WHEN did = 0 THEN 'e' || first_o || '-1' END AS dropped FROM t LEFT JOIN r ON r.q = t.c),
c AS (SELECT x.threat_id, e.cat, e.certainty FROM x JOIN e ON e.threat_id = x.threat_id WHERE e.id IS DISTINCT FROM x.dropped),
s AS (SELECT threat_id, max(CASE cat WHEN 'code' THEN 350 ELSE 0 END) + max(CASE cat WHEN 'gap' THEN CAST(floor(certainty * 300 + 0.5) AS INT) ELSE 0 END) AS points, count(DISTINCT cat) AS n, bool_or(cat = 'code') AS code, sum(CASE cat WHEN 'gap' THEN floor(certainty * 1000 + 0.5) ELSE 0 END) AS cs, count(*) AS items FROM c GROUP BY 1),
a AS (SELECT x.threat_id, greatest(1, least(5, impact + by_)) AS impact, greatest(1, least(5, likelihood + by_)) AS likelihood, claims, coalesce(s.items, 0) + CASE WHEN did = 1 THEN 1 ELSE 0 END AS items, coalesce(code, false) OR did = 1 IS TRUE AS observed,
  coalesce(points, 0) + CASE WHEN did = 1 THEN 300 ELSE 0 END AS points, coalesce(s.n, 0) + CASE WHEN did = 1 THEN 1 ELSE 0 END AS n, coalesce(cs, 0) AS cs, coalesce(s.n, 0) > (CASE WHEN code THEN 1 ELSE 0 END) AS gap,
  CASE WHEN guess = '' OR (did IN (0, 1) AND guess = 'as unknown-' || c || ' says') THEN 0 ELSE 1 END + CASE WHEN did = -1 THEN 1 ELSE 0 END AS assumed, did IS NOT NULL AS touched FROM x LEFT JOIN s USING (threat_id)),
b AS (SELECT *, greatest(0, least(1000, points + CASE WHEN n >= 2 THEN 100 ELSE 0 END - 150 * assumed)) AS clamped FROM a)
"""


def _answered(spark, sf_dir):
    t = facts(spark, sf_dir, FOUND, "orders")
    e = facts(spark, sf_dir, ITEMS, "lineitem")
    none = F.array().cast("array<string>")
    cites = e.groupBy("threat_id").agg(F.collect_list("id").alias("evidence_ids"))
    threats = t.join(cites, "threat_id", "left").select(
        "threat_id", "impact", "likelihood", F.when(F.col("claims"), F.array(F.lit("CWE-1"))).otherwise(none).alias("cwe"), "evidence_ids", F.filter(F.array("guess"), lambda x: x != "").alias("assumption_list"),
        F.lit("why").alias("impact_reason"), F.lit("why").alias("likelihood_reason"),
    )
    gap = F.col("cat") == "gap"
    evidence = e.select(
        "id", F.lit("code").alias("kind"), F.lit("detector").alias("source"), F.lit("s").alias("summary"), F.when(gap, "gap:csrf_missing").alias("rule_id"), F.concat(F.lit("f"), "o").alias("file"), F.col("n").alias("line"),
        F.when(gap, F.col("certainty")).alias("certainty"), F.when(gap, F.array(F.lit("CWE-1"))).alias("gap_cwe"),
    )
    about = t.groupBy("c").agg(F.collect_list("threat_id").alias("ids"))
    effect = lambda by: (F.col(by).cast("int").alias("impact_delta"), F.col(by).cast("int").alias("likelihood_delta"), F.lit("said").alias("reason"))
    choice = lambda label, by, resolution: F.struct(F.lit(label).alias("label"), *effect(by), F.lit(resolution).alias("resolution"))
    questions = facts(spark, sf_dir, ASKED, "customer", "orders").join(about, F.col("q") == F.col("c"), "left").select(
        F.concat(F.lit("q"), "q").alias("question_id"), F.col("q").alias("place"), F.concat(F.lit("unknown-"), "q").alias("unknown_id"), F.lit("Is it?").alias("text"), F.lit("assumed for want of an answer").alias("default_assumption"),
        F.struct(*effect("none_by")).alias("otherwise"), F.array(choice("Yes", "yes_by", "clears_gap"), choice("No", "no_by", "confirms_gap")).alias("choices"), F.concat(F.lit("e"), "first_o", F.lit("-1")).alias("gap_evidence_id"),
        F.when(F.col("known"), F.coalesce("ids", none)).alias("threat_ids"), F.coalesce("ids", none).alias("affected_ids"),
    )
    return answers.apply(threats, evidence, questions, facts(spark, sf_dir, GIVEN, "customer", "supplier"))


@query(ANSWERED_SQL + """SELECT threat_id, CAST(impact AS INT) AS impact, CAST(likelihood AS INT) AS likelihood, CAST(assumed AS INT) AS assumed, CAST(items AS INT) AS items, CASE WHEN observed THEN 'observed' ELSE 'inferred' END AS basis,
CAST(CASE WHEN n = 1 AND gap AND cs >= 800 AND claims AND clamped < 400 THEN 400 ELSE clamped END AS INT) AS milli FROM b WHERE NOT (touched AND items = 0 AND assumed = 0)""")
def answers_rescored(spark, sf_dir):
    """Findings after all answers: what they rest on now and their scores."""
    size = lambda c: F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0)))
    return _answered(spark, sf_dir)["threats"].select("threat_id", "impact", "likelihood", size("assumption_list").alias("assumed"), size("evidence_ids").alias("items"), "basis", "milli")


@query(ANSWERED_SQL + """, w AS (SELECT d.question_id AS subject, 'conflicting answers' AS problem FROM d WHERE n > 1 UNION ALL SELECT question_id, 'unknown question' FROM d WHERE n = 1 AND starts_with(question_id, 'z') UNION ALL SELECT 'q' || q, 'no known effects' FROM q WHERE NOT known
UNION ALL SELECT 'q' || q, CASE WHEN n IS NULL THEN 'no answer' WHEN o IS NULL THEN 'no option chosen' ELSE 'no such option' END FROM r WHERE known AND (n IS NULL OR n = 1 AND status = 'answered' AND (o IS NULL OR o > 1))
UNION ALL SELECT threat_id, 'an answer cleared its only support' FROM b WHERE touched AND items = 0 AND assumed = 0)
SELECT CASE problem WHEN 'an answer cleared its only support' THEN 'threat_ruled_out_by_answer' WHEN 'conflicting answers' THEN 'answer_not_applied' WHEN 'no option chosen' THEN 'answer_not_applied' WHEN 'no such option' THEN 'answer_not_applied' ELSE 'internal' END AS code, subject, problem FROM w""")
def answer_notes(spark, sf_dir):
    return _answered(spark, sf_dir)["notes"]


# --- sheets ---

NAMED = """SELECT 't' || o_orderkey AS threat_id, 'Title ' || (o_custkey % 9) AS title, 'c' || (o_orderkey % 14) AS a, 'c' || (o_custkey % 14) AS b, CASE o_orderkey % 3 WHEN 0 THEN 'ST' WHEN 1 THEN 'D' ELSE '' END AS stride,
  CASE o_orderkey % 2 WHEN 0 THEN 'high' ELSE 'low' END AS severity, CAST(o_orderkey % 1001 AS INT) AS milli, o_orderkey AS o FROM orders"""
PLACED = """SELECT 'e' || l_orderkey || '-' || l_linenumber AS id, l_orderkey AS o, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN 'gap:k' || (l_partkey % 4) END AS rule_id, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'src/f' || (l_suppkey % 7) || '.ts' END AS file,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_partkey % 90 AS INT) END AS line_start, CAST(l_partkey % 90 + l_suppkey % 2 AS INT) AS line_end, l_partkey % 13 <> 0 AS there FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) u"""
SHEET_SQL = f"""WITH t AS ({NAMED}), p AS ({PLACED}), k AS (SELECT 'c' || s_suppkey AS id, s_name AS name FROM supplier), m AS (SELECT *, CASE WHEN file = '' THEN '(no file) ' || coalesce(rule_id, 'code') WHEN line_start IS NULL THEN file WHEN line_end = line_start THEN file || ':' || line_start ELSE file || ':' || line_start || '-' || line_end END AS place FROM p),
z AS (SELECT *, CASE WHEN milli IN (125, 625) THEN '0.' || (milli // 10 + 1) ELSE printf('%.2f', milli / 1000.0::DOUBLE) END AS confidence FROM t)
"""


def _sheets(spark, sf_dir):
    t = facts(spark, sf_dir, NAMED, "orders")
    p = facts(spark, sf_dir, PLACED, "lineitem")
    cites = p.groupBy("o").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("evidence_ids"))
    t = t.join(cites, "o", "left").select("threat_id", "title", F.array("a", "b").alias("component_ids"), F.filter(F.split("stride", ""), lambda x: x != "").alias("stride"), "severity", "milli", "evidence_ids")
    c = facts(spark, sf_dir, "SELECT 'c' || s_suppkey AS id, s_name AS name FROM supplier", "supplier")
    return t, c, p.where("there").withColumn("kind", F.lit("code"))


@query(SHEET_SQL + """SELECT threat_id AS "threatId", title, coalesce(ka.name, a) || '; ' || coalesce(kb.name, b) AS component, stride, severity, confidence, coalesce((SELECT string_agg(m.id || ': ' || CASE WHEN there THEN place ELSE '(missing)' END, ' | ' ORDER BY n) FROM m WHERE m.o = z.o), '') AS "evidenceLocations",
'' AS "matchesExpected", '' AS supported, '' AS "evidenceCorrect", '' AS notes FROM z LEFT JOIN k ka ON ka.id = a LEFT JOIN k kb ON kb.id = b""")
def label_sheet(spark, sf_dir):
    return sheets.label_sheet(*_sheets(spark, sf_dir))


@query(SHEET_SQL + """SELECT z.threat_id AS "threatId", any_value(title) AS title, array_to_string(list_sort(list(DISTINCT substr(rule_id, 5))), ';') AS "gapKinds", array_to_string(list_sort(list(DISTINCT place)), ' | ') AS files, any_value(confidence) AS confidence, CASE WHEN any_value(milli) >= 250 THEN 'y' ELSE 'n' END AS visible, '' AS "gapLabel", '' AS notes
FROM z JOIN m USING (o) GROUP BY z.threat_id HAVING bool_and(there AND rule_id IS NOT NULL)""")
def gap_sheet(spark, sf_dir):
    t, _, e = _sheets(spark, sf_dir)
    return sheets.gap_sheet(t, e)


SECOND = f"""SELECT 't' || c_custkey AS {{q}}threatId{{q}}, CASE c_custkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'x1' WHEN 2 THEN 'x2;x1' ELSE 'x9' END AS {{q}}matchesExpected{{q}}, {pick('c_custkey', ('y', 'No', 'yes', 'n', 'Y'))} AS supported, (c_custkey % 3) || '/' || (c_custkey % 3 + 1) AS {{q}}evidenceCorrect{{q}} FROM customer"""
FIRST = "SELECT 't' || c_custkey AS threat_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'x1' END AS m, c_custkey % 2 = 0 AS supported, CAST(c_custkey % 3 AS INT) AS hit, CAST(2 AS INT) AS cited FROM customer"


@query("WITH a AS (" + FIRST + "), s AS (" + SECOND.format(q='"') + """), b AS (SELECT "threatId" AS threat_id, CASE "matchesExpected" WHEN 'None' THEN '' WHEN 'x2;x1' THEN 'x1,x2' ELSE "matchesExpected" END AS m, lower(supported) IN ('y', 'yes') AS supported, "evidenceCorrect" AS ec FROM s)
SELECT threat_id, a.supported = b.supported AS supported, ec = a.hit || '/' || a.cited AS evidence, a.m = b.m AS matches FROM a JOIN b USING (threat_id)""")
def second_labels_agree(spark, sf_dir):
    second = facts(spark, sf_dir, SECOND.format(q="`"), "customer")
    found, _, labelled = sheets.read_second_labels(second, spark.createDataFrame([("x1",), ("x2",), ("x9",)], "id string"))
    first = facts(spark, sf_dir, FIRST, "customer").select("threat_id", F.filter(F.array("m"), lambda x: x != "").alias("matches"), "supported", F.col("hit").alias("right"), "cited")
    return sheets.agreement(first, found, labelled)


# --- issues ---

DRAFT = """SELECT 't' || c_custkey AS threat_id, 'Title <' || c_name || '>' AS title, CASE c_custkey % 2 WHEN 0 THEN 'high' ELSE 'critical' END AS severity, CAST(c_custkey % 101 AS INT) AS pct, c_mktsegment AS seg, 'o' || c_nationkey || CASE c_custkey % 10 WHEN 9 THEN '' ELSE '/r ' || c_custkey END AS repo, repeat('story & ', CAST(c_custkey % 50 * c_custkey % 900 AS INT)) AS scenario FROM customer"""
CITED = """SELECT 't' || o_custkey AS threat_id, l_orderkey * 10 + l_linenumber AS pos, 'Line <' || l_linenumber || '> of ' || repeat('part ', CAST(l_partkey % 30 AS INT)) AS summary, CASE l_partkey % 4 WHEN 0 THEN NULL ELSE 'src/a b/f' || (l_suppkey % 7) || '.ts:' || l_linenumber || '-' || (l_linenumber + l_partkey % 2) END AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""


@query("WITH t AS (" + DRAFT + "), e AS (" + CITED + r"""), l AS (SELECT e.threat_id, pos, '- ' || CASE WHEN place IS NULL THEN '' ELSE '[`' || place || '`](https://github.com/' || replace(url_encode(repo), '%2F', '/') || '/blob/main/' || replace(url_encode(regexp_extract(place, '^(.*):', 1)), '%2F', '/') || '#L' || regexp_extract(place, ':(\d+)-', 1) || CASE WHEN regexp_extract(place, ':(\d+)-', 1) = regexp_extract(place, '-(\d+)$', 1) THEN '' ELSE '-L' || regexp_extract(place, '-(\d+)$', 1) END || ') — ' END
  || replace(replace(trim(summary), '<', '&lt;'), '>', '&gt;') AS line FROM e JOIN t USING (threat_id)),
h AS (SELECT threat_id, trim('Title <' || regexp_extract(title, '<(.*)>', 1) || '>') AS title, repo, '**Severity:** ' || upper(severity[1]) || severity[2:] || chr(10) || '**Confidence:** High (' || pct || '%)' || chr(10) || '**Basis:** Observed' || chr(10) || '**STRIDE:** ' || seg || chr(10) || '**OWASP Top 10:2025:** None' || chr(10) || '**CWE:** CWE-1, CWE-2' || chr(10) || '**Affected components:** None' || chr(10) || chr(10) || '## Attack scenario' || chr(10) || replace(trim(scenario), '&', '&amp;') || chr(10) || chr(10) AS head,
  '## Mitigation' || chr(10) || 'Mend it' || chr(10) || chr(10) || '1. first' || chr(10) || '2. then' || chr(10) || chr(10) || '_Generated for ' || repo || ' at `main`._' || chr(10) AS tail FROM t),
c AS (SELECT threat_id, row_number() OVER w AS k, sum(length(line) + 1) OVER w AS used, count(*) OVER (PARTITION BY threat_id) AS n, line FROM l WINDOW w AS (PARTITION BY threat_id ORDER BY pos, line)),
k AS (SELECT threat_id, k, n, string_agg(line || chr(10), '' ORDER BY k) OVER (PARTITION BY threat_id ORDER BY k) AS kept FROM c WHERE used < 6000 UNION ALL SELECT h.threat_id, 0, count(pos), '' FROM h LEFT JOIN l USING (threat_id) GROUP BY 1),
b AS (SELECT h.*, k, head || CASE WHEN n = 0 THEN '' ELSE '## Evidence' || chr(10) || kept || CASE n - k WHEN 0 THEN '' WHEN 1 THEN '_1 more evidence item omitted to fit the issue size limit._' || chr(10) ELSE '_' || (n - k) || ' more evidence items omitted to fit the issue size limit._' || chr(10) END || chr(10) END || tail AS body FROM h JOIN k USING (threat_id)),
o AS (SELECT threat_id, title, repo, CASE WHEN length(body) > 6000 THEN body[:5999] || '…' ELSE body END AS body FROM b QUALIFY row_number() OVER (PARTITION BY threat_id ORDER BY length(body) > 6000, CASE WHEN length(body) > 6000 THEN k ELSE -k END) = 1),
u AS (SELECT threat_id, title, body, CASE WHEN NOT contains(repo, '/') THEN '' ELSE 'https://github.com/' || replace(url_encode(repo), '%2F', '/') || '/issues/new?title=' || url_encode(title) || '&body=' || replace(replace(replace(replace(url_encode(body), '%2A', '*'), '%27', chr(39)), '%28', '('), '%29', ')') END AS url FROM o)
SELECT threat_id, title, sha256(body) AS body, CASE WHEN length(url) > 7000 THEN '' ELSE url END AS url, length(url) > 7000 AS too_long FROM u""")
def issue_addresses(spark, sf_dir):
    listed = lambda *xs: F.array(*(F.lit(x) if isinstance(x, str) else x for x in xs)).cast("array<string>")
    t = facts(spark, sf_dir, DRAFT, "customer").select(
        "threat_id", "title", "severity", F.col("pct").alias("confidence"), F.lit("high").alias("confidence_label"), F.lit("Observed").alias("basis_label"), listed(F.col("seg")).alias("stride"), listed().alias("owasp"), listed("CWE-1", "CWE-2").alias("cwe"), listed().alias("affected"), "scenario",
        F.lit(" Mend it").alias("mitigation"), listed(" first ", "then").alias("steps"), F.lit("").alias("code_location"), "repo", F.lit("main").alias("ref"),
    )
    return issues.issue_links(t, facts(spark, sf_dir, CITED, "lineitem", "orders")).withColumn("body", F.sha2("body", 256))
