"""Work on hot groups grows with the input, not with its square."""

import time

from pyspark.sql import functions as F

from wardline.operators import assembly, model, windows
from wardline.session import shared_dir


def test_evidence_of_a_hot_place(spark):
    n = 60_000
    i = F.col("id").cast("string")
    facts = spark.range(n).select(F.concat(F.lit("k"), i).alias("fact_id"), F.lit("f").alias("file"), F.lit(1).alias("line"), F.when(F.col("id") % 3 == 0, "Route").when(F.col("id") % 3 == 1, "").otherwise("Rö").alias("prefix"))
    evidence = spark.range(n).select(F.concat(F.lit("e"), i).alias("id"), F.lit("f").alias("file"), F.lit(1).alias("line"), F.when(F.col("id") == 7, "Röm").when(F.col("id") == 0, None).otherwise(F.concat(F.lit("Route "), i)).alias("summary"))
    began = time.monotonic()
    got = {(r.k, r.evidence_id): r["count"] for r in model.evidence_of_facts(facts, evidence).groupBy((F.substring("fact_id", 2, 9).cast("int") % 3).alias("k"), "evidence_id").count().collect()}
    assert got == {(0, "e1"): n // 3, (1, "e1"): n // 3, (2, "e7"): n // 3}
    assert time.monotonic() - began < 60  # pair by pair, 3.6 billion tests of a prefix


def test_similar_pairs_ship_only_first_tokens(spark, monkeypatch):
    import os

    words = F.expr("concat_ws(' ', transform(sequence(0, 29), i -> concat('w', CASE WHEN i < 24 + id % 3 THEN (id div 6) * 40 + i ELSE id * 1000 + i END)))")
    d = spark.range(60).select("id", words.alias("t"), F.when(F.col("id") >= 54, None).when(F.col("id") % 2 == 0, "x").otherwise("y").alias("b"))
    rows = {r.id: (r.b, set(r.t.split())) for r in d.collect()}
    want = {(a, b) for a, (ka, wa) in rows.items() for b, (kb, wb) in rows.items() if a < b and ka and ka == kb and wa != wb and len(wa & wb) >= 0.6 * len(wa | wb)}
    assert len(want) > 30
    for most in (windows.OFTEN, 5, 0):  # the order of tokens changes no pair
        monkeypatch.setattr(windows, "OFTEN", most)
        before = set(os.listdir(folder)) if os.path.isdir(folder := f"{shared_dir(spark).removeprefix('file://')}/wardline/{spark.sparkContext.applicationId}") else set()
        pairs = windows.similar_pairs(d, "id", "t", ["b"])
        assert {(r.a, r.b) for r in pairs.collect()} == want
        assert {x.rpartition("-")[0] for x in set(os.listdir(folder)) - before} == {"word-sets"}  # words are held once


def test_sets_of_common_words_bring_few_candidates(spark, monkeypatch):
    import random

    draw = random.Random(5)
    common = [f"w{i}" for i in range(400)]
    texts = [draw.sample(common, draw.choice((5, 40, 90, 300))) for _ in range(260)]
    texts += [t[: len(t) - draw.randrange(2, 3 + len(t) // 3)] + [f"x{i}"] for i, t in enumerate(texts[:120])]
    rows = [(i, "yx"[i % 2] if i % 9 else None, " ".join(t)) for i, t in enumerate(texts)]
    want = {(a, b) for a, ka, ta in rows for b, kb, tb in rows if a < b and ka and ka == kb and 0.6 * len({*ta.split()} | {*tb.split()}) <= len({*ta.split()} & {*tb.split()})}
    assert len(want) > 40
    made, seen = windows._candidates, []

    def spy(*given):
        out = made(*given)
        seen.append({(r.a, r.b) for r in out.collect()})
        return out

    monkeypatch.setattr(windows, "_candidates", spy)
    for most in (windows.CHUNK, 3000):  # one chunk a block, and many
        monkeypatch.setattr(windows, "CHUNK", most)
        d = spark.createDataFrame(rows, "id int, b string, t string").repartition(5)
        assert {(r.a, r.b) for r in windows.similar_pairs(d, "id", "t", ["b"]).collect()} == want
        assert want <= seen[-1] and len(seen[-1]) < 3 * len(want)  # some 30,000 pairs share a token


def test_issue_lines_of_a_hot_finding_are_not_written(spark):
    import os

    from wardline.sources import issues

    none = F.array().cast("array<string>")
    t = spark.createDataFrame([("t", "o/r")], "threat_id string, repo string").select("*", *(F.lit("x").alias(c) for c in ("title", "severity", "confidence_label", "basis_label", "scenario", "mitigation", "code_location", "ref")), F.lit(5).alias("confidence"), *(none.alias(c) for c in ("stride", "owasp", "cwe", "affected", "steps")))
    e = spark.range(50_000).select(F.lit("t").alias("threat_id"), (F.col("id") % 25_000).alias("pos"), F.when(F.col("id") < 25_000, "").otherwise("a").alias("summary"), F.when(F.col("id") % 3 == 0, "a b/c.ts:1-2").alias("place"))
    folder = f"{shared_dir(spark).removeprefix('file://')}/wardline/{spark.sparkContext.applicationId}"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    r = issues.issue_links(t, e).first()
    assert len(r.body) <= 6000 and r.body.count("\n- ") > 50
    kept = r.body.count("\n- ")
    assert f"_{50_000 - kept} more evidence items omitted to fit the issue size limit._" in r.body
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before


def test_lists_of_components_go_along_flows(spark, monkeypatch):
    import random

    draw = random.Random(3)
    some = lambda k: [tuple(draw.randrange(x) for x in k) for _ in range(120)]
    c = spark.createDataFrame([("r", f"c{i}") for i in range(9)] + [("r", "c1")], "repo string, component_id string")
    flows = spark.createDataFrame([("r", f"f{i}", f"c{a}", f"c{b}") for i, (a, b) in enumerate(some((11, 11)))] + [("r", "f3", "c2", "c3"), ("r", "c4", "c5", "c6")], "repo string, flow_id string, source string, target string")
    gaps = spark.createDataFrame([("r", f"gap-{i}", i % 3 / 10) for i in range(15)], "repo string, gap_id string, certainty double")
    bound = spark.createDataFrame([("r", f"gap-{a}", f"c{b}") for a, b in some((15, 11))], "repo string, gap_id string, component_id string")
    doubts = spark.createDataFrame([("r", f"u{a}", p, [f"c{b}", f"c{d}"]) for a, p, b, d in some((12, 9, 11, 11))], "repo string, id string, pos int, component_ids array<string>")
    held = spark.createDataFrame([("r", f"c{b}", p, f"s{a}") for a, p, b in some((12, 9, 11))], "repo string, component_id string, pos int, path string")
    known = spark.createDataFrame([("r", f"ev-{i}") for i in range(5)], "repo string, id string")
    cited = spark.createDataFrame([("r", f"{'fc'[a % 2]}{b}", p, f"ev-{e}") for a, b, p, e in some((2, 9, 5, 7))], "repo string, element_id string, pos int, evidence_id string")
    seen = {}
    gathered = assembly._expand_repeated

    def spy(components, flows, known, own):
        seen["repeated"] = gathered(components, flows, known, own)
        seen["facts"] = known, own
        return seen["repeated"]

    monkeypatch.setattr(assembly, "_expand_repeated", spy)
    got = sorted(map(repr, assembly.expand(c, flows, gaps, bound, doubts, held, known, cited).collect()))
    assert {r.element_id for r in seen["repeated"].collect()} == {"f3", "c4"}  # no other element is gathered fact by fact
    assert got == sorted(map(repr, gathered(c.distinct(), flows, *seen["facts"]).collect())) and len(got) == 9 + 120 + 1


def test_lists_of_sources_lie_where_their_targets_are(spark):
    c = spark.createDataFrame([("r", f"c{i}") for i in range(40)], "repo string, component_id string")
    pairs = [(i, i % 40, i * 7 % 41) for i in range(300)]
    flows = spark.createDataFrame([("r", f"f{i}", f"c{a}", f"c{b}") for i, a, b in pairs] + [(None, "f1", "c1", "c2"), ("r", None, "c1", "c2")], "repo string, flow_id string, source string, target string")
    held = spark.createDataFrame([("r", f"c{i % 40}", i, f"s{i % 30}") for i in range(100)], "repo string, component_id string, pos int, path string")
    cited = spark.createDataFrame([("r", f"{k}{i}", 0, "e") for k in "cf" for i in range(5)], "repo string, element_id string, pos int, evidence_id string")
    none = lambda kinds: spark.createDataFrame([], kinds)
    d = assembly.expand(c, flows, none("repo string, gap_id string, certainty double"), none("repo string, gap_id string, component_id string"), none("repo string, id string, pos int, component_ids array<string>"), held, spark.createDataFrame([("r", "e")], "repo string, id string"), cited)
    plan = d._jdf.queryExecution().executedPlan().toString()
    join = next(x for x in plan.split("Join") if x.split("]")[0].count("target#"))
    assert join.count("SelectedBucketsCount") >= 2 and "Exchange" not in join[: join.rindex("SelectedBucketsCount")], plan
    files = {f"c{i}": [f"s{k % 30}" for k in range(i, 100, 40)] for i in range(40)}
    got = {r.element_id: r for r in d.where("repo is not null and element_id is not null").collect()}
    assert len(got) == 340 and all([*dict.fromkeys(files[f"c{a}"] + files.get(f"c{b}", []))] == got[f"f{i}"].files for i, a, b in pairs)
    assert all(got[f"{k}{i}"].evidence_ids == (["e"] if i < 5 else []) for k in "cf" for i in range(40)) and d.count() == 342


def test_spans_are_dealt_by_the_size_of_their_input(spark):
    from wardline.operators import context

    parts = []
    for n in (1, 4):
        d = spark.range(0, 40_000, 1, n).select((F.col("id") % 9_000).alias("id"), (F.col("id") % 11).cast("int").alias("lo"), (F.col("id") % 11 + 3).cast("int").alias("hi"), F.lit("jwt").alias("type"))
        merged = context.merge_spans(d, ("aws", "jwt"))
        parts.append(merged.rdd.getNumPartitions())
        assert merged.select("id").distinct().count() == 9_000
    assert parts[1] == 4 * parts[0] >= 16


def test_lines_of_a_long_file_are_counted_once():
    from wardline.operators.code_facts import routes_in, uses_in

    n = 20_000
    began = time.monotonic()
    routes = routes_in("".join(f'app.get("/admin/c{i}", requireUser, (req, res) => res.json(1));\n// app.post("/gone{i}", (req, res) => 1);\n' for i in range(n)))
    uses = uses_in("\n" + "".join(f'app.use("/s{i}", handler);\n\n' for i in range(n)))
    assert [r[0] for r in routes] == list(range(1, 2 * n, 2)) and [u[0] for u in uses] == list(range(2, 2 * n + 1, 2))
    assert time.monotonic() - began < 15  # from the start of the file for each: 30 seconds and more


def test_tables_that_grow_are_not_sent_whole(spark):
    from wardline.operators import rules, scoring, views
    from wardline.session import materialize

    ids = spark.range(2000).select(F.lit("r").alias("repo"), F.concat(F.lit("route-"), "id").alias("route_id"), F.concat(F.lit("t"), "id").alias("threat_id"))
    none = F.array().cast("array<string>")
    written = lambda *more: materialize(ids.select("*", *more), "small")
    routes = written(F.lit("GET").alias("method"), F.lit("/a/:b").alias("url"), F.lit("f").alias("file"), F.lit(1).alias("line"), none.alias("middleware"))
    auth = written(F.lit("authenticated").alias("status"), none.alias("role_checks"), F.lit(False).alias("admin")).drop("threat_id")
    uses = spark.createDataFrame([], "repo string, file string, prefix string, names array<string>")
    threats = written(F.lit("t").alias("title"), F.array("route_id").alias("evidence_ids"), none.alias("component_ids"), none.alias("cwe"), F.lit(1).alias("milli"), F.lit(0).alias("assumptions"))
    evidence = written(F.col("route_id").alias("id"), F.lit("f").alias("file"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))
    cited = written(F.lit(0).alias("pos"), *(F.lit("code").alias(c) for c in ("kind", "source", "rule_id", "file")), F.lit(1).alias("line"), F.lit(0.5).alias("certainty"), none.alias("gap_cwe"))
    bound = rules.bind_to_components(routes.withColumn("gap_id", F.col("route_id")), evidence.select("repo", F.col("id").alias("component_id"), F.col("file").alias("path")), spark.createDataFrame([("r", "c", "api")], "repo string, component_id string, type string"))
    for made in (rules.authz_missing(routes, auth, uses), assembly.unresolved(threats, evidence), scoring.confidence(threats.drop("milli"), cited), views.cards(threats, spark.createDataFrame([("c", "n")], "id string, name string"), evidence), bound):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, plan
    assert rules.authz_missing(routes, auth, uses).count() == 2000
