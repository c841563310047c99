"""Advisories, drafted models, sources."""

from pyspark.sql import functions as F

from wardline.operators import advisories as adv
from wardline.operators import model
from wardline.sources import tables


def col(df, *names):
    return sorted(((tuple(r[n] for n in names) if len(names) > 1 else r[names[0]]) for r in df.collect()), key=repr)


def test_dependencies_and_advisories(spark):
    lock = '{"lockfileVersion": 3, "packages": {"": {"version": "1.0.0"}, "node_modules/a": {"version": "1.5.0"}, "pkg/x/node_modules/a": {"version": "2.1.0"}, "node_modules/l": {"link": true, "version": "9.0.0"}}}'
    files = spark.createDataFrame([("r", "package-lock.json", lock), ("r", "old/package-lock.json", '{"lockfileVersion": 1}'), ("r", "bad/package-lock.json", "{")], "repo string, path string, content string")
    deps = spark.createDataFrame([("r", "a", "^1.0", False, "package.json"), ("r", "a", "^2", False, "pkg/x/package.json"), ("r", "b", "^1.2", True, "package.json"), ("r", "c", "git+ssh://x", False, "package.json"), ("r", "l", "~3.1.x", False, "package.json")], "repo string, name string, spec string, dev boolean, file string")
    res = adv.resolve(deps, adv.locked_versions(files))
    assert col(res, "name", "file", "version", "version_exact") == [("a", "package.json", "1.5.0", True), ("a", "pkg/x/package.json", "2.1.0", True), ("b", "package.json", "1.2.0", False), ("l", "package.json", "3.1.0", False)]
    ev = lambda *events: [{"events": [dict([e]) for e in events]}]
    rows = [
        ("V1", ["C1"], [{"name": "a", "ecosystem": "npm", "ranges": ev(("introduced", "1.0.0"), ("fixed", "1.6.0"), ("introduced", "2.0.0"), ("fixed", "2.2.0"))}], 7.5, None),
        ("V2", ["C1"], [{"name": "a", "ecosystem": "npm", "ranges": ev(("introduced", "0"), ("fixed", "1.7.0"))}], None, "CRITICAL"),
        ("V3", None, [{"name": "b", "ecosystem": "npm", "ranges": ev(("introduced", "1.0.0"), ("last_affected", "1.2.0"))}], None, None),
        ("V4", None, [{"name": "b", "ecosystem": "npm", "ranges": ev(("introduced", "1.3.0"))}, {"name": "a", "ecosystem": "other", "ranges": ev(("introduced", "0"))}], None, "LOW"),
    ]
    a = spark.createDataFrame(rows, "id string, aliases array<string>, affected array<struct<name: string, ecosystem: string, ranges: array<struct<events: array<map<string,string>>>>>>, severityScore double, severityLabel string")
    found = adv.match(res, a)
    assert col(found, "name", "version", "id", "fixed_version") == [("a", "1.5.0", "V1", "1.6.0"), ("a", "1.5.0", "V2", "1.7.0"), ("a", "2.1.0", "V1", "2.2.0"), ("b", "1.2.0", "V3", None)]
    groups = adv.alias_groups(found, a)
    assert col(groups, "name", "version", "id", "fixed_version") == [("a", "1.5.0", "V2", "1.7.0"), ("a", "2.1.0", "V1", "2.2.0"), ("b", "1.2.0", "V3", None)]
    top = adv.findings(res, groups, most=2)
    assert col(top, "place", "id", "omitted") == [(1, "V2", 1), (2, "V1", 1)]
    assert adv.detail_order(found).first()["id"] == "V1"


def test_invented_references_and_issues(spark):
    comps = spark.createDataFrame([("a", ["e1", "zz"]), ("b", ["src/x.ts"]), ("ghost", ["nope"])], "id string, refs array<string>")
    refs = spark.createDataFrame([("e1",), ("src/x.ts",)], "ref string")
    flows = spark.createDataFrame([("f1", "a", "b", "t1"), ("f2", "a", "ghost", None), ("f3", "b", "a", "t2")], "id string, source string, target string, boundary_id string")
    bounds = spark.createDataFrame([("t1", ["b", "ghost", "a"]), ("t2", ["ghost"])], "id string, component_ids array<string>")
    unknowns = spark.createDataFrame([("u1", ["ghost"])], "id string, component_ids array<string>")
    got = model.drop_invented(comps, refs, flows, bounds, unknowns)
    assert col(got["components"], "id") == ["a", "b"] and col(got["flows"], "id", "boundary_id") == [("f1", "t1"), ("f3", None)]
    assert [r.component_ids for r in got["boundaries"].collect()] == [["b", "a"]] and [r.component_ids for r in got["unknowns"].collect()] == [[]]
    t = spark.createDataFrame([("t1", ["a"], ["e1"], []), ("t2", ["x"], [], []), ("t3", ["a"], ["e9"], ["s"])], "threat_id string, element_ids array<string>, evidence_ids array<string>, assumptions array<string>")
    issues = model.reference_issues(t, spark.createDataFrame([("a", True), ("b", False)], "element_id string, batch boolean"), spark.createDataFrame([("a", "e1")], "element_id string, evidence_id string"))
    assert col(issues, "threat_id", "issues") == [("t2", ["no element of its batch", "no support", "unknown element x"]), ("t3", ["evidence not offered e9"])]


def test_duplicates_merge(spark):
    rows = [("t1", "SQL injection in login form", ["web"], [], 3, "r1"), ("t2", "Login form SQL injection", ["web"], [], 5, "r2"), ("t3", "SQL injection login form", [], ["f1"], 2, "r3"), ("t4", "SQL injection in login form", ["db"], [], 1, "r4"), ("t5", "Something else entirely here", ["web"], [], 1, "r5")]
    t = spark.createDataFrame(rows, "threat_id string, title string, component_ids array<string>, flow_ids array<string>, impact int, impact_reason string").repartition(4)
    ends = spark.createDataFrame([("f1", "web")], "flow_id string, component_id string")
    groups = model.duplicate_groups(t, ends)
    assert dict(col(groups, "threat_id", "group")) == {"t1": "t1", "t2": "t1", "t3": "t1", "t4": "t4", "t5": "t5"}
    merged = {r.threat_id: r for r in model.merge_groups(t, groups).collect()}
    assert set(merged) == {"t1", "t4", "t5"} and merged["t1"].flow_ids == ["f1"] and (merged["t1"].impact, merged["t1"].impact_reason) == (5, "r2")


def test_questions_and_answers(spark):
    unknowns = spark.createDataFrame([("r", "u1", ["a"]), ("r", "u2", [])], "run_id string, id string, component_ids array<string>")
    threats = spark.createDataFrame([("r", "t1", 4, 0.1, ["a"], []), ("r", "t2", 2, 0.3, ["b"], ["u1", "u2"])], "run_id string, threat_id string, weight int, confidence double, component_ids array<string>, unknown_ids array<string>")
    got = {r.unknown_id: r for r in model.question_candidates(unknowns, threats).collect()}
    assert got["u1"].n == 2 and got["u1"].reason is None and got["u2"].reason == "below the least value"
    opts = spark.createDataFrame([("q", 0, -2, 0), ("q", 1, 1, 0), ("q", 2, 0, 0)], "question_id string, option_index int, impact_delta int, likelihood_delta int")
    assert col(model.cautious_default(opts), "option_index") == [2]
    t = spark.createDataFrame([("t1", 5, 1, ["e"], []), ("t2", 2, 2, [], ["x"]), ("t3", 2, 2, [], ["x", "y"])], "threat_id string, impact int, likelihood int, evidence_ids array<string>, assumption_list array<string>")
    eff = spark.createDataFrame([("t1", "q1", 2, -3, []), ("t2", "q1", 0, 0, ["x"]), ("t3", "q1", 1, 0, ["x"]), ("t3", "q2", -1, 0, []), ("t3", "q2", 2, 0, [])], "threat_id string, question_id string, impact_delta int, likelihood_delta int, settles array<string>")
    assert col(model.apply_answers(t, eff), "threat_id", "impact", "likelihood") == [("t1", 5, 1), ("t3", 3, 2)]
    answers = spark.createDataFrame([("q1", "Yes, behind a proxy"), ("q2", "skip"), ("q3", "yes and no")], "question_id string, text string")
    labels = spark.createDataFrame([(q, i, x) for q in ("q1", "q2", "q3") for i, x in enumerate(("yes", "no"))], "question_id string, option_index int, label string")
    assert col(model.match_answer(answers, labels), "question_id", "option_index") == [("q1", 0)]


def test_unknowns_batches_notes(spark):
    gaps = spark.createDataFrame([("r", "gap-1", "k1", 0.5, ["a"]), ("r", "gap-2", "k1", 0.9, ["a"])], "run_id string, gap_id string, kind string, certainty double, component_ids array<string>")
    unknowns = spark.createDataFrame([("r", "m1", "Is rate limiting used?", ["a"]), ("r", "m2", "Who hosts it?", ["a", "b"])], "run_id string, id string, description string, component_ids array<string>")
    got = model.gap_unknowns(gaps, unknowns, spark.createDataFrame([("k1", "rate limiting")], "kind string, control string"))
    assert col(got, "place", "id") == [(1, "unknown-gap-1"), (2, "m2")]
    parts, flows = spark.createDataFrame([("r", c) for c in "dcba"], "run_id string, component_id string"), spark.createDataFrame([("r", "d2", "d"), ("r", "b1", "b"), ("r", "d1", "d"), ("r", "zz", "gone"), ("r", "aa", "gone")], "run_id string, flow_id string, source string")
    assert dict(col(model.batches(parts, flows), "element_id", "batch")) == {"a": 0, "b": 1, "b1": 1, "c": 0, "d": 2, "d1": 2, "d2": 3, "aa": 3, "zz": 4}
    assert dict(col(model.batches(parts, flows, 3), "element_id", "batch")) == {"a": 0, "b": 0, "b1": 0, "c": 1, "d": 2, "d1": 2, "d2": 2, "aa": 1, "zz": 1}
    notes = spark.createDataFrame([("r", "c", "x", 2), ("r", "c", "y", 1), ("r", "c", "x", 0)], "run_id string, code string, subject string, pos int")
    assert col(model.limitation_notes(notes), "n", "subjects") == [(2, ["x", "y"])]
    s = spark.createDataFrame([("actor", None), ("flow", True), ("flow", False), ("api", None)], "k string, c boolean").select(model.stride_for(F.col("k"), F.col("c")))
    assert [r[0] for r in s.collect()] == ["SR", "STID", "TID", "STRIDE"]


def test_sources(spark, tmp_path):
    listing = spark.createDataFrame([(1, '{"tree": [{"path": "a", "type": "blob", "size": 3}, {"type": "blob"}]}'), (2, '{"entries": [{"path": "b", "type": "tree"}]}'), (3, '[{"path": "c", "type": "blob"}]'), (4, "broken")], "id int, j string")
    assert col(tables.read_tree(listing, "j"), "id", "path", "size") == [(1, "a", 3), (2, "b", None), (3, "c", None)]
    (tmp_path / "repo/src").mkdir(parents=True)
    (tmp_path / "repo/src/a.ts").write_text("é = 1")
    (tmp_path / "repo/bin").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "repo/big").write_text("x" * 50)
    assert col(tables.read_files(spark, f"file://{tmp_path}/repo", most=40), "path", "content") == [("src/a.ts", "é = 1")]
    (tmp_path / "x.csv").write_text('﻿id,note\r\n1,"a, ""b""\nc"\r\n,\r\n2,\r\n', encoding="utf-8")
    rows = tables.read_csv(spark, str(tmp_path / "x.csv")).collect()
    assert [(r.id, r.note) for r in rows] == [("1", 'a, "b"\nc'), ("2", None)]
    df = spark.createDataFrame([(1, '=x,"q"'), (2, None)], "id int, t string")
    assert col(df.select(tables.csv_line(["id", "t"]).alias("v")), "v") == ['1,"\'=x,""q"""', "2,"]
    tables.write_csv(df, str(tmp_path / "out"))
    assert b"\r\n" in b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert col(tables.read_yaml(spark, "items:\n  - {id: a, n: 2}\n  - {id: b}\n", "id string, n int", "items"), "id", "n") == [("a", 2), ("b", None)]
    snap = str(tmp_path / "snap")
    assert tables.load_snapshot(spark, snap, "repo string, run string, x int").count() == 0
    mk = lambda *r: spark.createDataFrame(list(r), "repo string, run string, x int")
    tables.save_snapshot(mk(("a", "last", 1), ("b", "last", 2)), snap)
    tables.save_snapshot(mk(("a", "last", 9)), snap)
    assert col(tables.load_snapshot(spark, snap, ""), "repo", "x") == [("a", 9), ("b", 2)]
    assert tables.merge_report("new\n", f"old\n{tables.MARKER}\nmine\n").endswith("mine\n") and tables.MARKER in tables.merge_report("new", None)
    assert tables.markdown_table(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n| --- | --- |\n| 1 | – |"
    t = spark.createDataFrame([("t", "T" * 300, "high", "story")], "threat_id string, title string, severity string, scenario string")
    e = spark.createDataFrame([("t", i, "s" * 1000, "f", 1, 2) for i in range(9)], "threat_id string, pos int, summary string, file string, line_start int, line_end int")
    d = tables.issue_drafts(t, e).first()
    assert len(d.title) == 200 and len(d.body) <= 6000 and d.body.count("\n- ") == 5 and "(f:1-2)" in d.body


def test_binding_of_facts(spark):
    refs = spark.createDataFrame([("ev-1",), ("route-1",), ("a.ts",), ("no",)], "ref string")
    got = model.resolve_refs(refs, spark.createDataFrame([("ev-1",)], "id string"), spark.createDataFrame([("route-1",)], "route_id string"), spark.createDataFrame([("a.ts",)], "path string"))
    assert col(got.where("resolved"), "ref") == ["a.ts", "ev-1", "route-1"]
    f = spark.createDataFrame([("f1", "a", 1, "Route"), ("f2", "a", 1, "Store")], "fact_id string, file string, line int, prefix string")
    e = spark.createDataFrame([("e2", "a", 1, "Route GET /"), ("e1", "a", 1, "Route POST /")], "id string, file string, line int, summary string")
    assert col(model.evidence_of_facts(f, e), "fact_id", "evidence_id") == [("f1", "e1"), ("f2", None)]
    g = spark.createDataFrame([("g1", ["db"], ["e1"], [], "main"), ("g2", ["api"], [], ["x"], "web"), ("g3", ["db"], ["e9"], [], "other")], "group_id string, types array<string>, evidence_ids array<string>, files array<string>, group_name string")
    c = spark.createDataFrame([("c1", "db", ["e1"], [], "Main"), ("c2", "db", ["e1"], [], "Spare"), ("c3", "api", [], ["x"], "A"), ("c4", "api", [], ["x"], "B"), ("c5", "api", ["e9"], [], "other")], "component_id string, type string, evidence_ids array<string>, files array<string>, name string")
    assert col(model.bind_facts(g, c), "group_id", "component_id") == [("g1", "c1")]
    comps = spark.createDataFrame([("c1", ["DB"]), ("c2", ["db", "web"]), ("c3", ["gone"])], "component_id string, service_names array<string>")
    assert col(model.internal_components(comps, spark.createDataFrame([("db", []), ("web", [80])], "name string, ports array<int>")), "component_id") == ["c1"]
    t = spark.createDataFrame([("r", "observed", 300), ("r", "inferred", 250), ("s", "observed", 900), ("s", "inferred", 249)], "run_id string, basis string, milli int")
    assert dict(col(model.fit_for_demo(t), "run_id", "fit")) == {"r": True, "s": False} and model.level_costs(spark).count() == 5
