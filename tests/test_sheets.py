"""Label sheets: built, blanked for a second labeller, read again, compared."""

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from wardline.operators import labels, sheets

THREATS = "threat_id string, title string, component_ids array<string>, stride array<string>, severity string, milli int, evidence_ids array<string>"
EVIDENCE = "id string, kind string, rule_id string, file string, line_start int, line_end int"


def model(spark):
    t = spark.createDataFrame([
        ("t1", "One", ["c2", "cx"], ["S", "T"], "high", 345, ["e1", "e2", "ex"]), ("t2", "Two", [], [], "low", 125, ["e3", "e2", "e3"]),
        ("t3", "Three", ["c1"], ["D"], "low", 1000, []), ("t4", "Four", ["c1"], ["D"], "low", 5, ["e2", "ex"]), ("t5", "Five", None, None, None, 249, None),
    ], THREATS)
    c = spark.createDataFrame([("c1", "Api"), ("c2", "Web")], "id string, name string")
    e = spark.createDataFrame([("e1", "code", None, "a.ts", 3, 9), ("e2", "code", "gap:csrf_missing", "b.ts", 4, 4), ("e3", "code", "gap:authz_missing", None, None, None)], EVIDENCE)
    return t, c, e


def test_label_sheet(spark):
    t, c, e = model(spark)
    got = {r.threatId: r.asDict() for r in sheets.label_sheet(t, c, e).collect()}
    assert list(got["t1"]) == list(sheets.LABELS) and set(got) == {"t1", "t2", "t3", "t4", "t5"}
    assert (got["t1"]["component"], got["t1"]["stride"], got["t1"]["evidenceLocations"]) == ("Web; cx", "ST", "e1: a.ts:3-9 | e2: b.ts:4 | ex: (missing)")
    assert got["t2"]["evidenceLocations"] == "e3: (no file) gap:authz_missing | e2: b.ts:4 | e3: (no file) gap:authz_missing"
    assert got["t3"]["evidenceLocations"] == got["t5"]["component"] == got["t1"]["supported"] == ""
    assert sheets.label_sheet(t.limit(0), c, e).count() == 0


def test_gap_sheet(spark):
    t, _, e = model(spark)
    got = [r.asDict() for r in sheets.gap_sheet(t, e).collect()]
    assert [list(r.values()) for r in got] == [["t2", "Two", "authz_missing;csrf_missing", "(no file) gap:authz_missing | b.ts:4", "0.13", "n", "", ""]]
    sheet = sheets.gap_sheet(t, e).withColumn("label", F.lit("Predicted_Wrong"))
    found, problems = labels.read_gap_sheet(sheet)
    assert problems.count() == 0 and [tuple(r) for r in found.collect()] == [("t2", ["authz_missing", "csrf_missing"], False, "predicted_wrong")]
    assert labels.gap_sheet_problems(found, sheets.gap_rows(t, e).withColumn("visible", F.lit(False))).count() == 0


def test_decimals_of_every_confidence(spark):
    """Decimal of a float is exact, and ties of exact values go up."""
    got = {r.m: r.s for r in spark.range(1001).select(F.col("id").cast("int").alias("m"), sheets.two_decimals(F.col("id").cast("int")).alias("s")).collect()}
    assert got == {m: str(Decimal(m / 1000).quantize(Decimal("0.01"), ROUND_HALF_UP)) for m in range(1001)}


def test_second_sheet(spark):
    t, c, e = model(spark)
    first = sheets.label_sheet(t, c, e).withColumns({"supported": F.lit("y"), "notes": F.lit("mine"), "threatId": F.concat(F.lit(" "), "threatId"), "extra": F.lit("kept")})
    copy = sheets.second_sheet(first, spark.createDataFrame([("t2",), ("t3",), ("t3",), ("zz",)], "threat_id string"))
    rows = copy.collect()
    assert copy.columns == first.columns and sorted(r.threatId for r in rows) == [" t2", " t3"]
    assert {(r.supported, r.notes, r.extra, r.title != "") for r in rows} == {("", "", "kept", True)}


def test_second_labels(spark):
    expected = spark.createDataFrame([("x1",), ("x2",)], "id string")
    sheet = lambda *m: spark.createDataFrame([(f"t{i}", x, "y", "1/1") for i, x in enumerate(m)], "threatId string, matchesExpected string, supported string, evidenceCorrect string")
    found, problems, labelled = sheets.read_second_labels(sheet("x1; x2", " None ", "x1"), expected)
    assert labelled and problems.count() == 0 and {r.threat_id: r.matches for r in found.collect()} == {"t0": ["x1", "x2"], "t1": [], "t2": ["x1"]}
    _, problems, labelled = sheets.read_second_labels(sheet("", None, " "), expected)
    assert not labelled and problems.count() == 0
    _, problems, labelled = sheets.read_second_labels(sheet("x1", "", "zz"), expected)
    assert labelled and sorted(map(tuple, problems.collect())) == [("t1", "matches are labelled on other rows"), ("t2", "unknown expected id zz")]
    assert sheets.read_second_labels(sheet("x1").limit(0), expected)[2] is False


def test_agreement(spark):
    one = spark.createDataFrame([("a", ["x", "y"], True, 1, 2), ("b", [], True, 1, 2), ("c", [], True, 0, 0)], "threat_id string, matches array<string>, supported boolean, right int, cited int")
    two = spark.createDataFrame([("a", ["y", "x"], False, 1, 2), ("b", ["x"], True, 2, 2)], one.schema)
    assert sorted(map(tuple, sheets.agreement(one, two, True).collect())) == [("a", False, True, True), ("b", True, False, False)]
    assert sorted(map(tuple, sheets.agreement(one, two, False).collect())) == [("a", False, True, None), ("b", True, False, None)]


def test_missing_columns(spark):
    d = spark.createDataFrame([("a", "b")], "` threatId ` string, supported string")
    assert sheets.missing_columns(d, ("threatId", "supported", "evidenceCorrect", "notes")) == ["evidenceCorrect", "notes"]
