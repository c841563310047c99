"""Label sheets: reading with all problems, pairing, samples, planted markers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED, SAMPLE = 20260925, 20


def read_labels(sheet: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (threat_id, matches, supported, right, cited) and problems (threat_id, problem) of a sheet (threatId,
    matchesExpected, supported, evidenceCorrect). A sheet with problems is refused by the caller; all are named."""
    key = F.trim("threatId")
    d = sheet.withColumn("threat_id", key).withColumns({
        "matches": F.array_distinct(F.filter(F.split("matchesExpected", r"[;,\s]+"), lambda x: x != "")),
        "said": F.lower(F.trim("supported")),
        "right": F.try_to_number(F.regexp_extract("evidenceCorrect", r"^\s*(\d{1,9})\s*/\s*\d{1,9}\s*\z", 1), F.lit("999999999")).cast("int"),
        "cited": F.try_to_number(F.regexp_extract("evidenceCorrect", r"^\s*\d{1,9}\s*/\s*(\d{1,9})\s*\z", 1), F.lit("999999999")).cast("int"),
    })
    problem = lambda rows, text: rows.select("threat_id", (text if isinstance(text, Column) else F.lit(text)).alias("problem"))
    twice = d.groupBy("threat_id").agg(F.count("*").alias("n")).where("n > 1")
    unknown = d.select("threat_id", F.explode("matches").alias("id")).join(expected.select("id").distinct(), "id", "left_anti")
    problems = (
        problem(d.where(F.coalesce("threat_id", F.lit("")) == ""), "no id").unionByName(problem(twice, "repeated id"))
        .unionByName(problem(d.where(~F.coalesce(F.col("said").isin("y", "yes", "n", "no"), F.lit(False))), "supported is not y or n"))
        .unionByName(problem(d.where(F.col("right").isNull() | (F.col("right") > F.col("cited"))), "evidence is not k/n"))
        .unionByName(problem(unknown, F.concat(F.lit("unknown expected id "), "id")))
    )
    return d.select("threat_id", "matches", F.col("said").isin("y", "yes").alias("supported"), "right", "cited"), problems


def recall(labels: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: expected, found, recall, unsupported share, evidence accuracy; null where nothing is counted. A finding that is not supported
    recalls nothing."""
    found = expected.join(labels.where("supported").select(F.explode("matches").alias("id")).distinct(), "id", "left_semi").select(F.lit(1).alias("found"))
    zero = F.lit(0).cast("bigint")
    parts = (
        expected.agg(F.count("*").alias("expected")).select("expected", zero.alias("found"), zero.alias("rows"), zero.alias("bad"), zero.alias("right"), zero.alias("cited"))
        .unionByName(found.agg(F.count("*").alias("found")).select(zero.alias("expected"), "found", zero.alias("rows"), zero.alias("bad"), zero.alias("right"), zero.alias("cited")))
        .unionByName(labels.agg(F.count("*").alias("rows"), F.count(F.when(~F.col("supported"), 1)).alias("bad"), F.coalesce(F.sum("right"), zero).alias("right"), F.coalesce(F.sum("cited"), zero).alias("cited")).select(zero.alias("expected"), zero.alias("found"), "rows", "bad", "right", "cited"))
    ).agg(*(F.sum(c).alias(c) for c in ("expected", "found", "rows", "bad", "right", "cited")))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return parts.select("expected", "found", share("found", "expected").alias("recall"), share("bad", "rows").alias("unsupported"), share("right", "cited").alias("evidence_accuracy"))


def pair(primary: DataFrame, second: DataFrame) -> DataFrame:
    """(threat_id, a, b) of findings that both labelled."""
    return primary.select("threat_id", F.col("supported").alias("a")).join(second.select("threat_id", F.col("supported").alias("b")), "threat_id")


def mulberry32(seed: int) -> Iterator[float]:
    """The 32-bit generator of that name, in [0, 1)."""
    state, mask = seed & 0xFFFFFFFF, 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & mask
        t = ((state ^ (state >> 15)) * (state | 1)) & mask
        t ^= (t + ((t ^ (t >> 7)) * (t | 61))) & mask
        t &= mask
        yield ((t ^ (t >> 14)) & mask) / 4294967296


def quotas(sizes: dict[str, int], size: int) -> dict[str, int]:
    """How many of each stratum: its share rounded down, one at least; then one more, or fewer, where the share asks for it
    most, by name among equals, until they sum to size. Never more than a stratum has."""
    if size >= sum(sizes.values()):
        return dict(sizes)
    share = {k: size * n / sum(sizes.values()) for k, n in sizes.items()}
    out = {k: min(n, max(1, int(share[k]))) for k, n in sizes.items()}
    while sum(out.values()) < size:
        out[min((k for k in out if out[k] < sizes[k]), key=lambda k: (out[k] - share[k], k))] += 1
    while sum(out.values()) > size and any(n > 1 for n in out.values()):
        out[min((k for k in out if out[k] > 1), key=lambda k: (share[k] - out[k], k))] -= 1
    return out


def _natural(value: str) -> list:
    """Sorts digits by their number."""
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", str(value))]


def stratified_sample(rows: DataFrame, stratum: Column, id_: str, size: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Rows sampled by stratum: ids in natural order, shuffled from the end by one seeded generator that goes through the
    strata by name. The sampling is the feature. Strata are few by nature, and only their sizes reach the driver;
    each stratum's ids, a part of one run's labels, are shuffled in a task of their own, which starts the generator
    where the strata before leave it."""
    keyed = rows.select(F.col(id_).alias("id"), stratum.alias("stratum"))
    sizes = {r.stratum: r["count"] for r in keyed.groupBy("stratum").count().collect()}
    want, before, start = quotas(sizes, size), 0, {}
    for k in sorted(sizes):
        start[k], before = before, before + sizes[k] - 1

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["stratum"].iloc[0]
        ids, random = sorted(pdf["id"], key=_natural), mulberry32(seed + start[key] * 0x6D2B79F5)
        for i in range(len(ids) - 1, 0, -1):
            j = int(next(random) * (i + 1))
            ids[i], ids[j] = ids[j], ids[i]
        return pd.DataFrame({"id": ids[: want[key]]})

    picked = keyed.groupBy("stratum").applyInPandas(draw, f"id {rows.schema[id_].dataType.simpleString()}")
    return rows.join(picked.withColumnRenamed("id", id_), id_, "left_semi")


def marker_problems(files: DataFrame, issues: DataFrame, reach: int = 5) -> DataFrame:
    """(repo, id, problem): planted issues without their marker within ``reach`` lines above, and markers nobody
    labelled. A marker is PLANTED: <id> in a comment."""
    lines = files.select("repo", F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("i", "text")).withColumn("id", F.regexp_extract("text", r"PLANTED:\s*([\w-]+)", 1)).where("id <> ''").select("repo", "file", "id", (F.col("i") + 1).alias("at"))
    near = issues.join(lines, ["repo", "file", "id"]).where((F.col("at") <= F.col("line")) & (F.col("at") >= F.col("line") - reach)).select("repo", "id").distinct()
    lost = issues.join(near, ["repo", "id"], "left_anti").select("repo", "id", F.lit("no marker").alias("problem"))
    loose = lines.join(issues.select("repo", "id"), ["repo", "id"], "left_anti").select("repo", "id", F.lit("no label").alias("problem")).distinct()
    return lost.unionByName(loose)


def gap_only(threats: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings whose every cited item is a gap, and that cite something; an id that is not there is no gap. threats: threat_id,
    evidence_ids."""
    cited = threats.select("threat_id", F.explode("evidence_ids").alias("id")).join(evidence.select("id", "rule_id"), "id", "left")
    only = cited.groupBy("threat_id").agg(F.bool_and(F.coalesce(F.col("rule_id").startswith("gap:"), F.lit(False))).alias("only")).where("only")
    return threats.join(only.select("threat_id"), "threat_id", "left_semi")


def presence_in_text(rows: DataFrame, text: str, routes: list[str]) -> DataFrame:
    """rows with the routes that the text names as whole paths; a route is no prefix of a longer one."""
    said = lambda p: F.col(text).rlike(r"(?<![\w/:-])" + re.escape(p) + r"(?![\w/:-])")
    named = F.filter(F.array(*(F.when(said(p), F.lit(p)) for p in routes)).cast("array<string>"), lambda p: p.isNotNull())
    return rows.withColumn("named", named)


def strip_foreign_gaps(citations: DataFrame, threats: DataFrame) -> DataFrame:
    """Citations without the gap ones whose route is not among those the finding's text names, where it names any.
    citations: threat_id, evidence_id, gap_route (null: no gap); threats: threat_id, named."""
    d = citations.join(threats.select("threat_id", "named"), "threat_id", "left")
    foreign = F.col("gap_route").isNotNull() & (F.size("named") > 0) & ~F.array_contains("named", F.col("gap_route"))
    return d.where(~F.coalesce(foreign, F.lit(False))).select(*citations.columns)


def numbered_questions(questions: DataFrame) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy("place")
    return questions.where("reason is null").withColumn("number", F.row_number().over(w))


def stratum_of(supported: Column, matches: Column) -> Column:
    """What a sample is stratified on: whether a finding is supported and whether it matches anything expected."""
    return F.concat_ws("/", F.when(supported, "supported").otherwise("unsupported"), F.when(F.size(matches) > 0, "match").otherwise("nomatch"))


def revision_mismatch(revision: Column, scanned: Column) -> Column:
    """Why a result cannot be held against an answer key; null where it can. A key without a revision takes any."""
    named = F.coalesce(revision, F.lit("")) != ""
    return F.when(named & ~revision.eqNullSafe(scanned), F.format_string('result was scanned at "%s" but the answer key is for "%s"', F.coalesce(scanned, F.lit("")), revision))


VERDICTS = ("predicted_correct", "predicted_wrong")


def read_gap_sheet(sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (threat_id, gap_kinds, visible, label) and problems (threat_id, problem) of a sheet (threatId, gapKinds, visible,
    label). Rows with a problem are no labels."""
    d = sheet.select(
        F.trim("threatId").alias("threat_id"), F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce("gapKinds", F.lit("")), r"[;,\s]+"), lambda k: k != ""))).alias("gap_kinds"),
        F.lower(F.trim("visible")).alias("seen"), F.lower(F.trim("label")).alias("label"), F.count("*").over(Window.partitionBy(F.trim("threatId"))).alias("times"),
    )
    tests = (
        ("no id", F.coalesce("threat_id", F.lit("")) == ""), ("repeated id", F.col("times") > 1), ("no gap kinds", F.size("gap_kinds") == 0),
        ("visible is not y or n", ~F.coalesce(F.col("seen").isin("y", "n"), F.lit(False))), ("unknown label", ~F.coalesce(F.col("label").isin(*VERDICTS), F.lit(False))),
    )
    said = F.filter(F.array(*(F.when(t, F.lit(name)) for name, t in tests)), lambda x: x.isNotNull())
    d = d.withColumn("problems", said)
    return d.where(F.size("problems") == 0).select("threat_id", "gap_kinds", (F.col("seen") == "y").alias("visible"), "label"), d.select("threat_id", F.explode("problems").alias("problem"))


def sheet_started(sheet: DataFrame, column: str = "label") -> DataFrame:
    """One row, started: whether any row is labelled."""
    return sheet.agg((F.count(F.when(F.trim(F.coalesce(F.col(column), F.lit(""))) != "", 1)) > 0).alias("started"))


def gap_precision(labelled: DataFrame) -> DataFrame:
    """(scope, correct, wrong, n, precision) over all findings that rest on gaps and over the visible ones."""
    ok = F.col("label") == "predicted_correct"
    each = labelled.select("label", F.explode(F.when(F.col("visible"), F.array(F.lit("overall"), F.lit("visible"))).otherwise(F.array(F.lit("overall")))).alias("scope"))
    return each.groupBy("scope").agg(F.count(F.when(ok, 1)).alias("correct"), F.count(F.when(~ok, 1)).alias("wrong"), F.count("*").alias("n"), F.avg(ok.cast("int")).alias("precision"))


def wrong_by_kind(labelled: DataFrame) -> DataFrame:
    """(kind, wrong, total): a finding of several kinds counts once under each."""
    return labelled.select("label", F.explode("gap_kinds").alias("kind")).groupBy("kind").agg(F.count(F.when(F.col("label") == "predicted_wrong", 1)).alias("wrong"), F.count("*").alias("total"))


def gap_sheet_problems(labelled: DataFrame, expected: DataFrame) -> DataFrame:
    """(threat_id, problem) where a sheet and a result (threat_id, gap_kinds, visible) differ, in both directions."""
    b = expected.select("threat_id", F.col("gap_kinds").alias("__k"), F.col("visible").alias("__v"), F.lit(True).alias("__b"))
    d = labelled.select("threat_id", "gap_kinds", "visible", F.lit(True).alias("__a")).join(b, "threat_id", "full_outer")
    both = F.col("__a") & F.col("__b")
    tests = (
        ("not in the sheet", F.col("__a").isNull()), ("no gap-only finding of the result", F.col("__b").isNull()),
        ("other gap kinds", both & ~F.col("gap_kinds").eqNullSafe(F.col("__k"))), ("other visibility", both & ~F.col("visible").eqNullSafe(F.col("__v"))),
    )
    return d.select("threat_id", F.explode(F.filter(F.array(*(F.when(t, F.lit(name)) for name, t in tests)), lambda x: x.isNotNull())).alias("problem"))
