"""Sheets for people to label: one row for each finding, hand-filled columns empty; copies for a second labeller and what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scoring import visible
from wardline.functions.text import location
from wardline.operators import labels

# Columns of the two sheets, those filled by hand, and the cell that says "matches nothing".
LABELS = ("threatId", "title", "component", "stride", "severity", "confidence", "evidenceLocations", "matchesExpected", "supported", "evidenceCorrect", "notes")
GAPS = ("threatId", "title", "gapKinds", "files", "confidence", "visible", "gapLabel", "notes")
BY_HAND = ("matchesExpected", "supported", "evidenceCorrect", "gapLabel", "notes")
NOTHING = "none"


def two_decimals(milli: Column) -> Column:
    """Thousandths, 0 to 1000, as their double is written with two decimals: where the third is a 5, the double lies above or
    below it, and exact ties go up. The double times 2^60 is a whole number, so the test is exact."""
    exact = (milli / F.lit(1000.0) * F.lit(float(1 << 60))).cast("bigint").cast("decimal(38,0)") * F.lit(1000).cast("decimal(5,0)")
    up = (milli % 10 > 5) | ((milli % 10 == 5) & (exact >= milli.cast("decimal(5,0)") * F.lit(1 << 60).cast("decimal(20,0)")))
    cents = F.floor(milli / 10) + up.cast("int")
    return F.format_string("%d.%02d", F.floor(cents / 100), cents % 100)


def _place() -> Column:
    """Where evidence is: its lines, or what it is where it has no file."""
    said = F.concat(F.lit("(no file) "), F.coalesce("rule_id", "kind", F.lit("")))
    return F.when(F.coalesce("file", F.lit("")) == "", said).otherwise(location(F.col("file"), F.col("line_start"), F.col("line_end")))


def _cited(threats: DataFrame, evidence: DataFrame, *columns: Column) -> DataFrame:
    """(threat_id, i, id, columns) of each citation, null where an id is not there."""
    e = evidence.select("id", *columns)
    return threats.select("threat_id", F.posexplode("evidence_ids").alias("i", "id")).join(e, "id", "left")


def _in_order(what: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(what).alias("x")))), lambda s: s["x"])


def _blank(d: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return d.select(*(F.lit("").alias(c) if c in BY_HAND else F.col(c) for c in columns))


def label_sheet(threats: DataFrame, components: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row for each finding, all cells text. Components by name, the id where it is not known; one place for each citation, since
    their number is what a labeller counts against. threats: threat_id, title, component_ids, stride (letters), severity, milli,
    evidence_ids; components: id, name; evidence: id, kind, rule_id, file, line_start, line_end. No findings, no rows."""
    named = threats.select("threat_id", F.posexplode("component_ids").alias("i", "id")).join(components.select("id", "name"), "id", "left")
    named = named.withColumn("said", F.coalesce("name", "id")).groupBy("threat_id").agg(F.array_join(_in_order("said"), "; ").alias("component"))
    placed = _cited(threats, evidence, _place().alias("place")).withColumn("said", F.concat("id", F.lit(": "), F.coalesce("place", F.lit("(missing)"))))
    placed = placed.groupBy("threat_id").agg(F.array_join(_in_order("said"), " | ").alias("evidenceLocations"))
    d = threats.join(named, "threat_id", "left").join(placed, "threat_id", "left").na.fill("", ["component", "evidenceLocations"])
    return _blank(d.withColumns({"threatId": F.col("threat_id"), "stride": F.array_join("stride", ""), "confidence": two_decimals(F.col("milli"))}), LABELS)


def gap_rows(threats: DataFrame, evidence: DataFrame) -> DataFrame:
    """(threat_id, gap_kinds, files) of findings that cite something, gaps alone, and nothing that is not there; both sorted."""
    cited = _cited(labels.gap_only(threats, evidence), evidence, F.substring("rule_id", len("gap:") + 1, 1 << 20).alias("kind"), _place().alias("place"))
    return cited.groupBy("threat_id").agg(F.array_sort(F.collect_set("kind")).alias("gap_kinds"), F.array_sort(F.collect_set("place")).alias("files"))


def gap_sheet(threats: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row for each finding of gap_rows, all cells text. threats: threat_id, title, milli, evidence_ids."""
    d = threats.join(gap_rows(threats, evidence), "threat_id")
    return _blank(d.withColumns({
        "threatId": F.col("threat_id"), "gapKinds": F.array_join("gap_kinds", ";"), "files": F.array_join("files", " | "),
        "confidence": two_decimals(F.col("milli")), "visible": F.when(visible(F.col("milli")), "y").otherwise("n"),
    }), GAPS)


def second_sheet(sheet: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a sheet with those ids (threat_id), cells filled by hand emptied, columns as they were."""
    wanted = ids.select(F.col("threat_id").alias("__id")).distinct()
    kept = sheet.withColumn("__id", F.trim("threatId")).join(wanted, "__id", "left_semi")
    return kept.select(*(F.lit("").alias(c) if c in BY_HAND else F.col(c) for c in sheet.columns))


def missing_columns(sheet: DataFrame, columns: tuple[str, ...]) -> list[str]:
    """Columns that a sheet lacks, in their order; names count without white space around them."""
    there = {c.strip() for c in sheet.columns}
    return [c for c in columns if c not in there]


def read_second_labels(sheet: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Labels and problems as labels.read_labels gives them, and whether matches were labelled at all.

    A second labeller may never have seen the answer key, so an empty cell says nothing: a column empty on every row was not
    labelled, a full one says "none" where nothing matches, and in a column filled in part every empty cell is a problem."""
    empty = F.trim(F.coalesce("matchesExpected", F.lit(""))) == ""
    filled, blank = sheet.agg(F.count(F.when(~empty, 1)), F.count(F.when(empty, 1))).first()
    said = F.when(F.lower(F.trim("matchesExpected")) == NOTHING, "").otherwise(F.coalesce("matchesExpected", F.lit("")))
    found, problems = labels.read_labels(sheet.withColumn("matchesExpected", said), expected)
    if filled and blank:
        problems = problems.unionByName(sheet.where(empty).select(F.trim("threatId").alias("threat_id"), F.lit("matches are labelled on other rows").alias("problem")))
    return found, problems, filled > 0


def agreement(primary: DataFrame, second: DataFrame, matches: bool) -> DataFrame:
    """(threat_id, supported, evidence, matches) of findings that both labelled: whether they say the same; matches is null where the
    second did not label them."""
    b = second.select("threat_id", F.struct("supported", "right", "cited", F.array_sort("matches").alias("matches")).alias("b"))
    same = F.array_sort("matches") == F.col("b.matches") if matches else F.lit(None).cast("boolean")
    return primary.join(b, "threat_id").select("threat_id", (F.col("supported") == F.col("b.supported")).alias("supported"), ((F.col("right") == F.col("b.right")) & (F.col("cited") == F.col("b.cited"))).alias("evidence"), same.alias("matches"))
