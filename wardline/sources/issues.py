"""Drafts of issues: title, Markdown body and the address that opens a form filled with them.

A body that is too long loses evidence from the end, and says how much; only where that is not enough is it cut. What a
finding says is text of others: it is escaped in the body and percent-encoded in the address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.text import cut_units, uri_component, units

# Limits in UTF-16 units, white space, words of the form.
TITLE, BODY, ADDRESS = 200, 6000, 7000
#: Lines that a body can hold: each has two characters and its end at least.
LINES = BODY // 3
SPACE = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
HOST = "https://github.com/"
HEADING, OMITTED = "## Evidence", " omitted to fit the issue size limit._"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def _escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def inline(text: Column) -> Column:
    """One line of escaped text; null is empty."""
    return _escape(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")))


def prose(text: Column) -> Column:
    """Escaped text with its line breaks; null is empty."""
    return _escape(_trim(F.coalesce(text, F.lit(""))))


def _code(text: Column) -> Column:
    """Text between backticks, which may hold none itself."""
    return F.replace(text, F.lit("`"), F.lit("'"))


def _encoded(path: Column) -> Column:
    return F.replace(uri_component(path), F.lit("%2F"), F.lit("/"))


def _blob(repo: Column, ref: Column) -> Column:
    """What the addresses of all places of a revision begin with."""
    return F.concat(F.lit(HOST), _encoded(repo), F.lit("/blob/"), _encoded(ref), F.lit("/"))


def _parts(place: Column) -> list[Column]:
    """Path and line numbers of a place path[:a[-b]]; all empty where it has none."""
    return [F.regexp_extract(place, r"\A([^\n]*):(\d+)(?:-(\d+))?\z", i) for i in (1, 2, 3)]


def _below(place: Column, path: Column, a: Column, b: Column) -> Column:
    """The rest of a place's address, from its parts."""
    anchor = F.when(a == "", "").when((b == "") | (a.cast("decimal(38,0)") == b.cast("decimal(38,0)")), F.concat(F.lit("#L"), a)).otherwise(F.concat(F.lit("#L"), a, F.lit("-L"), b))
    return F.concat(_encoded(F.when(a == "", place).otherwise(path)), anchor)


def blob_address(repo: Column, ref: Column, place: Column) -> Column:
    """The page of a place path[:a[-b]] at a revision, with its lines."""
    return F.concat(_blob(repo, ref), _below(place, *_parts(place)))


def _listed(items: Column) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(F.transform(items, inline), ", ")).otherwise("None")


def _lines(parts: list[Column]) -> Column:
    """Lines, each with its end; a null line is none."""
    return F.concat(*(F.coalesce(F.concat(p, F.lit("\n")), F.lit("")) for p in parts))


def issue_links(threats: DataFrame, evidence: DataFrame) -> DataFrame:
    """(threat_id, title, body, url, too_long): url is empty where the repository is not owner/name or the address would be over
    the limit; too_long tells the second.

    threats: threat_id, title, severity, confidence (per cent), confidence_label, basis_label, stride, owasp, cwe, affected (arrays), scenario,
    mitigation, steps (array), code_location, repo, ref. evidence: threat_id, pos, summary, place (null: none).
    Null texts are empty, null arrays have no items. The parts of a line are made once, where evidence is read. Of a finding's lines
    only the first LINES leave the task that made them, more can't fit, so that one with a large part of all evidence fills many
    tasks; they meet its draft once, and what fits is found there."""
    capital = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 20))
    field = lambda name, value: F.concat(F.lit(f"**{name}:** "), value)
    label = F.when(F.col("confidence_label").isin("high", "medium", "low"), F.initcap("confidence_label")).otherwise(F.coalesce("confidence_label", F.lit("")))
    head = _lines([
        field("Severity", capital(F.coalesce("severity", F.lit("")))), field("Confidence", F.concat(label, F.lit(" ("), F.coalesce(F.col("confidence").cast("string"), F.lit("")), F.lit("%)"))), field("Basis", inline(F.col("basis_label"))),
        field("STRIDE", _listed(F.col("stride"))), field("OWASP Top 10:2025", _listed(F.col("owasp"))), field("CWE", _listed(F.col("cwe"))), field("Affected components", _listed(F.col("affected"))),
        F.lit(""), F.lit("## Attack scenario"), prose(F.col("scenario")), F.lit(""),
    ])
    steps = F.when(F.size("steps") > 0, F.concat(F.lit("\n"), F.array_join(F.transform("steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), inline(s))), "\n")))
    where = F.when(F.col("code_location") != "", F.concat(F.lit("\nWhere: `"), _code(inline(F.col("code_location"))), F.lit("`")))
    tail = _lines([F.lit("## Mitigation"), prose(F.col("mitigation")), steps, where, F.lit(""), F.concat(F.lit("_Generated for "), inline(F.col("repo")), F.lit(" at `"), _code(inline(F.col("ref"))), F.lit("`._"))])
    title = cut_units(_trim(F.regexp_replace(F.coalesce("title", F.lit("")), f"{SPACE}+", " ")), TITLE)
    t = threats.select("threat_id", title.alias("title"), F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("ref", F.lit("")).alias("ref"), head.alias("head"), tail.alias("tail")).withColumn("base", units("head") + units("tail"))

    parted = evidence.select("threat_id", "pos", "place", "summary", *(x.alias(n) for n, x in zip(("path", "a", "b"), _parts(F.col("place")), strict=True)))
    made = parted.select(
        "threat_id", "pos", F.when(F.col("place").isNull(), "- ").otherwise(F.concat(F.lit("- [`"), _code(F.col("place")), F.lit("`]("))).alias("lead"), F.col("place").isNotNull().alias("linked"),
        F.concat(F.when(F.col("place").isNull(), "").otherwise(F.concat(_below(*map(F.col, ("place", "path", "a", "b"))), F.lit(") — "))), inline(F.col("summary"))).alias("rest"),
    ).withColumn("u", units(F.col("lead")) + units(F.col("rest")) + 1)
    first = F.rank().over(Window.partitionBy("threat_id").orderBy("pos", "lead", "rest"))
    held = made.withColumn("__r", first).where(F.col("__r") <= LINES).groupBy("threat_id").agg(F.collect_list(F.struct("pos", "lead", "linked", "rest", "u")).alias("items"))
    counts = evidence.groupBy("threat_id").agg(F.count("*").alias("n"))
    omitted = lambda n: F.concat(F.lit("_"), n.cast("string"), F.lit(" more evidence item"), F.when(n == 1, "").otherwise("s"), F.lit(OMITTED))
    # digits of the number, the words around it, the line's end
    spent = lambda n: F.when(n > 0, F.length(n.cast("string")) + F.when(n == 1, len("_ more evidence item" + OMITTED) + 1).otherwise(len("_ more evidence items" + OMITTED) + 1)).otherwise(0) + len(HEADING) + 2

    d = t.join(held, "threat_id", "left").join(counts, "threat_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "blob": _blob(F.col("repo"), F.col("ref"))}).withColumn("h", units(F.col("blob")))
    line = lambda x: F.concat(x["lead"], F.when(x["linked"], F.col("blob")).otherwise(""), x["rest"])
    d = d.withColumn("lines", F.array_sort(F.transform("items", lambda x: F.struct(x["pos"].alias("pos"), line(x).alias("line"), (x["u"] + F.when(x["linked"], F.col("h")).otherwise(0)).alias("u")))))

    def step(acc: Column, x: Column) -> Column:
        end, k = acc["end"] + x["u"], acc["k"] + 1
        return F.struct(end.alias("end"), k.alias("k"), F.when(F.col("base") + end + spent(F.col("n") - k) <= BODY, k).otherwise(acc["best"]).alias("best"))

    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).alias("k"), F.lit(0).alias("best"))
    d = d.withColumn("best", F.aggregate(F.transform("lines", lambda x: F.struct(x["u"].cast("bigint").alias("u"))), zero, step)["best"])
    d = d.withColumn("kept", F.when(F.col("best") > 0, F.array_join(F.transform(F.slice("lines", F.lit(1), F.col("best")), lambda x: x["line"]), "\n")))
    left = F.col("n") - F.coalesce("best", F.lit(0))
    middle = F.when(F.col("n") == 0, "").otherwise(_lines([F.lit(HEADING), F.col("kept"), F.when(left > 0, omitted(left)), F.lit("")]))
    whole = F.concat("head", middle, "tail")
    d = d.withColumn("whole", whole).withColumn("body", F.when(units(F.col("whole")) > BODY, F.concat(cut_units(F.col("whole"), BODY - 1), F.lit("…"))).otherwise(F.col("whole")))
    full = F.when(F.col("repo").rlike(r"\A[^/]+/[^/]+\z"), F.concat(F.lit(HOST), _encoded(F.col("repo")), F.lit("/issues/new?title="), uri_component(F.col("title")), F.lit("&body="), uri_component(F.col("body")))).otherwise("")
    long = F.length(full) > ADDRESS
    return d.select("threat_id", "title", "body", F.when(long, "").otherwise(full).alias("url"), long.alias("too_long"))
