"""Reading and writing: files and trees, CSV, YAML, JSON, snapshots, reports, issue drafts."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.text import csv_guard, location

MOST_BYTES, TITLE, BODY, URL = 1 << 20, 200, 6000, 7000
MARKER = "<!-- written by hand below -->"


def read_tree(listing: DataFrame, column: str) -> DataFrame:
    """Tree entries (path, type, size) of JSON listings in three shapes: {tree: [...]}, {entries: [...]}, [...].
    Entries without a path or type are left out; size may be null."""
    entry = "path string, type string, size bigint"
    either = F.coalesce(F.from_json(column, f"tree array<struct<{entry}>>, entries array<struct<{entry}>>")["tree"], F.from_json(column, f"entries array<struct<{entry}>>")["entries"], F.from_json(column, f"array<struct<{entry}>>"))
    keep = [c for c in listing.columns if c != column]
    return listing.select(*keep, F.explode(either).alias("e")).select(*keep, "e.*").where("path is not null and type is not null")


def read_files(spark: SparkSession, folder: str, glob: str = "*", most: int = MOST_BYTES) -> DataFrame:
    """(path, content) of text files below a folder, path relative to it. Files over the limit are not read, and those
    that are not UTF-8 or hold a NUL are binary and left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).where(F.col("length") <= most)
    text = raw.where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("content")).where(~F.col("content").contains("\u0000"))
    root = folder.split(":", 1)[-1].lstrip("/").rstrip("/")
    return text.select(F.regexp_replace("path", r"^[a-z0-9]+:/*" + root.replace(".", r"\.") + "/", "").alias("path"), "content")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted cells may hold separators, doubled quotes and line breaks; rows that are blank throughout are left out."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=False)
    df = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.trim(c) != "", F.lit(False)) for c in df.columns]))


def csv_line(columns: list[str]) -> Column:
    """A row as CSV: formulas guarded, quotes doubled, cells with separators, quotes or breaks quoted."""
    cell = lambda c: (lambda v: F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v))(csv_guard(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    return F.concat_ws(",", *map(cell, columns))


def write_csv(df: DataFrame, path: str) -> None:
    """Part files with CRLF line ends, each beginning with the header; columns in the table's order."""
    header = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') else c for c in df.columns)

    def headed(batches):
        first = True
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([header] * first + batch.column(0).to_pylist(), pa.string())], ["value"])
            first = False

    df.select(csv_line(df.columns).alias("value")).mapInArrow(headed, "value string").write.option("lineSep", "\r\n").text(path)


def read_yaml(spark: SparkSession, text: str, schema: str, key: str | None = None) -> DataFrame:
    """Rows of a small YAML document (labels, answer keys), parsed on the driver."""
    import yaml

    data = yaml.safe_load(text)
    rows = data[key] if key else data
    names = [part.split()[0] for part in schema.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def save_snapshot(df: DataFrame, path: str) -> None:
    """The rows of their repositories and runs replace those there; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo", "run").parquet(path)


def load_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What is saved, or an empty table where nothing is."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def merge_report(generated: str, existing: str | None) -> str:
    """A generated report with what was written by hand below the marker kept."""
    tail = existing.split(MARKER, 1)[1] if existing and MARKER in existing else "\n"
    return generated.rstrip("\n") + f"\n\n{MARKER}{tail}"


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small aggregate as a Markdown table."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("not a small table")
    line = lambda cells: "| " + " | ".join("–" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def issue_drafts(threats: DataFrame, evidence: DataFrame) -> DataFrame:
    """(threat_id, title, body): the title within 200 characters; evidence lines from the first on while the body stays
    within 6000. threats: threat_id, title, severity, scenario; evidence: threat_id, pos, summary, file, line_start, line_end."""
    from pyspark.sql import Window

    line = F.concat(F.lit("- "), "summary", F.coalesce(F.concat(F.lit(" ("), location(F.col("file"), F.col("line_start"), F.col("line_end")), F.lit(")")), F.lit("")))
    head = threats.select("threat_id", F.substring(F.concat(F.lit("["), "severity", F.lit("] "), "title"), 1, TITLE).alias("title"), F.substring("scenario", 1, BODY // 2).alias("head"))
    lines = evidence.select("threat_id", "pos", line.alias("line")).join(head.select("threat_id", F.length("head").alias("used")), "threat_id")
    total = F.sum(F.length("line") + 1).over(Window.partitionBy("threat_id").orderBy("pos"))
    kept = lines.withColumn("t", total).where(F.col("used") + 2 + F.col("t") <= BODY).groupBy("threat_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    return head.join(kept, "threat_id", "left").select("threat_id", "title", F.concat_ws("\n\n", "head", "lines").alias("body"))


def write_log(df: DataFrame, path: str) -> None:
    """Rows (level, message, fields map) as JSON lines. An authorization field loses its value; a secret that is left anywhere
    stops the write."""
    from wardline.functions.guards import refuse_secrets

    clean = F.transform_values("fields", lambda k, v: F.when(F.lower(k) == "authorization", F.lit("[REDACTED:authorization]")).otherwise(v))
    refuse_secrets(df.select(F.to_json(F.struct("level", "message", clean.alias("fields"))).alias("value")), "value").write.mode("append").text(path)
