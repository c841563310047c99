"""Removal of repeated passages by overlapping windows of three lines, in DataFrame functions only.

Every three consecutive lines of a text are a window (one without a word is none), known by two 64-bit
hashes. A window that occurs more than once anywhere keeps its first occurrence, by id, then position; all
others are later ones, and the lines that later occurrences cover are removed, merged over windows. Lines of
the first occurrence that a later one overlaps in the same text stay. With
``short`` a text of fewer lines is one shorter window of all its lines. Only hashes and positions are grouped;
counts combine before the shuffle, and the join of a frequent window can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import put_aside

WIDTH = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def covered_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", short: bool = False) -> DataFrame:
    """(id, text_hash, covered): the 0-based lines to remove, for texts that have any; of a short text also positions past its end."""
    d = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_hash"), _lines(F.col(text_column)).alias("lines")).where(F.size("lines") >= (1 if short else WIDTH))
    d = d.select(
        "id", "text_hash",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("a"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("b"),
        F.transform("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("spoken"),
    )
    at = lambda c, i, k: F.get(c, i + k)
    windows = F.transform(
        F.slice("a", F.lit(1), F.greatest(F.size("a") - (WIDTH - 1), F.lit(1))),
        lambda x, i: F.struct(
            i.alias("pos"), F.xxhash64(x, at("a", i, 1), at("a", i, 2)).alias("h1"), F.xxhash64(at("b", i, 0), at("b", i, 1), at("b", i, 2)).alias("h2"),
            (at("spoken", i, 0) | at("spoken", i, 1) | at("spoken", i, 2)).alias("spoken"),
        ),
    )
    w = d.select("id", "text_hash", F.explode(windows).alias("w")).where("w.spoken").select("id", "text_hash", "w.pos", "w.h1", "w.h2")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "pos")
    repeated = w.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = w.join(repeated, ["h1", "h2"]).where(place != F.col("first"))
    own = F.array(*(F.col("pos") + k for k in range(WIDTH)))
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    cover = F.when(same, F.filter(own, lambda p: p > F.col("first.pos") + (WIDTH - 1))).otherwise(own)
    return later.select("id", "text_hash", F.explode(cover).alias("p")).groupBy("id", "text_hash").agg(F.collect_set("p").alias("covered"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", short: bool = False) -> DataFrame:
    """docs with the text left and two columns more, __n_lines and __n_removed.

    Rows with the same id and text are one text: they keep and lose the same lines. Rows without an id come
    last in the order of first occurrences. Null text stays null and empty text empty, with one line. A text
    whose lines are all removed becomes empty. Other columns pass through, but for the caller's own columns of those
    two names, which are replaced. An empty table gives an empty one.
    """
    names = [c for c in docs.columns if c not in ("__n_lines", "__n_removed")]
    docs, back = put_aside(docs.select(*names))
    cover = covered_lines(docs, id_column, text_column, short).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("covered").alias("__covered"))
    d = docs.withColumn("__own", F.xxhash64(text_column))
    d = d.join(cover.hint("shuffle_hash"), F.col(id_column).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left")
    d = d.withColumn("__lines", _lines(F.col(text_column)))
    if short:
        d = d.withColumn("__covered", F.filter("__covered", lambda p: p < F.size("__lines")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__covered"))
    left = F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n")
    out = {
        "__n_lines": F.size("__lines").cast("bigint"),
        "__n_removed": F.coalesce(F.size("__covered"), F.lit(0)).cast("bigint"),
        text_column: F.when(F.col("__covered").isNull(), F.col(text_column)).otherwise(left),
    }
    return d.withColumns(out).select(*docs.columns, "__n_lines", "__n_removed").withColumnsRenamed(back)
