"""Excerpts of code for a budget: windows around findings, merged, cut and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.windows import merge_intervals, skip_fit

AROUND, RESERVE = 30, 0.2
#: Tasks that sort spans, for each task that reads them: a split of 128 MB may hold some millions.
TASKS = 16
CAPS = (50, 20, 10, 5, 3, 2, 1, 0)


def windows_around(places: DataFrame, files: DataFrame, around: int = AROUND) -> DataFrame:
    """(repo, file, lo, hi, n, rank): lines around places (repo, file, line, rank) within their files, merged where they
    overlap or touch; a window has the best rank of its places. Places beyond a file's end or in no file have none."""
    held = files.select("repo", F.col("path").alias("file"), F.size(F.split("content", "\n")).alias("lines"))
    spans = places.join(held, ["repo", "file"]).where(F.col("line").between(1, F.col("lines"))).select("repo", "file", "rank", "line", F.greatest(F.lit(1), F.col("line") - around).alias("lo"), F.least(F.col("lines"), F.col("line") + around).alias("hi"))
    merged = merge_intervals(spans, ["repo", "file"], "lo", "hi")
    inside = merged.join(spans.select("repo", "file", "line", "rank"), ["repo", "file"]).where(F.col("line").between(F.col("lo"), F.col("hi")))
    best = inside.groupBy("repo", "file", "lo", "hi").agg(F.min("rank").alias("rank"))
    return merged.join(best, ["repo", "file", "lo", "hi"])


def excerpts(spans: DataFrame, files: DataFrame) -> DataFrame:
    """spans with their text and its size in UTF-8 bytes."""
    held = files.select("repo", F.col("path").alias("file"), F.split("content", "\n").alias("__lines"))
    d = spans.join(held, ["repo", "file"])
    text = F.array_join(F.slice("__lines", F.col("lo"), F.col("hi") - F.col("lo") + 1), "\n")
    return d.withColumn("text", text).withColumn("bytes", F.octet_length("text")).drop("__lines")


def pack(parts: DataFrame, budget: int, reserve: float = RESERVE) -> DataFrame:
    """parts (repo, file, lo, rank, bytes) with taken: first the best part of each file within the reserve, so that files
    are covered, then all others by rank, file and line, within what is left. A part that does not fit is passed over."""
    w = Window.partitionBy("repo", "file").orderBy("rank", "lo")
    d = parts.withColumn("__first", F.row_number().over(w) == 1)
    cover = skip_fit(d.where("__first"), ["repo"], "bytes", ["rank", "file", "lo"], int(budget * reserve)).select("repo", "file", "lo", "bytes", "taken")
    used = cover.where("taken").groupBy("repo").agg(F.sum("bytes").alias("__used"))
    rest = d.join(cover.where("taken").select("repo", "file", "lo"), ["repo", "file", "lo"], "left_anti").join(used, "repo", "left")
    # what the cover took is a part of its own in front of the others
    head = used.select("repo", F.lit("").alias("file"), F.lit(0).alias("lo"), F.lit(-1).alias("rank"), F.col("__used").cast("int").alias("bytes"))
    more = skip_fit(rest.select("repo", "file", "lo", "rank", "bytes").unionByName(head), ["repo"], "bytes", ["rank", "file", "lo"], budget).where("taken and rank >= 0").select("repo", "file", "lo")
    taken = cover.where("taken").select("repo", "file", "lo").unionByName(more).withColumn("taken", F.lit(True))
    return parts.join(taken, ["repo", "file", "lo"], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def shrink(facts: DataFrame, budget: int) -> DataFrame:
    """facts (repo, section, place, bytes) up to the largest cap of entries a section, one for all sections, with which a
    repository's facts fit. Sizes are summed once; the caps are tried on the sums."""
    w = Window.partitionBy("repo", "section").orderBy("place")
    d = facts.withColumn("__n", F.row_number().over(w))
    sums = d.groupBy("repo").agg(*(F.coalesce(F.sum(F.when(F.col("__n") <= c, F.col("bytes"))), F.lit(0)).alias(f"c{c}") for c in CAPS))
    cap = F.coalesce(*(F.when(F.col(f"c{c}") <= budget, F.lit(c)) for c in CAPS))
    return d.join(sums.select("repo", cap.alias("__cap")), "repo").where(F.col("__n") <= F.col("__cap")).select(*facts.columns)


def merge_spans(spans: DataFrame, priorities: tuple[str, ...]) -> DataFrame:
    """(id, lo, hi, type): overlapping half-open spans as one, under the type of highest priority among them.

    Spans are dealt over TASKS tasks for each split of the input, so that a task's share stays the same as the input grows."""
    place = F.coalesce(*(F.when(F.col("type") == t, i) for i, t in enumerate(priorities)), F.lit(len(priorities)))
    w = Window.partitionBy("id").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    dealt = spans.repartition(TASKS * max(1, spans.rdd.getNumPartitions()), "id")
    d = dealt.withColumn("__new", F.when(F.col("lo") < before, 0).otherwise(1)).withColumn("__g", F.sum("__new").over(w))
    return d.groupBy("id", "__g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("type", F.struct(place.alias("p"), "lo")).alias("type")).drop("__g")
