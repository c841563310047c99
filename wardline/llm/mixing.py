"""Mixing of sources to target weights by systematic sampling.

Every document of a source is expected in the mix as often as its source's target asks, target / size. The
expected copies are summed along the documents of a source, in order of size, from one random offset; a document
is emitted once for each whole number that its stretch of the sum crosses. So no document strays from its
expectation by a whole copy, nor does any run of documents of like size, which keeps the words taken within about
one document of the target. Sums are whole multiples of 2**-48 copies, so they are the same in any order of
adding and on every run. The documents are sorted in ranges and only one row a range is summed across them
(running_sums), so a hot source is shared by many tasks; texts take no part but for their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.windows import in_ranges, running_sums

WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1 << 48
#: Sources in order of code points weigh these in turn; all share this part of all sizes; none goes beyond so many times its own.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def words(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) of ``sources`` (source, source_size).

    Sources weigh ``weights`` in turn by code point, null last, and share ``share`` of all sizes by weight; what would exceed
    ``most`` times a source's size is shared again among the rest, until none is above. That ends where target =
    min(most * size, level * weight), and the level follows from one pass over the sources by size / weight: a source is capped
    if what the caps before it leave, by weight of those left, still reaches its cap. A source without words gets 0.
    The level is the one number that reaches the driver. An empty table gives an empty one.
    """
    if not 0 < share <= most:
        raise ValueError("the share must be above 0 and within what the sources may give")
    by_name = [F.col("source").asc_nulls_last()]
    ranked = running_sums(in_ranges(sources.select("source", "source_size"), [], by_name, "sources"), by_name, {"place": F.lit(1).cast("bigint")})
    weight = F.get(F.array(*(F.lit(w) for w in weights)), (F.col("place_before") % len(weights)).cast("int"))
    weighed = ranked.select("source", "source_size", weight.cast("bigint").alias("weight")).withColumn("ratio", F.col("source_size") / F.col("weight"))
    by_ratio = ["ratio", F.col("source").asc_nulls_last()]
    filled = running_sums(in_ranges(weighed, [], by_ratio, "sources"), by_ratio, {"size": F.col("source_size"), "weight": F.col("weight")})
    level = (share * F.col("size_total") - most * F.col("size_before")) / (F.col("weight_total") - F.col("weight_before"))
    open_ = filled.select("weight", "ratio", level.alias("level"), F.col("size_before")).where(F.col("level") < most * F.col("ratio"))
    first = open_.agg(F.min_by("level", F.struct("ratio", "size_before"))).first()[0]
    cap = (most * F.col("source_size")).cast("double")
    target = cap if first is None else F.least(cap, F.lit(first) * F.col("weight"))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def crossings(before: Column, expected: Column, offset: Column) -> Column:
    """How many whole numbers lie in (offset + before, offset + before + expected], all in units of 2**-48."""
    whole = lambda x: F.floor(x.cast("decimal(38,0)") / F.lit(UNIT).cast("decimal(16,0)")).cast("bigint")
    return whole(offset + before + expected) - whole(offset + before)


def offset(source: Column, seed: int) -> Column:
    """A number of [0, 2**48) for each source and seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary")), 1, 12), 16, 10).cast("decimal(20,0)")


def plan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(id, source, text_hash, size, source_size, target, copies): how often the mix takes each row of ``docs``.

    Size is the number of words. Null texts and texts without a word have size 0 and take part like any other; null sources
    are one source. Rows are ordered by size, then id, then hash of the text; rows equal in all of these stand for one another.
    Of texts of any length only the size and a 64-bit hash go on. Other columns are not read. The same rows and
    seed give the same copies, whatever the partitions. An empty table gives an empty one.
    """
    sized = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), F.xxhash64(text_column).alias("text_hash"), words(F.col(text_column)).alias("size"))
    order = ["size", "id", "text_hash"]
    ranged = in_ranges(sized, ["source"], order, "mix")
    # one row for each range and source: the sizes of sources, and then their rates, pass through these, never through a source's rows
    parts = ranged.groupBy("__range", "__key").agg(F.sum("size").alias("part_size"))
    sources = parts.groupBy("__key").agg(F.sum("part_size").alias("source_size"))
    targets = source_targets(sources.select(F.col("__key.k0").alias("source"), "source_size"), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("bigint")
    rates = targets.select(F.struct(F.col("source").alias("k0")).alias("__key"), "source_size", "target", rate.alias("expected"))
    placed = ranged.join(parts.select("__range", "__key").join(rates, "__key"), ["__range", "__key"])
    summed = running_sums(placed, order, {"expected": F.col("expected").cast("decimal(20,0)")})
    copies = crossings(F.col("expected_before"), F.col("expected"), offset(F.col("source"), seed))
    return summed.select("id", "source", "text_hash", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 0, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as plan() says, with one column more, __copy (from 0).

    Rows that share id, source and text are one document, with their copies summed; one of them is emitted. A column of
    the caller's called __copy is replaced. An empty table gives an empty one.
    """
    names = [c for c in docs.columns if c != "__copy"]
    same = F.struct(F.col(id_column).alias("i"), F.col(source_column).alias("s"), F.xxhash64(text_column).alias("h"))
    taken = plan(docs, id_column, text_column, source_column, seed, **how).groupBy(F.struct(F.col("id").alias("i"), F.col("source").alias("s"), F.col("text_hash").alias("h")).alias("__same")).agg(F.sum("copies").alias("__copies"))
    each = docs.select(*names, same.alias("__same")).dropDuplicates(["__same"]).join(taken.where("__copies > 0"), "__same")
    return each.select(*names, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__copies") - 1)).alias("__copy"))
