"""Runs compared: keys, differences, statuses, order by handling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.scoring import VISIBLE
from wardline.functions.text import norm

OPEN = "open"


def threat_key(title: Column, components: Column, stride: Column) -> Column:
    """Stable across runs: normalised title, sorted normalised component names and sorted letters, as a JSON array."""
    return F.to_json(F.array(norm(title), F.array_join(F.array_sort(F.transform(components, norm)), ","), F.array_join(F.array_sort(stride), ",")))


def first_of_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, status) of two runs with key and milli, one row a key: new, persisting, not_found, dropped_below_cutoff.

    Only what was visible counts as known before. "not_found" says no more than that."""
    b = before.select("key", (F.col("milli") >= VISIBLE).alias("was"))
    a = after.select("key", (F.col("milli") >= VISIBLE).alias("is"))
    status = (
        F.when(F.col("is") & F.coalesce("was", F.lit(False)), "persisting").when(F.col("is"), "new")
        .when(F.col("was") & F.col("is").isNull(), "not_found").when(F.col("was"), "dropped_below_cutoff")
    )
    return b.join(a, "key", "full_outer").select("key", status.alias("status")).where("status is not null")


def carry_forward(before: DataFrame, after: DataFrame, statuses: DataFrame) -> DataFrame:
    """Keys visible before, not found now, whose handling is neither fixed nor a false positive."""
    gone = before.where(F.col("milli") >= VISIBLE).join(after.select("key"), "key", "left_anti")
    return gone.join(statuses.select("key", F.col("status").alias("handled")), "key", "left").where(F.coalesce("handled", F.lit(OPEN)).isin("fixed", "false_positive") == F.lit(False)).select(*before.columns)


def with_status(threats: DataFrame, statuses: DataFrame) -> DataFrame:
    """Open is never stored: a key without a row is open."""
    return threats.join(statuses.select("key", F.col("status").alias("__s")), "key", "left").select(*threats.columns, F.coalesce("__s", F.lit(OPEN)).alias("status"))


def migrate_statuses(by_id: DataFrame, by_key: DataFrame, threats: DataFrame) -> DataFrame:
    """Statuses kept by finding id, moved to keys; a status the key already has wins, ids without a finding go."""
    moved = by_id.join(threats.select("threat_id", "key"), "threat_id").select("key", "status", F.lit(1).alias("o"), "threat_id")
    return first_of_key(by_key.select("key", "status", F.lit(0).alias("o"), F.lit("").alias("threat_id")).unionByName(moved), "key", "o", "threat_id").select("key", "status")


def band_order(rows: DataFrame, group: list[str], band: str, handled: str, pos: str) -> DataFrame:
    """rows with place: within each run of equal band values in pos order, open rows come first, else as before."""
    w = Window.partitionBy(*group).orderBy(pos)
    change = F.when(F.col(band).eqNullSafe(F.lag(band).over(w)), 0).otherwise(1)
    d = rows.withColumn("__c", change).withColumn("__band", F.sum("__c").over(w))
    return d.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("__band", handled, pos))).drop("__c", "__band")


def rotate(runs: DataFrame, keep: int = 2) -> DataFrame:
    """The last ``keep`` runs of each repository; runs with the same time are one."""
    w = Window.partitionBy("repo").orderBy(F.desc("analyzed_at"))
    return runs.withColumn("__r", F.dense_rank().over(w)).where(F.col("__r") <= keep).drop("__r")


def union_by_id(*sources: DataFrame, id_: str = "id") -> DataFrame:
    """The rows of the sources in their order, the first of each id."""
    w = Window.partitionBy(id_).orderBy("__s", *(c for c in sources[0].columns if c != id_))
    every = reduce(DataFrame.unionByName, [s.withColumn("__s", F.lit(i)) for i, s in enumerate(sources)])
    return every.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__s")


def all_refs(visible: DataFrame, hidden: DataFrame, key: str, *order: str) -> DataFrame:
    """Every finding of a run with hidden: those shown first, one for each key."""
    d = visible.withColumn("hidden", F.lit(False)).unionByName(hidden.withColumn("hidden", F.lit(True)))
    return first_of_key(d, key, "hidden", *order)


def distinct_lines(rows: DataFrame, group: list[str], pos: str, line: str) -> DataFrame:
    """Trimmed lines, each once, where it first stands; blank ones go."""
    d = rows.withColumn(line, F.regexp_replace(line, r"^\s+|\s+$", "")).where(F.col(line) != "")
    return d.groupBy(*group, line).agg(F.min(pos).alias(pos))


def number_of(id_: Column, prefix: str) -> Column:
    """The number of an id prefix-<n>; null, which sorts last, for others."""
    return F.try_to_number(F.regexp_extract(id_, "^" + prefix + r"-(\d{1,18})\z", 1), F.lit("999999999999999999")).cast("bigint")


def threat_order(id_: str = "threat_id") -> list[Column]:
    """Numbered ids by number, others after them by name."""
    return [number_of(F.col(id_), "threat").asc_nulls_last(), F.col(id_)]


def gap_order(id_: str = "gap_id") -> list[Column]:
    """The most certain first, then ids by their number."""
    return [F.desc("certainty"), number_of(F.col(id_), "gap").asc_nulls_last(), F.col(id_)]
