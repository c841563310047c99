"""Sums over ranges of rows, against plain loops."""

import random

from pyspark.sql import functions as F

from wardline.operators.windows import in_ranges, running_sums


def test_hot_group_ties_and_nulls(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None, ""]), rng.choice([None, 1, 2, 2, 3]), i, rng.randrange(5)) for i in range(900)]
    d = spark.createDataFrame(rows, "g string, o int, id long, v long")
    order = ["o", "id"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would be one range
    try:
        ranged = in_ranges(d.repartition(7), ["g"], order)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranged.select("__range").distinct().count() > 2
    got = running_sums(ranged, order, {"n": F.lit(1).cast("bigint"), "v": F.col("v")})
    have = {r.id: (r.n_before, r.n_total, r.v_before, r.v_total) for r in got.collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        at = 0
        for k, r in enumerate(own):
            want[r[2]] = (k, len(own), at, sum(x[3] for x in own))
            at += r[3]
    assert have == want


def test_no_group_and_empty(spark):
    d = spark.range(50).withColumn("v", F.col("id").cast("decimal(20,0)"))
    got = running_sums(in_ranges(d, [], [F.desc("id")]), [F.desc("id")], {"v": F.col("v")})
    assert {r.id: int(r.v_before) for r in got.collect()} == {i: sum(range(i + 1, 50)) for i in range(50)}
    none = running_sums(in_ranges(d.where("id < 0"), [], ["id"]), ["id"], {"n": F.lit(1)})
    assert none.count() == 0
