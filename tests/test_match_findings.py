from wardline.plans import catalog


def test_findings_of_all_orders(spark, tmp_path):
    lines = [(k, k % 4 + 1, "A" if k % 2 else "R", "F") for k in range(1, 60)] + [(7, 4, "N", "O"), (7, 4, "A", "F")]
    parts = [(k, k) for k in range(1, 12)] + [(102, 6), (103, 5)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(parts, "p_partkey bigint, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    want = {(o, p) for o, s, a, b in lines for p, size in parts if s == p % 100 + 1 and a + b in {"AF"[: 2 * (size % 2 == 0)], "RF"[: 2 * (size % 3 == 0)]} - {""}}
    for name in ("match_findings", "match_findings_all"):
        assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want)
