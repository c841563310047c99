"""Excerpts for a budget."""

from wardline.operators import context


def col(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_windows_and_excerpts(spark):
    files = spark.createDataFrame([("r", "a", "\n".join(f"l{i}é" for i in range(1, 201))), ("r", "b", "one")], "repo string, path string, content string")
    places = spark.createDataFrame([("r", "a", 10, 2), ("r", "a", 71, 1), ("r", "a", 180, 3), ("r", "b", 1, 1), ("r", "b", 9, 0), ("r", "zzz", 1, 0)], "repo string, file string, line int, rank int")
    w = context.windows_around(places, files)
    assert col(w, "file", "lo", "hi", "n", "rank") == [("a", 1, 101, 2, 1), ("a", 150, 200, 1, 3), ("b", 1, 1, 1, 1)]
    e = {(r.file, r.lo): r for r in context.excerpts(w, files).collect()}
    assert e["b", 1].text == "one" and e["a", 150].text.startswith("l150é\n") and e["a", 150].bytes == len(e["a", 150].text.encode())


def test_pack_never_exceeds_the_budget(spark):
    rows = [("r", "a", 1, 0, 50), ("r", "a", 9, 0, 30), ("r", "b", 1, 5, 15), ("r", "c", 1, 6, 40), ("r", "d", 1, 7, 4), ("q", "x", 1, 0, 500)]
    parts = spark.createDataFrame(rows, "repo string, file string, lo int, rank int, bytes int").repartition(3)
    got = context.pack(parts, 100).where("taken")
    assert col(got, "repo", "file", "lo") == [("r", "a", 1), ("r", "a", 9), ("r", "b", 1), ("r", "d", 1)]
    assert sum(r.bytes for r in got.collect()) <= 100
    assert context.pack(parts.limit(0), 100).count() == 0


def test_shrink_and_spans(spark):
    facts = spark.createDataFrame([("r", s, i, 10) for s in ("routes", "gaps") for i in range(30)] + [("q", "x", 1, 999)], "repo string, section string, place int, bytes int")
    assert context.shrink(facts, 250).count() == 20 and context.shrink(facts, 600).where("repo = 'r'").count() == 60 and context.shrink(facts, 5).count() == 0
    s = spark.createDataFrame([(1, 0, 5, "b"), (1, 4, 9, "a"), (1, 9, 12, "c"), (2, 3, 4, "z")], "id int, lo int, hi int, type string")
    assert col(context.merge_spans(s, ("a", "b", "c")), "id", "lo", "hi", "type") == [(1, 0, 9, "a"), (1, 9, 12, "c"), (2, 3, 4, "z")]
