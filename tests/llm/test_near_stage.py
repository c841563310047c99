import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def stage(spark, rows):
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA).repartition(3)
    out = corpus_pipeline.near_duplicates(spark, df, "")
    assert out.columns == df.columns
    return sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=repr)


def test_near_copies_beyond_three_bits(spark):
    words = [f"w{k}" for k in range(100)]
    near, far = " ".join(words[:50] + ["new"] * 3 + words[53:]), " ".join(words[:50] + [f"n{k}" for k in range(20)] + words[70:])
    rows = [(1, " ".join(words), "a"), (2, near, "a"), (3, far, "a")]
    assert stage(spark, rows) == [rows[0], rows[2]]


def test_each_row_by_its_own_component(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a, "s"), (2, a, "s"), (2, b, "s"), (3, b, "s"), (None, c, "s"), (None, c, "t"), (None, a, "s"), (4, a + " end", "s"), (5, "", "s"), (6, "", "s"), (5, "", "s")]
    got = stage(spark, rows)
    assert [r for r in got if r[0]] == [(1, a, "s"), (2, b, "s"), (5, "", "s")]
    assert [r[:2] for r in got if r[0] is None] == [(None, c)]
    assert stage(spark, rows[::-1]) == got


def test_maps_and_reserved_names_pass_through(spark):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, {"a": 1}, "k"), (2, text, {"b": 2}, "k"), (2, text, {"b": 2}, "k"), (3, None, None, "k"), (None, "other words here", {"c": 1, "d": 2}, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, about map<string, int>, __key string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.about, r["__key"]) for r in got.collect()), key=repr) == sorted([(1, {"a": 1}, "k"), (3, None, "k"), (None, {"c": 1, "d": 2}, "k")], key=repr)
