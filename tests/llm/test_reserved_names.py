from pyspark.sql import functions as F

from wardline.llm import common, line_dedup, quality


def test_columns_of_our_own_names_pass_through(spark):
    text = "\n".join(f"line {i} of the text and more of it in a row" for i in range(9))
    names = ["__lines", "__own", "__text", "__quality", "__words", "__n_lines", "kept__own"]
    rows = [(1, text, "en", *names), (2, text, "en", *names)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", *names])
    left = line_dedup.dedup_lines(docs)
    assert left.columns == ["doc_id", "text", "lang", *(n for n in names if n != "__n_lines"), "__n_lines", "__n_removed"]
    assert all([r[n] for n in names if n != "__n_lines"] == [n for n in names if n != "__n_lines"] and r["__n_lines"] == 9 for r in left.collect())
    docs = docs.withColumn("text", F.lit(" ".join(f"word{i}" for i in range(90))))
    kept = quality.keep_documents(docs)
    assert kept.columns == docs.columns and all([r[n] for n in names] == names for r in kept.collect()) and kept.count() == 2


def test_written_tables_can_be_discarded(spark):
    import os

    t = common.materialize(spark.range(3), "x")
    assert os.path.exists(t._written_at.removeprefix("file://"))
    common.discard(t)
    assert not os.path.exists(t._written_at.removeprefix("file://"))
