import random

from wardline.llm import line_dedup

from .test_line_dedup import by_hand as windows_by_hand


def by_hand(rows):
    """rows (id, text), ids distinct: windows of three lines, and copies of shorter texts, which lose all lines."""
    first, out = {}, []
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        if len(lines) < 3 and (t or "").strip(" \t\n\v\f\r"):
            first.setdefault(t, i)
    for (i, whole), (_, left, n) in zip(rows, windows_by_hand(rows), strict=True):
        later = first.get(whole, i) != i
        out.append((i, "" if later else left, whole.count("\n") + 1 if later else n))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    return sorted(((r.doc_id, r.text, r["__n_removed"]) for r in line_dedup.dedup_lines(df, short=True).collect()), key=repr)


def test_copies_of_short_texts(spark):
    rows = [(1, "a b c"), (2, "a b c"), (3, "x\ny"), (4, "x\ny"), (5, "x\ny\nz"), (6, "x"), (7, None), (8, ""), (9, ""), (10, " \n"), (11, " \n"), (12, "a b c\nx\ny\nz"), (13, "q\na b c"), (14, "x\ny\nz\n")]
    got = run(spark, rows)
    assert got == by_hand(rows)
    assert {(2, "", 1), (4, "", 2)} <= set(got) and (9, "", 0) in got
    r = random.Random(6)
    rows = [(i, "\n".join(r.choice("abc") for _ in range(r.randint(0, 6)))) for i in range(80)]
    assert run(spark, rows) == by_hand(rows)
