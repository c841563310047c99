import random

from wardline.llm import line_dedup


def by_hand(rows):
    """rows (id, text): the text left and the number of lines removed, by dictionaries."""
    key = lambda i, t, p: (i is None, i if i is not None else 0, t or "", p)
    places = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(x.strip(" \t\n\v\f\r") for x in w):
                places.setdefault(w, []).append((i, t, p))
    gone = {}
    for found in places.values():
        if len(found) < 2:
            continue
        first = min(found, key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[2]))
        for i, t, p in found:
            if (i, t, p) != first:
                cover = {p, p + 1, p + 2}
                if (i, t) == first[:2]:
                    cover = {q for q in cover if q > first[2] + 2}
                gone.setdefault((i, t), set()).update(cover)
    out = []
    for i, t in rows:
        g = gone.get((i, t), set())
        out.append((i, t if not g else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in g), len(g)))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, lines int").repartition(4)
    return sorted(((r.doc_id, r.text, r["__n_removed"]) for r in line_dedup.dedup_lines(df).collect()), key=repr)


def test_passages_and_edges(spark):
    p = "one\ntwo\nthree\nfour"
    rows = [
        (1, f"a\n{p}\nb"), (2, f"c\n{p}\nd"), (3, p), (4, "a\na\na\na\na\na"), (5, "one\ntwo"), (6, None), (7, ""), (8, "\n\n\n\n"), (9, "\n\n\n\n"),
        (None, f"x\n{p}"), (10, f"e\n{p}\nf"), (10, f"e\n{p}\nf"), (11, "two\nthree\nfour\nfive"), (12, "four\nfive\r\nsix"), (13, "k\n" * 3000), (14, "k\n" * 3000),
    ]
    assert run(spark, rows) == sorted(by_hand(rows), key=repr)
    assert run(spark, [(1, "x")]) == [(1, "x", 0)]
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = [(i, "\n".join(r.choice("abcd") for _ in range(r.randint(0, 12)))) for i in range(60)]
    assert run(spark, rows) == sorted(by_hand(rows), key=repr)


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a\nb\nc")], "doc_id bigint, text string")
    plan = line_dedup.dedup_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
