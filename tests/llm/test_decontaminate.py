import random

import numpy as np
import pytest

from wardline.llm import decontaminate as D

R = random.Random(7)
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(n):
    return " ".join("".join(R.choice(LETTERS) for _ in range(R.randint(2, 9))) for _ in range(n))


def edit(text, k):
    t = list(text)
    for _ in range(k):
        p, kind = R.randrange(len(t)), R.random()
        if kind < 0.33:
            t[p] = R.choice(LETTERS)
        elif kind < 0.66:
            t.insert(p, R.choice(LETTERS))
        elif len(t) > 1:
            del t[p]
    return "".join(t)


def distance_anywhere(p, t):
    row = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        new = [i]
        for j in range(1, len(t) + 1):
            new.append(min(row[j - 1] + (p[i - 1] != t[j - 1]), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_alignment_is_the_edit_distance():
    for _ in range(200):
        p = np.array([R.randrange(4) for _ in range(R.randint(3, 18))], np.uint32)
        t = np.array([R.randrange(4) for _ in range(R.randint(0, 30))], np.uint32)
        wide = np.concatenate((np.full(len(p), 99, np.uint32), t))
        assert D.align(p, wide, len(wide) + 1, 10**6)[0] == distance_anywhere(p.tolist(), t.tolist())


def test_no_passage_within_the_budget_is_missed():
    items = [(i, words(R.randint(8, 60))) for i in range(25)]
    index = D.Index(items)
    for _ in range(150):
        item, text = R.choice(items)
        probe = text[: D.PROBE]
        text = words(R.randint(0, 40)) + " " + edit(probe, int(D.EDITS * len(probe)) - 1) + " " + words(R.randint(0, 40))
        assert item in {m[0] for m in D.find(text, index)}


def test_filter_agrees_with_brute_force():
    items = [(i, words(12)) for i in range(6)]
    index = D.Index(items)
    for _ in range(60):
        item, text = R.choice(items)
        folded = D._trim(D.fold(text)).tolist()
        made = edit(text, R.randint(0, 14))
        k = int(index.budget[index.items.index(item)])
        want = distance_anywhere(folded[: D.PROBE], D.fold(made).tolist()) <= k
        assert (item in {m[0] for m in D.find(made, index)}) == want


def test_places_and_case_and_punctuation():
    item = "The quick brown fox jumps over the lazy dog and runs away"
    index = D.Index([(1, item), (2, "Ab"), (3, ""), (4, "!!!")])
    text = "intro -- THE quick,  brown fox; jumps over\nthe lazy dog... and runs away! ab outro"
    found = {m[0]: m for m in D.find(text, index)}
    assert set(found) == {1, 2}
    _, edits, _, start, end = found[1]
    assert edits == 0 and text[start:end] == "THE quick,  brown fox; jumps over\nthe lazy dog... and runs away"
    assert D.find("cab abs", index) == []


def test_long_text_across_pieces():
    item = words(20)
    index = D.Index([(1, item)])
    for before in (1 << 20, (1 << 20) - 60):
        text = ("x1 " * (before // 3 + 1))[:before] + item + " tail"
        assert [m[0] for m in D.find(text, index)] == [1]


def test_documents(spark, monkeypatch):
    a, b = words(30), words(60)
    rows = [(1, f"start {a} end"), (1, f"start {a} end"), (2, words(50)), (3, None), (4, ""), (None, f"x {b}"), (5, b[len(b) // 3 :] + " tail"), (6, f"{a} {b}")]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([(10, a, "k"), (11, b, "k"), (12, None, "k"), (13, "", "k")], "item_id bigint, text string, doc_id string")
    want = sorted([(1, 10), (1, 10), (-1, 11), (5, 11), (6, 10), (6, 11)])
    for block in (D.BLOCK, 10):  # one index, and one for each item
        monkeypatch.setattr(D, "BLOCK", block)
        got = D.contamination(docs.select("doc_id", "text"), bench).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in got) == want
        assert sorted(r.doc_id for r in D.clean_documents(docs, bench).collect()) == [2, 3, 4]
    assert D.contamination(docs, bench.limit(0)).count() == 0 and D.contamination(docs.limit(0), bench).count() == 0
    assert D.clean_documents(docs, bench.limit(0)).count() == len(rows)


@pytest.mark.parametrize("kind", ["string", "int", "smallint", "decimal(20,0)"])
def test_ids_of_any_type_and_null_items(spark, kind):
    a, b = words(30), words(25)
    docs = spark.createDataFrame([(1, f"x {a} y"), (2, f"{b} and {a}"), (3, None)], "doc_id bigint, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text")
    bench = spark.createDataFrame([(None, a), (7, b), (7, b), (8, a)], "item_id bigint, text string").selectExpr(f"cast(item_id as {kind}) item_id", "text")
    found = D.contamination(docs, bench)
    assert [found.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")] == [kind] * 2
    number = lambda x: x if x is None else int(x)
    assert sorted(((number(r.doc_id), number(r.item_id)) for r in found.collect()), key=repr) == sorted([(1, 8), (1, None), (2, 7), (2, 8), (2, None)], key=repr)
    renamed = bench.withColumnsRenamed({"item_id": "own", "text": "passage"})
    assert [number(r.doc_id) for r in D.clean_documents(docs, renamed, item_column="own", item_text="passage").collect()] == [3]
