import random

import pytest
from pyspark.sql import functions as F

from wardline.llm import toxicity


def by_definition(scores):
    """The best segment, then the same to its left and right."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-12 and (best is None or total > best[0] + 1e-12):
                best = total, i, j
    if best is None:
        return []
    left, right = by_definition(scores[: best[1]]), by_definition(scores[best[2] + 1 :])
    return left + [best] + [(s, a + best[2] + 1, b + best[2] + 1) for s, a, b in right]


def test_segments_are_the_maximal_ones():
    r = random.Random(3)
    for _ in range(800):
        n = r.randint(0, 25)
        hits = [(i, r.choice([0.3, 0.7, 1.1, 2.3]) + r.random() * 0.01) for i in range(n) if r.random() < 0.3]
        scores = [-0.313] * n
        for i, s in hits:
            scores[i] = s
        assert [(round(s, 6), a, b) for s, a, b in toxicity.segments(hits, 0.313)] == [(round(s, 6), a, b) for s, a, b in by_definition(scores)]


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(1)
    words, rude = [f"word{i}" for i in range(300)], ["grub", "vermin", "dolt", "oaf"]
    rows, labels = [], []
    for i in range(900):
        text = [r.choice(words) for _ in range(r.randint(30, 150))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(5):
                text.insert(r.randrange(len(text)), r.choice(rude))
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    rows += [(9000, None, "x"), (9001, "", "x"), (None, "grub dolt oaf vermin", "x"), (1, rows[1][1], "x"), (9002, "word1 " * 40000, "x")]
    labels += [(9001, None), (None, 1), (0, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_accuracy_and_edges(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))
    assert {b"grub", b"vermin", b"dolt", b"oaf"} <= set(model.scores)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    held = [i for i in range(900) if i % 3 == 0]
    right = sum(by_id[i].predicted == int(i % 5 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert by_id[None].predicted == 1 and by_id[9000].predicted == by_id[9001].predicted == by_id[9002].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert by_id[9000].score == by_id[9001].score


def test_one_class_or_no_rows(spark, tables):
    docs, labels = tables
    for some in (labels.limit(0), labels.where("toxic = 1")):
        model = toxicity.fit(docs, some)
        assert toxicity.score_documents(docs.limit(3), model).agg(F.max("predicted")).first()[0] == 0
    empty = docs.limit(0)
    assert toxicity.score_documents(empty, toxicity.fit(empty, labels)).count() == 0
