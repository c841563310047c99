"""Mixing against exact fractions and the stated bounds."""

import random
from fractions import Fraction

import pytest

from wardline.llm import mixing


def naive_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Shares by weight, capped, the excess reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return got | {s: level * w[s] for s in free}
        for s in over:
            got[s] = Fraction(most * sizes[s])
            left -= got[s]
        free -= over
    return got


def rows_of(rng, n):
    out = []
    for i in range(n):
        source = rng.choice(["hot", "hot", "hot", "b", "", None, "é", "zz", "\U0001f600"])
        k = rng.choice([0, 1, 3, 3, 40, 200 if source == "b" else 7])
        out.append((i if i % 17 else None, source, None if i % 29 == 0 else " \t".join(["w"] * k) + rng.choice(["", "\n", "\xa0x"]), 1))
    return out


def test_targets_and_bounds(spark):
    rng = random.Random(5)
    rows = rows_of(rng, 700)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copies int")
    got = mixing.plan(docs.repartition(5)).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode().split())
    sizes = {s: sum(size(t) for _, x, t, _ in rows if x == s) for s in {r[1] for r in rows}}
    want = naive_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]}
        assert all(r.target == pytest.approx(float(want[s]), rel=1e-12) for r in own)
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 2 * max(r.size for r in own) + 1e-6
        rate = own[0].target / sizes[s] if sizes[s] else 0
        assert all(int(rate) <= r.copies <= min(2, int(rate) + 1) for r in own)
    assert sum(want.values()) == Fraction(3, 2) * sum(sizes.values())
    assert sorted((r.id or -1, r.size) for r in got) == sorted((r[0] or -1, size(r[2])) for r in rows)
    again = mixing.plan(docs.repartition(3)).collect()
    key = lambda r: (r.source or "", r.source is None, r.id or -1, r.text_hash or 0, r.size, r.copies)
    assert sorted(map(key, again)) == sorted(map(key, got))
    other = mixing.plan(docs, seed=9).collect()
    assert sorted(map(key, other)) != sorted(map(key, got))


def test_mix_emits_the_copies(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame(rows_of(rng, 200), "doc_id long, source string, text string, __copy int")
    taken = {}
    for r in mixing.plan(docs).collect():
        k = (r.id, r.source, r.text_hash)
        taken[k] = taken.get(k, 0) + r.copies
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(taken.values())


def test_edges(spark):
    kind = "doc_id long, source string, text string"
    assert mixing.plan(spark.createDataFrame([], kind)).count() == 0 and mixing.mix(spark.createDataFrame([], kind)).count() == 0
    blank = mixing.plan(spark.createDataFrame([(1, "a", None), (2, "a", ""), (None, None, " ")], kind)).collect()
    assert [(r.size, r.target, r.copies) for r in blank] == [(0, 0.0, 0)] * 3
    one = mixing.plan(spark.createDataFrame([(1, "a", "x y " * 90_000)], kind)).first()
    assert (one.size, one.target) == (180_000, 270_000.0) and one.copies in (1, 2)
    with pytest.raises(ValueError):
        mixing.plan(spark.createDataFrame([(1, "a", "x")], kind), share=2.5)
