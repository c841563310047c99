"""The trie against plain dictionaries of prefixes, with buckets of every size."""

import hashlib
import random
import zlib

import pytest

from wardline.llm import prefix_trie, queries

KIND = "conv_id long, turn long, role string, text string"


def plain_nodes(convs):
    """{prefix: row} of {conv_id: [(role, text)]}."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    rows = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        below = [rows[k] for k in children.get(p, [])]
        rows[p] = (
            min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), sum(b[5] for b in below) or 1, own + sum(b[6] for b in below),
            hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
        )
    return sorted(rows.values(), key=repr)


def as_rows(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=repr)


def sequences(spark, convs):
    ids = {}
    rows = [(c, [ids.setdefault(t, len(ids)) for t in turns], [len(t[1]) for t in turns]) for c, turns in convs.items()]
    return spark.createDataFrame(rows, "conv_id long, ids array<long>, sizes array<int>")


def talks(rng, n):
    """A common first turn, many copies of one talk, turnless ones and a deep one."""
    some = lambda k: [(rng.choice("ua"), rng.choice(["", "x", "yé", "\U0001f600z"])) for _ in range(k)]
    copy = [("s", "hi"), *some(4)]
    out = {}
    for i in range(n):
        kind = rng.randrange(6)
        out[i * 3 - 7] = [] if kind == 0 else list(copy) if kind == 1 else copy[: rng.randrange(1, 5)] if kind == 2 else copy[:2] + some(rng.randrange(4)) if kind == 3 else some(rng.randrange(6))
    out[1000] = copy + [("u", "more")] * 60
    out[1001] = copy + [("u", "more")] * 59
    return out


@pytest.mark.parametrize(("local", "turns"), [(1, 10**6), (3, 10**6), (40, 30), (10**6, 10**6)])
def test_buckets_of_every_size(spark, local, turns):
    convs = talks(random.Random(local), 160)
    assert as_rows(prefix_trie.nodes(sequences(spark, convs).repartition(3), local, turns)) == plain_nodes(convs)


@pytest.mark.parametrize("convs", [{5: []}, {5: [("u", "x")]}, {1: [("u", "x")], 2: [("u", "x")]}, {1: [], 2: [], 3: []}, {1: [("u", "a")] * 30, 2: [("u", "a")] * 30, 4: [("u", "a")] * 31}])
def test_small_tries(spark, convs):
    assert as_rows(prefix_trie.nodes(sequences(spark, convs), 1)) == plain_nodes(convs) == as_rows(prefix_trie.nodes(sequences(spark, convs)))


def test_chunks_of_ended(spark):
    convs = {i: [("u", "same"), ("a", "talk")] for i in range(-20, 400)} | {i: [] for i in range(500, 600)}
    assert as_rows(prefix_trie.nodes(sequences(spark, convs).repartition(5), 8)) == plain_nodes(convs)


def test_rows_to_sequences(spark):
    rows = [(1, 2, "u", "b"), (1, None, "s", None), (1, 2, "a", "c"), (1, 2, "a", "c"), (2, 0, None, "b"), (None, 0, "u", "x"), (3, 1, "u", "w" * 300_000)]
    d = spark.createDataFrame([(*r, 1) for r in rows], KIND + ", ids int")
    got = {r.conv_id: (list(r.ids), list(r.sizes)) for r in prefix_trie.sequences(d).collect()}
    assert {c: s for c, (_, s) in got.items()} == {1: [0, 1, 1, 1], 2: [1], 3: [300_000]}
    a = got[1][0]
    assert a[1] == a[2] and len({a[0], a[1], a[3], got[2][0][0], got[3][0][0]}) == 5
    assert sorted(x for i, _ in got.values() for x in i) == [0, 1, 2, 2, 3, 4] or len({x for i, _ in got.values() for x in i}) == 5
    assert prefix_trie.nodes(prefix_trie.sequences(d.where("conv_id > 9"))).count() == 0


def test_rebuilt(spark):
    rng = random.Random(2)
    convs = {c: [(c, d) for d in range(rng.randrange(9))] for c in [*range(0, 130), 205, 300, 307, 399]}
    want = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    rows = [(c, [10 * a + b for a, b in t], [b for _, b in t]) for c, t in convs.items()]
    got = queries.rebuilt(spark.createDataFrame(rows, "conv_id long, ids array<long>, sizes array<int>")).collect()
    assert {r.conv_id: (list(r.ids), list(r.sizes)) for r in got} == {c: ([10 * a + b for a, b in t], [b for _, b in t]) for c, t in want.items()}
