import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.llm import common, simhash


def naive_fingerprint(text):
    words = (text or "").lower().encode().split() if text and text.isascii() else [w for w in bytes((text or "").encode()).lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def naive_components(values, radius=3):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    vs = list(root)
    for i, a in enumerate(vs):
        for b in vs[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in vs}


def grouped(pairs, values):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc XY\t\né", max_size=30), max_size=12))
def test_fingerprint(texts):
    for t in texts:
        assert simhash.fingerprint(t.encode()) == naive_fingerprint(t)


def test_trees_lose_no_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    near = base[rng.integers(0, 40, 900)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64))
    values = np.unique(np.concatenate((base, near, np.array([0], np.uint64))))
    want = naive_components([int(v) for v in values])
    for shards in (1, 6):
        nodes = simhash.upper_tree(rng.choice(values, 800, replace=False), shards, 3)
        pairs = [(int(a), int(b)) for _, part in simhash.deal(values, nodes, 3) for a, b in simhash.local_links(part, 3)]
        assert grouped(pairs, want) == want
        assert len(pairs) < 3 * len(values)  # a spanning set, not all pairs


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 50)
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(150)]
    texts += [texts[0]] * 40 + [texts[1] + " tail", texts[2].upper(), "", None, " \n", "one", "one two"]
    long = " ".join(rng.choice(words, 30000))
    texts += [long, long + " end"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(5, texts[5], "again"), (None, texts[0], "none")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string").repartition(5)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = {i: naive_fingerprint(t) for i, t, _ in rows if i is not None}
    root = naive_components(sorted(set(fps.values())))
    first = {}
    for i, f in sorted(fps.items()):
        first.setdefault(root[f], i)
    for r in got:
        i = 0 if r.doc_id is None else r.doc_id
        assert (r.fingerprint, r.component_id) == (f"{fps[i]:016x}", first[root[fps[i]]])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
