import random

import numpy as np
from pyspark.sql import functions as F

from wardline.llm import shingles


def words_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_hand(rows):
    """rows (id, text): the smallest id of each row's component, by comparing all pairs."""
    sets = [words_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    first = {}
    for k, (i, _) in enumerate(rows):
        first[find(k)] = min(i, first.get(find(k), i))
    return sorted((i, first[find(k)]) for k, (i, _) in enumerate(rows))


def copies(seed=3):
    """Texts with copies of which a run of words is new, on both sides of the similarity; chains; short and empty texts."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(60):
        own = list(rng.choice(words, int(rng.integers(40, 160))))
        texts.append(" ".join(own))
        for _ in range(3):
            new, at = int(rng.integers(1, max(2, len(own) // 6))), int(rng.integers(0, len(own) - 30))
            texts.append(" ".join(own[:at] + [f"n{x}" for x in rng.integers(0, 10**6, new)] + own[at + new :]))
    chain = list(rng.choice(words, 120))
    texts += [" ".join(chain[k * 8 : k * 8 + 80]) for k in range(5)]
    texts += ["", None, " \n", "one", "ONE", "one two", "one two three four five", "one two three four five six", texts[0], texts[0].upper()]
    order = rng.permutation(len(texts)).tolist()
    return [(i, texts[k]) for i, k in enumerate(order)]


def test_components_against_all_pairs(spark):
    rows = copies()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = by_hand(rows)
    assert sorted((r.doc_id, r.component_id) for r in shingles.near_duplicates(df).collect()) == want
    assert 60 < len({c for _, c in want}) < len(rows) - 60
    assert shingles.near_duplicates(df.limit(0)).count() == 0


def test_bands_at_the_least_similarity():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(3000):
        all_ = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        missed += not set(shingles.bands(np.unique(all_[:81]))) & set(shingles.bands(np.unique(all_[9:])))  # 72 of 90
    assert missed == 0


def test_chains_rebuild():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 60, 30, dtype=np.uint64)) for _ in range(40)]
    sets += [s[:-1] for s in sets[::2]] + [s[:20] for s in sets[1::2]]
    got = shingles.chains(sets)
    assert got[:40] == list(range(40)) and got[40:60] == list(range(0, 40, 2)) and got[60:] == list(range(60, 80))


def test_large_groups_in_parts_lose_no_link(spark, monkeypatch):
    """Families that chain from text to text, dealt into parts of three: the same components as all pairs give."""
    monkeypatch.setattr(shingles, "GROUP", 3)
    r = random.Random(9)
    rows = []
    for family in range(3):
        words = [f"f{family}w{i}" for i in range(60)]
        for step in range(14):
            rows.append((len(rows), " ".join(words)))
            at = r.randrange(0, 55)
            words[at : at + 1] = [f"n{len(rows)}"]  # far ends of a family share too little to link by themselves
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    sets = {i: set(shingles.shingle_set(t.encode()).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {(x.doc_id, x.component_id) for x in shingles.near_duplicates(df).collect()} == {(i, find(i)) for i in sets}
    texts = df.select(F.lit(1).cast("bigint").alias("root"), F.col("doc_id").alias("value"), "text")  # one candidate group of all
    got = {x.value: x.component for x in shingles.group_links(texts).collect()}
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in sets for b in sets)
