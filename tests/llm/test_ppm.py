import math
from collections import Counter, defaultdict

import pytest

from wardline.llm import ppm


def trie_of(train):
    """The same model as dictionaries."""
    counts = defaultdict(Counter)
    pad = bytes([ppm.BEFORE]) * ppm.ORDER
    for t in train:
        d = pad + t + bytes([ppm.END])
        for i in range(ppm.ORDER, len(d)):
            for k in range(ppm.ORDER + 1):
                counts[d[i - k : i]][d[i]] += 1
    return counts


def code_length(counts, text):
    """Exclusion by sets, escape by counting."""
    pad = bytes([ppm.BEFORE]) * ppm.ORDER
    d, total = pad + text + bytes([ppm.END]), 0.0
    for i in range(ppm.ORDER, len(d)):
        out, symbol, found = set(), d[i], False
        for k in range(ppm.ORDER, -1, -1):
            c = counts.get(d[i - k : i])
            if not c:
                continue
            n, q = sum(v for x, v in c.items() if x not in out), sum(x not in out for x in c)
            if n + q == 0:
                continue
            if symbol in c:
                total += math.log10(c[symbol] / (n + q))
                found = True
                break
            total += math.log10(q / (n + q))
            out |= set(c)
        if not found:
            total -= math.log10(ppm.SYMBOLS - len(out))
    return total


def by_hand(train, text):
    return code_length(trie_of(train), text)


ROWS = [(1, "The cat sat on the mat. The cat", True), (2, "the cat ate the rat\n\tagain", True), (2, "the cat ate the rat\n\tagain", True), (3, "Zebra über cat", False), (4, None, True), (5, "", False), (None, "mat mat mat", False), (6, "cat " * 500, True)]


@pytest.mark.parametrize("rows", [ROWS, [r for r in ROWS if not r[2]], [(1, "a", True)]])
def test_scores(spark, rows):
    df = spark.createDataFrame([(i, t, f, "x") for i, t, f in rows], "doc_id bigint, text string, training boolean, score string")
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ppm.score_documents(df, "training").collect())
    low = [((t or "").lower().encode(), f) for _, t, f in rows]
    train = [t for t, f in low if f]
    c = Counter(w for t in train for w in t.split())
    c["end"] = len(train)
    n, v = sum(c.values()), len([w for w in c if c[w]])
    want = []
    for (i, _, _), (t, _) in zip(rows, low, strict=True):
        toks = [*t.split(), "end"]
        want.append((i is None, i, len(toks), sum(c[w] > 0 for w in toks), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks), by_hand(train, t)))
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want)]
    for g, w in zip(got, sorted(want), strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("least", [0, 3, 40])
def test_scores_from_split_pieces(spark, monkeypatch, least):
    """Hot contexts split by one to three more bytes; the values do not change."""
    monkeypatch.setattr(ppm.Trie, "LEAST", least)
    monkeypatch.setattr(ppm.Trie, "PARTS", 10**6)
    seen = []
    made = ppm.Trie.__init__
    monkeypatch.setattr(ppm.Trie, "__init__", lambda self, g: (made(self, g), seen.append({k: len(v) for k, v in self.split.items()}))[0])
    test_scores(spark, ROWS)
    assert seen and (set(seen[0]) == {2, 3, 4} if least < 40 else len(seen[0]) <= 1)


def test_block_numbers_have_no_gaps(spark):
    rows = [(part, place, [part], b"") for part in (0, 3, (1 << 20) + 5, 780_000, 1 << 40) for place in range(3)]
    df = spark.createDataFrame(rows[::-1], "part bigint, place bigint, ids array<bigint>, texts binary")
    assert [(r.block, r.ids[0]) for r in sorted(ppm.numbered(df).collect())] == [(k, r[0]) for k, r in enumerate(sorted(rows))]


def test_packed_answers_are_exact():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (1, 2, 15, 5000):
        places = np.sort(r.choice(1 << 31, n, replace=False))
        for values in (r.random(n), r.choice(np.log10(np.arange(1, 9) / 11), n)):
            got = ppm.unsqueeze(ppm.squeeze(places, values))
            assert (got[0] == places).all() and (got[1] == values).all()


@pytest.mark.parametrize("kind", ["smallint", "string", "decimal(12,0)"])
def test_ids_of_any_type(spark, kind):
    df = spark.createDataFrame([(i, t, f) for i, t, f in ROWS], "doc_id bigint, text string, training boolean")
    got = ppm.score_documents(df.selectExpr(f"cast(doc_id as {kind}) doc_id", "text", "training"), "training")
    assert got.schema["doc_id"].dataType.simpleString() == kind
    assert sorted(-1 if r.doc_id is None else int(r.doc_id) for r in got.collect()) == sorted(-1 if i is None else i for i, _, _ in ROWS)


def test_probabilities_of_a_context_sum_to_one():
    import numpy as np

    train = [b"abracadabra", b"abrak"]
    keys, n = ppm.count_grams(train)
    o1 = np.zeros((256, 256))
    np.add.at(o1, ((keys >> np.uint64(8) & np.uint64(255)).astype(int), (keys & np.uint64(255)).astype(int)), n)
    context = ppm.grams([b"abra"])[-1] & ~np.uint64(255)
    every = np.sort(context | np.arange(256, dtype=np.uint64))
    both = np.union1d(keys, every)
    counts = np.zeros(len(both), np.int64)
    counts[np.searchsorted(both, keys)] = n
    mine = (both >> np.uint64(8) & np.uint64(65535)) == (context >> np.uint64(8) & np.uint64(65535))
    values = ppm.code_lengths(both[mine], counts[mine], o1.sum(0), o1)
    chosen = np.isin(both[mine], every)
    assert (10 ** values[chosen]).sum() == pytest.approx(1.0, abs=1e-9)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, training boolean")
    assert ppm.score_documents(df, "training").count() == 0


def test_long_text_in_runs(monkeypatch):
    import numpy as np

    text = b"hello world " * 50
    keys, n = ppm.count_grams([text])
    table = ppm.Lookup(keys, np.arange(len(keys), dtype=float))
    whole = ppm.score_texts([text], table)
    monkeypatch.setattr(ppm, "RUN", 37)
    assert ppm.score_texts([b"a", text, b"b"], ppm.Lookup(np.unique(ppm.grams([b"a", text, b"b"])), np.ones(len(np.unique(ppm.grams([b"a", text, b"b"]))))))[1] == len(text) + 1
    assert ppm.score_texts([text], table) == pytest.approx(whole)
    again = ppm.count_grams([text, text])
    assert (again[0] == keys).all() and (again[1] == 2 * n).all()
