"""lambda, K, evidence and score of a small corpus against plain code written from the definitions."""

import math
import random
import re
from collections import defaultdict

import pytest

from wardline.llm import toxicity as T

from .test_toxicity import by_definition


def bisect(f, low, high):
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def plain_fit(texts):
    """texts: (text, label), each once. Returns (scores, drift, lambda, K, weights)."""
    split = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", t.lower().encode())
    counts = defaultdict(lambda: [0, 0])
    for text, y in texts:
        for w in set(split(text)):
            counts[w][y] += 1
    n = [sum(c[y] for c in counts.values()) for y in (0, 1)]

    def leaning(counts):
        out = {}
        for w, (c, t) in counts.items():
            prior = T.PRIOR * (c + t)
            odds = [math.log((x + prior) / (n[y] + T.PRIOR * sum(n) - x - prior)) for y, x in ((0, c), (1, t))]
            delta = odds[1] - odds[0]
            if delta / math.sqrt(1 / (t + prior) + 1 / (c + prior)) >= T.Z_LEAST:
                out[w] = delta
        return out

    candidates = leaning(counts)
    follows = defaultdict(set)
    for text, y in texts:
        found = split(text)
        for before, w in zip([b"", *found], found, strict=False):
            if w in candidates:
                follows[w].add((before, y))
    kept = {w: [min(counts[w][y], sum(z == y for _, z in s)) for y in (0, 1)] for w, s in follows.items()}
    scores = leaning(kept)
    p = {w: (kept[w][0] + 0.5) / (n[0] + 0.5 * len(scores)) for w in scores}
    drift = max(T.DRIFT, 2 * sum(p[w] * s for w, s in scores.items()))
    rest = 1 - sum(p.values())
    moment = lambda x: sum(p[w] * math.exp(x * s) for w, s in scores.items()) + rest * math.exp(-x * drift) - 1
    lam = bisect(moment, 1e-3, 50)
    passages = lambda t: (len(split(t)), [s for s, _, _ in by_definition([scores.get(w, -drift) for w in split(t)])])
    clean = [passages(t) for t, y in texts if not y]
    k = max(sum(s >= T.LEAST_SEGMENT for _, found in clean for s in found), 0.5) * math.exp(lam * T.LEAST_SEGMENT) / sum(m for m, _ in clean)

    def evidence(text):
        m, found = passages(text)
        return sum(max(0.0, lam * s - math.log(k * max(m, 1))) for s in found)

    rows = [(math.log1p(evidence(t)), y) for t, y in texts]
    a = b = 0.0
    for _ in range(200):  # Newton steps of the penalized likelihood, by hand for two weights
        g, h = [-1e-6 * a, -1e-3 * b], [1e-6, 0.0, 1e-3]
        for x, y in rows:
            q = 1 / (1 + math.exp(-max(-30, min(30, a + b * x))))
            g[0], g[1] = g[0] + y - q, g[1] + (y - q) * x
            v = q * (1 - q)
            h[0], h[1], h[2] = h[0] + v, h[1] + v * x, h[2] + v * x * x
        det = h[0] * h[2] - h[1] * h[1]
        step = ((h[2] * g[0] - h[1] * g[1]) / det, (h[0] * g[1] - h[1] * g[0]) / det)
        a, b = a + step[0], b + step[1]
        if max(map(abs, step)) < 1e-10:
            break
    return scores, drift, lam, k, (a, b), lambda t: 1 / (1 + math.exp(-(a + b * math.log1p(evidence(t)))))


def test_every_number_of_a_small_corpus(spark):
    r = random.Random(11)
    plain, rude = [f"w{i}" for i in range(60)], ["grub", "dolt", "oaf"]
    texts = []
    for i in range(160):
        words = [r.choice(plain) for _ in range(r.randint(12, 30))]
        y = int(i % 4 == 0)
        for _ in range(r.randint(0, 4) if y else r.random() < 0.08):
            words.insert(r.randrange(len(words)), r.choice(rude))
        texts.append((" ".join(words).capitalize(), y))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id bigint, toxic int")
    model = T.fit(docs, labels)
    scores, drift, lam, k, weights, score = plain_fit(texts)
    assert scores and set(model.scores) == set(scores)
    assert model.scores == pytest.approx(scores) and (model.drift, model.lam, model.k) == pytest.approx((drift, lam, k), rel=1e-6)
    assert model.weights == pytest.approx(weights, rel=1e-5)
    for row in T.score_documents(docs, model).collect():
        want = score(texts[row.doc_id][0])
        assert row.score == pytest.approx(want, rel=1e-5) and row.predicted == int(want >= 0.5)


def test_the_lexicon_has_no_cap(spark):
    """Every token that leans far enough is in it, however many there are."""
    r = random.Random(2)
    words = {y: [f"{'cr'[y]}{i}" for i in range(21_000)] for y in (0, 1)}
    rows = [(i, " ".join(r.sample(words[i % 2], 21_000))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = T.fit(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int"))
    assert {w.encode() for w in words[1]} == set(model.scores)
