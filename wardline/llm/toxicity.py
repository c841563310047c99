"""Toxic passages as maximal-scoring segments of token log-odds, with extreme-value calibration.

Fit: the numbers of toxic and of clean training texts with a token give log-odds with an informative
Dirichlet prior (the prior follows the pooled counts) and their z-scores; tokens that lean toxic beyond
Z_LEAST are candidates, all of them. Texts count no more than the different tokens that a candidate
follows, or a group of near copies would pass for independent evidence; what still leans beyond Z_LEAST
forms the lexicon. All other tokens score -DRIFT. lambda solves the moment equation
sum p_i exp(lambda s_i) = 1 under the clean token distribution, and K is taken from the rate of segments
in clean texts. Score: one linear scan finds every maximal segment; E = K n exp(-lambda S) is the number
of such segments expected by chance in a text of n tokens; the evidence of a text is the sum of -ln E over
its segments with E < 1. A logistic curve fitted on the training texts maps the evidence to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, materialize, sliced

#: Labelled rows of each class used for fitting, those with the smallest hash of the id: the documented bound.
ROWS_PER_CLASS = 20_000
Z_LEAST = 3.5
DRIFT = 0.15
#: Weight of the prior: pseudo-tokens for each token counted, spread as the pooled counts are.
PRIOR = 0.05
#: Segments below this score are left out of the estimate of K.
LEAST_SEGMENT = 2.0

tokens_of = re.compile(rb"[a-z0-9\x80-\xff]+").findall


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last token), in order, of a token sequence in which the
    listed positions have positive scores and all others -drift. One pass with a stack: each position is
    pushed once, and merging removes what it passes (Ruzzo and Tompa)."""
    stack: list[tuple[float, float, int, int]] = []  # total before, total after, first, last
    total, before = 0.0, -1
    for at, score in hits:
        total -= drift * (at - before - 1)
        left, right, first = total, total + score, at
        total, before = right, at
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j -= 1
            # segments above j begin no lower than this one; they stay, unless one at j absorbs them
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, first, at))
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(r - l, a, b) for l, r, a, b in stack]


@dataclass
class Model:
    scores: dict[bytes, float]
    drift: float
    lam: float
    k: float
    weights: tuple[float, float] = (0.0, 0.0)

    def passages(self, text: bytes) -> tuple[int, list[tuple[float, int, int]]]:
        words = tokens_of(text.lower())
        get = self.scores.get
        hits = [(i, s) for i, s in enumerate(map(get, words)) if s is not None]
        return len(words), segments(hits, self.drift) if hits else []

    def evidence(self, text: bytes) -> tuple[float, int, float]:
        """Sum of -ln E over significant passages, their number, and the best segment score."""
        n, found = self.passages(text)
        total, count = 0.0, 0
        for s, _, _ in found:
            x = self.lam * s - math.log(self.k * max(n, 1))
            if x > 0:
                total, count = total + x, count + 1
        return total, count, max((s for s, _, _ in found), default=0.0)

    def probability(self, evidence: float) -> float:
        z = self.weights[0] + self.weights[1] * math.log1p(evidence)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _lambda(p: np.ndarray, s: np.ndarray, drift: float) -> float:
    """Root of sum p exp(lambda s) + (1 - sum p) exp(-lambda drift) = 1 above zero; the mean score is negative."""
    f = lambda x: float(np.sum(p * np.exp(np.minimum(x * s, 600.0))) + (1 - p.sum()) * math.exp(-x * drift)) - 1
    low, high = 1e-6, 1e-3
    while f(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a = np.column_stack((np.ones(len(x)), x))
    w, ridge = np.zeros(2), np.diag([1e-6, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(float(w[1]), 0.0)


def training_rows(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, rows: int) -> DataFrame:
    """The bounded training texts with column y. The ids come from labels by their hashes, at most ``rows``
    of a class, so they are broadcast. Equal texts count once, else a group of copies would pass for evidence.
    Of conflicting labels the larger counts."""
    marked = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(id_column).agg(F.max(F.col(label_column).cast("int")).alias("y"))
    part = lambda y: marked.where(F.col("y") == y).orderBy(F.xxhash64(id_column), id_column).limit(rows)
    picked = part(1).unionByName(part(0))
    texts = docs.select(id_column, text_column).join(F.broadcast(picked), id_column)
    return materialize(texts.groupBy(F.xxhash64(text_column).alias("h")).agg(F.max("y").alias("y"), F.min(text_column).alias("text")).select("y", "text"), "toxicity-training")


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", rows: int = ROWS_PER_CLASS) -> Model:
    train = training_rows(docs, labels, id_column, text_column, label_column, rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def out() -> pa.RecordBatch:
            words = list(set(seen[0]) | set(seen[1]))
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64())], ["word", "toxic", "clean"])

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), byte_column(batch, "text"), strict=True):
                seen[y].update(set(tokens_of(text.lower())))
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield out()
                seen = Counter(), Counter()
        yield out()

    words = train.mapInArrow(count, "word binary, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    totals = words.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    n_t, n_c = float(totals[0]), float(totals[1])
    def leaning(counts: DataFrame) -> DataFrame:
        prior = F.lit(PRIOR) * (F.col("toxic") + F.col("clean"))
        log_odds = lambda y, n: F.log((F.col(y) + prior) / (F.lit(n + PRIOR * (n_t + n_c)) - F.col(y) - prior))
        scored = counts.withColumn("delta", log_odds("toxic", n_t) - log_odds("clean", n_c)).withColumn("z", F.col("delta") / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)))
        return scored.where(F.col("z") >= Z_LEAST)

    # drawn from at most 2 * rows texts, whatever the corpus: a candidate takes several toxic ones
    candidates = {bytes(r.word): (r.toxic, r.clean) for r in leaning(words).collect()} if n_t and n_c else {}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[bytes, bytes, int]] = set()
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), byte_column(batch, "text"), strict=True):
                found = tokens_of(text.lower())
                seen.update((w, before, y) for before, w in zip([b"", *found], found, strict=False) if w in candidates)
        rows = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int32())], ["word", "before", "y"])

    follows = train.mapInArrow(contexts, "word binary, before binary, y int").distinct().groupBy("word").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")) if candidates else None
    capped = [(w, min(candidates[w][0], r.toxic), min(candidates[w][1], r.clean)) for r in (follows.collect() if candidates else []) for w in [bytes(r.word)]]
    lexicon = leaning(docs.sparkSession.createDataFrame(capped, "word binary, toxic bigint, clean bigint")).collect() if capped else []
    if not lexicon:  # one class or none: nothing to tell apart
        return Model({}, DRIFT, 1.0, 1.0, (-20.0, 0.0))
    s = np.array([r.delta for r in lexicon])
    p = (np.array([r.clean for r in lexicon], float) + 0.5) / (n_c + 0.5 * len(lexicon))
    drift = max(DRIFT, 2 * float((p * s).sum()))  # keeps the mean score below zero
    model = Model({bytes(r.word): float(r.delta) for r in lexicon}, drift, _lambda(p, s, drift), 1.0)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = found = 0
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), byte_column(batch, "text"), strict=True):
                if not y:
                    size, parts = model.passages(text)
                    n, found = n + size, found + sum(x[0] >= LEAST_SEGMENT for x in parts)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([found], pa.int64())], ["n", "found"])

    n, found = train.mapInArrow(rate, "n bigint, found bigint").agg(F.sum("n"), F.sum("found")).first()
    model.k = max(float(found), 0.5) * math.exp(model.lam * LEAST_SEGMENT) / max(float(n), 1.0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.evidence(t)[0] for t in byte_column(batch, "text")], pa.float64())], ["y", "x"])

    xy = np.array([(r.y, r.x) for r in train.mapInArrow(measure, "y int, x double").collect()], float).reshape(-1, 2)  # two numbers for each of at most 2 * rows texts
    model.weights = _logistic(np.log1p(xy[:, 1]), xy[:, 0])
    return model


def score_documents(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, score, predicted, n_passages, best_passage for each row. Null and empty texts have no passages and get
    the score of no evidence. Repeated and null ids pass through; other columns are not read. No shuffle."""
    schema = f"{id_column} {docs.schema[id_column].dataType.simpleString()}, score double, predicted int, n_passages int, best_passage double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_column):
            found = [model.evidence(t) for t in byte_column(batch, text_column)]
            scores = [model.probability(x) for x, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(p >= 0.5) for p in scores], pa.int32()), pa.array([n for _, n, _ in found], pa.int32()), pa.array([s for _, _, s in found], pa.float64())],
                [id_column, "score", "predicted", "n_passages", "best_passage"],
            )

    return docs.select(id_column, text_column).mapInArrow(run, schema)
