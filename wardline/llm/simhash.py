"""Near-duplicates by SimHash: exact pairs within a Hamming radius through vantage-point trees.

Fingerprints are made once for each text and reduced to distinct values, so a group of exact copies is one
value. A vantage-point tree fitted on a bounded sample deals all values into shards: a node sends distances
up to its threshold m inside and the rest outside, and those in (m - radius, m] to both. By the triangle
inequality two values within the radius differ by at most the radius in their distance to the vantage
point, so both lie on one side's list; every such pair therefore meets in some shard, however the tree was
fitted. A shard goes on splitting in memory the same way, compares small leaves exactly and returns a
spanning set of links, at most one for each value, never all pairs of a group. Components come from the
links by star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, connected_components, materialize, sliced

SEED = 42
#: Values from which the upper tree is fitted; all values are dealt by it.
SAMPLE = 16_384
#: Values that a shard should hold before the overlap is added.
SHARD = 40_000
LEAF = 384


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each run of width words, or of all words where there are fewer; no words: none. Unsigned."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def fingerprint_of(packed: np.ndarray) -> int:
    """Bits set in more than half of the hashes; none: zero. Unsigned."""
    n, total = len(packed), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = packed[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = 3) -> int:
    """Bits set in more than half of the XXH64 of the word shingles; no words: zero. Unsigned."""
    return fingerprint_of(np.array(shingle_hashes(text, width), np.uint64))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """id and fp (the 64 bits as a signed long) for each row; null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_column):
            fps = np.array([fingerprint(t, width) for t in byte_column(batch, text_column)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [id_column, "fp"])

    return docs.select(id_column, text_column).mapInArrow(run, f"{id_column} {docs.schema[id_column].dataType.simpleString()}, fp bigint")


def distance(values: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ to)


def split_at(values: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 6) -> tuple[np.uint64, int] | None:
    """A vantage point and threshold with the least work expected below it, or None where none helps."""
    best, n = None, len(values)
    for v in rng.choice(values, min(tries, n), replace=False):
        upto = np.cumsum(np.bincount(distance(values, v), minlength=66))
        for m in range(radius, 64):
            inside, outside = int(upto[m]), n - int(upto[m - radius])
            if 0 < inside and outside < n:
                cost = inside**1.8 + outside**1.8
                if best is None or cost < best[0]:
                    best = cost, v, m
    return None if best is None or best[0] > 0.995 * n**1.8 else best[1:]


def upper_tree(sample: np.ndarray, shards: int, radius: int) -> list[tuple]:
    """Nodes (vantage, threshold, inside, outside), or (shard,) for a leaf; node 0 is the root."""
    rng = np.random.default_rng(SEED)
    nodes, open_, closed = [()], [(len(sample), 0, sample)], []
    while open_ and len(open_) + len(closed) < shards:
        open_.sort(key=lambda x: x[0])
        size, node, part = open_.pop()
        cut = split_at(part, radius, rng) if size > 8 else None
        if cut is None:
            closed.append((size, node, part))
            continue
        v, m = cut
        d = distance(part, v)
        nodes[node] = (v, m, len(nodes), len(nodes) + 1)
        for child in (part[d <= m], part[d > m - radius]):
            open_.append((len(child), len(nodes), child))
            nodes.append(())
    for k, (_, node, _) in enumerate(open_ + closed):
        nodes[node] = (k,)
    return nodes


def deal(values: np.ndarray, nodes: list[tuple], radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, its values); a value near a boundary is in several."""
    todo = [(0, values)]
    while todo:
        node, part = todo.pop()
        if not len(part):
            continue
        if len(nodes[node]) == 1:
            yield nodes[node][0], part
            continue
        v, m, inside, outside = nodes[node]
        d = distance(part, v)
        todo += [(inside, part[d <= m]), (outside, part[d > m - radius])]


def leaf_links(part: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the values that link, as (value, one of its group)."""
    if len(part) <= LEAF:
        near = np.bitwise_count(part[:, None] ^ part[None, :]) <= radius
        alone = near.sum(axis=1) == 1
        if alone.all():
            return
        part = part[~alone]
    left = part
    while len(left):  # breadth first: a value is compared once with those not reached yet
        root, left, reached = left[0], left[1:], [left[0]]
        while reached and len(left):
            hit = distance(left, reached.pop()) <= radius
            if hit.any():
                new = left[hit]
                left = left[~hit]
                reached.extend(new)
                for x in new:
                    yield x, root


def local_links(values: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    rng = np.random.default_rng(SEED)
    todo = [np.unique(values)]
    while todo:
        part = todo.pop()
        cut = split_at(part if len(part) <= 4096 else rng.choice(part, 4096, replace=False), radius, rng) if len(part) > LEAF else None
        if cut is not None:
            v, m = cut
            d = distance(part, v)
            inside, outside = part[d <= m], part[d > m - radius]
            if len(inside) < len(part) and len(outside) < len(part):
                todo += [inside, outside]
                continue
        yield from leaf_links(part, radius)


def links(distinct: DataFrame, radius: int = 3, count: int | None = None) -> DataFrame:
    """Edges a, b among the values of column fp that span every group of values within the radius."""
    n = distinct.count() if count is None else count
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    shards = max(1, -(-n // SHARD))
    nodes = upper_tree(sample, shards, radius) if len(sample) else [(0,)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for shard, part in deal(values, nodes, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard, np.int32)), pa.array(part.view(np.int64))], ["shard", "fp"])

    def within(table: pa.Table) -> pa.Table:
        values = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        pairs = np.array(list(local_links(values, radius)), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": pairs[:, 0].copy(), "b": pairs[:, 1].copy()})

    return distinct.select("fp").mapInArrow(route, "shard int, fp bigint").groupBy("shard").applyInArrow(within, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (smallest id reachable over links) for each row.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows stay, each with the
    same result. A row without an id gets a fingerprint and its component's id, but cannot name a component;
    a component of such rows only has none. Other columns are not read.
    """
    found = materialize(fingerprints(docs, id_column, text_column, width), "fingerprints")
    values = materialize(found.groupBy("fp").agg(F.min(id_column).alias("first")), "values")
    roots = connected_components(links(values, radius), "simhash")
    rooted = values.join(roots, values.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = materialize(rooted, "rooted")
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(names, "root").select("fp", "component_id")
    return found.join(classes, "fp").select(id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
