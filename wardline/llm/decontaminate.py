"""Benchmark passages in texts: q-gram lemma filtering over diagonal bands, verified by banded alignment.

Texts and items are folded: letters and digits in lower case, every run of other characters one space. An
item is cut into probes of at most PROBE characters that begin every STRIDE characters, so a part of a long
item counts too: an exact part of SHORTEST folded characters is found wherever it lies in the item. A probe of m characters with at most k = EDITS * m edits shares at least m - q + 1 - k q of its q-grams
with the text, all on diagonals (text place - probe place) that differ by at most k. Bands of 2 (k + 1)
diagonals that overlap by half therefore hold all of them in one band. Bands with as many shared q-grams are
aligned within the band, ends free in the text, and kept when the distance is at most k.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, sliced

Q = 9
EDITS = 0.08
PROBE = 160
STRIDE = 20
#: A part as long holds all but the edits' characters of some probe, at one end or the other.
SHORTEST = PROBE - 2 * int(EDITS * PROBE) + STRIDE - 1
#: Folded characters of items whose q-grams are held and broadcast at once; a larger benchmark takes more passes.
BLOCK = 2_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _fold_table() -> np.ndarray:
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LNM":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
        else:
            out[c] = 32
    return out


_table: list[np.ndarray] = []


def _kept(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of every place of the text, and which of them are kept."""
    if not _table:
        _table.append(_fold_table())
    points = _table[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = points != 32
    keep[1:] |= keep[:-1]  # the first other character after a letter or digit
    if len(keep):
        keep[0] = True
    return points, keep


def fold(text: str) -> np.ndarray:
    """Folded code points."""
    points, keep = _kept(text)
    return points[keep]


def places(text: str) -> np.ndarray:
    """The place in the text of each folded code point."""
    return np.nonzero(_kept(text)[1])[0]


def qgrams(points: np.ndarray) -> np.ndarray:
    """The q-grams as numbers of 7 bits a character. Characters that share their low bits may make different
    q-grams equal; that only adds candidates."""
    n = len(points) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    one = (points & np.uint32(127)).astype(np.uint64)
    two = one[:-1] << np.uint64(7) | one[1:]
    four = two[:-2] << np.uint64(14) | two[2:]
    eight = four[:-4] << np.uint64(28) | four[4:]
    return eight[:n] << np.uint64(7) | one[Q - 1 :]


class Index:
    """Probes of a block of items and their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: list[int] = []
        self.texts: list[np.ndarray] = []
        self.short: list[tuple[int, np.ndarray]] = []  # below q characters: found as whole words
        owner, offsets, sizes = [], [], []
        flat, first, many, inner = [], [], [], []  # of each q-gram of an item: the probes that hold it, its place
        for item, text in items:
            points = _trim(fold(text))
            if len(points) < Q:
                if len(points):
                    self.short.append((item, points))
                continue
            last = max(0, len(points) - PROBE)
            at = np.array(sorted({*range(0, last + 1, STRIDE), last}), np.int64)
            grams = qgrams(points)
            place = np.arange(len(grams))
            low = np.searchsorted(at + min(PROBE, len(points)) - Q, place)
            flat.append(grams)
            inner.append(place)
            first.append(low + len(self.items))
            many.append(np.searchsorted(at, place, "right") - low)
            owner += [len(self.texts)] * len(at)
            offsets += at.tolist()
            sizes += [min(PROBE, len(points))] * len(at)
            self.items += [item] * len(at)
            self.texts.append(points)
        self.owner, self.offsets, self.sizes = (np.array(x, np.int64) for x in (owner, offsets, sizes))
        self.budget = np.minimum((EDITS * self.sizes).astype(np.int64), (self.sizes - Q) // Q)
        self.least = self.sizes - Q + 1 - self.budget * Q
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.first, self.many, self.place = (np.concatenate(x)[order].astype(np.int32) if x else np.zeros(0, np.int32) for x in (first, many, inner))
        self.grams, self.starts = np.unique(flat[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(flat))
        bits = max(12, int(16 * max(len(self.grams), 1)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self._slot(self.grams)] = True

    def probe(self, number: int) -> np.ndarray:
        at = self.offsets[number]
        return self.texts[self.owner[number]][at : at + self.sizes[number]]

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams * MULTIPLIER) >> self.shift

    def hits(self, points: np.ndarray, base: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text place, probe, probe place) of every q-gram shared with a probe."""
        g = qgrams(points)
        at = np.nonzero(self.maybe[self._slot(g)])[0]
        if not len(at) or not len(self.grams):
            return (np.zeros(0, np.int64),) * 3
        where = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        real = self.grams[where] == g[at]
        at, where = at[real], where[real]
        counts = self.ends[where] - self.starts[where]
        post = np.repeat(self.starts[where], counts) + _inside(counts)
        many = self.many[post].astype(np.int64)
        probe = np.repeat(self.first[post].astype(np.int64), many) + _inside(many)
        return np.repeat(np.repeat(at, counts), many) + base, probe, np.repeat(self.place[post], many) - self.offsets[probe]


def _inside(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... below each count, one run after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _trim(points: np.ndarray) -> np.ndarray:
    words = np.nonzero(points != 32)[0]
    return points[words[0] : words[-1] + 1] if len(words) else points[:0]


def align(probe: np.ndarray, region: np.ndarray, width: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of the probe in the region, among alignments that stay on the
    region's first ``width`` diagonals; None beyond the budget. Row i holds the cells (i, i + d), d < width."""
    d = np.arange(width)
    big = len(probe) + len(region) + 1
    cost, begin = np.where(d <= len(region), 0, big), d.copy()
    for i in range(len(probe)):
        at = i + d  # region place consumed by a match on diagonal d
        inside = at < len(region)
        match = np.full(width, big)
        match[inside] = cost[inside] + (region[at[inside]] != probe[i])
        up, up_begin = np.append(cost[1:] + 1, big), np.append(begin[1:], 0)  # probe character left out
        new = np.minimum(match, up)
        new_begin = np.where(match <= up, begin, up_begin)
        # region characters put in: from the left along the row
        key = (new - d) * (big * 4) + d
        best = np.minimum.accumulate(key)
        source = best % (big * 4)
        cost = np.minimum((best // (big * 4)) + d, big)
        begin = new_begin[source]
        cost[i + 1 + d > len(region)] = big
        if cost.min() > budget:
            return None
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), len(probe) + end


def find(text: str, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(item, edits, probes, start, end) for each item with a probe in the text: the fewest edits of a probe, the
    number of probes found, and the place in the text of all of them together."""
    points = fold(text)
    found: dict[int, list[tuple[int, int, int]]] = {}
    step, reach = 1 << 20, 2 * PROBE
    candidates: set[tuple[int, int]] = set()
    for base in range(0, max(len(points), 1), step):  # a long text in pieces that overlap by more than a match
        place, probe, inner = index.hits(points[max(0, base - reach) : base + step], max(0, base - reach))
        if not len(place):
            continue
        wide = index.budget[probe] + 1
        band = (place - inner) // wide
        key = (probe << 40) + (band + (1 << 20))
        keys, counts = np.unique(np.concatenate((key, key - 1)), return_counts=True)  # each diagonal is in two bands
        enough = keys[counts >= index.least[keys >> 40]]
        candidates.update(zip((enough >> 40).tolist(), ((enough & ((1 << 40) - 1)) - (1 << 20)).tolist(), strict=True))
    for probe, band in sorted(candidates):
        wanted, k = index.probe(probe), int(index.budget[probe])
        low = band * (k + 1)
        skip = max(0, -low)
        region = points[max(0, low) : low + 2 * (k + 1) + len(wanted) + k]
        same = _exact(wanted, region)
        got = (0, same, same + len(wanted)) if same >= 0 else align(wanted, region, 2 * (k + 1) - skip, k) if not skip else _align_at_start(wanted, region, 2 * (k + 1), skip, k)
        if got and got[0] <= k:
            found.setdefault(index.items[probe], []).append((got[0], max(0, low) + got[1], max(0, low) + got[2], probe))
    for item, short in index.short:
        space = np.array([32], np.uint32)
        same = _exact(np.concatenate((space, short, space)), np.concatenate((space, points, space)))
        if same >= 0:
            found.setdefault(item, []).append((0, same, same + len(short), -1))
    if not found:
        return []
    at = places(text)
    return [(item, min(m[0] for m in ms), len({m[3] for m in ms}), int(at[min(m[1] for m in ms)]), int(at[min(max(m[2] for m in ms), len(at)) - 1]) + 1) for item, ms in sorted(found.items(), key=lambda x: (x[0] is None, x[0]))]


def _exact(probe: np.ndarray, region: np.ndarray) -> int:
    """Place of the probe itself in the region, or -1: no alignment is needed for most passages."""
    hay, needle = region.tobytes(), probe.tobytes()
    at = hay.find(needle)
    while at >= 0 and at % 4:
        at = hay.find(needle, at + 1)
    return at // 4 if at >= 0 else -1


def _align_at_start(probe: np.ndarray, region: np.ndarray, width: int, skip: int, budget: int) -> tuple[int, int, int] | None:
    """As align, for a band that begins before the text: cells before it cannot be used, only left behind."""
    padded = np.concatenate((np.full(skip, 0xFFFFFFFF, np.uint32), region))
    got = align(probe, padded, width, budget)
    return got and (got[0], max(0, got[1] - skip), max(0, got[2] - skip))


def _blocks(benchmark: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[int, str]]]:
    held: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.where(F.col(text_column).isNotNull()).select(id_column, text_column).orderBy(id_column).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1])
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, edits, probes, start, end): one row for each text and item found in it; start and end are
    code point places in the text.

    Null and empty texts and items hold nothing; an empty table of either kind finds nothing. Ids of both kinds may be
    of any type and null; a null item id is returned as null, and items that share an id are one. Repeated rows are
    searched one by one. The benchmark is a query set: blocks of it of a bounded size go to all tasks, each in one
    pass over the texts without a shuffle. The index of a full block takes some 120 MB, which is what is broadcast.
    """
    kinds = docs.schema[id_column].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
    schema = f"{id_column} {kinds[0]}, {item_column} {kinds[1]}, edits int, probes int, start bigint, end bigint"

    item_kind = to_arrow_type(benchmark.schema[item_column].dataType)

    def search(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in sliced(batches, text_column):
                types = batch.schema.field(0).type
                rows = [(i, *m) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for m in find(text, index)]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds_of = [types, item_kind, pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True)], [id_column, item_column, "edits", "probes", "start", "end"])

        return docs.select(id_column, text_column).mapInArrow(run, schema)

    out, waiting = None, None
    for block in _blocks(benchmark, item_column, item_text):
        if waiting is not None:  # more than one block: written, so that the driver holds one index at a time
            waiting = materialize(waiting, "contamination")
            out = waiting if out is None else out.unionByName(waiting)
        waiting = search(Index(block))
    if waiting is None:
        return docs.sparkSession.createDataFrame([], schema)
    return waiting if out is None else out.unionByName(waiting)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs without a benchmark passage, with all their columns; the verdict is made row by row, so
    repeated ids and rows without an id are judged by their own texts. Null and empty texts stay, and an empty
    benchmark leaves all rows. Several blocks mean several filters."""
    out = docs
    for block in _blocks(benchmark, item_column, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block))

        def clean(texts: pa.Array, shared=shared) -> pa.Array:
            index = shared.value
            found = [bool(t) and bool(find(t, index)) for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()]
            return pa.array([not x for x in found], pa.bool_())

        out = out.where(F.arrow_udf(clean, "boolean", F.ArrowUDFType.SCALAR)(F.col(text_column)))
    return out
