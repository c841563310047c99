"""Document scores by prediction by partial matching over bytes, with word counts as a base.

The model is the byte-context trie of the training texts, depth ORDER, with escape estimate q / (n + q)
(method C: n symbols seen after a context, q different ones) and symbol exclusion: after an escape the
symbols of the longer context are left out of the shorter one. As every context's symbols are among those
of its suffix, the exclusion set is always that of the context escaped from, so the denominator left is one
number for each context, and the whole code length of a symbol is a function of its ORDER + 1 bytes.

Texts are packed into blocks of about BLOCK bytes, written once. Each block numbers its distinct grams and words
and reports them with their counts in training texts; counts are summed over blocks; the trie is worked out in
pieces that share their last context bytes, two of them, or as many more as a piece needs to be no hot one (see
Trie). Each block then gets back the values of its own grams and words, packed, and scores its texts. What is
sent along is bounded whatever the corpus: the counts of order 0 and 1, those of the contexts that were split
further, and one number for each input split.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import byte_column, discard, materialize, release, sliced

ORDER = 5
BLOCK = 32 << 20
#: Bytes that UTF-8 never uses: before a text, and its end.
BEFORE, END = 0xFE, 0xFF
SYMBOLS = 256
#: Longest run of bytes turned into grams at once.
RUN = 4 << 20


def lower(text: bytes) -> bytes:
    return text.lower()  # bytes.lower() maps A-Z only


def _windows(data: np.ndarray) -> np.ndarray:
    """Each ORDER + 1 bytes of the data packed high to low, built by doubling."""
    n, out, width = len(data) - ORDER, None, 0
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, size, at = data.astype(np.uint64), 1, 0
    wanted = ORDER + 1
    while True:
        if wanted & size:
            piece = part[at : at + n]
            out = piece if out is None else out << np.uint64(8 * size) | piece
            at += size
            width += size
        if width == wanted:
            return out
        part = part[:-size] << np.uint64(8 * size) | part[size:]
        size *= 2


def grams(texts: list[bytes]) -> np.ndarray:
    """For each byte and each text's end: ORDER bytes of context and the symbol, packed high to low."""
    pad, end = bytes([BEFORE]) * ORDER, bytes([END])
    keys = _windows(np.frombuffer(b"".join(x for t in texts for x in (pad, t, end)), np.uint8))
    if len(texts) == 1:
        return keys
    keep = np.ones(len(keys), bool)
    starts = np.cumsum([len(t) + 1 + ORDER for t in texts])[:-1]
    for k in range(1, ORDER + 1):  # grams that reach into the next text's padding
        keep[starts - k] = False
    return keys[keep]


def runs_of(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in groups of about RUN bytes; a longer text is a group of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > RUN:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def pieces(text: bytes) -> Iterator[np.ndarray]:
    """The grams of one long text, about RUN at a time."""
    data = bytes([BEFORE]) * ORDER + text + bytes([END])
    for at in range(ORDER, len(data), RUN):
        yield _windows(np.frombuffer(data[at - ORDER : at + RUN], np.uint8))


def gram_groups(texts: list[bytes]) -> Iterator[np.ndarray]:
    for run in runs_of(texts):
        if len(run) == 1:
            yield from pieces(run[0])
        else:
            yield grams(run)


def count_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, and their counts; only a group's grams are held at once."""
    found = [np.unique(g, return_counts=True) for g in gram_groups(texts)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])
    order = np.argsort(keys, kind="stable")  # merges sorted runs
    keys, counts = keys[order], counts[order]
    first = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0]
    return keys[first], np.add.reduceat(counts, first).astype(np.int64)


def pack(rows: list[tuple[bytes, bool]]) -> bytes:
    """Texts with their training flags, compressed."""
    head = np.array([[len(t), f] for t, f in rows], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(rows).to_bytes(8, "little") + head + b"".join(t for t, _ in rows))


def unpack(data: bytes) -> list[tuple[bytes, bool]]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(data[:8], "little")
    head = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for size, flag in head.tolist():
        out.append((data[at : at + size], bool(flag)))
        at += size
    return out


def blocks(docs: DataFrame, id_column: str, text_column: str, training: str) -> DataFrame:
    """Rows (part, place, ids, packed texts): the blocks of each partition; the written table fixes which text is in which."""
    ids = docs.schema[id_column].dataType.simpleString()
    id_type = pa.list_(to_arrow_type(docs.schema[id_column].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bool]] = []
        own: list = []
        size, part, place = 0, TaskContext.get().partitionId(), -1

        def out() -> pa.RecordBatch:
            nonlocal place
            place += 1
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([place], pa.int64()), pa.array([own], id_type), pa.array([pack(held)], pa.binary())], ["part", "place", "ids", "texts"])

        for batch in sliced(batches, text_column):
            for i, text, flag in zip(batch.column(0).to_pylist(), byte_column(batch, text_column), batch.column(2).to_pylist(), strict=True):
                held.append((lower(text), bool(flag)))
                own.append(i)
                size += len(text)
                if size >= BLOCK:
                    yield out()
                    held, own, size = [], [], 0
        if held:
            yield out()

    return docs.select(id_column, text_column, training).mapInArrow(run, f"part bigint, place bigint, ids array<{ids}>, texts binary")


def numbered(packed: DataFrame) -> DataFrame:
    """Blocks numbered from 0 without a gap, so that block << 32 fits a long for 2**31 of them (64 exabytes of text),
    whatever the partitions. One row for each partition that read the input goes through the driver."""
    first, rows = 0, []
    for r in packed.groupBy("part").count().orderBy("part").collect():
        rows.append((r.part, first))
        first += r["count"]
    if first >= 1 << 31:
        raise ValueError(f"{first} blocks: raise BLOCK")
    starts = packed.sparkSession.createDataFrame(rows, "part bigint, first bigint")
    return packed.join(F.broadcast(starts), "part").select((F.col("first") + F.col("place")).alias("block"), "ids", "texts")


def contents(rows: list[tuple[bytes, bool]], counted: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes], list[int]]:
    """A block's distinct grams and words in an order that depends on its texts only, with their counts in training
    texts (``counted``), for which texts are looked through apart."""
    train, other = [t for t, f in rows if f], [t for t, f in rows if not f]
    if not counted:
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(g) for part in (train, other) for g in gram_groups(part))]))
        return keys, np.zeros(0, np.int64), list(dict.fromkeys(chain.from_iterable(map(bytes.split, train + other)))), []
    keys, n = count_grams(train)
    whole = np.union1d(keys, count_grams(other)[0])
    counts = np.zeros(len(whole), np.int64)
    counts[np.searchsorted(whole, keys)] = n
    words = Counter(chain.from_iterable(map(bytes.split, train)))
    for w in chain.from_iterable(map(bytes.split, other)):
        words.setdefault(w, 0)
    return whole, counts, list(words), list(words.values())


def block_counts(packed: DataFrame) -> DataFrame:
    """(slot, gram, word, n): the contents of each block; slot is block << 32 with the place in the block, grams first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts, words, n = contents(unpack(data))
                step, base = 100_000, block << 32
                for at in range(0, len(keys), step):
                    k = keys[at : at + step]
                    slots = np.arange(base + at, base + at + len(k), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(k.view(np.int64)), pa.nulls(len(k), pa.binary()), pa.array(counts[at : at + step])], ["slot", "gram", "word", "n"])
                base += len(keys)
                for at in range(0, len(words), step):
                    w = words[at : at + step]
                    slots = np.arange(base + at, base + at + len(w), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.nulls(len(w), pa.int64()), pa.array(w, pa.binary()), pa.array(n[at : at + step], pa.int64())], ["slot", "gram", "word", "n"])

    return packed.select("block", "texts").mapInArrow(run, "slot bigint, gram bigint, word binary, n bigint")


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, at = np.unique(keys, return_inverse=True)
    return out, np.bincount(at, n, len(out))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def code_lengths(keys: np.ndarray, n: np.ndarray, order0: np.ndarray, order1: np.ndarray, more: tuple[np.ndarray, ...] = ()) -> np.ndarray:
    """log10 probability of each gram's last byte, for grams that share their last 2 + len(more) context bytes.

    n: training counts of the grams, zero where only other texts have them; order0[s], order1[b, s] and more[j][s]:
    counts of the whole training data, the last for the shared contexts of two bytes and up."""
    eight = np.uint64(8)
    seen = n > 0
    depth = 2 + len(more)
    b = int(keys[0] >> eight & np.uint64(255)) if len(keys) else 0
    rows = [r.astype(float) for r in (order0, order1[b], *more)]
    levels = []  # from ORDER down to the shared depth: grams, counts, contexts, their n, q
    for k in range(ORDER, depth - 1, -1):
        g, c = _sums(keys[seen] & np.uint64((1 << 8 * (k + 1)) - 1), n[seen])
        ctx, at = np.unique(g >> eight, return_inverse=True)
        levels.append((g, c, ctx, np.bincount(at, c, len(ctx)), np.bincount(at, minlength=len(ctx)), at))
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    left = np.full(len(keys), np.nan)  # exclusion: weight n + q left in the next context, nan where nothing is excluded
    gone = np.zeros(len(keys))  # symbols excluded
    for i, k in enumerate(range(ORDER, depth - 1, -1)):
        g, c, ctx, total, kinds, at = levels[i]
        own = keys & np.uint64((1 << 8 * (k + 1)) - 1)
        where, has = _find(ctx, own >> eight)
        if not len(ctx):
            continue
        # what this level's symbols weigh in the next shorter context
        if k > depth:
            g2, c2, ctx2, total2, kinds2, _ = levels[i + 1]
            shorter, _ = _find(g2, g & np.uint64((1 << 8 * k) - 1))
            weigh, (parent, _) = c2[shorter], _find(ctx2, ctx & np.uint64((1 << 8 * (k - 1)) - 1))
            whole = (total2 + kinds2)[parent]
        else:
            row = rows[-1]
            weigh, whole = row[(g & np.uint64(255)).astype(np.int64)], np.full(len(ctx), row.sum() + (row > 0).sum())
        after = whole - np.bincount(at, weigh + 1, len(ctx))
        place, there = _find(g, own)
        here = open_ & has
        denominator = np.where(np.isnan(left), (total + kinds)[where], left)
        hit = here & there
        with np.errstate(divide="ignore", invalid="ignore"):
            out[hit] += np.log10(c[place[hit]] / denominator[hit])
            miss = here & ~there
            escape = (kinds[where] - gone)[miss] / denominator[miss]
        out[miss] += np.log10(np.where(denominator[miss] > 0, escape, 1.0))
        open_ &= ~hit
        left[miss], gone[miss] = after[where[miss]], kinds[where[miss]]
    sym = (keys & np.uint64(255)).astype(np.int64)
    for j in range(depth - 1, -1, -1):
        counts = rows[j]
        if not open_.any() or not counts.any():
            continue
        kinds, whole = (counts > 0).sum(), counts.sum() + (counts > 0).sum()
        denominator = np.where(np.isnan(left), whole, left)
        hit = open_ & (counts[sym] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[hit] += np.log10(counts[sym[hit]] / denominator[hit])
            miss = open_ & ~hit
            escape = (kinds - gone[miss]) / denominator[miss]
        out[miss] += np.log10(np.where(denominator[miss] > 0, escape, 1.0))
        open_ &= ~hit
        shorter = rows[j - 1]
        left[miss], gone[miss] = (shorter.sum() + (shorter > 0).sum() - (shorter[counts > 0] + 1).sum()) if j else np.nan, kinds
    alphabet = (rows[0] > 0).sum()
    out[open_] -= np.log10(SYMBOLS - alphabet) if alphabet < SYMBOLS else 0.0
    return out


class Trie:
    """How the grams are dealt into pieces, and what each piece must know of shorter contexts.

    A piece is the grams of one two-byte context. A context with more than ``share`` of all distinct grams is split by
    one more byte, again and again up to ORDER bytes; no piece is then hotter, unless a whole context of ORDER bytes is
    (256 grams). For each context that is split the counts of its 256 symbols are kept: with at most 1 / share
    such contexts of each length that is 1024 * 256 numbers at most, and 8 times as many for tables of more than 4 billion
    grams, where the share shrinks to keep pieces near PIECE.
    """

    PARTS, PIECE, LEAST = 1024, 4 << 20, 256

    def __init__(self, g: DataFrame):
        self.order1, self.order0 = np.zeros((256, 256)), np.zeros(256)
        for r in g.groupBy(F.expr("gram & 65535").alias("k")).agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
            self.order1[r.k >> 8, r.k & 255] += r.n
            self.order0[r.k & 255] += r.n
        total = g.count()
        least = max(total / (8 * self.PARTS), min(total / self.PARTS, self.PIECE), self.LEAST)
        self.split: dict[int, dict[int, np.ndarray]] = {}  # context bytes -> context -> counts of its symbols
        hot = g
        for depth in range(2, ORDER):
            context = self.context(depth)
            found = [r.c for r in hot.groupBy(context.alias("c")).count().where(F.col("count") > least).collect()]
            if not found:
                break
            hot = hot.where(context.isin(found))
            rows = {c: np.zeros(256) for c in found}
            symbols = hot.groupBy(context.alias("c"), F.expr("gram & 255").alias("s")).agg(F.sum("n").alias("n")).toArrow()
            for c, s, n in zip(*(symbols.column(x).to_pylist() for x in ("c", "s", "n")), strict=True):
                rows[c][s] = n
            self.split[depth] = rows

    @staticmethod
    def context(depth: int):
        return F.expr(f"shiftright(gram, 8) & {(1 << 8 * depth) - 1}L")

    def piece(self):
        """The piece of column gram: its context with the context's length in front."""
        key = F.lit((2 + len(self.split)) << 48) + self.context(2 + len(self.split))
        for depth, rows in sorted(self.split.items(), reverse=True):
            key = F.when(self.context(depth).isin(list(rows)), key).otherwise(F.lit(depth << 48) + self.context(depth))
        return key

    def values(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        more, context = [], int(keys[0]) >> 8
        for depth, rows in sorted(self.split.items()):
            row = rows.get(context & (1 << 8 * depth) - 1)
            if row is None:
                break
            more.append(row)
        return code_lengths(keys, n, self.order0, self.order1, tuple(more))


class Lookup:
    """Values of sorted, distinct keys: a table of guesses by hash, and a search where a guess is another key's."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(10, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.guess = np.zeros(1 << bits, np.int32)
        self.guess[self._slot(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self.guess[self._slot(keys)]
        odd = np.nonzero(self.keys[at] != keys)[0]
        if len(odd):
            at[odd] = np.searchsorted(self.keys, keys[odd])
        return self.values[at]


#: Looked-up values that are packed at once.
GATHER = 2_000_000


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, low bytes first, then the next: they compress better apart."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(data: bytes, n: int, at: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T.copy().view("<u4").ravel()


def squeeze(places: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted places with their values, exact: steps between places, and numbers into the table of different values."""
    kinds, codes = np.unique(values, return_inverse=True)
    head = np.array([len(places), len(kinds)], np.int64).tobytes()
    body = _planes(np.diff(places, prepend=0)) + _planes(codes) + kinds.astype("<f8").tobytes()
    return head + (zstandard.ZstdCompressor(level=1).compress(body) if len(body) > 200 else body)


def unsqueeze(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, kinds = np.frombuffer(data, np.int64, 2).tolist()
    size = 8 * (n + kinds)
    body = zstandard.ZstdDecompressor().decompress(data[16:], max_output_size=size) if size > 200 else data[16:]
    return np.cumsum(_unplanes(body, n, 0), dtype=np.int64), np.frombuffer(body, "<f8", kinds, 8 * n)[_unplanes(body, n, 4 * n)]


def gathered(found: DataFrame) -> DataFrame:
    """(block, answers): the rows (slot, value) packed by block, a task's rows GATHER at a time, so that a few long
    rows of some two bytes a value are shuffled to the blocks, not one row for each gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            slots, values = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(slots)
            slots, values = slots[order], values[order]
            blocks, starts = np.unique(slots >> 32, return_index=True)
            for block, at, end in zip(blocks.tolist(), starts.tolist(), [*starts[1:].tolist(), len(slots)], strict=True):
                packed = squeeze(slots[at:end] & 0xFFFFFFFF, values[at:end])
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([packed], pa.binary())], ["block", "answers"])

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            if sum(len(s) for s, _ in held) >= GATHER:
                yield from out()
        if held:
            yield from out()

    return found.mapInArrow(run, "block bigint, answers binary")


def score_documents(docs: DataFrame, training: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score for each row; ``training`` names a boolean column.

    A-Z are lower-cased. Tokens are the words and one end for each text; base_score is their add-one unigram
    log10 probability, score the model's log10 probability of the text's bytes and end. Null and empty
    texts have the end only. Where nothing is in training, all counts are zero and both scores are those of
    uniform choices. Repeated rows count as often as they occur; ids may be of any type and null; other columns
    are not read. An empty table gives an empty one. A text longer than BLOCK is a block of its own: its distinct grams
    are held by one task, its occurrences never are.
    """
    packed = numbered(materialize(blocks(docs, id_column, text_column, training), "ppm-blocks"))
    counted = materialize(block_counts(packed), "ppm-counts")
    g = counted.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
    w = counted.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    g, w = materialize(g, "ppm-grams"), materialize(w, "ppm-words")
    release(docs.sparkSession)
    trie = Trie(g)
    ends = int(trie.order0[END])
    sums = w.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    total, kinds = int(sums[0]) + ends, int(sums[1]) + (ends > 0)

    def learn(table: pa.Table) -> pa.Table:
        keys = table.column("gram").to_numpy().astype(np.int64)
        return pa.table({"gram": keys, "value": trie.values(keys.view(np.uint64), table.column("n").to_numpy().astype(np.int64))})

    values = materialize(g.groupBy(trie.piece()).applyInArrow(learn, "gram bigint, value double"), "ppm-values")
    discard(g)
    release(docs.sparkSession)
    answers = gathered(
        counted.where("gram is not null").select("slot", "gram").join(values, "gram").select("slot", "value")
        .unionByName(counted.where("word is not null").select("slot", "word").join(w, "word").select("slot", F.col("n").cast("double").alias("value")))
    )
    kind = docs.schema[id_column].dataType.simpleString()

    def score(own: pa.Table, told: pa.Table) -> pa.Table:
        told = [unsqueeze(x.as_py()) for x in told.column("answers")]
        value = np.empty(sum(len(places) for places, _ in told))
        for places, found in told:
            value[places] = found
        texts = unpack(own.column("texts")[0].as_py())
        keys, _, words, _ = contents(texts, counted=False)
        table = Lookup(keys, value[: len(keys)])
        counts = dict(zip(words, value[len(keys) :].tolist(), strict=True))
        v = math.log10(total + kinds + 1)
        logs = {word: math.log10(c + 1) for word, c in counts.items()}
        known = {word: int(c > 0) for word, c in counts.items()}
        scores, rows = iter(score_texts([t for t, _ in texts], table)), []
        for i, (text, _) in zip(own.column("ids")[0].as_py(), texts, strict=True):
            tokens = text.split()
            n = len(tokens) + 1
            base = math.fsum(map(logs.__getitem__, tokens)) + math.log10(ends + 1) - n * v
            rows.append((i, n, sum(map(known.__getitem__, tokens)) + (ends > 0), total, base, next(scores)))
        kinds_of = [own.schema.field("ids").type.value_type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds_of, strict=True)], names=[id_column, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"{id_column} {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score_texts(texts: list[bytes], table: Lookup) -> list[float]:
    """Sum of values of each text's grams; texts are looked up in groups, very long ones in pieces."""
    out: list[float] = []
    for run in runs_of(texts):
        if len(run) == 1:
            out.append(sum(float(table.of(g).sum()) for g in pieces(run[0])))
            continue
        starts = np.cumsum([0, *(len(t) + 1 for t in run)])[:-1]
        out += np.add.reduceat(table.of(grams(run)), starts).tolist()
    return out
