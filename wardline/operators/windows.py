"""Intervals, budgets, prefixes, ranges, blocks and components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from wardline.functions.text import tokens
from wardline.session import discard, materialize

#: Without use since pairs are found by marks, not by an order of tokens; tests still set it.
OFTEN = 1 << 20
#: Tokens of a chunk of sets, each set counting for 256 more; most tasks that compare chunks.
CHUNK, MOST_TASKS = 1 << 22, 4096


def merge_intervals(rows: DataFrame, group: list[str], lo: str, hi: str, touching: bool = True) -> DataFrame:
    """(group, lo, hi, n): overlapping intervals as one; with ``touching`` also those that begin where another ends + 1."""
    w = Window.partitionBy(*group).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(F.col(lo) <= reach + 1, 0).otherwise(1) if touching else F.when(F.col(lo) < reach, 0).otherwise(1)
    d = rows.withColumn("__start", start).withColumn("__island", F.sum("__start").over(w))
    return d.groupBy(*group, "__island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count("*").alias("n")).drop("__island")


def walk(rows: DataFrame, group: list[str], order: list[str], given: list[str], start, step, out: str, kind: str) -> DataFrame:
    """rows (group, order, given columns) with one column more, from a state that is carried from row to row within each
    group: ``start()`` makes it, ``step(state, *given values)`` returns the next one and the row's value.

    A group's rows come to one task, sorted by Spark, and pass through it once in Arrow batches: the state is all that
    is held, so a hot group costs time in one task but no memory. Pass numbers only, never texts."""
    d = rows.select(*dict.fromkeys([*group, *order, *given])).repartition(*group).sortWithinPartitions(*group, *order)
    names, arrow = d.columns, to_arrow_type(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            column = lambda c: batch.column(names.index(c)).to_pylist()
            keys, values, made = list(zip(*map(column, group), strict=True)), list(zip(*map(column, given), strict=True)), []
            for k, v in zip(keys, values, strict=True):
                if state is None or k != key:
                    key, state = k, start()
                state, x = step(state, *v)
                made.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], [*names, out])

    return d.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields) + f", {out} {kind}")


def in_ranges(rows: DataFrame, group: list[str], order: list[str | Column], name: str = "ranges") -> DataFrame:
    """rows in written ranges of (group, order), with two columns more: __range says which, __key is the group as one value
    (null is a group of its own). A hot group fills as many ranges as its share of rows; only rows equal in group and order
    are always in one, so end the order with something that tells rows apart. Columns of those two names are replaced."""
    key = F.struct(*(F.col(g).alias(f"k{i}") for i, g in enumerate(group))) if group else F.lit(0)
    by = [F.col(x) if isinstance(x, str) else x for x in [*group, *order]]
    dealt = rows.withColumn("__key", key).repartitionByRange(*(by or [F.lit(0)])).withColumn("__range", F.spark_partition_id())
    return materialize(dealt, name)


def running_sums(ranged: DataFrame, order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """Rows of in_ranges with two columns more for each of sums: <name>_before, the sum over the earlier rows of the group in
    that order, and <name>_total, the sum over the group. Values may not be null.

    Each range sums its own rows; one row for each range and group, not more, is then summed over the ranges of a group.
    So no task holds a group, however large. Rows equal in the order stand in any order among themselves. An empty table
    gives an empty one."""
    by = [F.col(x) if isinstance(x, str) else x for x in order]
    d = ranged.withColumns({f"__v_{k}": v for k, v in sums.items()})
    parts = d.groupBy("__range", "__key").agg(*(F.sum(f"__v_{k}").alias(f"__p_{k}") for k in sums))
    whole = Window.partitionBy("__key")
    earlier = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda v, k: F.coalesce(v, F.lit(0).cast(parts.schema[f"__p_{k}"].dataType))
    starts = parts.select(
        "__range", "__key", *(zero(F.sum(f"__p_{k}").over(earlier), k).alias(f"__s_{k}") for k in sums), *(F.sum(f"__p_{k}").over(whole).alias(f"{k}_total") for k in sums)
    )
    own = Window.partitionBy("__range", "__key").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"__b_{k}": zero(F.sum(f"__v_{k}").over(own), k) for k in sums}).join(starts, ["__range", "__key"])
    before = [(F.col(f"__s_{k}") + F.col(f"__b_{k}")).cast(parts.schema[f"__p_{k}"].dataType).alias(f"{k}_before") for k in sums]
    return d.select(*ranged.columns, *before, *(F.col(f"{k}_total") for k in sums))


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """rows with a dense number from 1 in each group, in that order; ranges of a group are numbered by different tasks."""
    placed = running_sums(in_ranges(rows, group, order, "numbered"), order, {"__n": F.lit(1).cast("bigint")})
    return placed.select(*rows.columns, (F.col("__n_before") + 1).alias(name))


def skip_fit(rows: DataFrame, group: list[str], size: str, order: list[str], budget: int, most: int | None = None) -> DataFrame:
    """rows with taken: in order, each row that still fits the budget is taken, others are skipped and the walk goes on.

    No running sum can say this, as a skipped row uses nothing. Only sizes are walked; the texts or contents of rows take
    no part. A null size is zero."""
    w = Window.partitionBy(*group).orderBy(*order)
    numbered = rows.withColumn("__n", F.row_number().over(w))
    sized = numbered.select(*group, "__n", F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("__s"))

    def step(state: tuple[int, int], s: int) -> tuple[tuple[int, int], bool]:
        used, took = state
        fits = used + s <= budget and (most is None or took < most)
        return (used + s, took + 1) if fits else state, fits

    taken = walk(sized, group, ["__n"], ["__s"], lambda: (0, 0), step, "__t", "boolean").where("__t").select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__n").alias("__m"))
    same = F.col("__n") == F.col("__m")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return numbered.join(taken, same, "left").select(*rows.columns, F.col("__m").isNotNull().alias("taken"))


def prefixes(path: Column) -> Column:
    """Directory prefixes of a path, shortest first, each with its depth; the path itself is the last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("prefix")))


def longest_prefix(rows: DataFrame, key: str, path: str, owners: DataFrame, owner: str, prefix: str) -> DataFrame:
    """(key, owner, depth): the owners with the deepest prefix of the path, all of them on a tie. Prefixes are
    exploded and joined by equality."""
    exploded = rows.select(key, F.explode(prefixes(F.col(path))).alias("p")).select(key, "p.depth", "p.prefix")
    hits = exploded.join(owners.select(F.col(prefix).alias("prefix"), F.col(owner).alias("owner")), "prefix")
    best = hits.groupBy(key).agg(F.max("depth").alias("best"))
    return hits.join(best, key).where("depth = best").select(key, "owner", "depth").distinct()


def range_join(points: DataFrame, ranges: DataFrame, key: str, value: str, lo: str, hi: str) -> DataFrame:
    """Points with lo <= value < hi for the same key: an equi-join with a filter. A null hi is open."""
    r = ranges.withColumnsRenamed({key: "__k"})
    return points.join(r, (points[key] == r["__k"]) & (points[value] >= r[lo]) & (r[hi].isNull() | (points[value] < r[hi]))).drop("__k")


def _token_rows(rows: DataFrame, id_: str, text: str, blocks: list[str], stopwords: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """(id, block keys, words) of rows that hold a token, words as sorted hashes; the names of the keys."""
    keys = [f"__block{i}" for i in range(len(blocks))]  # block columns may be called like ours
    words = F.array_sort(F.transform(tokens(F.col(text), stopwords), lambda t: F.xxhash64(t)))
    spoken = rows.where(F.col(text).rlike("[a-zA-Z0-9]"))  # so that no test of the tokens makes them twice
    return spoken.select(F.col(id_).alias("id"), *(F.col(c).alias(k) for c, k in zip(blocks, keys, strict=True)), words.alias("words")), keys


def _hashed(sets: DataFrame) -> DataFrame:
    """Two hashes and the number of words of each set."""
    return sets.withColumns({"__h": F.xxhash64("words"), "__g": F.hash("words"), "__n": F.size("words")})


def _lowest(sets: DataFrame, keys: list[str]) -> DataFrame:
    """(block keys, hashes, representative) of each set, a grouped minimum of numbers, so that no task holds a hot group."""
    return sets.groupBy(*keys, "__h", "__g").agg(F.min("id").alias("representative"))


def _of_set(sets: DataFrame, low: DataFrame, keys: list[str], how: str, *more: Column) -> DataFrame:
    """sets joined to the representatives of their own set; null keys are a block of their own."""
    group = [*keys, "__h", "__g"]
    return sets.join(low.withColumnsRenamed({g: f"{g}_of" for g in group}), reduce(and_, (*more, *(F.col(g).eqNullSafe(F.col(f"{g}_of")) for g in group))), how)


def word_sets(rows: DataFrame, id_: str, text: str, blocks: list[str], stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(id, block keys, representative): rows of one block with the same set of tokens share the smallest id among
    them. Tokens are known by 64 bits of hash; only numbers are written, grouped and joined. Rows without a token are left out."""
    sets, keys = _token_rows(rows, id_, text, blocks, stopwords)
    sets = materialize(_hashed(sets).drop("words"), "word-hashes").where("__n > 0")
    return _of_set(sets, _lowest(sets, keys), keys, "inner").select("id", *keys, "representative")


def _bits(n: np.ndarray) -> np.ndarray:
    """Bits of the mark of a set of n tokens: a power of two, 4 to 8 for each token."""
    return 1 << np.maximum(7, np.ceil(np.log2(4 * n)).astype(np.int64))


def _marked(sets: DataFrame) -> DataFrame:
    """Sets of tokens with a mark (bits) in place of their words: each token sets the bit that its hash says. A mark of half the bits is
    that of the lower half or that of the upper one."""
    names = [c for c in sets.columns if c != "words"]
    d = sets.select(*names, "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            lists = batch.column(len(names))
            k, n = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            wide = np.where(n > 0, _bits(np.maximum(n, 1)), 0)
            ends = np.cumsum(wide)
            bits = np.zeros(ends[-1], np.uint8)
            bits[np.repeat(ends - wide, n) + (k & np.repeat(wide - 1, n))] = 1
            offsets = np.concatenate([[0], ends // 8]).astype(np.int32)
            marks = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(bits, bitorder="little"))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], marks], [*names, "mark"])

    return d.mapInArrow(run, ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in names) + ", mark binary")


def _classes(n: np.ndarray, marks: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sets in order of size, in classes of equally wide marks: (their places, sizes, marks as rows of 64-bit words)."""
    order = np.argsort(n, kind="stable")
    wide, out = _bits(n[order]), []
    for w in np.unique(wide):
        at = order[wide == w]
        data = b"".join(marks.take(pa.array(at)).to_pylist())
        out.append((at, n[at].astype(np.int64), np.frombuffer(data, np.uint64).reshape(len(at), w // 64)))
    return out


def _may_reach(a: tuple, b: tuple, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of two classes, or of one (``same``), that their marks do not rule out: what two sets share is at most the bits
    they share and the lesser number of tokens that found their bit set."""
    (at_a, na, ma), (at_b, nb, mb) = a, b
    while ma.shape[1] != mb.shape[1]:
        if ma.shape[1] > mb.shape[1]:
            ma = ma[:, : ma.shape[1] // 2] | ma[:, ma.shape[1] // 2 :]
        else:
            mb = mb[:, : mb.shape[1] // 2] | mb[:, mb.shape[1] // 2 :]
    over_a, over_b = (n - np.bitwise_count(m).sum(axis=1, dtype=np.int64) for n, m in ((na, ma), (nb, mb)))
    ma, mb, part = np.ascontiguousarray(ma.T), np.ascontiguousarray(mb.T), threshold / (1 + threshold)
    kind = np.uint16 if len(ma) * 64 < 1 << 16 else np.uint32
    for i in range(0, len(na), 32):
        i_to = min(i + 32, len(na))
        lo, hi = np.searchsorted(nb, threshold * na[i] - 1e-9, "left"), np.searchsorted(nb, (na[i_to - 1] + 1e-9) / threshold + 1e-9, "right")
        for j in range(max(lo, i + 1) if same else lo, hi, 4096):
            j_to = min(j + 4096, hi)
            both, count, found = np.empty((i_to - i, j_to - j), np.uint64), np.empty((i_to - i, j_to - j), np.uint8), np.zeros((i_to - i, j_to - j), kind)
            for x, y in zip(ma[:, i:i_to], mb[:, j:j_to], strict=True):
                np.bitwise_and(x[:, None], y[None, :], out=both)
                np.add(found, np.bitwise_count(both, out=count), out=found)
            n, m = na[i:i_to, None], nb[None, j:j_to]
            fits = (found + np.minimum(over_a[i:i_to, None], over_b[None, j:j_to]) >= part * (n + m) - 1e-9) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)
            x, y = np.nonzero(fits)
            if same:
                x, y = x[(later := x + i < y + j)], y[later]
            if len(x):
                yield at_a[x + i], at_b[y + j]


def _candidates(marked: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Written (block keys, a, b): pairs of sets of a block that their marks do not rule out, each once. marked: id, block keys, __n, mark.

    The sets of a block stand in order of size and are cut into chunks; two chunks whose sizes allow a pair, or a chunk and
    itself, are compared by a task that holds no more than them."""
    order = ["__n", "id"]
    ranged = in_ranges(marked, keys, order, "word-ranges")
    placed = running_sums(ranged, order, {"__w": (F.col("__n") + 256).cast("bigint")})
    placed = placed.select("id", "__n", "mark", *keys, "__key", F.floor(F.col("__w_before") / CHUNK).alias("__chunk"))
    chunks = materialize(placed.groupBy("__key", "__chunk").agg(F.min("__n").alias("lo"), F.max("__n").alias("hi")), "word-chunks")
    one = lambda x: chunks.select("__key", *(F.col(c).alias(f"{c}{x}") for c in ("__chunk", "lo", "hi")))
    meet = one("a").join(one("b"), "__key").where((F.col("__chunka") <= F.col("__chunkb")) & (F.col("hia") >= F.lit(threshold) * F.col("lob") - 1e-9))
    tiles = materialize(meet.select("__key", F.col("__chunka").alias("ta"), F.col("__chunkb").alias("tb")), "word-tiles")
    sides = tiles.select("*", F.col("ta").alias("__chunk")).unionByName(tiles.where("ta < tb").select("*", F.col("tb").alias("__chunk")))
    dealt = placed.join(sides, ["__key", "__chunk"]).repartition(max(1, min(tiles.count(), MOST_TASKS)), "__key", "ta", "tb")
    kind = marked.schema["id"].dataType.simpleString()

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        n, chunk, (ta, tb) = t["__n"].to_numpy(), t["__chunk"].to_numpy(), (t[c][0].as_py() for c in ("ta", "tb"))
        of = lambda x: (at := np.nonzero(chunk == x)[0], _classes(n[at], t["mark"].take(pa.array(at)).combine_chunks()))
        (at_a, a), (at_b, b) = of(ta), of(tb)
        found = [(at_a[x], at_b[y]) for i, c in enumerate(a) for j, d in enumerate(b) if ta < tb or i <= j for x, y in _may_reach(c, d, threshold, ta == tb and i == j)]
        x, y = (pa.array(np.concatenate([f[k] for f in found]) if found else [], pa.int64()) for k in (0, 1))
        return pa.table([*(t[k].take(x) for k in keys), t["id"].take(x), t["id"].take(y)], names=[*keys, "x", "y"])

    schema = ", ".join(f"`{k}` {marked.schema[k].dataType.simpleString()}" for k in keys) + (", " if keys else "") + f"x {kind}, y {kind}"
    pairs = dealt.groupBy("__key", "ta", "tb").applyInArrow(compare, schema)
    out = materialize(pairs.select(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "word-pairs")
    for t in (ranged, chunks, tiles):
        discard(t)
    return out


def similar_pairs(rows: DataFrame, id_: str, text: str, blocks: list[str], threshold: float = 0.6, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, jaccard), a < b, of word sets of one block that reach the threshold, each under its representative (word_sets
    says whose); copies are one set and make no pairs.

    All pairs of a block whose sizes allow it are compared, by marks of 4 to 8 bits a token; in a block of common words most
    sets share some rare token of theirs, so that joins by tokens bring nearly as many pairs, and those as rows. Work thus grows with
    the square of a block. Only marks are dealt; words are made again for the sets of pairs that marks do not rule out, and only these
    are written. Ids tell rows of a block apart."""
    sets, keys = _token_rows(rows, id_, text, blocks, stopwords)
    if blocks:  # rows without a block make no pairs
        sets = sets.where(reduce(and_, (F.col(k).isNotNull() for k in keys)))
    written = materialize(_marked(_hashed(sets)), "word-marks")
    every = written.where("__n > 0")
    one_each = _of_set(every, _lowest(every.select("id", *keys, "__h", "__g"), keys), keys, "left_semi", F.col("id") == F.col("representative"))
    pairs = _candidates(one_each.select("id", *keys, "__n", "mark").dropDuplicates(["id", *keys]), keys, threshold)
    discard(written)
    # each set of a pair, with those it is compared with
    ends = pairs.select(*keys, F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(*keys, F.col("b").alias("id"), F.lit(None).cast(pairs.schema["b"].dataType).alias("other")))
    wanted = ends.groupBy(*keys, "id").agg(F.collect_list("other").alias("others")).withColumnsRenamed({c: f"{c}_of" for c in ("id", *keys)})
    named = rows.select(F.col(id_).alias("__id"), F.col(text).alias("__text"), *(F.col(c).alias(f"{k}_") for c, k in zip(blocks, keys, strict=True)))
    asked = named.join(wanted, reduce(and_, (F.col(f"{k}_") == F.col(f"{k}_of") for k in keys), F.col("__id") == F.col("id_of")))
    held, _ = _token_rows(asked.withColumn("__of", F.struct("__id", "others")), "__of", "__text", [f"{k}_" for k in keys], stopwords)
    held = materialize(held.select("id.__id", "id.others", *keys, "words").withColumnRenamed("__id", "id").dropDuplicates(["id", *keys]), "word-sets")
    discard(pairs)
    end = lambda x, *more: held.select(F.col("id").alias(x), *(F.col(k).alias(f"{k}{x}") for k in keys), F.col("words").alias(f"w{x}"), *more)
    full = end("a", F.explode("others").alias("o")).join(end("b"), reduce(and_, (F.col(f"{k}a") == F.col(f"{k}b") for k in keys), F.col("o") == F.col("b")))
    same = F.size(F.array_intersect("wa", "wb"))
    return full.select("a", "b", (same / (F.size("wa") + F.size("wb") - same)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node each node of an edge (a, b) reaches, by alternating large-star and small-star rounds.

    Every round regroups edges by one end with a pre-aggregated minimum and a join that adaptive execution may split, so
    no neighbourhood is gathered in a task. Rounds stop when the edge set no longer changes; each is a table in the
    shared folder, and replaces the one before."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e, before = materialize(e, name), None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        both_ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        done, e = e, materialize(large.join(least, "a").select(F.explode(both_ends).alias("e")).select("e.*").where("a <> b").distinct(), name)
        discard(done)
        # sums of 64-bit hashes as decimals tell edge sets apart
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError("components did not settle")
