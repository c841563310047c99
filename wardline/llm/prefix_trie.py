"""Prefix trie of conversations by most-significant-digit radix partitioning over turn ids.

Turns (role and text) are known by the id of a dictionary, so a conversation is a short array of numbers. Conversations
are dealt by their first turn, the buckets that are still too large by their next one, and so on, until each bucket fits a
task. What all conversations of a large bucket share is skipped at once: the least and the greatest of its arrays tell how
far they agree, so copies, however many, take one round and no turn of a bucket is counted one by one. A task then finishes
its buckets by multikey quicksort, three-way by the turn at the depth reached, and every run of equal turns that the
recursion meets is a node. Nodes of the large buckets (the trunk) take their subtree sums from what lies below, round by
round; the list of conversations that end in one is digested from sorted chunks, never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.windows import in_ranges, running_sums

from .common import materialize

#: A bucket of at most so many conversations and turns is finished by one task.
LOCAL, LOCAL_TURNS = 4096, 1 << 18
CHUNK = 1 << 20
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, turn_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_BUCKET = "struct<c: bigint, d: int, t: bigint>"


def dictionary(turns: DataFrame) -> DataFrame:
    """(h1, h2, turn_id): dense ids of the distinct turns, by 128 bits of hash."""
    order = ["h1", "h2"]
    numbered = running_sums(in_ranges(turns.select("h1", "h2").distinct(), [], order, "turn-ids"), order, {"n": F.lit(1).cast("bigint")})
    return numbered.select("h1", "h2", F.col("n_before").alias("turn_id"))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): of each conversation the turn ids in order, and the code points of their texts.

    Rows of ``conversations`` (conv_id, turn, role, text) stand in the order of turn, null first, then role, then hash of the text;
    repeated rows keep a place each. Null roles and texts are empty. Rows without a conv_id belong to none and are left out. Other
    columns are not read. A conversation is one row by nature, of 12 bytes a turn; texts of any length are only hashed
    and measured where they are read. An empty table gives an empty one.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"), F.length(text).alias("n")
    )
    turns = materialize(turns, "turns")
    known = turns.join(dictionary(turns), ["h1", "h2"])
    in_order = known.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "h1", "h2", "turn_id", "n"))).alias("s"))
    return in_order.select("conv_id", F.transform("s", lambda x: x["turn_id"]).alias("ids"), F.transform("s", lambda x: x["n"]).alias("sizes"))


def nodes(sequences: DataFrame, local: int = LOCAL, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """One row for each distinct prefix of ``sequences`` (conv_id, unique, ids, sizes), the empty one included.

    conv_id: the smallest conversation that begins so (a member); depth; parent_conv_id: that of the prefix one turn shorter
    (null for the root); turn_id: its last turn (null for the root); n_convs: members; n_children; n_leaves: prefixes in its
    subtree, itself included, that none extends; saved_tokens: over its subtree, (n_convs - 1) times the size of the last turn;
    ends_sha256: of the ids of members that end here, ascending, joined by commas. Conversations without a turn end at the
    root. An empty table gives an empty one, without a root. ``local`` bounds what a task finishes alone.
    """
    bucket = F.struct(F.lit(None).cast("bigint").alias("c"), F.lit(None).cast("int").alias("d"), F.lit(None).cast("bigint").alias("t"))
    live = materialize(sequences.select("conv_id", "ids", "sizes", bucket.alias("b")), "trie")  # ids from the depth of b on
    dealt, trunks = [], []
    while True:
        stats = live.groupBy("b").agg(F.count("*").alias("n"), F.min("conv_id").alias("m"), F.sum(F.size("ids")).alias("turns"), F.min(F.struct("ids", "sizes")).alias("lo"), F.max("ids").alias("hi"))
        agree = F.zip_with("lo.ids", "hi", lambda x, y: x.eqNullSafe(y))
        stop = F.array_position(agree, False).cast("int")
        stats = materialize(stats.select(
            "b", "n", "m", ((F.col("n") > local) | ((F.col("turns") > local_turns) & (F.col("n") > 1))).alias("large"),
            F.when(stop > 0, stop - 1).otherwise(F.size("hi")).alias("shared"), F.col("lo.ids").alias("ids"), F.col("lo.sizes").alias("sizes"),
        ), "trie-buckets")
        large = stats.where("large").select("b", "n", "m", (F.coalesce("b.d", F.lit(0)) + F.col("shared")).alias("bottom"), F.slice("ids", F.lit(1), F.col("shared")).alias("ids"), F.slice("sizes", F.lit(1), F.col("shared")).alias("sizes"))
        if large.limit(1).count() == 0:
            dealt.append(live.select("b", "conv_id", "ids", "sizes", F.lit("local").alias("kind")))
            break
        trunks.append(large)
        at = live.join(stats.select("b", "m", "large", "shared"), "b")
        bottom = (F.coalesce("b.d", F.lit(0)) + F.col("shared")).cast("int")
        kind = F.when(~F.col("large"), "local").when(F.size("ids") == F.col("shared"), "ended").otherwise("live")
        cut = lambda c: F.when(kind == "live", F.slice(c, F.col("shared") + 1, F.size(c))).when(kind == "local", F.col(c)).alias(c)
        below = F.when(kind == "local", F.col("b")).otherwise(F.struct(F.col("m").alias("c"), bottom.alias("d"), F.when(kind == "live", F.get("ids", F.col("shared"))).alias("t")))
        step = materialize(at.select(below.cast(_BUCKET).alias("b"), "conv_id", cut("ids"), cut("sizes"), kind.alias("kind")), "trie")
        dealt.append(step)
        live = step.where("kind = 'live'").drop("kind")
    rows = dealt[0]
    for x in dealt[1:]:
        rows = rows.unionByName(x)
    finished = rows.where("kind = 'local'").select("b", "conv_id", "ids", "sizes").repartition("b").sortWithinPartitions("b").mapInArrow(_finish, f"b {_BUCKET}, {NODE}")
    if not trunks:
        return finished.drop("b")
    finished = materialize(finished, "trie-nodes")
    # children of the trunk's nodes: tops of the buckets finished, then of the trunk itself, from the last round up
    tops, trunk = finished.where("b is not null").select("b", "n_leaves", "saved_tokens"), None
    for large in reversed(trunks):
        made = materialize(_chains(large, tops), "trie-trunk")
        tops = tops.unionByName(made.where("b.c is not null").select("b", "n_leaves", "saved_tokens"))
        trunk = made if trunk is None else trunk.unionByName(made)
    ends = _ends(rows.where("kind = 'ended'").select(F.col("b.c").alias("m"), F.col("b.d").cast("bigint").alias("d"), "conv_id"))
    trunk = trunk.drop("b").join(ends, (F.col("conv_id") == F.col("m")) & (F.col("depth") == F.col("d")), "left").drop("m", "d")
    return finished.drop("b").unionByName(trunk.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))))


def _chains(large: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes of large buckets of one round: each is a chain of turns that all its conversations share; b, on the first node
    only, says under which node and turn it hangs. ``tops`` has the top nodes of all buckets below."""
    below = tops.groupBy(F.struct("b.c", "b.d").alias("k")).agg(F.count("*").alias("below"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    own = large.join(below, F.struct(F.col("m").alias("c"), F.col("bottom").alias("d")) == F.col("k"), "left")
    root = F.struct(F.lit(None).cast("bigint").alias("turn"), F.lit(0).alias("size"))  # above the first turn
    link = F.arrays_zip(F.col("ids").alias("turn"), F.col("sizes").alias("size"))
    each = own.select("*", F.posexplode(F.when(F.col("b.c").isNull(), F.concat(F.array(root), link)).otherwise(link)).alias("p", "link"))
    each = each.withColumn("depth", (F.when(F.col("b.c").isNull(), 0).otherwise(F.col("b.d") + 1) + F.col("p")).cast("bigint"))
    top, last = F.col("p") == 0, F.col("depth") == F.col("bottom")
    deeper = Window.partitionBy("m", "bottom").orderBy(F.desc("depth"))
    return each.select(
        F.when(top, F.col("b")).alias("b"), F.col("m").alias("conv_id"), "depth", F.when(top, F.col("b.c")).otherwise(F.col("m")).alias("parent_conv_id"), F.col("link.turn").alias("turn_id"), F.col("n").alias("n_convs"),
        F.when(last, F.coalesce("below", F.lit(0))).otherwise(1).cast("bigint").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("bigint").alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) + F.sum((F.col("n") - 1) * F.col("link.size")).over(deeper)).cast("bigint").alias("saved_tokens"),
    )


def _ends(ended: DataFrame) -> DataFrame:
    """(m, d, ends_sha256) of (m, d, conv_id). A digest of a list is made in its order by nature: ranges of ids are joined to
    chunks in parallel, and only chunks pass through the digest, one after the other and none held."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, text, size = None, 0, [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, first, ",".join(text))], ["m", "d", "first", "text"])
        for batch in batches:
            for m, d, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (m, d) != key or size > CHUNK:
                    if key:
                        yield out()
                    key, first, text, size = (m, d), conv, [], 0
                text.append(str(conv))
                size += len(text[-1]) + 1
        if key:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, h.hexdigest())], ["m", "d", "ends_sha256"])
        for batch in batches:
            for i in range(batch.num_rows):
                m, d, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(3)[i].as_py()
                if (m, d) != key:
                    if key:
                        yield out()
                    key, h = (m, d), hashlib.sha256()
                else:
                    h.update(b",")
                h.update(text.encode())
        if key:
            yield out()

    ranges = ended.repartitionByRange("m", "d", "conv_id").sortWithinPartitions("m", "d", "conv_id").mapInArrow(chunks, "m bigint, d bigint, first bigint, text string")
    return ranges.repartition("m", "d").sortWithinPartitions("m", "d", "first").mapInArrow(digest, "m bigint, d bigint, ends_sha256 string")


def multikey_nodes(rows: list[tuple[int, list[int], list[int]]], depth: int) -> list[list]:
    """Nodes of conversations (conv_id, ids, sizes) that share nothing yet, from the node above their first turn at that depth:
    [parent's place in the list, depth, turn id, size, smallest conv_id, members, ends], parents first.

    Multikey quicksort: a run is split by the turn at its depth into less, equal and greater; an equal run is a node, and is
    sorted on by the next turn."""
    found = [[-1, depth, None, 0, min(r[0] for r in rows), len(rows), []]]
    todo = [(rows, 0, 0)]
    while todo:
        run, at, parent = todo.pop()
        middle = run[len(run) // 2][1]
        pivot = middle[at] if at < len(middle) else -1  # where a conversation ends is the least
        less, equal, more = [], [], []
        for r in run:
            turn = r[1][at] if at < len(r[1]) else -1
            (equal if turn == pivot else less if turn < pivot else more).append(r)
        for side in (less, more):
            if side:
                todo.append((side, at, parent))
        if pivot == -1:
            found[parent][6] = sorted(r[0] for r in equal)
        else:
            found.append([parent, depth + at + 1, pivot, equal[0][2][at], min(r[0] for r in equal), len(equal), []])
            todo.append((equal, at + 1, len(found) - 1))
    return found


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of whole buckets, which come one after the other."""
    names = ["b", *(x.split()[0] for x in NODE.split(", "))]
    kinds = [pa.struct([("c", pa.int64()), ("d", pa.int32()), ("t", pa.int64())]), *(pa.string() if " string" in x else pa.int64() for x in NODE.split(", "))]

    def finished(bucket: dict, rows: list[tuple]) -> pa.RecordBatch:
        under = bucket["c"] is not None  # else this is the root
        found = multikey_nodes(rows, bucket["d"] if under else 0)
        children, leaves, saved = [0] * len(found), [0] * len(found), [0] * len(found)
        for i in range(len(found) - 1, -1, -1):
            parent, _, _, size, _, n, _ = found[i]
            leaves[i] = leaves[i] or 1
            saved[i] += (n - 1) * size
            if parent >= 0:
                children[parent] += 1
                leaves[parent] += leaves[i]
                saved[parent] += saved[i]
        out = []
        for i, (parent, depth, turn, _, conv, n, ends) in enumerate(found):
            if under and not parent >= 0:
                continue  # the node above belongs to the trunk
            top = under and parent == 0
            above = bucket["c"] if top else found[parent][4] if parent >= 0 else None
            out.append((bucket if top else None, conv, depth, above, turn, n, children[i], leaves[i], saved[i], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    key, rows = None, []
    for batch in batches:
        for b, conv, ids, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != key:
                if rows:
                    yield finished(key, rows)
                key, rows = b, []
            rows.append((conv, ids, sizes))
    if rows:
        yield finished(key, rows)
