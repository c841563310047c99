"""Merkle manifest of a dataset: a digest of every row, a root of every source, one root of all, and proofs.

Rows are leaves. The leaves of a source, in order, and then the subroots of all sources, are folded three at a time until
one digest is left. Building is driven by digests as they come: a task holds, for each parent that has begun, the
child digests it has so far by index, and knows from the size of the tree how many there will be; the child that
completes a parent makes its digest at once, and that digest is the next event, one level up. Leaves lie in sorted ranges,
so a task completes all but a few parents at the two ends of each run; only the children of these unresolved parents (the
frontier) are dealt again, by an ancestor PERIOD levels up, until none is left. A resolved parent keeps the
digests of its children: these reverse links, walked from the root down in blocks of PERIOD levels, give each leaf
its siblings, level by level, which is its proof. Texts are read once, to be hashed where they lie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.windows import in_ranges, running_sums

from .common import discard, materialize

ARITY = 3
#: Levels that one reshuffle resolves: a block has at most ARITY ** PERIOD = 6,561 leaves.
PERIOD = 8
#: One level of a proof: the place of the node among the children of its parent, and the other children, left to right.
PROOF = "array<struct<place: int, siblings: array<string>>>"
_PROOF = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))


def digest_of(columns: list[Column]) -> Column:
    """SHA-256 in lowercase hex over the columns, each `-` if null, else its UTF-8 length, `:` and its text; numbers are decimal."""
    said = [x.cast("string") for x in columns]
    return F.sha2(F.concat(*(F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)) for x in said)).cast("binary"), 256)


def fold_digests(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def level_size(size: int, level: int) -> int:
    """Nodes of a level in a tree of so many leaves."""
    return -(-size // ARITY**level)


def arity_of(size: int, level: int, at: int) -> int:
    """Children of the node at a place of a level above the leaves."""
    return min(ARITY, level_size(size, level - 1) - ARITY * at)


@dataclass
class Tree:
    """Of many trees: leaves (the caller's columns, tree, at, size, digest) and nodes (tree, level, at, size, digest, children), as
    written tables; levels is the height of the tallest, period the height of the blocks."""

    leaves: DataFrame
    nodes: DataFrame
    levels: int
    period: int = PERIOD

    def roots(self) -> DataFrame:
        """(tree, root): the one node left of each tree; a lone leaf itself."""
        lone = self.leaves.where("size = 1").select("tree", F.col("digest").alias("root"))
        return self.nodes.where(F.col("size") <= F.pow(F.lit(ARITY), "level")).select("tree", F.col("digest").alias("root")).unionByName(lone)


def _climb(rows: DataFrame) -> DataFrame:
    """rows (tree, size, level, at, digest) as events: (.., children, open) with a row for each parent completed and, open, for
    each child of a parent that this task leaves unresolved."""
    kind = rows.schema["tree"].dataType
    names = ["tree", "size", "level", "at", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial: dict[tuple, dict[int, str]] = {}
        schema = None
        for batch in batches:
            schema = schema or pa.schema([*batch.schema, ("children", pa.list_(pa.string())), ("open", pa.bool_())])
            made = []
            for tree, size, level, at, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                while level_size(size, level) > 1:
                    level, at, place = level + 1, at // ARITY, at % ARITY
                    key = (tree, level, at)
                    held = partial.setdefault(key, {-1: size})
                    held[place] = digest
                    arity = arity_of(size, level, at)
                    if len(held) <= arity:  # the size is held too
                        break
                    del partial[key]
                    children = [held[i] for i in range(arity)]
                    digest = fold_digests(children)
                    made.append((tree, size, level, at, digest, children, False))
            if made:
                yield _batch(made, schema)
        left = []
        for (tree, level, at), held in partial.items():
            size = held.pop(-1)
            left += [(tree, size, level - 1, ARITY * at + place, digest, None, True) for place, digest in held.items()]
            if len(left) >= 10_000:
                yield _batch(left, schema)
                left = []
        if left:
            yield _batch(left, schema)

    return rows.select(*names).mapInArrow(run, f"tree {kind.simpleString()}, size bigint, level int, at bigint, digest string, children array<string>, open boolean")


def _above(levels: Column) -> Column:
    """The place of a node's ancestor so many levels up."""
    return F.call_function("div", F.col("at"), F.pow(F.lit(ARITY), levels).cast("bigint"))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def build(leaves: DataFrame, tree_column: str, order: list[str | Column], digest_column: str = "digest", period: int = PERIOD) -> Tree:
    """Trees over ``leaves``, one for each value of ``tree_column`` (null is one), its leaves in that order.

    Rows equal in the order should have equal digests: they stand in any order. The leaf table keeps all columns of the
    caller's but those called tree, at, size, digest, level, children and open, unless it is the tree or digest column itself. An empty
    table gives empty ones. No task holds a tree: leaves are numbered by ranges, and of a tree only the frontier between ranges
    is dealt again, to tasks that get at most one block of ARITY ** period leaves for each key.
    """
    ranged = in_ranges(leaves, [tree_column], order, "merkle-ranges")
    numbered = running_sums(ranged, order, {"at": F.lit(1).cast("bigint")})
    own = [c for c in leaves.columns if c not in ("tree", "at", "size", "digest", "level", "children", "open", tree_column, digest_column)]
    numbered = numbered.select(*own, F.col(tree_column).alias("tree"), F.col("at_before").alias("at"), F.col("at_total").alias("size"), F.col(digest_column).alias("digest"))
    held = materialize(numbered, "merkle-leaves")
    discard(ranged)
    most = held.agg(F.max("size")).first()[0] or 1
    levels = 0
    while level_size(most, levels) > 1:
        levels += 1
    step = materialize(_climb(held.withColumn("level", F.lit(0))), "merkle-nodes")
    found, height = [step], 0
    while height < levels:
        height += period
        # every open child under one ancestor at this height comes to one task; children above it go by their parent
        up = F.greatest(F.lit(height) - F.col("level"), F.lit(1))
        frontier = step.where("open").select("tree", "size", "level", "at", "digest", (F.col("level") + up).alias("top"), _above(up).alias("over"))
        step = materialize(_climb(frontier.repartition("tree", "top", "over")), "merkle-nodes")
        found.append(step)
    nodes = found[0]
    for x in found[1:]:
        nodes = nodes.unionByName(x)
    return Tree(held, nodes.where("not open").select("tree", "level", "at", "size", "digest", "children"), levels, period)


def proofs(tree: Tree, above: DataFrame | None = None) -> DataFrame:
    """The leaves of ``tree`` with one column more, proof: for each level from the leaf up, its place among the
    children of its parent and their other digests. ``above`` (tree, proof) goes on where a tree is itself a leaf.

    Blocks of PERIOD levels are walked from the top: a task gets the nodes of a block with their reverse links and the one proof
    of the block's top node, and gives the proofs of what lies below. A block has a bounded number of rows, however large its tree.
    """
    kind = tree.leaves.schema["tree"].dataType.simpleString()
    tops = tree.leaves.where("at = 0").select("tree", "size", F.lit(0).cast("bigint").alias("block"))
    if above is None:
        tops = tops.withColumn("proof", F.array().cast(PROOF))
    else:
        known = above.select(F.struct("tree").alias("k"), "proof")
        tops = tops.join(known, F.struct("tree") == F.col("k"), "left").select("tree", "size", "block", F.coalesce("proof", F.array().cast(PROOF)).alias("proof"))
    period = tree.period
    base = max(0, (tree.levels - 1) // period) * period
    while True:
        if base:
            members, keep = tree.nodes.where(F.col("level") == base), []
        else:
            members, keep = tree.leaves, [c for c in tree.leaves.columns if c not in ("tree", "at", "size")]
        row = F.struct(*(F.col(c) for c in keep)) if keep else F.struct(F.lit(0).alias("x"))
        asked = members.select("tree", _above(F.lit(period)).alias("block"), F.lit(2).alias("kind"), F.lit(base).alias("level"), "at", "size", row.alias("row"))
        links = tree.nodes.where((F.col("level") > base) & (F.col("level") <= base + period)).select("tree", _above(F.lit(base + period) - F.col("level")).alias("block"), F.lit(1).alias("kind"), "level", "at", "size", "children")
        top = tops.select("tree", "block", F.lit(0).alias("kind"), F.lit(base + period).alias("level"), F.col("block").alias("at"), "size", "proof")
        together = top.unionByName(links, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True).select("tree", "block", "kind", "level", "at", "size", "children", "proof", "row")
        dealt = together.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind")
        walked = dealt.mapInArrow(_walk(base, period), f"tree {kind}, at bigint, size bigint, row {asked.schema['row'].dataType.simpleString()}, proof {PROOF}")
        if not base:
            return walked.select(*(F.col(f"row.`{c}`").alias(c) for c in keep), "tree", "at", "size", "proof")
        # a tree that ends below this level has no node here: its proof is for the next block
        short = tops.where(F.col("size") <= ARITY ** (base - 1))
        tops = materialize(walked.select("tree", "size", F.col("at").alias("block"), "proof").unionByName(short.select("tree", "size", "block", "proof")), "merkle-proofs")
        base -= period


def _walk(base: int, period: int):
    """Blocks, sorted: first the proof of the top, then links, then what asks for proofs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, above, links, known = None, [], {}, {}

        def proof_of(level: int, at: int, size: int) -> list[dict]:
            """From just below `level` to the root; shared by all that lie under the same node."""
            if level == base + period or level_size(size, level) == 1:
                return above
            if (level, at) not in known:
                known[level, at] = [_one(links[level + 1, at // ARITY], at % ARITY), *proof_of(level + 1, at // ARITY, size)]
            return known[level, at]

        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                take, out = [], []
                columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5, 6, 7)]
                for i, (tree, block, kind, level, at, size, children, proof) in enumerate(zip(*columns, strict=True)):
                    if (tree, block) != key:
                        key, above, links, known = (tree, block), [], {}, {}
                    if kind == 0:
                        above = proof
                    elif kind == 1:
                        links[level, at] = children
                    else:
                        take.append(i)
                        if level_size(size, level) == 1:
                            out.append(above)
                        else:
                            out.append([_one(links[level + 1, at // ARITY], at % ARITY), *proof_of(level + 1, at // ARITY, size)])
                if take:
                    rows = batch.take(pa.array(take))
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(4), rows.column(5), rows.column(8), pa.array(out, _PROOF)], ["tree", "at", "size", "row", "proof"])

    return run


def _one(children: list[str], place: int) -> dict:
    return {"place": place, "siblings": [c for i, c in enumerate(children) if i != place]}


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    up = lambda acc, s: F.sha2(
        F.concat(F.array_join(F.slice(s["siblings"], F.lit(1), s["place"]), ""), acc, F.array_join(F.slice(s["siblings"], s["place"] + 1, F.lit(ARITY)), "")).cast("binary"), 256
    )
    return F.aggregate(proof, leaf, up)


def manifest(docs: DataFrame, columns: list[str], id_column: str = "doc_id", source_column: str = "source", keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, source, leaf, subroot, root, proof, and the columns of ``keep``): one row for each row of ``docs``.

    A leaf is the digest of ``columns``. Leaves of a source are in order of id (null first), then digest: rows that repeat an
    id are leaves of their own, and equal rows have equal leaves, which stand for one another. A null source is a source, the
    first. Nulls in any column, empty and very long texts are digested as they are (a text is hashed where it
    is read). Columns that are not named are not read. An empty table gives an empty one.
    """
    own = {f"kept_{i}": v for i, v in enumerate((keep or {}).values())}
    leaves = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), digest_of([F.col(c) for c in columns]).alias("leaf"), *(v.alias(k) for k, v in own.items()))
    leaves = materialize(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-digests")  # tells equal rows apart, so that ranges can split them
    lower = build(leaves, "source", ["id", "leaf", "row"], "leaf")
    subroots = materialize(lower.roots().withColumn("all", F.lit(0)), "merkle-subroots")
    upper = build(subroots.withColumnRenamed("tree", "name"), "all", ["name"], "root")
    root = (upper.roots().first() or (None, None))[1]  # one digest
    top = materialize(proofs(upper).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), F.lit(root).alias("root"), "proof"), "merkle-top")
    found = proofs(lower, top).alias("f")
    named = top.select(F.struct("tree").alias("k"), "subroot", "root").alias("t")
    out = found.join(named, F.struct("f.tree") == F.col("k"))
    return out.select("id", F.col("f.tree").alias("source"), F.col("digest").alias("leaf"), "subroot", "root", "proof", *(F.col(k).alias(c) for k, c in zip(own, keep or {}, strict=True)))
