"""Conversations from reply trees: chosen root-to-leaf paths, each formatted with a reversible template.

Messages form trees by (tree, node, parent). Iterative self-joins double the reach of each node's ancestor
pointer, so depth and path score are known after about log2(depth) joins. Branches of a tree are ranked by
mean score along the path, then depth, then leaf; the joins are then walked back from the chosen leaves,
which marks every node of the chosen paths, again in log2(depth) joins. Only numbers take part in the
joins; texts are gathered once, for the chosen nodes, one conversation to a row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: A turn is "### <Role>: <text> </turn>\n"; backslashes, turn heads and turn ends inside roles and texts are escaped.
HEAD, MIDDLE, TAIL = "### ", ": ", " </turn>\n"
_control = re.compile(r"\\|###|</turn>|:|\n")
_control_text = re.compile(r"\\|###|</turn>")
_escaped = re.compile(r"\\(\\|###|</turn>|:|n)")


def escape(text: str, role: bool = False) -> str:
    if role:
        return _control.sub(lambda m: "\\n" if m[0] == "\n" else "\\" + m[0], text)
    return _control_text.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the spans [start, end) of assistant texts in it, in code points: the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = HEAD + escape(role, True) + MIDDLE, escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, TAIL]
        at += len(head) + len(body) + len(TAIL)
    return "".join(out), spans


_turn = re.compile(r"### ((?:[^\\:\n]|\\.)*): ((?:[^\\<]|\\(?:\\|###|</turn>)|<(?!/turn>))*) </turn>\n", re.S)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Reads a formatted conversation back; anything that is not a sequence of turns is refused."""
    out, at = [], 0
    while at < len(formatted):
        m = _turn.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role_end = m.end(1)
        text = formatted[role_end + len(MIDDLE) : m.end() - len(TAIL)]
        out.append((unescape(m[1]), unescape(text)))
        at = m.end()
    return out


def reply_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, depth) of the best branch of each tree.

    ``nodes`` has tree, node, parent (null or unknown: a root) and score (null: zero). Trees and nodes may be of any
    type that can be ordered. Of rows with the same tree and node the one with the largest score counts, then parent; rows
    without a node are left out. Nodes on a cycle have no root and belong to no path. Of equal branches the one with
    the smallest leaf is chosen. An empty table has no paths.
    """
    n = nodes.where("node is not null").groupBy("tree", "node").agg(F.max(F.struct(F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), "parent")).alias("b"))
    n = n.select("tree", "node", "b.parent", "b.score")
    known = n.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    step = n.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")), "left").select("tree", "node", F.col("p").alias("up"), "score", F.lit(1).alias("length"))
    step = materialize(step, "replies")
    base, hops = step, []
    # each round: up is the ancestor 2^k steps away, or null once the root is passed; score and length sum the nodes up to it
    most = 1
    while step.where("up is not null").limit(1).count():
        active, settled = step.where("up is not null"), step.where("up is null")  # what has passed its root takes no part any more
        hops.append(active.select("tree", "node", "up"))
        above = step.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("next"), F.col("score").alias("s"), F.col("length").alias("l"))
        moved = active.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")), "left").select(
            "tree", "node", F.col("next").alias("up"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"), (F.col("length") + F.coalesce("l", F.lit(0))).alias("length")
        )
        step = materialize(settled.unionByName(moved), "replies")
        most *= 2
        if most > 2**40:
            raise ValueError("no end: the replies form a cycle")
        if len(hops) % 8 == 0:  # a cycle never ends: drop what cannot reach a root once the reach passes the number of nodes
            if most > base.count():
                step = step.where("up is null")
    parents = base.where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("u")).distinct()
    leaves = step.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("u")), "left_anti")
    rank = F.struct((-F.col("score") / F.col("length")).alias("mean"), (-F.col("length")).alias("longest"), "node")
    best = leaves.groupBy("tree").agg(F.min(rank).alias("b")).select("tree", F.col("b.node").alias("leaf"))
    path = best.select("tree", "leaf", F.col("leaf").alias("node"))
    for hop in reversed(hops):
        far = hop.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        path = path.unionByName(path.join(far, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", F.col("up").alias("node")))
        path = materialize(path, "paths")
    depth = step.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("length").alias("depth"))
    return path.join(depth, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", "node", "depth")


def format_trees(messages: DataFrame) -> DataFrame:
    """(tree, formatted, loss_spans): one conversation for each tree of ``messages`` (tree, node, parent, score, role, text).

    Null roles and texts are empty. Rows that repeat a tree and node are one message: the first of them by role, then text.
    A conversation is one row by nature; only the chosen path is gathered. Other columns are not read.
    """
    path = reply_paths(messages.select("tree", "node", "parent", "score"))
    m = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = (
        path.alias("path").join(m, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        .groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("depth", F.col("path.node").alias("node"), "role", "text"))).alias("turns"))
        .select("tree", F.filter("turns", lambda x, i: (i == 0) | (F.get("turns", i - 1)["node"] != x["node"])).alias("turns"))
    )
    kind = messages.schema["tree"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column(1).to_pylist()]
                spans = [[{"start": a, "end": b} for a, b in s] for _, s in made]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f for f, _ in made], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["tree", "formatted", "loss_spans"])

    return turns.mapInArrow(run, f"tree {kind}, formatted string, loss_spans array<struct<start: bigint, end: bigint>>")


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees without branches. Rows of a conversation are in the order of
    turn, role, text (nulls first), each a reply to the one before; ties and repeated rows keep a place each."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(w).cast("bigint")
    return conversations.select(F.col("conv_id").alias("tree"), n.alias("node"), F.when(n > 1, n - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns, text under the loss mask, lengths."""
    kind = formatted.schema["tree"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
