"""Trees, roots and proofs against plain loops."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wardline.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_tree(digests):
    """The root, and for each leaf its proof as (place, siblings) by level."""
    levels, proofs = [list(digests)], [[] for _ in digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    for i in range(len(digests)):
        at = i
        for level in levels[:-1]:
            run = level[at - at % 3 : at - at % 3 + 3]
            proofs[i].append((at % 3, [x for k, x in enumerate(run) if k != at % 3]))
            at //= 3
    return levels[-1][0], proofs


def plain_manifest(rows):
    """{(doc_id, source, leaf): ...} as sorted rows."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    found, subroots = {}, []
    for s in sources:
        own = sorted(((r[0], h(*map(said, r))) for r in rows if r[1] == s), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subroot, proofs = plain_tree([x[1] for x in own])
        found[s] = [(i, leaf, subroot, proof) for (i, leaf), proof in zip(own, proofs, strict=True)]
        subroots.append(subroot)
    root, tops = plain_tree(subroots)
    return [(i, s, leaf, subroot, root, proof + top) for s, top in zip(sources, tops, strict=True) for i, leaf, subroot, proof in found[s]]


def as_rows(df):
    return [(r.id, r.source, r.leaf, r.subroot, r.root, [(s.place, list(s.siblings)) for s in r.proof]) for r in df.collect()]


def sorted_rows(rows):
    return sorted(rows, key=repr)


KIND = "doc_id long, source string, text string, size int"


def test_manifest_of_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i if i % 41 else None, rng.choice(["hot"] * 6 + ["b", "", None, "é", "\U0001f600"]), rng.choice([None, "", "a\nb", "x" * 200_000 if i == 7 else "y"]), 1) for i in range(260)]
    rows += rows[5:8] + [(900, "lone", "z", None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, KIND)
    got = merkle.manifest(docs.repartition(5), ["doc_id", "source", "text", "size"], keep={"leaf_": F.col("size")})
    want = plain_manifest(rows)
    assert sorted_rows(as_rows(got)) == sorted_rows(want) and got.columns[-1] == "leaf_"
    assert got.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert got.where(merkle.folded(F.sha2(F.col("leaf").cast("binary"), 256), F.col("proof")) == F.col("root")).count() == 0


@pytest.mark.parametrize("period", [1, 2, 3])
def test_blocks_and_frontier(spark, period):
    """Several ranges a tree and low blocks: open parents are dealt again, trees of all heights pass through."""
    rng = random.Random(period)
    sizes = {"t0": 1, "t1": 2, "t2": 3, "t3": 4, "t4": 9, "t5": 10, "t6": 27, "t7": 28, "t8": 200, None: 82}
    rows = [(t, i, h(f"{t}{i}")) for t, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tree = merkle.build(spark.createDataFrame(rows, "t string, i int, d string").repartition(7), "t", ["i"], "d", period)
        got = {(r.tree, r.i): (r.digest, [(s.place, list(s.siblings)) for s in r.proof]) for r in merkle.proofs(tree).collect()}
        roots = {r.tree: r.root for r in tree.roots().collect()}
        assert tree.nodes.where("children is null").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for t, n in sizes.items():
        digests = [h(f"{t}{i}") for i in range(n)]
        root, proofs = plain_tree(digests)
        assert roots[t] == root
        assert [got[t, i] for i in range(n)] == list(zip(digests, proofs, strict=True))
    assert len(got) == len(rows)


def test_empty_and_clashing_names(spark):
    assert merkle.manifest(spark.createDataFrame([], KIND), ["doc_id"]).count() == 0
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", None)], "at long, tree string, digest string")
    got = merkle.manifest(docs, ["at", "digest"], "at", "tree", keep={"level": F.col("digest"), "size": F.col("at")})
    assert {(r.id, r.leaf, r.level, r["size"]) for r in got.collect()} == {(1, h("1:1", "1:x"), "x", 1), (2, h("1:2", "-"), None, 2)}
