"""Near-duplicates by word shingles: components of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts with equal sets are one value. Candidates come from two sources, which only saves work: SimHash fingerprints of the same
shingles within RADIUS bits, found by vantage-point trees, and MinHash bands. At a similarity of 0.8 two fingerprints differ in
some ten bits of 64 (an angle of 27 degrees, three bits more or less), a radius at which no triangle bound prunes anything, so
trees alone would miss about half of the near copies or compare all pairs; the bands are for those. Texts that meet
are joined to candidate groups, and inside a group every pair that no chain links yet is compared exactly, so no link
below the similarity is made. A pair at exactly 0.8 shares none of the bands with probability (1 - 0.8**ROWS)**BANDS,
5 in ten million, and less above it. A group of more than GROUP texts is dealt into parts of about that size, each linked
in a task of its own; one text of each part then links the parts. Where that leaves a group in several components,
every two of its parts meet once more, so no link is lost and no task holds more than two parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, connected_components, materialize, sliced
from .simhash import SEED, fingerprint_of, links, shingle_hashes

WIDTH = 5
#: Similarity from which two texts link, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 48, 6
#: Differing bits at which fingerprints make candidates; the trees prune well up to here.
RADIUS = 3
#: Texts of a candidate group that one task compares.
GROUP = 1024
_draw = np.random.default_rng(SEED)
_TIMES, _WITH = (_draw.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text with fewer words than width is one shingle, one without words has none."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def value_of(found: np.ndarray) -> int:
    """The hash of a shingle set, signed; of the empty set zero."""
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), SEED)], np.uint64).view(np.int64)[0]) if len(found) else 0


def bands(found: np.ndarray) -> list[int]:
    """Hashes of the MinHash bands, signed; each band has a seed of its own."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 256):  # bounded memory, and the products stay in cache
        np.minimum(least, ((found[at : at + 256] ^ _WITH) * _TIMES).min(axis=1), out=least)
    hashes = [xxhash.xxh64_intdigest(part.tobytes(), k) for k, part in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(hashes, np.uint64).view(np.int64).tolist()


def chains(sets: list[np.ndarray]) -> list[int]:
    """For each set the position of one set of its component; breadth first, a set is compared once with those not reached yet."""
    root, left = np.full(len(sets), -1), np.arange(len(sets))
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    numbers = np.split(number, np.cumsum(sizes)[:-1])
    marked = np.zeros(number.max() + 1, bool)
    flat, starts = number, np.concatenate(([0], np.cumsum(sizes)[:-1]))
    flat_of = left
    while len(left):
        first, left = left[0], left[1:]
        root[first], reached = first, [first]
        while reached and len(left):
            if 2 * len(left) < len(flat_of):
                flat, flat_of = np.concatenate([numbers[k] for k in left]), left
                starts = np.concatenate(([0], np.cumsum(sizes[left])[:-1]))
            own = reached.pop()
            marked[numbers[own]] = True
            shared = np.add.reduceat(marked[flat], starts, dtype=np.int64)
            marked[numbers[own]] = False
            hit = flat_of[LEAST[1] * shared >= LEAST[0] * (sizes[own] + sizes[flat_of] - shared)]
            new = hit[root[hit] < 0]
            if len(new):
                root[new] = first
                left = left[root[left] < 0]
                reached.extend(new)
    return root.tolist()


def sketches(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, place (hash of the text), value (hash of its shingle set), fp (fingerprint of its shingles) and bands for each row."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_column):
            hashes = [np.array(shingle_hashes(t, WIDTH), np.uint64) for t in byte_column(batch, text_column)]
            sets = [np.unique(h) for h in hashes]
            fps = np.array([fingerprint_of(h) for h in hashes], np.uint64).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array([value_of(s) for s in sets], pa.int64()), pa.array(fps), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "place", "value", "fp", "bands"])

    return docs.select(id_column, F.xxhash64(text_column).alias("place"), text_column).mapInArrow(run, f"{id_column} {kind}, place bigint, value bigint, fp bigint, bands array<bigint>")


def candidates(values: DataFrame) -> DataFrame:
    """Edges (a, b) among values (value, fp, bands): those that share a band, and those whose fingerprints are within the radius,
    each once to the least value of its band or fingerprint."""
    entries = values.select("value", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.min("value").alias("b"), F.max("value").alias("most")).where("b < most").select("band", "b")
    by_band = entries.join(shared, "band").select(F.col("value").alias("a"), "b")
    spoken = values.where(F.size("bands") > 0)
    least = materialize(spoken.groupBy("fp").agg(F.min("value").alias("b")), "fingerprints")
    of = lambda c: least.select(F.col("fp").alias(c), F.col("b").alias(f"v{c}"))
    near = links(least, RADIUS).join(of("a"), "a").join(of("b"), "b").select(F.col("va").alias("a"), F.col("vb").alias("b"))
    return by_band.unionByName(spoken.join(least, "fp").select(F.col("value").alias("a"), "b").where("a <> b")).unionByName(near)


def _sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Different values of a group's rows, the places of their first rows, and their shingle sets."""
    values, at = np.unique(table.column("value").to_numpy(), return_index=True)
    texts = table.column("text")
    return values, at, [shingle_set((texts[int(k)].as_py() or "").encode()) for k in at]


def _within(table: pa.Table) -> pa.Table:
    values, at, sets = _sets(table)
    return pa.table({"root": pa.array(np.full(len(values), table.column("root")[0].as_py()), pa.int64()), "value": pa.array(values, pa.int64()), "component": pa.array(values[chains(sets)], pa.int64())})


def _across(table: pa.Table) -> pa.Table:
    """Links (a, b) between the components that the rows of two parts have so far."""
    values, at, sets = _sets(table)
    own = table.column("component").to_numpy()[at]
    pairs = np.unique(np.stack((own, own[chains(sets)]), axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pa.table({"a": pa.array(pairs[:, 0].copy(), pa.int64()), "b": pa.array(pairs[:, 1].copy(), pa.int64())})


def group_links(texts: DataFrame) -> DataFrame:
    """(value, component) of candidate groups (root, value, text): component is a value of the texts that link."""
    schema = "root bigint, value bigint, component bigint"
    sizes = materialize(texts.groupBy("root").agg(F.ceil(F.count("*") / GROUP).alias("parts")), "group-sizes")
    dealt = texts.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("value"), F.col("parts")))
    if not sizes.where("parts > 1").limit(1).count():
        return dealt.groupBy("root", "part").applyInArrow(_within, schema).select("value", "component")
    dealt = materialize(dealt, "group-parts")
    local = materialize(dealt.groupBy("root", "part").applyInArrow(_within, schema), "group-links")
    big = dealt.where("parts > 1")
    first = big.select("value", "root", "part").join(local.select("value", "component"), "value").groupBy("root", "part").agg(F.min("component").alias("value")).select("root", "value")
    met = big.select("root", "value", "text").join(first, ["root", "value"]).groupBy("root").applyInArrow(_within, schema).select(F.col("value").alias("component"), F.col("component").alias("met"))
    known = materialize(local.join(met, "component", "left").select("root", "value", F.coalesce("met", "component").alias("component")), "group-met")
    several = known.groupBy("root").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("root")
    rest = big.join(several, "root", "left_semi").join(known.select("value", "component"), "value")
    each = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).where("other <> part")
    edges = each.groupBy("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).applyInArrow(_across, "a bigint, b bigint")
    merged = connected_components(edges, "parts").select(F.col("node").alias("component"), F.col("root").alias("end"))
    return known.select("value", "component").join(merged, "component", "left").select("value", F.coalesce("end", "component").alias("component"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and component_id (smallest id reachable over links) for each row.

    Texts without a word, null among them, are one value. Repeated rows stay, each with the same result. Other columns
    are not read. Texts of any length are read whole; an empty table gives an empty one.
    """
    found = materialize(sketches(docs, id_column, text_column), "sketches")
    place = F.min(F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), "place")).alias("first")
    # texts with equal sets may repeat shingles differently: any of their fingerprints will do
    values = materialize(found.groupBy("value").agg(place, F.min("fp").alias("fp"), F.any_value("bands").alias("bands")), "values")
    groups = connected_components(candidates(values), "shingles")
    chosen = values.join(groups, values["value"] == groups["node"]).select("value", "root", F.col("first.id").alias("__first"), F.col("first.place").alias("__place"))
    texts = docs.select(F.col(id_column).alias("__id"), F.xxhash64(text_column).alias("__own"), F.col(text_column).alias("text"))
    texts = texts.join(chosen, (F.col("__own") == F.col("__place")) & F.col("__id").eqNullSafe(F.col("__first"))).select("root", "value", "text")

    linked = group_links(texts)
    rooted = values.select("value", "first").join(linked, "value", "left").select("value", "first", F.coalesce("component", "value").alias("component"))
    rooted = materialize(rooted, "rooted")
    names = rooted.groupBy("component").agg(F.min("first").alias("name")).select("component", F.col("name.id").alias("component_id"))
    return found.join(rooted.join(names, "component").select("value", "component_id"), "value").select(id_column, "component_id")
