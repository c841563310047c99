"""The queries opN_<name>: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import workers_import

from . import bpe, chat, decontaminate, line_dedup, merkle, mixing, ppm, prefix_trie, quality, simhash, token_counts, toxicity, warc
from .common import materialize, read, remainder

TOKEN_LIMIT = 2048


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id have no remainder and count as not held out; labels of such rows are not used."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity.score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_passages", "best_passage")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id have no remainder and count as training rows."""
    held_out = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("training"))
    scored = ppm.score_documents(docs, "training")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str, short: bool = False) -> DataFrame:
    """Texts of one or two lines have no window and stay; op6_line_dedup_short takes them too."""
    left = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), short=short)
    text = F.coalesce("text", F.lit(""))
    return left.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.length(text).cast("bigint").alias("n_chars_left"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def op6_line_dedup_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_line_dedup(spark, sf_dir, short=True)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")], "conv_id bigint, turn bigint, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    messages = materialize(chat.linear_messages(rows), "messages")
    return chat.digests(chat.format_trees(messages))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate_documents(read(spark, sf_dir, "documents"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"), least=0)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), TOKEN_LIMIT)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of even crc32 are tampered with: their texts lose their line breaks. Rows without an id stay as they are."""
    docs, columns = read(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]
    forged = F.when(remainder(F.col("doc_id"), 2) == 0, merkle.digest_of([F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in columns]))
    found = merkle.manifest(docs, columns, keep={"forged": forged})
    siblings = F.array_join(F.flatten(F.transform("proof", lambda s: s["siblings"])), "")
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("forged", "leaf"), F.col("proof")))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % 100, h being crc32(c) % 6; where
    that one is absent they are gone. Only the heads of these hundredths take part in the join, each with at most 100 others."""
    at = F.col("conv_id")
    heads = sequences.where(at % 100 == 0).select(at.alias("__head"), F.slice("ids", 1, 5).alias("__ids"), F.slice("sizes", 1, 5).alias("__sizes"))
    h = remainder(at, 6).cast("int")
    joined = sequences.join(heads, at - at % 100 == F.col("__head"), "left")
    put = lambda c: F.concat(F.coalesce(F.slice(f"__{c}", F.lit(1), h), F.array().cast(sequences.schema[c].dataType)), F.slice(c, h + 1, F.size(c)))
    return joined.select("conv_id", put("ids").alias("ids"), put("sizes").alias("sizes"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = materialize(prefix_trie.sequences(read(spark, sf_dir, "conversations")), "sequences")
    return prefix_trie.nodes(rebuilt(sequences)).drop("turn_id")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(read(spark, sf_dir, "documents"))
    return planned.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return {k: (lambda spark, sf_dir, f=f: f(workers_import(spark), sf_dir)) for k, f in found.items()}


OP6_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT rid, doc_id, text, lines, unnest(range(1, len(lines) - 1)) AS i FROM t WHERE len(lines) >= 3
), w AS (
  SELECT rid, doc_id, text, i - 1 AS pos, lines[i:i + 2] AS win FROM l
  WHERE regexp_matches(array_to_string(lines[i:i + 2], chr(10)), '[^\x20\x09-\x0D]')
), f AS (
  SELECT win, min(struct_pack(a := doc_id IS NULL, b := doc_id, p := pos)) AS first FROM w GROUP BY win HAVING count(*) > 1
), c AS (
  SELECT DISTINCT rid, unnest(CASE WHEN w.doc_id = f.first.b THEN list_filter([pos, pos + 1, pos + 2], lambda p: p > f.first.p + 2) ELSE [pos, pos + 1, pos + 2] END) AS p
  FROM w JOIN f USING (win) WHERE NOT (w.doc_id = f.first.b AND w.pos = f.first.p)
), g AS (
  SELECT rid, list(p) AS gone FROM c GROUP BY rid
), r AS (
  SELECT doc_id, len(lines) AS n_lines, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text
  FROM t LEFT JOIN g USING (rid)
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(text) AS BIGINT) AS n_chars_left, sha256(text) AS text_sha256 FROM r
"""

#: The same with a text of fewer than three lines as one window.
OP6_SHORT_SQL = OP6_SQL.replace("range(1, len(lines) - 1)) AS i FROM t WHERE len(lines) >= 3", "range(1, greatest(len(lines) - 1, 2))) AS i FROM t").replace(
    "ELSE [pos, pos + 1, pos + 2] END", "ELSE list_slice([pos, pos + 1, pos + 2], 1, len(win)) END"
)


def _op8_sql() -> str:
    """Built from the operator's own word lists and limits."""
    words = {k: ", ".join(f"'{w}'" for w in ws) for k, ws in quality.COMMON.items()}
    listed = " ".join(f"WHEN '{k}' THEN [{w}]" for k, w in words.items())
    everything = ", ".join(f"'{w}'" for w in sorted({w for ws in quality.COMMON.values() for w in ws}))
    ref_words = ", ".join(f"coalesce(sum(hist[{i + 1}]), 0)" for i in range(quality.BINS))
    term = "(CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0.0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0.0 END)"
    share = lambda x: f"list_transform({x}, lambda v: CAST(v AS DOUBLE) / list_sum({x}))"
    js = lambda a, b: f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({share(a)}, {share(b)}), lambda z: {term})) / 2))"
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    CASE WHEN lower(lang) IN ({", ".join(f"'{k}'" for k in words)}) THEN lower(lang) ELSE '' END AS lg,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '') AS words
  FROM documents
), win AS (
  SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM t WHERE len(words) >= 3
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid
), m AS (
  SELECT rid, doc_id, lg, len(words) AS n_words, length(regexp_replace(text, '[ 	-
]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')))) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, length(text) AS n_chars,
    length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS upper_, length(regexp_replace(text, '[^0-9]+', '', 'g')) AS digits_,
    length(regexp_replace(text, '[^.,;:!?''"()\-]+', '', 'g')) AS points_,
    list_transform(CASE lg {listed} ELSE CAST([] AS VARCHAR[]) END, lambda r: len(list_filter(words, lambda w: lower(w) = r))) AS hist
  FROM t LEFT JOIN rep USING (rid)
), v AS (
  SELECT *, [upper_, digits_, n_symbols, points_, n_chars - word_chars, word_chars - upper_ - digits_ - n_symbols - points_] AS ch,
    list_concat(hist, [n_words - coalesce(list_sum(hist), 0)]) AS wd FROM m
), ref AS (
  SELECT lg, [{", ".join(f"sum(ch[{i + 1}])" for i in range(len(quality.CLASSES) + 2))}] AS ref_ch, [{ref_words}] AS rw, sum(n_words) AS rn FROM v GROUP BY lg
), j AS (
  SELECT v.*, ref_ch, list_concat(rw, [rn - list_sum(rw)]) AS ref_wd FROM v JOIN ref USING (lg)
), d AS (
  SELECT *, (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words) AS base_failed,
    CASE WHEN n_chars >= {quality.LEAST_CHARS} THEN {js("ch", "ref_ch")} ELSE 0.0 END AS chars_far,
    CASE WHEN n_words >= {quality.LEAST_WORDS} AND lg <> '' THEN {js("wd", "ref_wd")} ELSE 0.0 END AS words_far
  FROM j
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND chars_far <= {quality.CHARS_FAR} AND words_far <= {quality.WORDS_FAR}
    AND (n_words < {quality.LEAST_SUM_WORDS} OR n_chars < {quality.LEAST_CHARS} OR lg = '' OR chars_far + words_far <= {quality.SUM_FAR}) AS kept
FROM d
"""


#: crc32 of the text of a number, as a list of bytes that is folded through the table of 256 remainders.
CRC_TABLE = "(SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS crc FROM range(256) r(i))"


def _crc32_sql(number: str) -> str:
    return f"xor(list_reduce(list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: xor(a >> 8, crc[CAST(xor(a, b) & 255 AS INT) + 1]), 4294967295), 4294967295)"


def _op11_sql(levels: int = 12) -> str:
    """Trees of up to 3**levels leaves, level by level: n<k> has the nodes, p<k> their siblings to the left and right."""
    said = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(said(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    out = [
        f"c AS {CRC_TABLE}",
        f"d AS (SELECT row_number() OVER () AS rid, doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_crc32_sql('doc_id')} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS forged FROM documents, c)",
        "a0 AS (SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS digest, rid FROM d)",
    ]
    for t, first in (("a", "a0"), ("b", "b0")):
        if t == "b":
            out.append(f"b0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, digest, tree AS source FROM a{levels})")
        for k in range(levels):
            out.append(f"{t}p{k} AS (SELECT tree, pos // 3 AS pos, list(digest ORDER BY pos) AS ds, max(max(pos)) OVER (PARTITION BY tree) AS last FROM {t}{k} GROUP BY tree, pos // 3)")
            out.append(f"{t}{k + 1} AS (SELECT tree, pos, CASE WHEN last = 0 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS digest FROM {t}p{k})")
    row, left, steps = "d JOIN a0 ON a0.rid = d.rid", [], []
    for t, base, tree in (("a", "a0", "a0.tree"), ("b", "b0", "0")):
        if t == "b":
            row += f" JOIN a{levels} ON a{levels}.tree IS NOT DISTINCT FROM a0.tree JOIN b0 ON b0.source IS NOT DISTINCT FROM a0.tree"
        for k in range(levels):
            row += f" JOIN {t}p{k} ON {t}p{k}.tree IS NOT DISTINCT FROM {tree} AND {t}p{k}.pos = {base}.pos // {3 ** (k + 1)}"
            place = f"{base}.pos // {3**k} % 3"
            steps.append((f"array_to_string({t}p{k}.ds[1:{place}], '')", f"array_to_string({t}p{k}.ds[{place} + 2:], '')", f"{t}p{k}.last"))
    cols = ", ".join(f"{a} AS l{i}, {b} AS r{i}, {last} AS z{i}" for i, (a, b, last) in enumerate(steps))
    out.append(f"f0 AS (SELECT doc_id, leaf, a{levels}.digest AS subroot, b{levels}.digest AS root, coalesce(forged, leaf) AS folded, {cols} FROM {row} JOIN b{levels} ON true)")
    for i in range(len(steps)):
        out.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN z{i} = 0 THEN folded ELSE sha256(l{i} || folded || r{i}) END AS folded) FROM f{i})")
    siblings = " || ".join(f"l{i} || r{i}" for i in range(len(steps)))
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, root, sha256({siblings}) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM f{len(steps)}"


OP12_SQL = rf"""
WITH c AS {CRC_TABLE}, o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), i AS (
  SELECT conv_id, {_crc32_sql("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o), c
), r AS (
  SELECT i.conv_id, n, role, text FROM i JOIN o ON o.conv_id = i.conv_id - i.conv_id % 100 AND n <= h UNION ALL SELECT i.conv_id, n, role, text FROM i JOIN o ON o.conv_id = i.conv_id AND n > h
), s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS depth, sha256(strlen(role) || ':' || role || text) AS turn, length(text) AS size FROM r
), p AS (
  SELECT conv_id, depth, size, array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY depth), ',') AS key FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM i
), q AS (
  SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS up, max(depth) OVER (PARTITION BY conv_id) = depth AS ends FROM p
), n AS (
  SELECT key, any_value(up) AS up, any_value(depth) AS depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY key
), k AS (
  SELECT up AS key, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up
), t AS (
  SELECT q.key, count(*) FILTER (k.key IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens FROM n LEFT JOIN k ON k.key = n.key JOIN q ON q.conv_id = n.conv_id AND q.depth <= n.depth GROUP BY q.key
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN t ON t.key = n.key LEFT JOIN k ON k.key = n.key LEFT JOIN n AS u ON u.key = n.up
"""


def _op13_sql() -> str:
    """The same sums in whole units; the level is found by the same pass over the sources."""
    unit, most, share = mixing.UNIT, mixing.MOST, mixing.SHARE
    whole = lambda x: f"({x}) // {unit}"
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    return rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} {weight} END AS weight FROM s
), f AS (
  SELECT *, coalesce(sum(source_size) OVER o, 0) AS size_before, sum(source_size) OVER () AS size_total, coalesce(sum(weight) OVER o, 0) AS weight_before, sum(weight) OVER () AS weight_total
  FROM w WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT *, ({share}::DOUBLE * CAST(size_total AS DOUBLE) - CAST({most} * size_before AS DOUBLE)) / CAST(weight_total - weight_before AS DOUBLE) AS level, CAST(source_size AS DOUBLE) / weight AS ratio FROM f
), t AS (
  SELECT source, source_size, least(CAST({most} * source_size AS DOUBLE), coalesce((SELECT arg_min(level, (ratio, size_before)) FROM v WHERE level < {most} * ratio), 'infinity'::DOUBLE) * weight) AS target FROM v
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * {unit}::DOUBLE) ELSE 0 END AS HUGEINT) AS e,
    CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1 AS HUGEINT) AS n, CAST(CAST('0x' || substr(md5('0:' || coalesce(d.source, '')), 1, 12) AS BIGINT) AS HUGEINT) AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST({whole("u + (n + 1) * e")} - {whole("u + n * e")} AS BIGINT) AS copies FROM r
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; the others are tested against brute force."""
    return {"op6_line_dedup": OP6_SQL, "op6_line_dedup_short": OP6_SHORT_SQL, "op8_quality": _op8_sql(), "op11_merkle": _op11_sql(), "op12_prefix_trie": OP12_SQL, "op13_mixing": _op13_sql()}
