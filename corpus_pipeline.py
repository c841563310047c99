"""From documents to token ids in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

run() writes each stage's rows to the shared folder as Parquet and reads them back for the next, so a stage
never recomputes its predecessors and survives lost executors; what a stage has read is deleted once its own rows are
written. All stages but the last return the columns
of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bpe, decontaminate, line_dedup, quality, shingles
from wardline.llm.common import discard, materialize, put_aside, read
from wardline.session import workers_import


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    workers_import(spark)
    return quality.keep_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go, but for their first occurrence, as do whole texts of one or two lines; n_chars
    follows the text."""
    left = line_dedup.dedup_lines(docs, short=True)
    changed = F.col("__n_removed") > 0
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts link from a Jaccard similarity of 0.8 of five-word shingles. Each row is judged by its own component: the row with the
    smallest id stays, rows without an id last, the smallest hash of all columns among equal ids; rows equal in all columns are one.
    Columns may be of any type; those named like the working columns pass through."""
    workers_import(spark)
    docs, back = put_aside(docs)
    # maps have no hash of their own: their sorted entries stand for them
    plain = lambda f: F.array_sort(F.map_entries(f.name)) if f.dataType.typeName() == "map" else F.col(f.name)
    parts = [x for f in docs.schema.fields for x in (F.col(f.name).isNull(), plain(f))]
    key = F.concat(F.hex(F.xxhash64(*parts)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *parts)))
    keyed = docs.withColumn("__key", key).withColumn("__row", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__key").alias("key")))
    found = shingles.near_duplicates(keyed, "__row")
    first = found.where(F.col("__row") == F.col("component_id")).select(F.col("__row.key").alias("__key")).distinct()
    return keyed.join(first, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns).withColumnsRenamed(back)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    workers_import(spark)
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the digests of what they decode to."""
    workers_import(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=True).drop("decoded_text")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontaminate_documents),
    ("byte_bpe", encode),
]

#: Edit distances and merges are not for SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before, written = written, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        docs = written
        if before is not None:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
