"""What the text operators share: table access, byte batches, reserved names; written tables and components come from the rest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.windows import components as connected_components
from wardline.session import discard, materialize, new_path, release, shared_dir

__all__ = ["connected_components", "discard", "materialize", "new_path", "release", "shared_dir"]

#: ASCII white space, as the contracts' word pattern excludes it; bytes.split() splits on the same six.
WHITE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def put_aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with the caller's columns that begin with two underscores, as our working columns do, under other names, and the
    way back."""
    names: dict[str, str] = {}
    for c in df.columns:
        if c.startswith("__"):
            own = f"kept{c}"
            while own in df.columns or own in names.values():
                own += "_"
            names[c] = own
    return df.withColumnsRenamed(names), {own: c for c, own in names.items()}


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id has no remainder."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes without decoding; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [b or b"" for b in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def text_column(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], name: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `most` bytes of the named column (one row at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(name))
        sizes = [x or 0 for x in pc.binary_length(col).to_pylist()]
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
