"""Session set-up that queries share."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def workers_import(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where driver and workers share the checkout; a cluster takes
    it by --py-files or an installed wheel instead."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, have)))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local session (tests) gets a folder of its
    own, removed at exit; on a cluster such a folder would be another one on each machine, so that is refused."""
    sc = spark.sparkContext
    if set_dir := spark.conf.get("spark.checkpoint.dir", None):
        return set_dir.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(sc, "_wardline_dir", None)
    if own is None:
        own = sc._wardline_dir = tempfile.mkdtemp(prefix="wardline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wardline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a table in the shared folder: it outlives executors, and is compressed."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def bucketed(df: DataFrame, name: str, keys: list[str], n: int) -> DataFrame:
    """materialize() in n buckets by the keys: joins by all of them with a table of as many buckets shuffle neither."""
    spark = df.sparkSession
    path, called = new_path(spark, name), f"wardline_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", path).format("parquet").bucketBy(n, *keys).saveAsTable(called)
    out = spark.table(called)
    out._written_at = path
    return out


def release(spark: SparkSession) -> None:
    """Lets the context cleaner drop the shuffle files of finished jobs now, not at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dealt(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, so that it is shuffled with the other and not sent whole to every task. Spark knows a
    written table by its compressed bytes, which may say a hundredth of what its rows take in the driver that sends them."""
    return side.hint("merge")


def discard(table: DataFrame) -> None:
    """Deletes a table made by materialize, once nothing that is still to run reads it."""
    sc = table.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(table._written_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
