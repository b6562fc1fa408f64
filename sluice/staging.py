"""Shared-folder tables that cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a private one only where that is unset and all tasks run in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, deleted with the staged tables."""
    path = f"{shared_dir(spark)}/sluice/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stage(df: DataFrame, label: str, sweep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it.

    The table is written once by Spark's own committer, so a lost executor only
    repeats its tasks, and every later reader starts from the files. ``sweep`` is for
    large tables: it compresses them harder and lets the driver drop the shuffle files
    behind them at once rather than at its next garbage collection.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd" if sweep else "snappy").parquet(path)
    if sweep:
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Delete the staged tables of this process; results that still read them must be consumed first."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):
            _delete(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its input has fewer partitions than there are cores.

    Only inputs of a few small files are shuffled by this; larger ones stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


atexit.register(release)
