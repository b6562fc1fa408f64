"""Bounds on the batches that go to Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bounds put on a session that still has Spark's defaults, so that long texts fit a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_DEFAULTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", str(BATCH_ROWS)),
             "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", f"{BATCH_BYTES}b")}


def bound_batches(spark: SparkSession) -> None:
    for name, (default, bound) in _DEFAULTS.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, bound)
