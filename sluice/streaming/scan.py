"""Micro-batch scanning of a folder of assets, with resume and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.rules import CATALOGUE
from sluice.operators.scan import scan
from sluice.schema import HIT_KEY


def stream_assets(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text, seen) of Parquet files that arrive in ``folder``."""
    return spark.readStream.schema("file string, text string, seen timestamp").parquet(folder)


def stream_hits(assets: DataFrame, delay: str = "1 hour", rules=CATALOGUE) -> DataFrame:
    """Hits of a stream of assets, each key once within ``delay`` of its first sight. [K1, K4, D22]"""
    hits = scan(assets.withWatermark("seen", delay), rules, unescaped=False, carry=("seen",))
    return hits.dropDuplicatesWithinWatermark(list(HIT_KEY))


def run_available(hits: DataFrame, out: str, checkpoint: str) -> None:
    """Scan what is there and stop; a later call goes on where this one ended. [K4]"""
    hits.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of tumbling or sliding windows. An extension: the reference has no event time."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(span.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
