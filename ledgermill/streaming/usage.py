"""Rolling usage of append-only logs, as batch and as stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_usage(log: DataFrame, ts: str = "ts", size: str = "1 day") -> DataFrame:
    """Rows, sum and errors per tumbling window and type; on a stream, put a watermark on ts first."""
    g = log.groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def stream_usage(log: DataFrame, ts: str = "ts", lateness: str = "1 hour", size: str = "1 day") -> DataFrame:
    return windowed_usage(log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness), ts, size)


def stream_once(log: DataFrame, key: str, ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Each key once, within the lateness (idempotent ingest)."""
    return log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])
