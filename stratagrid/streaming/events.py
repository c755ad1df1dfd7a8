"""Windowed aggregates over an unbounded events table, late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_means(events: DataFrame, width: str = "5 days", late: str = "1 day", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """(keys, start, n, mean) by tumbling event-time windows; works on batch and streaming tables alike."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return w.select(*keys, F.col("window.start").alias("start"), "n", "mean")
