"""The event table as a stream: windows with watermarks, and a daily counter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A folder of event files as a stream, with their batch schema."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def hourly(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(hour, event_type, n, total) with a watermark: the same expression over a stream or a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def daily_counter(events: DataFrame, zone: str = "America/Los_Angeles") -> DataFrame:
    """(key, day, n): events per type and local day."""
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone))
    return events.groupBy(F.col("event_type").alias("key"), day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
