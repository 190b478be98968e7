"""Structured Streaming forms of batch operators.

Each function takes a streaming DataFrame and returns one; the caller picks sink, trigger and
checkpoint folder.  Rows later than the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_events(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Appended files in the order they come; the sink's checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_event_time(df: DataFrame, delay: str = "1 hour") -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def sessions(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of events of a user with no gap longer than `gap`."""
    g = with_event_time(df).groupBy(F.session_window("ts", gap), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def distinct_content(df: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return with_event_time(df, delay).dropDuplicatesWithinWatermark(keys)


def running_funnel(df: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts by kind in tumbling windows."""
    g = with_event_time(df).groupBy(F.window("ts", width), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_votes(df: DataFrame, width: str = "2 hours", hop: str = "1 hour", least: float = 50.0) -> DataFrame:
    """Share of values from `least` on in sliding windows, which align to the epoch."""
    g = with_event_time(df).groupBy(F.window("ts", width, hop), "user_id")
    return g.agg(F.avg(F.when(F.col("value") >= least, 1.0).otherwise(0.0)).alias("votes"), F.count("*").alias("n")).select("user_id", F.col("window.start").alias("start"), "votes", "n")
