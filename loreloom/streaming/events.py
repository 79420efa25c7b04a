"""Event streams: windowed counts with late-data rules, in a batch form and a stream form with equal results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    """Events with `ts` as an instant (session zone UTC), which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) of tumbling or sliding windows."""
    counted = events.groupBy(F.window("ts", length, slide) if slide else F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, session_start, n) of runs of a user's events with less than `gap` between them."""
    counted = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), "n")


def stream(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """The events files of a folder as a stream with a watermark."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return timed(source).withWatermark("ts", late)
