"""Structured Streaming over the event table: late data, windows, and state with a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """A stream of the events files in a folder."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed_totals(events: DataFrame, width: str = "1 day", late: str | None = "2 days") -> DataFrame:
    """Counts and sums by event type and window; windows close once the watermark passes them. Works on batches too.

    late: None where events have a watermark already.
    """
    marked = events.withWatermark("ts", late) if late else events
    return marked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def first_seen(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
