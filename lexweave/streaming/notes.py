"""Beyond a batch library: counts of note events in windows of event time, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Works on a stream and on a table alike; rows later than the watermark are left out of a stream."""
    at = F.col("ts").cast("timestamp")
    return (
        events.withColumn("ts", at)
        .withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), "event_type", "n")
    )
