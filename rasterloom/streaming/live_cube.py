"""The cube's aggregation as a stream, with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(path)


def slot_means(events: DataFrame, hours: int = 6, late: str = "1 day", cells: int = 25) -> DataFrame:
    """start, cell, event_type, n, mean of each slot; slots close once the watermark has passed."""
    slot = F.window("ts", f"{hours} hours")
    out = events.withWatermark("ts", late).groupBy(slot.alias("slot"), (F.col("user_id") % cells).cast("int").alias("cell"), "event_type")
    return out.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("slot.start").alias("start"), "cell", "event_type", "n", "mean")
