"""Event-time forms of the batch operators over a stream of events (ts, event_type, value, user_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """hour, entity, v: counts by tumbling hours, complete once the watermark has passed them."""
    marked = events.withWatermark("ts", late)
    out = marked.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("entity")).agg(F.count("*").alias("v"))
    return out.select(F.col("w.start").alias("hour"), "entity", "v")


def sliding(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """start, entity, mean: of two hours, each hour."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), F.col("event_type").alias("entity")).agg(F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "entity", "mean")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """user_id, start, n: visits parted by a gap."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def unique(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """All there is now, into a table in memory."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
