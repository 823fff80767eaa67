"""Event-driven behaviour as Structured Streaming, with batch forms that give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUIET = "3 seconds"


def debounced(events: DataFrame, key: str = "path", ts: str = "ts", quiet: str = QUIET, watermark: str = "1 minute") -> DataFrame:
    """One row per burst of events of a path, after ``quiet`` without a further one (S1). Works on
    batches and streams: session windows on event time."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(ts, watermark)
    out = rows.groupBy(F.session_window(ts, quiet).alias("w"), key).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("first_at"), F.col("w.end").alias("fires_at"), "events")


def last_activity(events: DataFrame, key: str = "session_id", ts: str = "ts") -> DataFrame:
    """Newest event of each session."""
    return events.groupBy(key).agg(F.max(ts).alias("last_active_at"))


def idle_stream(events: DataFrame, hours: int = 24, key: str = "session_id", ts: str = "ts") -> DataFrame:
    """Sessions that went idle, each once, when the watermark passes their last event by so many hours."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, "0 seconds")
    out = rows.groupBy(F.session_window(ts, f"{hours} hours").alias("w"), key).agg(F.max(ts).alias("last_active_at"))
    return out.select(key, "last_active_at")


def watch(spark: SparkSession, folder: str, glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """Arriving files with their bytes and checksums."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.withColumn("checksum", F.sha2("content", 256))


def ingest(files: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``handle`` over each batch of new files until none is left (S5); the checkpoint makes a
    restart pick up where the last run ended."""
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_content(arrivals: DataFrame, key: str = "checksum", ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """Arrivals without repeats of the same bytes: within a watermark on streams, for good on batches."""
    if arrivals.isStreaming:
        return arrivals.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])
    first = F.row_number().over(Window.partitionBy(key).orderBy(ts))
    return arrivals.withColumn("n", first).where("n = 1").drop("n")
