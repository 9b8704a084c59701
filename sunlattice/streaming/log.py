"""The event log of a batch as a stream: counts of states and stalled tasks, with late events bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """An append-only folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def state_counts(events: DataFrame, at: str = "at", state: str = "state", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, end, state, n) for each window, once it is past the watermark; events that are later still are left out."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, window), state).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", state, "n")


def sessions(events: DataFrame, by: str, at: str = "at", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(by, start, end, n): runs of events that are no farther apart than gap."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("n")).select(by, "session_window.start", "session_window.end", "n")


def once(events: DataFrame, key: str, at: str = "at", late: str = "1 hour") -> DataFrame:
    """Events without those that a writer sent again within the watermark."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])
