"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import store

folder, hadoop, drop = store.folder, store.hadoop, store.drop

#: Rows and bytes of a batch between Spark and Python. A batch is held on both sides at once, and texts make rows large.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches to BATCH_ROWS and BATCH_BYTES, where they are higher. They stay so: the plans made here run later."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def path(spark: SparkSession, name: str) -> str:
    return store.place(spark, name)


def table(df: DataFrame, name: str, *used_up: DataFrame) -> DataFrame:
    """Writes df once and reads it back: cuts lineage, and a lost executor costs no recomputation. used_up: earlier tables that nothing reads any more, deleted."""
    return store.cut(df, name, *used_up)
