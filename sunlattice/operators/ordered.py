"""Ordered operators: crossings, interval merging, attempts, nearest in time, top k, samples, groups of dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def crossings(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows after which the value's sign changes strictly; with next_<order> and next_<value>."""
    w = Window.partitionBy(*by).orderBy(order)
    nxt = df.withColumns({f"next_{order}": F.lead(order).over(w), f"next_{value}": F.lead(value).over(w)})
    return nxt.where(F.col(value) * F.col(f"next_{value}") < 0)


def merge_intervals(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by, start, end): the union of half-open intervals; those that meet are one."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    run = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return run.groupBy(*by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def covered_length(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    return merge_intervals(df, by, start, end).groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))


def attempts(events: DataFrame, task: str, started: str, tie: str, most: int) -> DataFrame:
    """events with attempt, numbered from 1 for each task, and allowed: attempt <= most."""
    w = Window.partitionBy(task).orderBy(started, tie)
    return events.withColumn("attempt", F.row_number().over(w)).withColumn("allowed", F.col("attempt") <= most)


def first_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def stratified_sample(df: DataFrame, strata: list[str], key: list[str], k: int, seed: int) -> DataFrame:
    """k rows of each stratum, chosen by a hash of seed and key: the same rows whatever the partitions."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    return first_k(df.withColumn("_h", h), strata, ["_h", *key], k).drop("_h")


def nearest_time(df: DataFrame, by: list[str], seconds: str, wanted: int, tie: str) -> DataFrame:
    """(by, seconds, tie): each group's row nearest to a second of the day; the least on ties. One aggregate, no sort."""
    best = F.min(F.struct(F.abs(F.col(seconds) - wanted).alias("d"), F.col(tie).alias("tie"), F.col(seconds).alias("s")))
    return df.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.s").alias(seconds), F.col("b.tie").alias(tie))


def steps(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """df with the rows before and after in order."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({"previous": F.lag(order).over(w), "following": F.lead(order).over(w)})


def prefix_max(df: DataFrame, by: list[str], order: str, value: str, rows: int) -> DataFrame:
    """df with highest_before: the largest value of so many rows before each."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-rows, -1)
    return df.withColumn("highest_before", F.max(value).over(w))


def numbered(df: DataFrame, rows: str, columns: str, width: int) -> DataFrame:
    """df with number: its place in row-major order of a whole lattice; arithmetic, so no global sort."""
    return df.withColumn("number", F.col(rows) * width + F.col(columns))


def date_groups(sizes: list[tuple[str, int]], most: int = 512) -> list[list[str]]:
    """Whole dates in order, packed into groups of at most so many frames; a date that is larger alone is an error. Few rows, on the driver."""
    out: list[list[str]] = []
    used = 0
    for day, n in sizes:
        if n > most:
            raise ValueError(f"{day} has {n} frames; a group holds {most}: use a larger interval")
        if not out or used + n > most:
            out.append([])
            used = 0
        out[-1].append(day)
        used += n
    return out


def within_daylight(instants: DataFrame, bounds: DataFrame, seconds: str = "t") -> DataFrame:
    """instants (day, t) joined to their day's sunrise and sunset, with kept and, where dropped, reason."""
    both = instants.join(bounds, "day", "left")
    kept = F.coalesce(F.col(seconds).between(F.col("sunrise"), F.col("sunset")), F.lit(False))
    return both.withColumn("kept", kept).withColumn("reason", F.when(~F.col("kept"), "outside daylight"))
