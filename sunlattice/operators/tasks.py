"""The task graph of a batch as tables: states, readiness, invalidation, set comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store
from . import quantiles

STATES = ("queued", "running", "succeeded", "failed", "cancelled")
#: Which state may follow which.
MOVES = {"queued": ("running", "cancelled"), "running": ("succeeded", "failed", "queued", "cancelled"), "failed": ("queued",), "succeeded": ("queued",), "cancelled": ("queued",)}


def states(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def ready(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Queued tasks without an unfinished dependency. edges: task, needs."""
    open_ = edges.join(tasks.select(F.col("task").alias("needs"), F.col("state").alias("s")), "needs", "left").where(F.coalesce(F.col("s") != "succeeded", F.lit(True))).select("task")
    return tasks.where("state = 'queued'").join(open_, "task", "left_anti")


def illegal_moves(log: DataFrame) -> DataFrame:
    """Rows of an event log (task, at, state) whose state may not follow the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("task").orderBy("at", "event_id")
    allowed = F.lit(False)
    for a, after in MOVES.items():
        allowed = allowed | ((F.col("was") == a) & F.col("state").isin(*after))
    return log.withColumn("was", F.lag("state").over(w)).where(F.col("was").isNotNull() & ~allowed)


def invalidated(edges: DataFrame, invalid: DataFrame) -> DataFrame:
    """(task): invalid tasks and all that need them, directly or not. A round for each step of the graph's depth, until no task is new."""
    found = store.cut(invalid.select("task").distinct())
    front = found
    while True:
        front = store.cut(edges.join(front.select(F.col("task").alias("needs")), "needs", "left_semi").select("task").distinct().join(found, "task", "left_anti"))
        if front.isEmpty():
            return found
        found = store.cut(found.union(front), "cut", found)


def missing_and_extra(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, side): 'missing' if only expected, 'extra' if only there."""
    e, a = expected.select(key).distinct().withColumn("_e", F.lit(1)), actual.select(key).distinct().withColumn("_a", F.lit(1))
    return e.join(a, key, "full").where(F.col("_e").isNull() | F.col("_a").isNull()).select(key, F.when(F.col("_a").isNull(), "missing").otherwise("extra").alias("side"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, as often: what is read back against what was to be written."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def cost(units: DataFrame, coefficients: dict[str, float], efficiency: float) -> DataFrame:
    """One row: seconds of each phase and in all, of (horizons, frames, hits) of tasks, under a machine's coefficients."""
    total = units.agg(F.sum("horizons").alias("h"), F.sum("frames").alias("f"), F.sum("hits").alias("k"))
    parts = {"horizon_s": F.col("h") * coefficients["horizon"] / efficiency, "frame_s": F.col("f") * coefficients["frame"] / efficiency, "hit_s": F.col("k") * coefficients["hit"] / efficiency}
    return total.select(*[c.alias(n) for n, c in parts.items()]).withColumn("total_s", F.col("horizon_s") + F.col("frame_s") + F.col("hit_s"))


def percentage_errors(runs: DataFrame, predicted: str, observed: str) -> DataFrame:
    """One row: median and largest absolute error in percent."""
    e = runs.select((100 * F.abs(F.col(predicted) - F.col(observed)) / F.nullif(F.col(observed), F.lit(0))).cast("double").alias("e"))
    return quantiles.exact(e, "e", {"median_pct": 0.5}).join(e.agg(F.max("e").alias("max_pct")))
