"""Exact quantiles without a sort in one task: counts in ranges of values first, then only the ranges that hold a wanted rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges a round splits into; values of the last round's ranges that are collected.
RANGES, FEW = 4096, 10_000


def _rank(df: DataFrame, value: str, lo: float, hi: float, n: int, rank: int) -> float:
    """The value of a rank (from 0) among the n values of df, which are from lo to hi."""
    while n > FEW and lo < hi:
        width = (hi - lo) / RANGES
        if lo + width == lo or width == 0:  # ranges as narrow as the numbers themselves: equal values only, counted as they are
            break
        part = F.least(F.floor((F.col(value) - lo) / width), F.lit(RANGES - 1)).cast("int")
        counts = sorted(tuple(r) for r in df.groupBy(part.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect())
        for b, size, least, most in counts:
            if rank < size:
                df, n, lo, hi = df.where(part == b), size, least, most
                break
            rank -= size
    if lo == hi:
        return lo
    for v, size in sorted(tuple(r) for r in df.groupBy(value).agg(F.count(F.lit(1))).collect()):
        if rank < size:
            return v
        rank -= size
    raise ValueError("no such rank")


def exact(df: DataFrame, value: str, wanted: dict[str, float]) -> DataFrame:
    """One row: the quantiles (name: share) of a column's values that aren't null, between neighbours by linear interpolation; null without values.

    Each round is an aggregate to at most RANGES rows; one range is then looked at more closely, until it holds few values."""
    spark = df.sparkSession
    v = df.select(F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    n, lo, hi = v.agg(F.count(F.lit(1)), F.min(value), F.max(value)).first()
    out: dict[str, float | None] = {}
    for name, q in wanted.items():
        if not n:
            out[name] = None
            continue
        at = q * (n - 1)
        below = int(at)
        a = _rank(v, value, lo, hi, n, below)
        b = _rank(v, value, lo, hi, n, below + 1) if at > below else a
        out[name] = a + (b - a) * (at - below)
    return spark.createDataFrame([tuple(out.values())], ", ".join(f"{k} double" for k in out))
