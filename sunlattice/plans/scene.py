"""A height scene derived from order tables, which hold no rasters: pixels, tiles, frames, sites, tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 64
TILE = 16
LATITUDE, LONGITUDE = 22.3, 114.2


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, z float, tile): z is null where a rule says so, and addresses without an order line are absent."""
    x = read(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % SIDE).alias("row"), (F.col("l_partkey") % SIDE).alias("col")).agg(F.sum("l_quantity").alias("q"), F.sum("l_linenumber").cast("long").alias("n"))
    z = F.when(F.col("n") % 11 != 0, ((F.col("q").cast("long") % 97) / 4.0).cast("float"))
    return x.select("row", "col", z.alias("z"), tile_name(F.col("row"), F.col("col")).alias("tile"))


def tile_name(row, col):
    return F.concat(F.lit("t"), F.floor(row / TILE).cast("string"), F.lit("_"), F.floor(col / TILE).cast("string"))


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, z, tile, supplied): every address; about two in five missing, low heights along with high ones, and no tile supplied in the last column of tiles."""
    x = read(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % SIDE).alias("row"), (F.col("l_partkey") % SIDE).alias("col")).agg(F.sum("l_quantity").alias("q"), F.sum("l_linenumber").cast("long").alias("n"))
    z = F.when(F.col("n") % 5 >= 2, ((F.col("q").cast("long") % 23) / 4.0).cast("float"))
    grid = spark.range(SIDE * SIDE).select(F.floor(F.col("id") / SIDE).alias("row"), (F.col("id") % SIDE).alias("col"))
    return grid.join(x.select("row", "col", z.alias("z")), ["row", "col"], "left").select("row", "col", "z", tile_name(F.col("row"), F.col("col")).alias("tile"), (F.col("col") < SIDE - TILE).alias("supplied"))


def tiles(spark: SparkSession) -> DataFrame:
    """(tile, ty, tx, left, bottom, right, top, latitude, longitude): 4 x 4 tiles of 8 m without the last one."""
    n = SIDE // TILE
    x = spark.range(n * n - 1).select(F.floor(F.col("id") / n).cast("long").alias("ty"), (F.col("id") % n).alias("tx"))
    size = TILE * 0.5
    return x.select(
        F.concat(F.lit("t"), F.col("ty").cast("string"), F.lit("_"), F.col("tx").cast("string")).alias("tile"), "ty", "tx",
        (F.col("tx") * size).alias("left"), (-(F.col("ty") + 1) * size).alias("bottom"), ((F.col("tx") + 1) * size).alias("right"), (-F.col("ty") * size).alias("top"),
        (LATITUDE - F.col("ty") * 0.25).alias("latitude"), (LONGITUDE + F.col("tx") * 0.25).alias("longitude"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, utc): the distinct hours of all events, numbered in order."""
    from pyspark.sql import Window

    hours = read(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("utc")).where("utc is not null").distinct()
    return hours.withColumn("frame", F.row_number().over(Window.orderBy("utc")).cast("int"))


def tasks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tasks (task, state) and edges (task, needs) of orders: an order's state by its key, and it needs the order of half its key."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"))
    k = F.col("task") % 7
    state = F.when(k < 3, "succeeded").when(k < 5, "queued").when(k == 5, "running").otherwise("failed")
    return o.withColumn("state", state), o.where("task > 1").select("task", F.floor(F.col("task") / 2).cast("long").alias("needs"))
