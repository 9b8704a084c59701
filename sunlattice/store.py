"""Intermediate and materialised tables in shared folders."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_swept: set[str] = set()


def hadoop(spark: SparkSession, where: str):
    """(FileSystem, Path) of a location in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(where)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, a temporary folder on a local master; on a cluster that is an error, as executors don't see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="sunlattice-"))


def place(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of folder(), which is deleted when the application ends."""
    root = f"{folder(spark)}/sunlattice/{spark.sparkContext.applicationId}"
    if root not in _swept:
        fs, at = hadoop(spark, root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _swept.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str = "cut", *used_up: DataFrame) -> DataFrame:
    """df written once and read again: loops keep short plans, and a lost executor loses no round. used_up: tables of earlier cuts that df
    was made of and that nothing reads any more; they are deleted."""
    spark = df.sparkSession
    to = place(spark, name)
    df.write.option("compression", "zstd").parquet(to)
    out = spark.read.schema(df.schema).parquet(to)
    out._sunlattice_path = to
    for old in used_up:
        drop(old)
    return out


def drop(table: DataFrame) -> None:
    """Deletes the files of a table that cut() made."""
    at = getattr(table, "_sunlattice_path", None)
    if at:
        fs, path = hadoop(table.sparkSession, at)
        fs.delete(path, True)


def replace(spark: SparkSession, where: str, data: bytes) -> None:
    """Writes a small file as a whole: a reader sees the old one or the new one, never none or a part. The store's rename must be atomic."""
    fs, final = hadoop(spark, where)
    temp = spark._jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{final.getName()}-{uuid.uuid4().hex[:12]}")
    out = fs.create(temp, False)
    out.write(bytearray(data))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()) if final.toUri().getScheme() else spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(temp, final, options)


def exists(spark: SparkSession, where: str) -> bool:
    fs, at = hadoop(spark, where)
    return fs.exists(at)


def read_text(spark: SparkSession, where: str) -> str:
    """A small file."""
    fs, at = hadoop(spark, where)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class HorizonStore:
    """Horizons by tile and direction, which don't depend on a date: written once, found again by later runs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self) -> bool:
        fs, at = hadoop(self.spark, self.root)
        return fs.exists(at)

    def have(self) -> DataFrame:
        """(tile, direction) of what is there, from the files' paths: one row a file, and no file is opened."""
        none = self.spark.createDataFrame([], "tile string, direction double")
        if not self._exists():
            return none
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.root).select("path")
        part = lambda k: F.url_decode(F.regexp_extract("path", f"/{k}=([^/]+)/", 1))
        # a path is escaped once for the folder's name and once more as an URI
        return listed.select(F.url_decode(part("tile")).alias("tile"), part("direction").cast("double").alias("direction")).distinct()

    def put(self, horizons: DataFrame) -> None:
        """Replaces the tiles and directions that are in horizons (tile, direction, ...), and no others; trying again gives the same."""
        horizons.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile", "direction").parquet(self.root)

    def read(self, wanted: DataFrame, schema: str) -> DataFrame:
        """The horizons of wanted (tile, direction)."""
        return self.spark.read.schema(schema).parquet(self.root).join(wanted, ["tile", "direction"], "left_semi")

    def problems(self, pixels: DataFrame, radius_m: float) -> DataFrame:
        """(tile, direction, problem) of what is there and can't be used: 'rows' if it doesn't hold each pixel with a height (tile, row, col, z) once, or can't be read; 'range' if a value
        can't be what the operator gives. Reads everything once; rows are summed up before they are shuffled."""
        if not self._exists():
            return self.spark.createDataFrame([], "tile string, direction double, problem string")
        key = F.xxhash64(F.col("row").cast("long"), F.col("col").cast("long"))
        marks = lambda n: (F.count(F.lit(1)).alias(f"{n}_rows"), F.bit_xor(key).alias(f"{n}_xor"), F.sum(F.pmod(key, F.lit(1 << 31))).alias(f"{n}_sum"))
        want = pixels.where(F.col("z").isNotNull()).groupBy("tile").agg(*marks("want"))
        found = self.spark.read.option("ignoreCorruptFiles", "true").schema("row long, col long, horizon float, support smallint, blocker float, tile string, direction double").parquet(self.root)
        good = F.col("horizon").between(0, 90) & F.col("support").isin(0, 1) & F.col("blocker").between(0, radius_m)
        each = found.groupBy("tile", "direction").agg(*marks("own"), F.count_if(~F.coalesce(good, F.lit(False))).alias("bad"))
        both = self.have().join(each, ["tile", "direction"], "left").join(want, "tile", "left")
        whole = F.coalesce((F.col("own_rows") == F.col("want_rows")) & (F.col("own_xor") == F.col("want_xor")) & (F.col("own_sum") == F.col("want_sum")), F.lit(False))
        return both.select("tile", "direction", F.when(~whole, "rows").when(F.col("bad") > 0, "range").alias("problem")).where("problem is not null")
