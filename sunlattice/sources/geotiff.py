"""GeoTIFF, as much of it as single-band north-up grids need: classic TIFF, one band of uint8, int16, float32 or float64, strips or tiles,
no compression or DEFLATE, predictor 1 or 2 (integers). Files are read by Spark's binaryFile source, so from any store, and decoded in Arrow batches."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store

# Tag numbers, and bytes and struct codes of value types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
GEO_KEYS, PROJECTED = 34735, 3072
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
KINDS = {(1, 8): "u1", (1, 16): "u2", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


class Unsupported(ValueError):
    """A TIFF that isn't of the kind this module reads; nothing is guessed."""


@dataclass
class Raster:
    width: int
    height: int
    left: float
    top: float
    resolution: float
    nodata: float | None
    epsg: int | None = None
    data: np.ndarray | None = None

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.left, self.top - self.height * self.resolution, self.left + self.width * self.resolution, self.top


def _tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise Unsupported("not a classic TIFF")
    (at,) = struct.unpack_from(order + "I", raw, 4)
    (n,) = struct.unpack_from(order + "H", raw, at)
    out: dict[int, tuple] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
        code = TYPES.get(kind)
        if code is None:
            continue
        form = f"{order}{count}{code}"
        where = at + 10 + 12 * i
        if struct.calcsize(form) > 4:
            (where,) = struct.unpack_from(order + "I", raw, where)
        out[tag] = struct.unpack_from(form, raw, where)
    return order, out


def _epsg(tags: dict[int, tuple]) -> int | None:
    """The code of the projected coordinate system, of the directory of keys: a header of four numbers, then four for each key."""
    keys = tags.get(GEO_KEYS, ())
    return next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] == PROJECTED and keys[i + 1] == 0), None)


def decode(raw: bytes, pixels: bool = True) -> Raster:
    order, tags = _tags(raw)
    one = lambda tag, default: tags[tag][0] if tag in tags else default
    kind = KINDS.get((one(SAMPLE_FORMAT, 1), one(BITS, 1)))
    if kind is None or one(SAMPLES, 1) != 1:
        raise Unsupported("one band of 8 to 64 bits is read")
    if one(COMPRESSION, 1) not in (1, 8, 32946) or one(PREDICTOR, 1) not in (1, 2) or (one(PREDICTOR, 1) == 2 and kind[0] == "f"):
        raise Unsupported("compression or predictor")
    if PIXEL_SCALE not in tags or TIE_POINT not in tags or tags[PIXEL_SCALE][0] != tags[PIXEL_SCALE][1]:
        raise Unsupported("a grid of squares, north up, is read")
    size, tie = tags[PIXEL_SCALE][0], tags[TIE_POINT]
    text = b"".join(tags[NODATA]).split(b"\0")[0].strip() if NODATA in tags else b""
    out = Raster(one(WIDTH, 0), one(HEIGHT, 0), tie[3] - tie[0] * size, tie[4] + tie[1] * size, size, float(text) if text else None, _epsg(tags))
    if not pixels:
        return out
    tiled = TILE_WIDTH in tags
    bw, bh = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (out.width, min(one(ROWS_PER_STRIP, out.height), out.height))
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    across = -(-out.width // bw)
    out.data = np.zeros((out.height, out.width), kind)
    for i, (at, n) in enumerate(zip(offsets, sizes, strict=True)):
        y, x = i // across * bh, i % across * bw
        rows, cols = min(bh, out.height - y), min(bw, out.width - x)
        block = raw[at : at + n] if one(COMPRESSION, 1) == 1 else zlib.decompress(raw[at : at + n])
        stored = bh if tiled else rows
        if len(block) < stored * bw * out.data.itemsize:
            raise Unsupported("a block is cut off")
        values = np.frombuffer(block, np.dtype(order + kind), stored * bw).reshape(stored, bw)
        if one(PREDICTOR, 1) == 2:
            values = np.cumsum(values, axis=1, dtype=values.dtype)
        out.data[y : y + rows, x : x + cols] = values[:rows, :cols]
    return out


def encode(data: np.ndarray, left: float, top: float, resolution: float, nodata: float | None = None, tile: int = 256, epsg: int | None = None) -> bytes:
    """A tiled DEFLATE file; little-endian."""
    kind = data.dtype.newbyteorder("<")
    form, bits = next((f, b) for (f, b), k in KINDS.items() if np.dtype(k) == data.dtype)
    height, width = data.shape
    blocks = []
    for y in range(0, height, tile):
        for x in range(0, width, tile):
            part = np.full((tile, tile), 0 if nodata is None else nodata, data.dtype)
            piece = data[y : y + tile, x : x + tile]
            part[: piece.shape[0], : piece.shape[1]] = piece
            blocks.append(zlib.compress(part.astype(kind).tobytes(), 6))
    entries = [(WIDTH, "I", (width,)), (HEIGHT, "I", (height,)), (BITS, "H", (bits,)), (COMPRESSION, "H", (8,)), (SAMPLES, "H", (1,)), (TILE_WIDTH, "I", (tile,)), (TILE_HEIGHT, "I", (tile,)),
               (TILE_OFFSETS, "I", (0,) * len(blocks)), (TILE_BYTES, "I", tuple(map(len, blocks))), (SAMPLE_FORMAT, "H", (form,)), (PIXEL_SCALE, "d", (resolution, resolution, 0.0)), (TIE_POINT, "d", (0.0, 0.0, 0.0, left, top, 0.0))]
    if epsg is not None:
        entries.append((GEO_KEYS, "H", (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, PROJECTED, 0, 1, epsg)))
    if nodata is not None:
        entries.append((NODATA, "s", (f"{nodata:g}".encode() + b"\0",)))
    number = {"H": 3, "I": 4, "d": 12, "s": 2}
    pack = lambda code, v: v[0] if code == "s" else struct.pack(f"<{len(v)}{code}", *v)
    extra = 8 + 2 + 12 * len(entries) + 4
    places, at = {}, extra
    for tag, code, v in entries:
        if len(pack(code, v)) > 4:
            places[tag] = at
            at += len(pack(code, v))
    offsets = []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    entries = [(t, c, tuple(offsets) if t == TILE_OFFSETS else v) for t, c, v in entries]
    head, tail = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(entries)), b""
    for tag, code, v in entries:
        raw = pack(code, v)
        count = len(raw) if code == "s" else len(v)
        head += struct.pack("<HHI", tag, number[code], count) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", places[tag]))
        tail += raw if len(raw) > 4 else b""
    return head + struct.pack("<I", 0) + tail + b"".join(blocks)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, modified) of GeoTIFFs under a folder, without their contents."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", "true").load(path)
    return listed.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def inventory(spark: SparkSession, path: str, some: DataFrame | None = None) -> DataFrame:
    """(name, sha256, bytes, width, height, left, bottom, right, top, resolution, nodata, epsg, problem, path, modified) of each file, or of some (path); problem is null for one that can be read."""
    schema = "name string, sha256 string, bytes long, width int, height int, left double, bottom double, right double, top double, resolution double, nodata double, epsg int, problem string, path string, modified timestamp"
    names = [f.split()[0] for f in schema.split(", ")]

    def rows(batches):
        for batch in batches:
            out = []
            for name, raw, *rest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = raw.as_py()
                base = [name, hashlib.sha256(raw).hexdigest(), len(raw)]
                try:
                    r = decode(raw, pixels=False)
                    out.append([*base, r.width, r.height, *r.bounds, r.resolution, r.nodata, r.epsg, None, *rest])
                except (Unsupported, struct.error) as e:
                    out.append([*base, *[None] * 9, str(e), *rest])
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=_arrow(schema))

    return _contents(spark, path, some, "path").mapInArrow(rows, schema)


def pixels(spark: SparkSession, path: str, some: DataFrame | None = None) -> DataFrame:
    """(tile, row, col, z float): every pixel at its canonical address; declared no-data and NaN are null. some (name): the files that are read."""

    def rows(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                r = decode(raw.as_py())
                row0, col0 = round(-r.top / r.resolution), round(r.left / r.resolution)
                z = r.data.astype(np.float32)
                missing = np.isnan(z) | (False if r.nodata is None else r.data == r.nodata)
                row, col = np.divmod(np.arange(z.size), r.width)
                whole = pa.RecordBatch.from_arrays([pa.array([name] * z.size, pa.string()), pa.array(row + row0), pa.array(col + col0), pa.array(z.ravel(), mask=missing.ravel())], ["tile", "row", "col", "z"])
                for at in range(0, z.size, 65_536):
                    yield whole.slice(at, 65_536)

    return _contents(spark, path, some, "name").mapInArrow(rows, "tile string, row long, col long, z float")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, modified) of GeoTIFFs under a folder."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", "true").load(path)
    return listed.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def _contents(spark: SparkSession, path: str, some: DataFrame | None = None, by: str = "path") -> DataFrame:
    """(name, content, path, modified). A chosen few are listed first and only they are opened."""
    if some is not None:
        listed = listing(spark, path).withColumn("name", F.element_at(F.split("path", "/"), -1))
        chosen = [r["path"] for r in listed.join(some.select(by), by, "left_semi").select("path").collect()]
        if not chosen:
            return spark.createDataFrame([], "name string, content binary, path string, modified timestamp")
        read = spark.read.format("binaryFile").load(chosen)
    else:
        read = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", "true").load(path)
    return read.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", "path", F.col("modificationTime").alias("modified"))


def export(files: DataFrame, folder: str) -> int:
    """Writes files (tile, content) as folder/tile.tif in any store, one after the other through the driver, which holds one at a time; each under a hidden name first.
    Returns how many there are."""
    spark, n = files.sparkSession, 0
    fs, at = store.hadoop(spark, folder)
    fs.mkdirs(at)
    for r in files.toLocalIterator():
        store.replace(spark, f"{folder}/{r['tile']}.tif", bytes(r["content"]))
        n += 1
    return n


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "timestamp": pa.timestamp("us", "UTC")}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def encoded(layer: DataFrame, value: str, kind: str = "u1", nodata: float = 255, resolution: float = 0.5, epsg: int | None = None) -> DataFrame:
    """(tile, content): each tile's layer (tile, row, col, value) as a GeoTIFF; addresses without a value have nodata. A group is one tile."""

    def tile(pdf):
        import pandas as pd

        top, left = int(pdf["row"].min()), int(pdf["col"].min())
        grid = np.full((int(pdf["row"].max()) - top + 1, int(pdf["col"].max()) - left + 1), nodata, kind)
        have = pdf[value].notna()
        grid[pdf.loc[have, "row"] - top, pdf.loc[have, "col"] - left] = pdf.loc[have, value]
        return pd.DataFrame({"tile": [pdf["tile"].iloc[0]], "content": [encode(grid, left * resolution, -top * resolution, resolution, nodata, epsg=epsg)]})

    return layer.select("tile", "row", "col", value).groupBy("tile").applyInPandas(tile, "tile string, content binary")
