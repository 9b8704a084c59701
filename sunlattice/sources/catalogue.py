"""Catalogues of height tiles: what a folder of GeoTIFFs holds, whether it may be used, who covers a request, and views over it.

A catalogue is a table with a row for each file. Files are opened once: refresh() decodes only those that are new or changed."""

from __future__ import annotations

import json
import xml.sax.saxutils as xml
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions import lattice
from ..operators import fill, tiles
from . import geotiff

NATIVE = -9999.0
COLUMNS = ("name", "sha256", "bytes", "width", "height", "left", "bottom", "right", "top", "resolution", "nodata", "epsg", "problem")


class Refused(ValueError):
    """A catalogue or a request that doesn't keep to the rules; nothing is computed from it."""


class Stale(RuntimeError):
    """A view whose source has changed since it was built."""


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, stem, bytes, modified) of every file that isn't hidden, without contents."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return listed.select("path", name.alias("name"), F.regexp_replace(name, r"\..*$", "").alias("stem"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).where(~name.startswith("."))


def auxiliary(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, files): beside each GeoTIFF the other files of its name, in order; results depend on them too."""
    own = listing(spark, folder)
    tif = own.where(F.lower("name").rlike(r"\.tiff?$")).select("stem").distinct()
    return own.where(~F.lower("name").rlike(r"\.tiff?$")).join(tif, "stem", "left_semi").groupBy("stem").agg(F.sort_array(F.collect_list(F.struct("name", "bytes"))).alias("files"))


def refresh(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The folder's catalogue, kept as Parquet under table: only files whose size or time of change is new are opened; those that are gone are left out."""
    now = geotiff.listing(spark, folder)
    fs, at = store.hadoop(spark, table)
    if fs.exists(at):
        known = spark.read.parquet(table).join(now, ["path", "bytes", "modified"], "left_semi")
        new = geotiff.inventory(spark, folder, now.join(known, ["path", "bytes", "modified"], "left_anti"))
        whole = store.cut(known.unionByName(new), "catalogue")
    else:
        whole = store.cut(geotiff.inventory(spark, folder), "catalogue")
    whole.write.mode("overwrite").parquet(table)
    return spark.read.parquet(table)


def problems(catalogue: DataFrame, epsg: int | None = None, resolution: float = lattice.RESOLUTION, most_pixels: int = 400_000_000, size: float = 1000.0) -> DataFrame:
    """(name, problem): files that can't be read, of another coordinate system or pixel size, too large, off the lattice, or that overlap another file."""
    off = lambda c: F.abs(F.col(c) / resolution - F.rint(F.col(c) / resolution)) > 1e-6
    # null where a value isn't known, so that each is asked with a default
    why = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("resolution") != resolution, "resolution").when(F.col("width").cast("long") * F.col("height") > most_pixels, "size").when(off("left") | off("top"), "lattice")
    if epsg is not None:
        why = F.when(F.col("problem").isNull() & ~F.col("epsg").eqNullSafe(F.lit(epsg)), "crs").otherwise(why)
    single = catalogue.select("name", why.alias("problem")).where(F.col("problem").isNotNull())
    boxes = catalogue.where(F.col("problem").isNull()).select(F.col("name").alias("tile"), *tiles.SIDES)
    pairs = tiles.overlaps(boxes, size)
    both = pairs.select(F.explode(F.array("tile", "b_tile")).alias("name")).distinct()
    return single.unionByName(both.withColumn("problem", F.lit("overlap")))


def admitted(catalogue: DataFrame, **rules) -> DataFrame:
    """The catalogue, if it has no problem; else Refused, with the first of them."""
    bad = problems(catalogue, **rules).orderBy("name", "problem").limit(20).collect()
    if bad:
        raise Refused("; ".join(f"{r['name']}: {r['problem']}" for r in bad))
    return catalogue


def identity(catalogue: DataFrame, namespace: str = "") -> str:
    """A hash of what the files hold, wherever they lie and in whatever order: of each file its pixels' hash and place, sorted, folded in blocks."""
    each = F.sha2(F.concat_ws("|", "sha256", "width", "height", *[F.format_string("%.6f", F.col(c)) for c in ("left", "top", "resolution")], F.coalesce(F.col("nodata").cast("string"), F.lit(""))), 256)
    # lists are bounded by the hash's first two digits: 256 of them, each folded on its own
    part = catalogue.select(each.alias("h")).groupBy(F.substring("h", 1, 2).alias("k")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("h"))
    return part.agg(F.sha2(F.concat(F.lit(namespace), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ",")), 256)).first()[0]


def cells(catalogue: DataFrame, width: float, height: float, margin: float = 1000.0) -> DataFrame:
    """(name, cx, cy, shifted, ...): each tile's cell by its lower left corner, shifted where that is no corner of the lattice of cells; and the domain, the
    territory widened by margin, as one rectangle of every row."""
    all_ = [F.min("left").alias("d_left"), F.min("bottom").alias("d_bottom"), F.max("right").alias("d_right"), F.max("top").alias("d_top")]
    domain = catalogue.agg(*all_).select((F.col("d_left") - margin).alias("d_left"), (F.col("d_bottom") - margin).alias("d_bottom"), (F.col("d_right") + margin).alias("d_right"), (F.col("d_top") + margin).alias("d_top"))
    on = lambda c, s: F.abs(F.col(c) / s - F.rint(F.col(c) / s)) < 1e-9
    keyed = catalogue.withColumns({"cx": lattice.bin_of("left", width), "cy": lattice.bin_of("bottom", height), "shifted": ~(on("left", width) & on("bottom", height))})
    return keyed.join(domain)


def missing_cells(catalogue: DataFrame, width: float, height: float) -> DataFrame:
    """(cx, cy): cells inside the territory's rectangle that no tile has; a filled view gets made tiles there."""
    have = catalogue.select(lattice.bin_of("left", width).alias("cx"), lattice.bin_of("bottom", height).alias("cy")).distinct()
    ends = have.agg(*[f(c).alias(f"{n}_{c}") for c in ("cx", "cy") for n, f in (("min", F.min), ("max", F.max))])
    grid = ends.select(F.explode(F.sequence("min_cx", "max_cx")).alias("cx"), "min_cy", "max_cy").select("cx", F.explode(F.sequence("min_cy", "max_cy")).alias("cy"))
    return grid.join(have, ["cx", "cy"], "left_anti")


def covering(catalogue: DataFrame, rectangle: tuple[float, float, float, float], buffer: float, shifted: DataFrame | None = None) -> DataFrame:
    """Tiles within buffer of a request. One that stands in `shifted` (name) refuses the request."""
    own = catalogue.where(F.col("problem").isNull())
    near = tiles.touching(own, rectangle, buffer)
    if shifted is not None and (bad := near.join(shifted.select("name"), "name", "left_semi").orderBy("name").limit(5).collect()):
        raise Refused("off the lattice of cells: " + ", ".join(r["name"] for r in bad))
    return near


def resolve_city(corners: list[tuple[float, float]], cities: DataFrame) -> str:
    """The one city (city, left, bottom, right, top, in degrees) whose extent holds all corners (latitude, longitude). Refused if none or several do."""
    inside = F.lit(True)
    for lat, lon in corners:
        inside = inside & lattice.within_closed(tuple(F.col(s) for s in tiles.SIDES), F.lit(lon), F.lit(lat))
    found = [r["city"] for r in cities.where(inside).orderBy("city").limit(3).collect()]
    if len(found) != 1:
        raise Refused(f"{len(found) or 'no'} city holds the rectangle{': ' + ', '.join(found) if found else ''}")
    return found[0]


def needed_batches(batches: DataFrame, rectangle: tuple[float, float, float, float]) -> DataFrame:
    """The batches (tile, left, bottom, right, top) that a rectangle needs."""
    return tiles.touching(batches, rectangle)


def batch_window(batches: DataFrame, layers: DataFrame, rectangle: tuple[float, float, float, float], keys: list[str], values: list[str]) -> DataFrame:
    """layers (tile, row, col, keys, values) of the batches that a rectangle needs, as one. Refused if a batch isn't there at all or two give a pixel different values."""
    need = store.cut(needed_batches(batches, rectangle).select("tile"), "need")
    left, bottom, right, top = rectangle
    x, y = (F.col("col") + 0.5) * lattice.RESOLUTION, -(F.col("row") + 0.5) * lattice.RESOLUTION
    own = layers.join(need, "tile", "left_semi")
    if gone := [r["tile"] for r in need.join(own.select("tile").distinct(), "tile", "left_anti").orderBy("tile").limit(5).collect()]:
        raise Refused(f"batches {gone} aren't there")
    whole = store.cut(tiles.mosaic(own.where(x.between(left, right) & y.between(bottom, top)), ["row", "col", *keys], values), "window")
    if not whole.where("conflict").isEmpty():
        raise Refused("batches contradict each other")
    return whole.drop("conflict")


def views_of(index: DataFrame, views: DataFrame, text: str = "index") -> DataFrame:
    """(result, view): which views' tiles the JSON of each result names, at whatever depth. index: result, text; views: view (a folder's path)."""
    named = F.regexp_extract_all(F.col(text), F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    path = index.select("result", F.explode(named).alias("_p")).withColumn("view", F.regexp_extract("_p", r"^(.+)/tiles(?:/[^/]+)?$", 1))
    return path.join(views.select("view"), "view", "left_semi").select("result", "view").distinct()


def sheet_problems(expected: DataFrame, catalogue: DataFrame, **rules) -> DataFrame:
    """(name, problem) of a delivery: expected (name, bytes, sha256) against a catalogue: missing, extra, bytes, hash, and problems()."""
    e, a = expected.select("name", F.col("bytes").alias("e_bytes"), F.col("sha256").alias("e_sha256")), catalogue.select("name", "bytes", "sha256")
    both = e.join(a, "name", "full")
    why = F.when(F.col("bytes").isNull(), "missing").when(F.col("e_bytes").isNull(), "extra").when(F.col("bytes") != F.col("e_bytes"), "bytes").when(F.col("sha256") != F.col("e_sha256"), "hash")
    return both.select("name", why.alias("problem")).where(F.col("problem").isNotNull()).unionByName(problems(catalogue, **rules))


def ingest(spark: SparkSession, sheets: str, expected: DataFrame | None, root: str, cell_pixels: tuple[int, int], ingest_id: str, **rules) -> DataFrame:
    """Sheets to native cells: (cell, row, col, z), of each pixel the height of whichever sheet has one; written under root/ingest_id by cell and only
    then named in root/current.json. Refused if a sheet is missing, of another hash, or holds NATIVE as a height; sheets may not overlap."""
    found = store.cut(geotiff.inventory(spark, sheets), "sheets")
    bad = (problems(found, **rules) if expected is None else sheet_problems(expected, found, **rules)).orderBy("name").limit(20).collect()
    if bad:
        raise Refused("; ".join(f"{r['name']}: {r['problem']}" for r in bad))
    px = geotiff.pixels(spark, sheets)
    height, width = cell_pixels
    cell = F.concat_ws("_", F.floor(F.col("row") / height).cast("string"), F.floor(F.col("col") / width).cast("string"))
    to = f"{root.rstrip('/')}/{ingest_id}"
    px.select(cell.alias("cell"), "row", "col", F.when(F.col("z") == NATIVE, F.raise_error(F.lit("a sheet has the native no-data value as a height"))).otherwise(F.col("z")).alias("z")).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{to}/cells")
    store.replace(spark, f"{root.rstrip('/')}/current.json", json.dumps({"ingest_id": ingest_id, "identity": identity(found, "sheets")}, sort_keys=True).encode())
    return spark.read.schema("row long, col long, z float, cell string").parquet(f"{to}/cells")


@dataclass(frozen=True)
class RawSource:
    """Heights as the files have them."""

    spark: SparkSession
    folder: str
    epsg: int | None = None

    def catalogue(self) -> DataFrame:
        return geotiff.inventory(self.spark, self.folder).where(F.col("problem").isNull())

    def identity(self) -> str:
        return identity(self.catalogue(), "raw")

    def check(self) -> None:
        admitted(geotiff.inventory(self.spark, self.folder), epsg=self.epsg)

    def pixels(self, rectangle: tuple[float, float, float, float] | None = None, buffer: float = 0.0) -> DataFrame:
        """(tile, row, col, z) of the tiles within buffer of a rectangle; files of others aren't opened a second time."""
        near = None
        if rectangle is not None:
            near = covering(self.catalogue(), rectangle, buffer).select("name")
        return geotiff.pixels(self.spark, self.folder, near)

    def surface(self) -> DataFrame:
        """(row, col, surface) for reports: 0 where there is a height, 4 elsewhere."""
        return self.pixels().select("row", "col", F.when(F.col("z").isNull(), 4).otherwise(0).cast("smallint").alias("surface"))


@dataclass(frozen=True)
class FilledSource:
    """Heights of a view that build_view() made."""

    spark: SparkSession
    root: str
    raw: RawSource | None = None

    def manifest(self) -> dict:
        return json.loads(store.read_text(self.spark, f"{self.root}/current.json"))

    def identity(self) -> str:
        return self.manifest()["identity"]

    def check(self) -> None:
        if self.raw is not None and self.manifest()["source"] != self.raw.identity():
            raise Stale(f"{self.root} was built from other files")

    def _table(self) -> DataFrame:
        return self.spark.read.schema("row long, col long, z float, surface smallint, tile string").parquet(f"{self.root}/{self.manifest()['name']}")

    def pixels(self, rectangle: tuple[float, float, float, float] | None = None, buffer: float = 0.0) -> DataFrame:
        t = self._table().select("tile", "row", "col", "z")
        if rectangle is None:
            return t
        l, b, r, top = (v / lattice.RESOLUTION for v in (rectangle[0] - buffer, rectangle[1] - buffer, rectangle[2] + buffer, rectangle[3] + buffer))
        return t.where((F.col("col") + 1 > l) & (F.col("col") < r) & (F.col("row") + 1 > -top) & (F.col("row") < -b))

    def surface(self) -> DataFrame:
        return self._table().select("row", "col", "surface")

    def window(self, row0: int, col0: int, height: int, width: int) -> DataFrame:
        """(row, col, surface) of every address of a window: 255 outside of the view. The tiles that it reads must hold what the manifest says, or Stale is raised."""
        own = self._table().where(F.col("row").between(row0, row0 + height - 1) & F.col("col").between(col0, col0 + width - 1))
        met = [r["tile"] for r in own.select("tile").distinct().collect()]
        sums = {r["tile"]: r["sum"] for r in tile_sums(self._table().where(F.col("tile").isin(met))).collect()} if met else {}
        said = self.manifest()["tiles"]
        if changed := sorted(t for t in met if said.get(t) != sums.get(t)):
            raise Stale(f"tiles {changed[:5]} aren't what was built")
        return tiles.lattice_window(own.select("row", "col", "surface"), row0, col0, height, width, surface=255)


PROVIDERS = {"raw": RawSource, "filled": FilledSource}


def tile_sums(view: DataFrame) -> DataFrame:
    """(tile, sum): a checksum of each tile's rows in any order."""
    h = F.xxhash64("row", "col", F.coalesce(F.col("z"), F.lit(float("nan")).cast("float")), "surface")
    return view.groupBy("tile").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.bit_xor(h).cast("string"), F.sum(F.pmod(h, F.lit(1 << 31))).cast("string")).alias("sum"))


def build_view(spark: SparkSession, raw: RawSource, root: str, name: str, profile: fill.Profile, tile_pixels: tuple[int, int], side: int = 1024) -> dict:
    """The filled view of a source: each gap's surface and the sea's height on water, over all cells of the territory's rectangle, those without a tile too. Written
    under root/name, read back, its totals held against the domain's area, and only then named in root/current.json with the source's identity. Returns the manifest."""
    raw.check()
    px = store.cut(raw.pixels().select("row", "col", "z"), "view-heights")
    ends = px.agg(F.min("row"), F.min("col"), F.max("row"), F.max("col")).first()
    height, width = tile_pixels
    row0, col0 = ends[0] // height * height, ends[1] // width * width
    rows, cols = -(-(ends[2] + 1 - row0) // height) * height, -(-(ends[3] + 1 - col0) // width) * width
    tile = F.concat(F.lit("r"), F.floor(F.col("row") / height).cast("string"), F.lit("c"), F.floor(F.col("col") / width).cast("string"))
    grid = spark.range(rows * cols).select((F.floor(F.col("id") / cols) + row0).alias("row"), (F.col("id") % cols + col0).alias("col"))
    whole = store.cut(grid.join(px.withColumn("supplied", F.lit(True)), ["row", "col"], "left").select("row", "col", "z", F.coalesce("supplied", F.lit(False)).alias("supplied"), tile.alias("tile")), "view-domain")
    view = fill.filled(fill.surface(whole, profile, row0, col0, rows, cols, side=side), profile.sea_m).select("row", "col", "z", "surface", "tile")
    view.repartition("tile").write.mode("overwrite").partitionBy("tile").parquet(f"{root}/{name}")
    back = spark.read.schema("row long, col long, z float, surface smallint, tile string").parquet(f"{root}/{name}")
    totals = {str(r["surface"]): r["n"] for r in back.groupBy("surface").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(totals.values()) != rows * cols:
        raise RuntimeError(f"{sum(totals.values())} pixels were written of {rows * cols}")
    sums = {r["tile"]: r["sum"] for r in tile_sums(back).collect()}
    made = {"name": name, "source": raw.identity(), "domain": [row0, col0, rows, cols], "totals": totals, "tiles": sums, "profile": [profile.sea_m, profile.low_margin_m, profile.max_shore_m, profile.preference_m]}
    made["identity"] = store.digest(json.dumps(made, sort_keys=True))
    store.replace(spark, f"{root}/current.json", json.dumps(made, sort_keys=True).encode())
    return made


def virtual_mosaic(layer_files: DataFrame, resolution: float = lattice.RESOLUTION, nodata: float = 255, kind: str = "Byte", epsg: int | None = None) -> str:
    """A VRT document over files (name, left, top, width, height): one raster that reads them in place. As many lines as files, made on the driver."""
    rows = layer_files.orderBy("name").select("name", "left", "top", "width", "height").collect()
    left, top = min(r["left"] for r in rows), max(r["top"] for r in rows)
    right, bottom = max(r["left"] + r["width"] * resolution for r in rows), min(r["top"] - r["height"] * resolution for r in rows)
    size = lambda v: round(v / resolution)
    body = "".join(
        f'<SimpleSource><SourceFilename relativeToVRT="1">{xml.escape(r["name"])}</SourceFilename><SourceBand>1</SourceBand><SrcRect xOff="0" yOff="0" xSize="{r["width"]}" ySize="{r["height"]}"/>'
        f'<DstRect xOff="{size(r["left"] - left)}" yOff="{size(top - r["top"])}" xSize="{r["width"]}" ySize="{r["height"]}"/></SimpleSource>'
        for r in rows
    )
    srs = f"<SRS>EPSG:{epsg}</SRS>" if epsg else ""
    return f'<VRTDataset rasterXSize="{size(right - left)}" rasterYSize="{size(top - bottom)}">{srs}<GeoTransform>{left}, {resolution}, 0, {top}, 0, {-resolution}</GeoTransform><VRTRasterBand dataType="{kind}" band="1"><NoDataValue>{nodata:g}</NoDataValue>{body}</VRTRasterBand></VRTDataset>'
