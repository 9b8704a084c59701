"""python -m sunlattice check FOLDER | plan FOLDER L B R T TIME... | run FOLDER L B R T TIME... --to ROOT --name NAME | status ROOT --name NAME | build FOLDER --to ROOT --name NAME |
ingest FOLDER --to ROOT --name NAME | region FOLDER L B R T DAY... --to ROOT | prune ROOT"""

from __future__ import annotations

import argparse
import json
from datetime import datetime

from pyspark.sql import SparkSession

from . import store
from .functions import lattice
from .operators import fill
from .plans import publish, region, run
from .sources import catalogue, geotiff


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="sunlattice")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("check", "plan", "run", "status", "build", "ingest", "region", "prune"):
        p = verbs.add_parser(verb)
        p.add_argument("folder")
        if verb in ("plan", "run"):
            p.add_argument("rectangle", nargs=4, type=float, metavar="METRES")
            p.add_argument("times", nargs="+", type=datetime.fromisoformat, help="instants in UTC")
            p.add_argument("--radius", type=float, default=1000.0)
            p.add_argument("--method", default="nearest5")
        if verb == "region":
            p.add_argument("rectangle", nargs=4, type=float, metavar="METRES")
            p.add_argument("days", nargs="+")
            p.add_argument("--frames", type=int, default=144, help="most frames of a day")
            p.add_argument("--most-frames", type=int, default=512)
            p.add_argument("--most-pixels", type=int, default=400_000_000)
        if verb in ("run", "build", "ingest", "region"):
            p.add_argument("--to", required=True)
        if verb in ("run", "build", "ingest", "status"):
            p.add_argument("--name", required=True)
        if verb == "run":
            p.add_argument("--cache")
            p.add_argument("--at-once", type=int, help="frames of a group; a run that was lost goes on after the groups that are finished")
        if verb == "ingest":
            p.add_argument("--tile", nargs=2, type=int, default=[1200, 1500], metavar="PIXELS")
        if verb == "build":
            p.add_argument("--profile", nargs=4, type=float, required=True, metavar="METRES", help="sea, low margin, most to a shore, preference")
            p.add_argument("--tile", nargs=2, type=int, default=[1200, 1500], metavar="PIXELS")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.verb == "check":
        bad = catalogue.problems(geotiff.inventory(spark, a.folder)).orderBy("name").collect()
        for r in bad:
            print(f"{r['name']}: {r['problem']}")
        return int(bool(bad))
    if a.verb == "prune":
        print(json.dumps(publish.prune(spark, a.folder)))
        return 0
    if a.verb == "build":
        made = catalogue.build_view(spark, catalogue.RawSource(spark, a.folder), a.to, a.name, fill.Profile(*a.profile), tuple(a.tile))
        print(json.dumps({k: made[k] for k in ("name", "identity", "totals")}))
        return 0
    if a.verb == "status":
        at = f"{a.folder.rstrip('/')}/{a.name}"
        print(json.dumps({"frames": sorted(publish.finished_frames(spark, a.folder, a.name)), "finished": store.exists(spark, f"{at}/receipt.json")}))
        return 0
    if a.verb == "ingest":
        print(json.dumps({"cells": catalogue.ingest(spark, a.folder, None, a.to, tuple(a.tile), a.name).select("cell").distinct().count()}))
        return 0
    if a.verb == "region":
        pixel = lambda *v: tuple(round(x / lattice.RESOLUTION) for x in v)
        found = catalogue.covering(catalogue.RawSource(spark, a.folder).catalogue(), tuple(a.rectangle), 0.0).select("left", "bottom", "right", "top").collect()
        if not found:
            raise catalogue.Refused("no file touches the rectangle")
        boxes = [pixel(*r) for r in found]
        step = boxes[0][2] - boxes[0][0], boxes[0][3] - boxes[0][1]
        asked = region.requests(pixel(*a.rectangle), boxes, boxes[0][:2], step, a.most_pixels, [(d, a.frames) for d in region.days(a.days)], a.most_frames)
        print(json.dumps({"request": region.write_requests(spark, asked, a.to), "runs": len(asked["runs"]), "gaps": len(asked["gaps"])}))
        return 0
    request, source = run.Request(a.radius, a.method), catalogue.RawSource(spark, a.folder)
    if a.verb == "plan":
        near = catalogue.covering(source.catalogue(), tuple(a.rectangle), 0.0)
        print(json.dumps(run.plan(publish.instants(spark, a.times), publish.sites(near), request).counts))
        return 0
    publish.shade_map(spark, a.folder, tuple(a.rectangle), a.times, a.to, a.name, request, cache=a.cache, at_once=a.at_once).orderBy("frame", "grp").show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
