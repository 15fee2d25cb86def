"""Commands: ``split`` cuts one layer by one grid, ``process`` cuts layers by all rasters of a catalogue."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession

from terracell.functions.grid import GridDefinition, apply_indices
from terracell.operators import raster, split
from terracell.sources import rasters, vector

log = logging.getLogger("terracell")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terracell")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("-x", "--experimental", action="store_true", help="accepted; polygons are cut the same way")
    commands = p.add_subparsers(dest="command")
    s = commands.add_parser("split", help="cut features along a grid")
    s.add_argument("-f", "--features", required=True, help="vector file")
    s.add_argument("-l", "--layer", help="its layer")
    s.add_argument("-r", "--raster", help="raster that has the grid")
    s.add_argument("-t", "--transform", nargs=6, type=float, metavar=tuple("abcdef"), help="or the grid's transform")
    s.add_argument("-w", "--width", type=int, help="columns of the grid")
    s.add_argument("-g", "--height", type=int, help="rows of the grid")
    s.add_argument("-a", "--attribute", action="store_true", help="add raster values")
    s.add_argument("-b", "--band", nargs="+", type=int, help="bands to add, all by default")
    s.add_argument("-c", "--column", help="name of the value column, the raster's name by default")
    s.add_argument("--lazy-rasters", action="store_true", help="accepted; rasters are always read lazily")
    s.add_argument("-o", "--output", required=True)
    q = commands.add_parser("process", help="cut layers and add the values of all rasters")
    q.add_argument("-d", "--directory", help="where relative paths start")
    q.add_argument("-fs", "--features", required=True, help="CSV of layers: path[, layer][, output_path]")
    q.add_argument("-rs", "--rasters", required=True, help="CSV of rasters: path[, bands][, key or other columns]")
    q.add_argument("--lazy-rasters", action="store_true", help="accepted; rasters are always read lazily")
    return p


def kind_of(df: DataFrame) -> tuple[str, bool]:
    """point, line or polygon, and whether the layer has multi-geometries."""
    depth = df.schema["geometry"].dataType.simpleString().count("array<")
    return ("point", False) if depth == 0 else ("line", False) if depth == 1 else ("polygon", False) if depth == 2 else ("polygon", True)


def _prepared(df: DataFrame, name: str | None) -> tuple[DataFrame, str]:
    kind, multi = kind_of(df)
    if name == "MultiPoint":
        return split.prepare_points(df), "point"
    if name == "MultiLineString":
        return split.prepare_lines(df), "line"
    return (split.prepare_polygons(df), "polygon") if multi else (df, kind)


def _read(spark: SparkSession, path: str, layer: str | None) -> tuple[DataFrame, str]:
    return _prepared(*vector.read_typed(spark, path, layer))


def write(df: DataFrame, path: str, kind: str) -> None:
    if path.lower().endswith((".geojson", ".geojsonl", ".ndjson")):
        vector.write_geojson(df, path, {"point": "Point", "line": "LineString", "polygon": "Polygon"}[kind])
    else:
        df.write.mode("overwrite").parquet(path)


def run_split(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.raster:
        grid, bands = rasters.read_metadata(spark, a.raster)
    elif a.transform and a.width and a.height:
        grid, bands = GridDefinition("", a.width, a.height, tuple(a.transform)), ()
    else:
        raise SystemExit("give a raster, or a transform with width and height")
    features, kind = _read(spark, a.features, a.layer)
    cut = {"line": split.split_lines, "polygon": split.split_polygons, "point": split.split_points}[kind](features, grid)
    out = apply_indices(cut, grid, kind=kind)
    if a.attribute:
        if not a.raster:
            raise SystemExit("values need a raster")
        chosen = a.band or list(bands)
        name = a.column or a.raster.rstrip("/").rpartition("/")[2].rpartition(".")[0]
        for b in chosen:
            out = raster.lookup(out, rasters.read_band(spark, a.raster, b), name=name if len(chosen) == 1 else f"{name}_{b}")
    write(out, a.output, kind)


def run_process(spark: SparkSession, a: argparse.Namespace) -> None:
    catalogue = rasters.read_catalogue(spark, a.rasters, a.directory)
    layers = rasters.read_catalogue(spark, a.features, a.directory, raster=False)
    catalogue, grids = raster.extend_catalogue(catalogue, {r["path"]: rasters.read_metadata(spark, r["path"]) for r in catalogue})
    values = rasters.read_rasters(spark, catalogue)
    for layer in layers:
        features, kind = _read(spark, layer["path"], layer.get("layer"))
        crs = vector.layer_crs(spark, layer["path"], layer.get("layer"))
        if crs is None:
            log.warning("%s has no known CRS; that of each grid is taken", layer["path"])
        out = raster.associate(features, catalogue, grids, values, kind, crs)
        target = layer.get("output_path") or f"{layer['path']}.processed.parquet"
        if a.directory and layer.get("output_path") and not target.startswith("/") and "://" not in target:
            target = f"{a.directory.rstrip('/')}/{target}"
        log.info("writing %s", target)
        write(out, target, kind)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    a = p.parse_args(args)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(a.verbose, 2)])
    if a.command is None:
        p.print_help()
        return 0
    spark = spark or SparkSession.builder.appName("terracell").getOrCreate()
    (run_split if a.command == "split" else run_process)(spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
