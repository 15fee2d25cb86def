"""Rasters: Parquet tables with a sidecar, GeoTIFF, ASCII grids, Zarr headers, and catalogues.

A raster at ``path`` is a Parquet table ``band, j, i, value`` with ``path + ".grid.json"`` beside it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.functions.grid import GridDefinition
from terracell.sources import geotiff

TIFF = (".tif", ".tiff")


def _text(spark: SparkSession, path: str) -> str | None:
    """A small text file by way of Spark, or None."""
    try:
        return "\n".join(r.value for r in spark.read.text(path).collect())
    except Exception as e:  # the file isn't there
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def write_raster(values: DataFrame, path: str, grid: GridDefinition, nodata: float | None = None, dtype: str | None = None) -> None:
    """``[band,] j, i, value`` as a raster; missing cells are left out or filled with ``nodata``."""
    missing = {"j", "i", "value"} - set(values.columns)
    if missing:
        raise ValueError(f"a raster has the columns j, i, value; missing: {', '.join(sorted(missing))}")
    spark = values.sparkSession
    out = values if "band" in values.columns else values.withColumn("band", F.lit(1))
    out = out.select("band", F.col("j").cast("long").alias("j"), F.col("i").cast("long").alias("i"), F.col("value").cast(dtype) if dtype else F.col("value"))
    if nodata is not None:
        cells = spark.range(grid.width * grid.height).select(F.floor(F.col("id") / grid.width).cast("long").alias("j"), F.pmod("id", F.lit(grid.width)).cast("long").alias("i"))
        bands = [r.band for r in out.select("band").distinct().collect()] or [1]
        cells = cells.select("j", "i", F.explode(F.array(*map(F.lit, bands))).alias("band"))
        out = cells.join(out, ["band", "j", "i"], "left").select("band", "j", "i", F.coalesce("value", F.lit(nodata).cast(out.schema["value"].dataType)).alias("value"))
    out.repartitionByRange("band", "j").sortWithinPartitions("band", "j", "i").write.mode("overwrite").parquet(path)
    side = spark.createDataFrame([(grid.to_sidecar(),)], "value string").coalesce(1)
    side.write.mode("overwrite").text(path + ".grid.json")


def read_grid(spark: SparkSession, path: str) -> GridDefinition:
    """The grid of a raster: its sidecar, a GeoTIFF's tags, an ASCII grid's head, or a Zarr store's attributes."""
    if path.lower().endswith(TIFF):
        return geotiff.read_tiff(path).grid
    if path.endswith(".asc"):
        return ascii_grid(spark, path)[0]
    if path.rstrip("/").endswith(".zarr"):
        return zarr_grid(spark, path)[0]
    text = _text(spark, path + ".grid.json")
    if text is None:
        raise ValueError(f"{path} has no grid beside it")
    return GridDefinition.from_sidecar(text)


def read_metadata(spark: SparkSession, path: str) -> tuple[GridDefinition, tuple[int, ...]]:
    """Grid and band numbers."""
    if path.lower().endswith(TIFF):
        tiff = geotiff.read_tiff(path)
        return tiff.grid, tuple(range(1, tiff.bands + 1))
    if path.endswith(".asc"):
        return ascii_grid(spark, path)[0], (1,)
    if path.rstrip("/").endswith(".zarr"):
        return zarr_grid(spark, path)
    return read_grid(spark, path), tuple(sorted(r.band for r in spark.read.parquet(path).select("band").distinct().collect()))


def read_band(spark: SparkSession, path: str, band: int = 1) -> DataFrame:
    """``j, i, value`` of one band."""
    if band < 1:
        raise ValueError("bands are numbered from 1")
    if path.endswith(".asc"):
        if band != 1:
            raise ValueError(f"{path} has one band")
        return ascii_grid(spark, path)[1]
    if path.lower().endswith(TIFF):
        return geotiff.read_values(spark, path, (band,)).select("j", "i", "value")
    known = read_metadata(spark, path)[1]
    if band not in known:
        raise ValueError(f"{path} has the bands {', '.join(map(str, known))}")
    return spark.read.parquet(path).where(F.col("band") == band).select("j", "i", "value")


def read_rasters(spark: SparkSession, catalogue: list[dict]) -> DataFrame:
    """All bands of a catalogue ``path, key, bands`` as one table ``raster_key, band, j, i, value``."""
    parts = [read_band(spark, r["path"], b).select(F.lit(r["key"]).alias("raster_key"), F.lit(b).alias("band"), F.col("j").cast("long").alias("j"), F.col("i").cast("long").alias("i"), F.col("value").cast("double").alias("value")) for r in catalogue for b in r["bands"]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ascii_grid(spark: SparkSession, path: str, crs: str = "EPSG:4326") -> tuple[GridDefinition, DataFrame]:
    """An ASCII grid: its grid (north up) and values; cells without data are left out."""
    head = {}
    for r in spark.read.text(path).limit(6).collect():
        part = r.value.split()
        if len(part) == 2 and part[0][0].isalpha():
            head[part[0].lower()] = float(part[1])
    size, n, rows = head["cellsize"], int(head["ncols"]), int(head["nrows"])
    half = size / 2
    x = head["xllcorner"] if "xllcorner" in head else head["xllcenter"] - half
    y = head["yllcorner"] if "yllcorner" in head else head["yllcenter"] - half
    grid = GridDefinition(crs, n, rows, (size, 0, x, 0, -size, y + rows * size))
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    lines = lines.where(F.col("line").rlike(r"^\s*[-+.0-9]"))
    cells = lines.select((F.col("at") - len(head)).cast("long").alias("j"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("i", "v"))
    values = cells.select("j", F.col("i").cast("long").alias("i"), F.col("v").try_cast("double").alias("value")).where("value is not null")
    return grid, values.where(F.col("value") != head["nodata_value"]) if "nodata_value" in head else values


def zarr_grid(spark: SparkSession, path: str) -> tuple[GridDefinition, tuple[int, ...]]:
    """Grid and bands of a Zarr (version 3) store from its attributes; the arrays are not read."""
    text = _text(spark, f"{path.rstrip('/')}/zarr.json")
    if text is None:
        raise ValueError(f"{path} is no Zarr store")
    meta = json.loads(text)
    members = meta.get("consolidated_metadata", {}).get("metadata", {})

    def attributes(node):
        yield node.get("attributes", {})
        for m in members.values():
            yield m.get("attributes", {})

    transform = crs = None
    for a in attributes(meta):
        transform = transform or a.get("GeoTransform")
        crs = crs or a.get("crs") or a.get("spatial_ref") or a.get("crs_wkt")
    if not transform:
        raise ValueError(f"{path} has no GeoTransform")
    if not crs:
        raise ValueError(f"{path} has no CRS")
    c, a, b, f, d, e = map(float, transform.split()[:6])
    shapes = [m["shape"] for m in members.values() if m.get("node_type") == "array" and len(m.get("shape", [])) >= 2]
    if not shapes:
        raise ValueError(f"{path} has no array")
    shape = shapes[0]
    if len(shape) > 3 or 0 in shape:
        raise ValueError("an array has one dimension beside the two of space, and no empty one")
    return GridDefinition(crs, shape[-1], shape[-2], (a, b, c, d, e, f)), tuple(range(1, (shape[0] if len(shape) == 3 else 1) + 1))


def read_catalogue(spark: SparkSession, path: str, directory: str | None = None, raster: bool = True) -> list[dict]:
    """Rows of a CSV catalogue, with ``path`` under a directory, ``bands`` as numbers, and a ``key``.

    Without a key column it is made of all other columns, or of the path.
    """
    df = spark.read.option("header", True).csv(path)
    rows = [{k: v for k, v in r.asDict().items()} for r in df.collect()]  # files, as many as are listed
    names = sorted(set(df.columns) - {"path", "bands", "key", "output_path", "layer"})
    for r in rows:
        if directory and not r["path"].startswith(("/", "file:")) and "://" not in r["path"]:
            r["path"] = f"{directory.rstrip('/')}/{r['path']}"
        if raster:
            if r.get("key") is None:
                r["key"] = "|".join(f"{n}:{r[n]}" for n in names) if names else r["path"]
            if r.get("bands"):
                r["bands"] = tuple(int(b) for b in str(r["bands"]).split(","))
    return rows


def list_files(spark: SparkSession, directory: str, suffix: str) -> list[str]:
    """Paths below a directory with an ending, without hidden files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(directory).select("path")
    return sorted(r.path for r in files.where(~F.element_at(F.split("path", "/"), -1).startswith(".")).collect())
