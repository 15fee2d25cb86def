"""Rasters as long tables ``raster_key, band, j, i, value``: lookup, wide lookup, rasterising."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.functions.expr import let
from terracell.functions.grid import GridDefinition, in_grid, unravel
from terracell.operators.split import split_for_grids


def _need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")


def band(raster: DataFrame, raster_key: str | None = None, band_number: int = 1) -> DataFrame:
    """One band: ``j, i, value``."""
    if band_number < 1:
        raise ValueError("bands are numbered from 1")
    if "raster_key" in raster.columns and raster_key is not None:
        raster = raster.where(F.col("raster_key") == raster_key)
    return raster.where(F.col("band") == band_number).select("j", "i", "value") if "band" in raster.columns else raster.select("j", "i", "value")


def lookup(pieces: DataFrame, values: DataFrame, index_i: str = "index_i", index_j: str = "index_j", name: str = "value", strict: bool = False) -> DataFrame:
    """Adds the raster value of each piece's cell; null where there is none. ``strict`` raises for cells in no raster.

    The join side is left to the planner: a band below the broadcast threshold is broadcast,
    a larger one is joined by a shuffle on the cell, with skewed cells split at run time.
    """
    _need(pieces, index_i, index_j)
    v = values.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("value").alias(name), F.lit(True).alias("_hit"))
    out = pieces.join(v, (F.col(index_i) == F.col("_i")) & (F.col(index_j) == F.col("_j")), "left")
    if strict:
        lost = F.col("_hit").isNull() & (F.col(index_i) >= 0) & (F.col(index_j) >= 0)
        out = out.withColumn(name, F.when(lost, F.raise_error(F.lit("a cell is outside of the raster")).cast(values.schema["value"].dataType)).otherwise(F.col(name)))
    return out.drop("_i", "_j", "_hit")


def column_names(catalogue: list[tuple[str, list[int]]]) -> dict[tuple[str, int], str]:
    """The output column of each raster and band: the key, with the band if there are several."""
    return {(key, b): key if len(bands) == 1 else f"{key}_{b}" for key, bands in catalogue for b in bands}


def wide(raster: DataFrame, names: dict[tuple[str, int], str]) -> DataFrame:
    """One row a cell with a column for each raster and band, by one aggregation."""
    keys, bands = sorted({k for k, _ in names}), sorted({b for _, b in names})
    picked = raster.where(F.col("raster_key").isin(keys) & F.col("band").isin(bands))
    return picked.groupBy("i", "j").agg(*(F.max(F.when((F.col("raster_key") == k) & (F.col("band") == b), F.col("value"))).alias(n) for (k, b), n in names.items()))


def lookup_wide(pieces: DataFrame, raster: DataFrame, names: dict[tuple[str, int], str], index_i: str = "index_i", index_j: str = "index_j") -> DataFrame:
    """Adds all rasters of one grid in one join."""
    w = wide(raster, names).withColumnsRenamed({"i": "_i", "j": "_j"})
    return pieces.join(w, (F.col(index_i) == F.col("_i")) & (F.col(index_j) == F.col("_j")), "left").drop("_i", "_j")


def associate(features: DataFrame, catalogue: list[dict], grids: list[GridDefinition], raster: DataFrame, kind: str = "line", crs: str | None = None, geometry: str = "geometry", last_band_only: bool = False) -> DataFrame:
    """Cuts features by all grids and adds all rasters: one cut and one join for each grid.

    ``catalogue`` rows have ``key, bands, grid_id``. ``last_band_only``: bands of a raster share the
    column of its key and the last one holds.
    """
    out = split_for_grids(features, grids, kind, crs, geometry)
    for k in range(len(grids)):
        mine = [(r["key"], list(r["bands"])[-1:] if last_band_only else list(r["bands"])) for r in catalogue if r["grid_id"] == k]
        if mine:
            out = lookup_wide(out, raster, column_names(mine), f"i_{k}", f"j_{k}")
    return out


def extend_catalogue(rows: list[dict], grid_of: dict[str, tuple[GridDefinition, list[int]]]) -> tuple[list[dict], list[GridDefinition]]:
    """Fills ``bands`` and ``grid_id`` of ``path, key`` rows; equal grids share a number, in order of first use."""
    grids: list[GridDefinition] = []
    out = []
    for r in rows:
        grid, bands = grid_of[r["path"]]
        if grid not in grids:
            grids.append(grid)
        out.append({**r, "bands": tuple(r.get("bands") or bands), "grid_id": grids.index(grid)})
    return out, grids


def rasterise(pieces: DataFrame, value: str, grid: GridDefinition, index_i: str = "index_i", index_j: str = "index_j") -> DataFrame:
    """Sums in each cell that has pieces: ``i, j, value``. Null or foreign cells are left out; NaN counts as nothing."""
    _need(pieces, value, index_i, index_j)
    kind = pieces.schema[value].dataType.typeName()
    v = F.nanvl(F.col(value), F.lit(None)) if kind in ("double", "float") else F.col(value)
    # The index is evaluated once: a filter on it would copy its expression into every comparison.
    at = F.struct(F.col(index_i).cast("long").alias("i"), F.col(index_j).cast("long").alias("j"))
    cell = let(at, lambda c: F.when(in_grid(grid, c["i"], c["j"]), c["j"] * grid.width + c["i"]))
    sums = pieces.select(cell.alias("cell"), v.alias("v")).groupBy("cell").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("value"))
    row, column = unravel(F.col("cell"), grid.width)
    return sums.where("cell is not null").select(column.alias("i"), row.alias("j"), "value")


def rasterise_dense(pieces: DataFrame, value: str, grid: GridDefinition, fill=0.0, dtype: str | None = None, index_i: str = "index_i", index_j: str = "index_j") -> DataFrame:
    """The same for every cell of the grid, with ``fill`` where there are no pieces."""
    sums = rasterise(pieces, value, grid, index_i, index_j)
    cells = pieces.sparkSession.range(grid.width * grid.height).select(F.floor(F.col("id") / grid.width).cast("long").alias("j"), F.pmod(F.col("id"), F.lit(grid.width)).cast("long").alias("i"))
    out = cells.join(sums, ["j", "i"], "left").select("j", "i", F.coalesce(F.col("value"), F.lit(fill)).alias("value"))
    return out.withColumn("value", F.col("value").cast(dtype)) if dtype else out


def pixel_points(values: DataFrame, grid: GridDefinition, above: float = 0.0) -> DataFrame:
    """Cells over a value as points at their centres: ``id, x, y, value``; NaN and null are 0, ids follow (j, i)."""
    from pyspark.sql import Window as W

    v = F.coalesce(F.nanvl(F.col("value"), F.lit(0.0)), F.lit(0.0))
    x, y = grid.affine(F.col("i") + 0.5, F.col("j") + 0.5)
    rows = values.select("i", "j", x.alias("x"), y.alias("y"), v.alias("value")).where(F.col("value") > above)
    first = rows.groupBy("j").agg(F.count(F.lit(1)).alias("n"))  # rows of the raster are numbered first, then cells within each
    first = first.select(F.col("j"), (F.sum("n").over(W.orderBy("j")) - F.col("n")).alias("base"))
    rows = rows.join(first, "j")
    return rows.select((F.col("base") + F.row_number().over(W.partitionBy("j").orderBy("i")) - 1).cast("long").alias("id"), "x", "y", "value")
