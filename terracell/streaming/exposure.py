"""Exposure on streams: cells and raster values row by row, and sums in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.functions.geometry import point
from terracell.functions.grid import GridDefinition, point_indices
from terracell.operators.raster import lookup


def exposed(events: DataFrame, grid: GridDefinition, values: DataFrame | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Adds the cell of each event, and with a static band its value. Keeps no state."""
    i, j = point_indices(grid, point(F.col(x), F.col(y)))
    out = events.select("*", i.alias("index_i"), j.alias("index_j"))
    return out if values is None else lookup(out, values)


def windowed(events: DataFrame, time: str, late: str, window: str, value: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by cell and window; events later than ``late`` are dropped by the watermark."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    rows = events.withWatermark(time, late).groupBy(w.alias("w"), "index_i", "index_j")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "index_i", "index_j", "n", "total")
