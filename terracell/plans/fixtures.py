"""Geometry derived from the star schema tables: dyadic coordinates that every engine computes alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.functions.geometry import box_polygon, point
from terracell.functions.grid import GridDefinition

GRID_A = GridDefinition("EPSG:32630", 13, 4, (4, 0, 0, 0, 4, 0))
GRID_B = GridDefinition("EPSG:32630", 24, 7, (2, 0, 0, 0, -2, 14))
GRID_SMALL = GridDefinition("EPSG:32630", 6, 2, (4, 0, 0, 0, 4, 0))
PERIODS = (2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_points(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Line items with ``x, y``."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select(*keys, *more)
    return rows.withColumns({"x": (F.col("l_partkey") % 97) * 0.5, "y": (F.col("l_suppkey") % 53) * 0.25})


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``l_orderkey, line``: the points of an order's items, two at least."""
    rows = item_points(spark, sf_dir, "l_extendedprice")
    step = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", point(F.col("x"), F.col("y")).alias("p"))
    lines = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(step)).alias("s"))
    return lines.where(F.size("s") >= 2).select("l_orderkey", F.col("s.p").alias("line"))


def raster(spark: SparkSession, grid: GridDefinition, key: str = "depth", turn: int = 0) -> DataFrame:
    """A made-up raster: ``raster_key, band, j, i, value``; cells with a multiple of 7 as their number are missing."""
    cells = spark.range(grid.width * grid.height)
    i, j = F.pmod("id", F.lit(grid.width)).cast("long"), F.floor(F.col("id") / grid.width).cast("long")
    value = ((i * 7 + j * 13 + turn) % 321).cast("double")
    return cells.where(F.col("id") % 7 != 3).select(F.lit(key).alias("raster_key"), F.lit(1).alias("band"), j.alias("j"), i.alias("i"), value.alias("value"))


def supplier_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``s_suppkey, polygon``: rectangles, partly outside of the grids."""
    k = F.col("s_suppkey")
    x, y = (k % 40) + 0.5, (k % 9) + 0.25
    return table(spark, sf_dir, "supplier").select("s_suppkey", box_polygon(x, y, x + 1 + k % 5, y + 0.5 + k % 4).alias("polygon"))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``s_suppkey, polygon``: the lower left halves of the rectangles."""
    k = F.col("s_suppkey")
    x, y, w, h = (k % 40) + 0.5, (k % 9) + 0.25, 1 + k % 5, 0.5 + k % 4
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.array(point(x, y), point(x + w, y), point(x, y + h), point(x, y))).alias("polygon"))


def l_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_nationkey, polygon``: a box of 8 by 1 and on its left a box of 3 by 1.5, for each nation."""
    k = F.col("n_nationkey")
    x, y = (k % 5) * 10.0 + 0.1, F.floor(k / 5) * 3.0 + 0.1
    ring = [(0, 0), (8, 0), (8, 1), (3, 1), (3, 2.5), (0, 2.5), (0, 0)]
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array(F.array(*(point(x + a, y + b) for a, b in ring))).alias("polygon"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, x, y, point``: the distinct places of line items."""
    rows = item_points(spark, sf_dir).select("x", "y").distinct()
    return rows.select(F.concat_ws("/", "x", "y").alias("id"), "x", "y", point(F.col("x"), F.col("y")).alias("point"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_nationkey, n_regionkey, polygon``: a rectangle for each nation, without overlaps, with gaps between."""
    k = F.col("n_nationkey")
    x, y = (k % 5) * 10.0, F.floor(k / 5) * 3.0
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", box_polygon(x, y, x + 8, y + 2.5).alias("polygon"))


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An undirected network of nations: neighbours in a ring and every fifth, with integer weights."""
    k = F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation").select(k)
    ring = nations.select(k.alias("edge_id"), k.alias("from_node"), ((k + 1) % 25).alias("to_node"), (1 + (k * 7) % 5).cast("double").alias("weight"))
    far = nations.where(k % 3 == 0).select((k + 100).alias("edge_id"), k.alias("from_node"), ((k + 5) % 25).alias("to_node"), (2 + (k * 3) % 7).cast("double").alias("weight"))
    return ring.unionByName(far).select(*(F.col(c).cast("long").alias(c) for c in ("edge_id", "from_node", "to_node")), "weight")


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long exposure: ``edge, region, hazard, scenario, rp, probability, depth, length, damage``."""
    n = F.col("l_linenumber")
    rp = F.element_at(F.array(*map(F.lit, PERIODS)), (n % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        (F.col("l_partkey") % 500).alias("edge"), (F.col("l_suppkey") % 5).alias("region"), F.col("l_returnflag").alias("hazard"), F.col("l_linestatus").alias("scenario"),
        rp.alias("rp"), (1 / rp).alias("probability"), (F.col("l_quantity") / 16).alias("depth"), (F.col("l_partkey") % 64 + 1).cast("double").alias("length"), F.col("l_quantity").alias("damage"),
    )
