"""Road damage percentages and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Damage in per cent as slope * depth + constant, up to a depth.
ROADS = ((0.5, 40.0, 0.0), (1.0, 30.0, 5.0), (None, 10.0, 25.0))
PAVED = ((0.1, 0.0, 0.0), (0.25, 100.0 / 15.0, -10.0 / 15.0), (0.5, 4.0, 0.0), (0.75, 12.0, -4.0), (None, 20.0, -10.0))
UNPAVED = ((0.1, 10.0, 0.0), (0.25, 1000.0 / 15.0, 50.0 / 15.0), (0.5, 120.0, -10.0), (1.0, 80.0, 10.0), (None, 20.0, 70.0))


def _bands(depth: Column, bands: tuple) -> Column:
    out = None
    for top, slope, constant in bands:
        value = F.lit(slope) * depth + F.lit(constant)
        out = (F if out is None else out).when(depth <= top, value) if top is not None else out.when(depth.isNotNull(), value)
    return out


def road_damage(depth: Column, factor: float | Column = 1.0) -> Column:
    """Per cent of damage at a depth, at most 100."""
    return F.least(F.lit(100.0), (factor if isinstance(factor, Column) else F.lit(float(factor))) * _bands(depth, ROADS))


def road_damage_by_surface(depth: Column, surface: Column, factor: float | Column = 1.0) -> Column:
    """The same for ``paved`` and ``unpaved`` roads; null for others."""
    value = F.when(surface == "paved", _bands(depth, PAVED)).when(surface == "unpaved", _bands(depth, UNPAVED))
    scaled = (factor if isinstance(factor, Column) else F.lit(float(factor))) * value
    return F.when(scaled.isNotNull(), F.least(F.lit(100.0), scaled))


def direct_damage(percent: Column, width: Column, length: Column, cost: Column) -> Column:
    return F.lit(0.01) * percent * width * length * cost


def cost_per_area(rehabilitation: Column, width: Column, asset: Column) -> Column:
    """Roads cost thousands a km, other assets millions."""
    return F.when(asset == "road", F.lit(1.0e3)).otherwise(F.lit(1.0e6)) * rehabilitation / width


def cost_by_condition(condition: Column) -> Column:
    return F.when(condition == "paved", F.lit(1)).otherwise(F.lit(2))


#: The cost row of an asset type, and of a national road class.
ASSET_ROWS = {
    "Expressway": "Expressway",
    "National roads": "National  2x Carriageway",
    "Provincial roads": "Provincial",
    "Urban roads/Named roads": "District",
    "Boulevard": "District",
    "Other roads": "Commune",
}
CLASS_ROWS = {1: "Expressway", 2: "National  2x Carriageway", 3: "National  1x Carriageway", 4: "Provincial", 5: "District", 6: "Commune"}


def cost_by_terrain(roads: DataFrame, costs: DataFrame, length_factor: float, national: bool = False, out: str = "cost_per_area") -> DataFrame:
    """Adds the cost per area from a small table ``asset, terrain, basic_cost, design_width``.

    Bridges cost the most over the widest of the table, unknown assets the least over the narrowest.
    Rows are tried in the order of road importance; a class counts only for national roads.
    """
    row = F.lit(None).cast("string")
    rules = [("Expressway", 1), ("National  2x Carriageway", 2), ("National  1x Carriageway", 3), ("Provincial", 4), ("District", 5), ("Commune", 6)]
    for name, level in reversed(rules):
        hit = F.col("asset_type").isin(*[a for a, r in ASSET_ROWS.items() if r == name])
        if national:
            hit = F.coalesce(hit, F.lit(False)) | F.coalesce(F.col("road_class") == level, F.lit(False))
        row = F.when(hit, F.lit(name)).otherwise(row)
    terrain = F.when((F.lower(F.trim("terrain")) == "mountain") | (F.col("asset_type") == "Bridge"), "mountain").otherwise(F.lower(F.trim("terrain")))
    keyed = roads.withColumns({"_row": row, "_terrain": terrain})
    rate = F.col("basic_cost") * length_factor
    table = costs.select(F.col("asset").alias("_row"), F.col("terrain").alias("_terrain"), (rate / F.col("design_width")).alias("_cost"))
    limits = costs.agg(F.max(rate).alias("rate_max"), F.max("design_width").alias("width_max"), F.min(rate).alias("rate_min"), F.min("design_width").alias("width_min")).first()
    most = limits["rate_max"] / limits["width_max"] if limits["width_max"] else None
    least = limits["rate_min"] / limits["width_min"] if limits["width_min"] else None
    value = F.when(F.col("_row").isNotNull(), F.col("_cost")).when(F.col("asset_type") == "Bridge", F.lit(most)).otherwise(F.lit(least))
    return keyed.join(table, ["_row", "_terrain"], "left").withColumn(out, value).drop("_row", "_terrain", "_cost")
