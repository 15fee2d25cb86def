"""Damage curves: piecewise linear, from files or a catalogue, evaluated as columns."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from terracell.functions.expr import let

CURVE_SCHEMA = StructType([StructField("intensity", DoubleType()), StructField("damage", DoubleType())])

#: The columns of a curve catalogue; those marked True must have a value.
METADATA = {
    "curve_id": True,
    "hazard_type": True,
    "hazard_name": True,
    "sector": True,
    "sheet_name": True,
    "intensity_metric": True,
    "intensity_axis": True,
    "intensity_unit": False,
    "exposed_element": True,
    "additional_characteristics": False,
    "curve_type": False,
    "curve_characteristics": False,
    "damage_states": False,
    "derivation_methodology": False,
    "cost_feature": False,
    "uncertainty_range": False,
    "geographical_application": False,
    "readily_available": False,
    "source": True,
    "source_details": False,
    "original_id": False,
}
METADATA_SCHEMA = StructType([StructField(n, StringType(), not needed) for n, needed in METADATA.items()])


class DamageCurve(Protocol):
    """Anything that turns a column of exposure into a column of damage fractions."""

    def damage_fraction(self, exposure: Column) -> Column: ...


def _clip(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Damage within [0, 1]; a point is put in where the curve crosses a bound."""
    for bound, beyond in ((1.0, lambda d: d > 1), (0.0, lambda d: d < 0)):
        more = []
        for (x0, d0), (x1, d1) in zip(points, points[1:]):
            if beyond(d0) != beyond(d1) and bound not in (d0, d1):
                more.append((x0 + (bound - d0) / (d1 - d0) * (x1 - x0), bound))
        points = sorted(points + more)
    return [(x, min(max(d, 0.0), 1.0)) for x, d in points]


@dataclass(frozen=True)
class PiecewiseLinearCurve:
    """Strictly increasing intensities with damage fractions. Below the curve the least damage holds, above it the greatest."""

    points: tuple[tuple[float, float], ...]

    def __init__(self, points: Iterable[tuple[float, float]]) -> None:
        p = [(float(x), float(d)) for x, d in points]
        if not p or any(b[0] <= a[0] for a, b in zip(p, p[1:])):
            raise ValueError("intensities have to increase")
        object.__setattr__(self, "points", tuple(_clip(p)))

    @property
    def intensity(self) -> list[float]:
        return [x for x, _ in self.points]

    @property
    def damage(self) -> list[float]:
        return [d for _, d in self.points]

    def __call__(self, x: float) -> float:
        """The damage at one intensity, on the driver."""
        if math.isnan(x):
            return x
        xs, ds = self.intensity, self.damage
        if x < xs[0]:
            return min(ds)
        if x > xs[-1]:
            return max(ds)
        k = min(max(bisect.bisect_right(xs, x) - 1, 0), len(xs) - 2) if len(xs) > 1 else 0
        return ds[0] if len(xs) == 1 else ds[k] + (x - xs[k]) / (xs[k + 1] - xs[k]) * (ds[k + 1] - ds[k])

    def damage_fraction(self, exposure: Column) -> Column:
        """Null stays null and NaN stays NaN."""
        x, (p, q) = exposure.cast("double"), (self.points, self.points[1:])
        out = F.when(F.isnan(x), x).when(x < p[0][0], F.lit(min(self.damage))).when(x > p[-1][0], F.lit(max(self.damage)))
        for (x0, d0), (x1, d1) in zip(p, q):
            out = out.when(x <= x1, F.lit(d0) + (x - x0) / (x1 - x0) * (d1 - d0))
        return out if q else out.when(x.isNotNull(), F.lit(p[0][1]))

    def translate_x(self, by: float) -> PiecewiseLinearCurve:
        return PiecewiseLinearCurve((x + by, d) for x, d in self.points)

    def scale_x(self, by: float) -> PiecewiseLinearCurve:
        return PiecewiseLinearCurve((x * by, d) for x, d in self.points)

    def translate_y(self, by: float) -> PiecewiseLinearCurve:
        return PiecewiseLinearCurve((x, d + by) for x, d in self.points)

    def scale_y(self, by: float) -> PiecewiseLinearCurve:
        return PiecewiseLinearCurve((x, d * by) for x, d in self.points)

    @classmethod
    def interpolate(cls, a: PiecewiseLinearCurve, b: PiecewiseLinearCurve, factor: float) -> PiecewiseLinearCurve:
        """Between two curves, on the break points of both."""
        return cls((x, a(x) + (b(x) - a(x)) * factor) for x in sorted({*a.intensity, *b.intensity}))

    @classmethod
    def from_frame(cls, df: DataFrame, intensity: str = "intensity", damage: str = "damage") -> PiecewiseLinearCurve:
        """From a small table, in order of intensity."""
        return cls(sorted((r[0], r[1]) for r in df.select(intensity, damage).collect()))

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, intensity: str = "intensity", damage: str = "damage_ratio", comment: str = "#", sep: str = ",") -> PiecewiseLinearCurve:
        """From a text file; what follows a comment mark on a line is left out."""
        lines = spark.read.text(path).select(F.rtrim(F.substring_index("value", comment, 1)).alias("value")).where("trim(value) <> ''")
        rows = [r["value"].split(sep) for r in lines.coalesce(1).collect()]
        return cls._from_rows(rows, intensity, damage)

    @classmethod
    def from_excel(cls, path: str, sheet: int | str = 0, intensity: str = "intensity", damage: str = "damage_ratio", comment: str = "#") -> PiecewiseLinearCurve:
        from terracell.sources.xlsx import read_sheet

        rows = [r for r in read_sheet(path, sheet) if any(c is not None for c in r) and not str(r[0]).startswith(comment)]
        return cls._from_rows(rows, intensity, damage)

    @classmethod
    def _from_rows(cls, rows: list[list], intensity: str, damage: str) -> PiecewiseLinearCurve:
        head = [str(c).strip() for c in rows[0]]
        missing = {intensity, damage} - set(head)
        if missing:
            raise KeyError(f"missing columns: {', '.join(sorted(missing))}")
        i, d = head.index(intensity), head.index(damage)
        return cls((float(r[i]), float(r[d])) for r in rows[1:])

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """The points, for a chart or a table."""
        return spark.createDataFrame(list(self.points), CURVE_SCHEMA)


def curve_segments(curves: DataFrame) -> DataFrame:
    """Long curves ``curve_id, intensity, damage`` to ``curve_id, x0, d0, x1, d1, last, least, most``; a repeated intensity raises."""
    order, every = W.partitionBy("curve_id").orderBy("intensity"), W.partitionBy("curve_id")
    x1 = F.lead("intensity").over(order)
    rows = curves.select("curve_id", F.col("intensity").alias("x0"), F.col("damage").alias("d0"), x1.alias("x1"), F.lead("damage").over(order).alias("d1"), F.lead("intensity", 2).over(order).alias("x2"), F.min("damage").over(every).alias("least"), F.max("damage").over(every).alias("most"), F.min("intensity").over(every).alias("low"), F.max("intensity").over(every).alias("high"))
    bad = F.raise_error(F.lit("intensities have to increase")).cast("double")
    return rows.where("x1 is not null or low = high").select("curve_id", "x0", "d0", F.when(F.col("x1") == F.col("x0"), bad).otherwise(F.col("x1")).alias("x1"), "d1", F.col("x2").isNull().alias("last"), "least", "most", "low", "high")


def evaluate(exposure: DataFrame, curves: DataFrame, intensity: str, out: str = "damage") -> DataFrame:
    """Adds the damage of each row's own curve (``curve_id``); null without a curve or an intensity.

    Segments of a curve meet as one array in a row, so the join is on ``curve_id`` alone and a row
    of exposure stays one row.
    """
    seg = curve_segments(curves).groupBy("curve_id").agg(
        F.sort_array(F.collect_list(F.struct("x0", "d0", "x1", "d1"))).alias("_s"), F.first("least").alias("_least"), F.first("most").alias("_most"), F.first("low").alias("_low"), F.first("high").alias("_high")
    )
    x = F.col(intensity).cast("double")
    held = F.try_element_at(F.filter("_s", lambda v: (v["x0"] <= x) & (F.coalesce(v["x1"], v["x0"]) >= x)), F.lit(1))
    inner = let(held, lambda s: s["d0"] + F.coalesce(F.try_divide(x - s["x0"], s["x1"] - s["x0"]) * (s["d1"] - s["d0"]), F.lit(0.0)))
    value = F.when(F.col("_low").isNull() | x.isNull(), F.lit(None).cast("double")).when(F.isnan(x), x).when(x < F.col("_low"), F.col("_least")).when(x > F.col("_high"), F.col("_most")).otherwise(inner)
    return exposure.join(seg, "curve_id", "left").withColumn(out, value).drop("_s", "_least", "_most", "_low", "_high")


# The catalogue


def available_curves(metadata: DataFrame, **filters: str | Iterable[str] | None) -> DataFrame:
    """Rows of the catalogue. A string is a pattern found anywhere in any case; a list names exact values."""
    out = metadata
    for column, wanted in filters.items():
        if wanted is None:
            continue
        if column not in METADATA:
            raise KeyError(column)
        c = F.col(column)
        out = out.where(F.coalesce(c.rlike("(?i)" + wanted), F.lit(False)) if isinstance(wanted, str) else c.isin(*wanted))
    return out


def curve_metadata(metadata: DataFrame, curve_id: str) -> dict[str, str | None]:
    rows = metadata.where(F.col("curve_id") == curve_id).head(1)
    if not rows:
        raise KeyError(curve_id)
    return rows[0].asDict()


def load_curve(points: DataFrame, curve_id: str) -> PiecewiseLinearCurve:
    """A curve of ``curve_id, point_index, intensity, damage``."""
    rows = points.where(F.col("curve_id") == curve_id).select("point_index", "intensity", "damage").collect()
    if not rows:
        raise KeyError(curve_id)
    return PiecewiseLinearCurve((r[1], r[2]) for r in sorted(rows))


def curve_points(wide: DataFrame, axis: str, curve_ids: list[str]) -> DataFrame:
    """A sheet with one column a curve to ``curve_id, point_index, intensity, damage``; what is no number is left out."""
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    rows = wide.select(number(axis).alias("intensity"), *(number(c).alias(c) for c in curve_ids)).unpivot(["intensity"], [F.col(f"`{c}`") for c in curve_ids], "curve_id", "damage").where("intensity is not null and damage is not null")
    nth = F.row_number().over(W.partitionBy("curve_id").orderBy("intensity", "damage")) - 1
    return rows.select("curve_id", nth.alias("point_index"), "intensity", "damage")


def build_catalogue(metadata: DataFrame, points: DataFrame, curve_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables of a catalogue, each reduced to the curves that the other has, in order."""
    if curve_types is not None:
        metadata = metadata.where(F.col("curve_type").isin(*curve_types))
    kept = metadata.join(points.select("curve_id").distinct(), "curve_id", "left_semi")
    return kept.orderBy("curve_id"), points.join(kept.select("curve_id").distinct(), "curve_id", "left_semi").orderBy("curve_id", "point_index")


def parse_label(label: Column) -> Column:
    """``Depth (m)`` to ``struct<name, unit>``; a label without brackets has no unit."""
    name = F.trim(F.regexp_extract(label, r"^(.*?)(?:\(([^()]+)\))?\s*$", 1))
    unit = F.trim(F.regexp_extract(label, r"^(.*?)(?:\(([^()]+)\))?\s*$", 2))
    return F.struct(name.alias("name"), F.nullif(unit, F.lit("")).alias("unit"))


def normalise_header(name: str) -> str:
    """A column name in lower case with one underscore between words."""
    import re

    return re.sub(r"[^0-9a-z]+", "_", str(name).strip().lower()).strip("_")
