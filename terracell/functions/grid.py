"""Affine transforms and raster grids, on the driver and as columns."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: spacing of doubles at 1; added in world units before a cell is looked up.
EPSILON = 2.220446049250313e-16


@dataclass(frozen=True)
class Affine:
    """``x = a * i + b * j + c``, ``y = d * i + e * j + f``; numbers or columns go in."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float

    @classmethod
    def from_gdal(cls, c: float, a: float, b: float, f: float, d: float, e: float) -> Affine:
        return cls(a, b, c, d, e, f)

    @property
    def determinant(self) -> float:
        return self.a * self.e - self.b * self.d

    def inverse(self) -> Affine:
        det = self.determinant
        if det == 0:
            raise ValueError("The transform is not invertible")
        a, b, d, e = self.e / det, -self.b / det, -self.d / det, self.a / det
        return Affine(a, b, -self.c * a - self.f * b, d, e, -self.c * d - self.f * e)

    __invert__ = inverse

    def __call__(self, i, j):
        if isinstance(i, Column) or isinstance(j, Column):  # no terms that are zero: plans stay short
            term = lambda *parts: sum((F.lit(k) * v if k != 1 else v for k, v in parts if k != 0), start=F.lit(0.0) if all(k == 0 for k, _ in parts) else 0)
            return term((self.a, i), (self.b, j)) + F.lit(self.c), term((self.d, i), (self.e, j)) + F.lit(self.f)
        return self.a * i + self.b * j + self.c, self.d * i + self.e * j + self.f

    def coefficients(self) -> tuple[float, ...]:
        return (self.a, self.b, self.c, self.d, self.e, self.f)


@dataclass(frozen=True)
class GridDefinition:
    """A raster grid: CRS name, columns, rows, and the transform from (i, j) to the world."""

    crs: str
    width: int
    height: int
    transform: tuple[float, float, float, float, float, float]

    def __post_init__(self) -> None:
        object.__setattr__(self, "transform", tuple(float(v) for v in self.transform[:6]))

    @property
    def affine(self) -> Affine:
        return Affine(*self.transform)

    @classmethod
    def from_extent(cls, xmin: float, ymin: float, xmax: float, ymax: float, cell_width: float, cell_height: float, crs: str) -> GridDefinition:
        return cls(crs, math.ceil((xmax - xmin) / cell_width), math.ceil((ymax - ymin) / cell_height), (cell_width, 0.0, xmin, 0.0, cell_height, ymin))

    @classmethod
    def from_sidecar(cls, text: str) -> GridDefinition:
        """From the JSON that :func:`to_sidecar` makes."""
        d = json.loads(text)
        if not d.get("crs"):
            raise ValueError("the grid has no CRS")
        return cls(d["crs"], d["width"], d["height"], tuple(d["transform"]))

    def to_sidecar(self) -> str:
        return json.dumps({"crs": self.crs, "width": self.width, "height": self.height, "transform": list(self.transform)})

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        corners = [self.affine(i, j) for i in (0, self.width) for j in (0, self.height)]
        xs, ys = zip(*corners)
        return min(xs), min(ys), max(xs), max(ys)

    def to_cell_space(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.affine.inverse()(x, y)


def cell_indices(grid: GridDefinition, x: Column, y: Column) -> tuple[Column, Column]:
    """Column and row of the cell that holds a point, on the infinite lattice."""
    u, v = grid.to_cell_space(x + F.lit(EPSILON), y + F.lit(EPSILON))
    return F.floor(u), F.floor(v)


def in_grid(grid: GridDefinition, i: Column, j: Column) -> Column:
    return (i >= 0) & (i < grid.width) & (j >= 0) & (j < grid.height)


def bounded_indices(grid: GridDefinition, i: Column, j: Column) -> tuple[Column, Column]:
    """The indices, or ``(-1, -1)`` outside the grid; never null for a point that is not null."""
    inside = in_grid(grid, i, j)
    return F.when(inside, i).otherwise(F.lit(-1).cast("long")), F.when(inside, j).otherwise(F.lit(-1).cast("long"))


def cell_number(grid: GridDefinition, i: Column, j: Column) -> Column:
    return i + j * grid.width


def offset_in_cell(grid: GridDefinition, x: Column, y: Column) -> tuple[Column, Column]:
    ox, oy = grid.affine(*cell_indices(grid, x, y))
    return x - ox, y - oy


def unravel(index: Column, width: int) -> tuple[Column, Column]:
    """Row and column of a flat index (row first)."""
    return F.floor(index / F.lit(width)).cast("long"), F.pmod(index, F.lit(width)).cast("long")


def ravel(row: Column, column: Column, width: int, height: int) -> Column:
    """Flat index of a row and column; raises out of range."""
    inside = (row >= 0) & (row < height) & (column >= 0) & (column < width)
    return F.when(inside, row * width + column).otherwise(F.raise_error(F.lit("the index is outside of the grid")).cast("long"))


def point_indices(grid: GridDefinition, point: Column) -> tuple[Column, Column]:
    return bounded_indices(grid, *cell_indices(grid, point["x"], point["y"]))


def line_indices(grid: GridDefinition, line: Column) -> tuple[Column, Column]:
    """The cell of the centre of a line's bounding box."""
    x, y = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return bounded_indices(grid, *cell_indices(grid, (F.array_min(x) + F.array_max(x)) / 2, (F.array_min(y) + F.array_max(y)) / 2))


def apply_indices(df: DataFrame, grid: GridDefinition, geometry: str = "geometry", kind: str = "line", index_i: str = "index_i", index_j: str = "index_j") -> DataFrame:
    """Adds the cell of each geometry: ``kind`` is point, line or polygon (by its bounding box)."""
    g = F.col(geometry)
    i, j = point_indices(grid, g) if kind == "point" else line_indices(grid, F.flatten(g) if kind == "polygon" else g)
    return df.select("*", i.alias(index_i), j.alias(index_j))


def grid_boxes(spark: SparkSession, grid: GridDefinition) -> DataFrame:
    """All cells: ``cell, i, j, xmin, ymin, xmax, ymax``; numbered along columns of the grid."""
    cells = spark.range(grid.width * grid.height)
    i, j = F.floor(F.col("id") / grid.height).cast("long"), F.pmod(F.col("id"), F.lit(grid.height)).cast("long")
    cells = cells.select(F.col("id").alias("cell"), i.alias("i"), j.alias("j"))
    (x0, y0), (x1, y1) = grid.affine(F.col("i"), F.col("j")), grid.affine(F.col("i") + 1, F.col("j") + 1)
    return cells.select("cell", "i", "j", F.least(x0, x1).alias("xmin"), F.least(y0, y1).alias("ymin"), F.greatest(x0, x1).alias("xmax"), F.greatest(y0, y1).alias("ymax"))
