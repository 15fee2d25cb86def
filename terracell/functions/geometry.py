"""Geometry as plain nested columns.

Point ``struct<x, y>``, line ``array<point>``, polygon ``array<line>`` (ring 0 is the shell, closed
or not). All functions return columns and stay in the JVM, except :func:`geodesic_length`, which
iterates and works on Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from terracell.functions.expr import let, pairs, upto

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"
POLYGON = f"array<{LINE}>"
#: Mean radius of the earth in km; axis and flattening of WGS84.
EARTH_KM = 6371.0
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def length(p: Column, q: Column) -> Column:
    return F.hypot(q["x"] - p["x"], q["y"] - p["y"])


def midpoint(p: Column, q: Column) -> Column:
    return point((p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2)


def bearing(p: Column, q: Column) -> Column:
    return F.atan2(q["x"] - p["x"], q["y"] - p["y"])


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v)


def planar_length(line: Column) -> Column:
    return _total(F.transform(pairs(line), lambda s: length(s["p"], s["q"])))


def haversine(p: Column, q: Column) -> Column:
    """Kilometres between lon/lat points on a sphere."""
    half = lambda v: F.sin(F.radians(v) / 2)
    a = F.pow(half(q["y"] - p["y"]), 2) + F.cos(F.radians(p["y"])) * F.cos(F.radians(q["y"])) * F.pow(half(q["x"] - p["x"]), 2)
    return let(a, lambda v: 2 * EARTH_KM * F.atan2(F.sqrt(v), F.sqrt(1 - v)))


def haversine_length(line: Column) -> Column:
    return _total(F.transform(pairs(line), lambda s: haversine(s["p"], s["q"])))


def vincenty(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Metres between lon/lat points on WGS84, by the inverse formula; near antipodes the last iterate holds."""
    lon1, lat1, lon2, lat2 = (np.radians(np.asarray(v, float)) for v in (lon1, lat1, lon2, lat2))
    b = WGS84_A * (1 - WGS84_F)
    u1, u2 = np.arctan((1 - WGS84_F) * np.tan(lat1)), np.arctan((1 - WGS84_F) * np.tan(lat2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    gap = lon2 - lon1
    lam = gap.copy()
    with np.errstate(all="ignore"):
        for _ in range(200):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cos_s = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, cu1 * cu2 * sl / np.where(sin_s == 0, 1, sin_s))
            cos2a = 1 - sin_a**2
            c2m = np.where(cos2a > 1e-15, cos_s - 2 * su1 * su2 / np.where(cos2a > 1e-15, cos2a, 1), 0.0)
            c = WGS84_F / 16 * cos2a * (4 + WGS84_F * (4 - 3 * cos2a))
            new = gap + (1 - c) * WGS84_F * sin_a * (sigma + c * sin_s * (c2m + c * cos_s * (2 * c2m**2 - 1)))
            done = np.nanmax(np.abs(new - lam), initial=0) < 1e-13
            lam = new
            if done:
                break
        uu = cos2a * (WGS84_A**2 - b**2) / b**2
        big = 1 + uu / 16384 * (4096 + uu * (uu * (320 - 175 * uu) - 768))
        small = uu / 1024 * (256 + uu * (uu * (74 - 47 * uu) - 128))
        turn = small * sin_s * (c2m + small / 4 * (cos_s * (2 * c2m**2 - 1) - small / 6 * c2m * (4 * sin_s**2 - 3) * (4 * c2m**2 - 3)))
    return np.where((lon1 == lon2) & (lat1 == lat2), 0.0, b * big * (sigma - turn))


def geodesic_length(line: Column) -> Column:
    """Metres along a lon/lat line on WGS84; null for a null line."""

    @F.arrow_udf("double")
    def total(lines: pa.Array) -> pa.Array:
        flat = lines.flatten()
        x, y = (np.asarray(flat.field(k), float) for k in range(2))
        size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lines), 0))
        row = np.repeat(np.arange(len(size)), size)
        inner = row[1:] == row[:-1]
        d = np.where(inner, vincenty(x[:-1], y[:-1], x[1:], y[1:]), 0.0) if len(x) > 1 else np.zeros(0)
        sums = np.bincount(row[:-1], d, len(size)) if len(d) else np.zeros(len(size))
        return pa.array(sums, mask=np.asarray(lines.is_null()))

    return total(line)


def _closed(ring: Column) -> Column:
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def _moments(ring: Column) -> Column:
    """Twice the signed area and six times its first moments."""
    cross = lambda s: s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    add = lambda t, s: let(cross(s), lambda w: F.struct((t["a"] + w).alias("a"), (t["mx"] + (s["p"]["x"] + s["q"]["x"]) * w).alias("mx"), (t["my"] + (s["p"]["y"] + s["q"]["y"]) * w).alias("my")))
    return F.aggregate(pairs(_closed(ring)), zero, add)


def ring_area(ring: Column) -> Column:
    """Signed area of a ring, positive when it turns left."""
    return _moments(ring)["a"] / 2


def polygon_area(polygon: Column) -> Column:
    rings = F.transform(polygon, lambda r: F.abs(ring_area(r)))
    return F.element_at(rings, 1) - _total(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))))


def polygon_centroid(polygon: Column) -> Column:
    """Centroid of a polygon, holes taken out; null if it has no area."""
    sums = F.transform(polygon, lambda r: let(_moments(r), lambda m: let(F.signum(m["a"]), lambda g: F.struct((m["a"] * g).alias("a"), (m["mx"] * g).alias("mx"), (m["my"] * g).alias("my")))))
    part = lambda k: let(F.transform(sums, lambda s: s[k]), lambda v: F.element_at(v, 1) - _total(F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0)))))
    return let(F.struct(part("a").alias("a"), part("mx").alias("mx"), part("my").alias("my")), lambda m: F.when(m["a"] != 0, point(m["mx"] / (3 * m["a"]), m["my"] / (3 * m["a"]))))


def line_bounds(line: Column) -> Column:
    """``struct<xmin, ymin, xmax, ymax>``."""
    x, y = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def polygon_bounds(polygon: Column) -> Column:
    return line_bounds(F.element_at(polygon, 1))


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def box_polygon(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.array(F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax), point(xmin, ymin)))


def polygon_edges(polygon: Column) -> Column:
    """The edges of all rings: ``array<struct<p, q>>``."""
    return F.flatten(F.transform(polygon, lambda r: pairs(_closed(r))))


def point_in_polygon(p: Column, polygon: Column) -> Column:
    """Even-odd test over all rings: shells and holes alike. The lower left border is inside."""

    def crossed(s: Column) -> Column:
        a, b = s["p"], s["q"]
        at = a["x"] + (p["y"] - a["y"]) * F.try_divide(b["x"] - a["x"], b["y"] - a["y"])
        return ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < at)

    return F.size(F.filter(polygon_edges(polygon), crossed)) % 2 == 1


def segments_cross(p: Column, q: Column, a: Column, b: Column) -> Column:
    """Whether two segments have a point in common; false for parallel ones."""
    dx, dy, ex, ey = q["x"] - p["x"], q["y"] - p["y"], b["x"] - a["x"], b["y"] - a["y"]
    turn = dx * ey - dy * ex
    t = F.try_divide((a["x"] - p["x"]) * ey - (a["y"] - p["y"]) * ex, turn)
    s = F.try_divide((a["x"] - p["x"]) * dy - (a["y"] - p["y"]) * dx, turn)
    return F.coalesce(t.between(0, 1) & s.between(0, 1), F.lit(False))


def segments_touch(p: Column, q: Column, a: Column, b: Column) -> Column:
    """The same, and true for parallel ones that lie on each other."""
    side = lambda r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    over = lambda c: (F.least(p[c], q[c]) <= F.greatest(a[c], b[c])) & (F.least(a[c], b[c]) <= F.greatest(p[c], q[c]))
    return segments_cross(p, q, a, b) | ((side(a) == 0) & (side(b) == 0) & over("x") & over("y"))


def lines_cross(a: Column, b: Column) -> Column:
    return F.exists(pairs(a), lambda s: F.exists(pairs(b), lambda t: segments_cross(s["p"], s["q"], t["p"], t["q"])))


def line_meets_polygon(line: Column, polygon: Column) -> Column:
    touches = lambda r: F.exists(pairs(line), lambda s: F.exists(pairs(_closed(r)), lambda t: segments_touch(s["p"], s["q"], t["p"], t["q"])))
    return point_in_polygon(F.element_at(line, 1), polygon) | F.exists(polygon, touches)


def ring_is_simple(ring: Column) -> Column:
    """Whether edges that aren't neighbours keep apart, and the ring has an area."""
    edges = pairs(_closed(ring))
    n = F.size(edges)

    def apart(e: Column) -> Column:
        far = lambda i, j: (j > i + 1) & ~((i == 0) & (j == F.size(e) - 1))
        meets = lambda i, j: segments_cross(F.get(e, i)["p"], F.get(e, i)["q"], F.get(e, j)["p"], F.get(e, j)["q"])
        return ~F.exists(F.sequence(F.lit(0), F.size(e) - 1), lambda i: F.exists(F.sequence(F.lit(0), F.size(e) - 1), lambda j: far(i, j) & meets(i, j)))

    return (n >= 3) & (ring_area(ring) != 0) & let(edges, apart)


def almost_equal(x: Column, y: Column, ulps: int = 3) -> Column:
    gap = F.abs(x - y)
    return (gap <= 2.0**-52 * F.abs(x + y) * ulps) | (gap < 2.0**-1022)


def drop_repeats(array: Column) -> Column:
    """The array without entries that equal the one before."""
    return let(array, lambda a: F.filter(a, lambda v, i: (i == 0) | (v != F.get(a, i - 1))))


def round_line(line: Column, digits: int = 9) -> Column:
    return F.transform(line, lambda p: point(F.bround(p["x"], digits), F.bround(p["y"], digits)))


def line_piece_in_box(p: Column, q: Column, box: Column) -> Column:
    """The share ``struct<t0, t1>`` of a segment that a box holds, or null."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]

    def span(d: Column, low: Column, high: Column) -> tuple[Column, Column]:
        a, b = F.try_divide(low, d), F.try_divide(high, d)
        still = (low <= 0) & (high >= 0)
        return F.when(d != 0, F.least(a, b)).otherwise(F.when(still, F.lit(0.0)).otherwise(F.lit(2.0))), F.when(d != 0, F.greatest(a, b)).otherwise(F.when(still, F.lit(1.0)).otherwise(F.lit(-1.0)))

    x0, x1 = span(dx, box["xmin"] - p["x"], box["xmax"] - p["x"])
    y0, y1 = span(dy, box["ymin"] - p["y"], box["ymax"] - p["y"])
    t0, t1 = F.greatest(x0, y0, F.lit(0.0)), F.least(x1, y1, F.lit(1.0))
    return F.when(t0 <= t1, F.struct(t0.alias("t0"), t1.alias("t1")))


def length_in_box(line: Column, box: Column) -> Column:
    return _total(F.transform(pairs(line), lambda s: F.coalesce(let(line_piece_in_box(s["p"], s["q"], box), lambda t: (t["t1"] - t["t0"]) * length(s["p"], s["q"])), F.lit(0.0))))


# Coordinate reference systems


def mercator(p: Column) -> Column:
    """EPSG:4326 to EPSG:3857."""
    return point(F.radians(p["x"]) * WGS84_A, F.log(F.tan(F.lit(math.pi / 4) + F.radians(p["y"]) / 2)) * WGS84_A)


def from_mercator(p: Column) -> Column:
    return point(F.degrees(p["x"] / WGS84_A), F.degrees(2 * F.atan(F.exp(p["y"] / WGS84_A)) - math.pi / 2))


_N = WGS84_F / (2 - WGS84_F)
_RADIUS = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krueger's series to the third power of the third flattening.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_SCALE = 0.9996


def utm(p: Column, zone: int, south: bool = False) -> Column:
    """EPSG:4326 to UTM (EPSG:326xx, or 327xx in the south)."""
    lat, lon = F.radians(p["y"]), F.radians(p["x"] - (6 * zone - 183))
    k = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(lat)) - k * F.atanh(k * F.sin(lat)))
    xi, eta = F.atan2(t, F.cos(lon)), F.atanh(F.sin(lon) / F.sqrt(1 + t * t))
    east = eta + sum(a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(_ALPHA))
    north = xi + sum(a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(_ALPHA))
    return point(500000 + _SCALE * _RADIUS * east, (1e7 if south else 0.0) + _SCALE * _RADIUS * north)


def from_utm(p: Column, zone: int, south: bool = False) -> Column:
    xi, eta = (p["y"] - (1e7 if south else 0.0)) / (_SCALE * _RADIUS), (p["x"] - 500000) / (_SCALE * _RADIUS)
    x1 = xi - sum(b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(_BETA))
    e1 = eta - sum(b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(_BETA))
    chi = F.asin(F.sin(x1) / F.cosh(e1))
    lat = chi + sum(d * F.sin(2 * (j + 1) * chi) for j, d in enumerate(_DELTA))
    return point(6 * zone - 183 + F.degrees(F.atan2(F.sinh(e1), F.cos(x1))), F.degrees(lat))


def reproject(p: Column, source: str, target: str) -> Column:
    """A point in another CRS; equal ones are the identity, pairs without a formula raise."""

    def zone(name: str) -> tuple[int, bool] | None:
        code = name.upper().removeprefix("EPSG:")
        return (int(code[3:]), code[2] == "7") if len(code) == 5 and code[:3] in ("326", "327") and 1 <= int(code[3:]) <= 60 else None

    source, target = source.upper(), target.upper()
    if source == target:
        return p
    if source == "EPSG:3857":
        p = from_mercator(p)
    elif zone(source):
        p = from_utm(p, *zone(source))
    elif source != "EPSG:4326":
        raise ValueError(f"no formula from {source}")
    if target == "EPSG:4326":
        return p
    if target == "EPSG:3857":
        return mercator(p)
    if zone(target):
        return utm(p, *zone(target))
    raise ValueError(f"no formula to {target}")


def reproject_line(line: Column, source: str, target: str) -> Column:
    return line if source.upper() == target.upper() else F.transform(line, lambda p: reproject(p, source, target))


def reproject_geometry(geometry: Column, kind: str, source: str, target: str) -> Column:
    """:func:`reproject` for a point, line or polygon."""
    if source.upper() == target.upper():
        return geometry
    if kind == "point":
        return reproject(geometry, source, target)
    return reproject_line(geometry, source, target) if kind == "line" else F.transform(geometry, lambda r: reproject_line(r, source, target))


def is_box(polygon: Column) -> Column:
    """Whether a polygon is a rectangle along the axes: one ring of four corners that all are corners of its bounds."""
    ring = F.element_at(polygon, 1)

    def fits(b: Column) -> Column:
        corner = lambda p: ((p["x"] == b["xmin"]) | (p["x"] == b["xmax"])) & ((p["y"] == b["ymin"]) | (p["y"] == b["ymax"]))
        return F.forall(ring, corner) & (F.abs(ring_area(ring)) == (b["xmax"] - b["xmin"]) * (b["ymax"] - b["ymin"]))

    return (F.size(polygon) == 1) & (F.size(F.array_distinct(ring)) == 4) & let(polygon_bounds(polygon), fits)


def grid_levels(low: Column, high: Column) -> Column:
    """The integers from ``low`` to ``high`` in grid coordinates."""
    return upto(F.ceil(low), F.floor(high))
