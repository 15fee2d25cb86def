"""Joins between features by place.

Candidates meet on tiles: each side is listed under every tile that its bounding box covers, the
sides are joined on the tile, and a pair is kept in the one tile that holds the lower left corner of
the boxes' common part, so nothing has to be made distinct. Then the exact predicate decides. A tile
join is an equi-join: skewed tiles are split at run time, and no side is broadcast unless the
planner finds it small.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from terracell.functions import geometry as g
from terracell.functions.expr import let, upto


def _tiles(low: Column, high: Column, size: float) -> Column:
    return upto(F.floor(low / size), F.floor(high / size))


def with_tiles(df: DataFrame, box: Column, size: float, prefix: str) -> DataFrame:
    """Adds ``{prefix}box, {prefix}tx, {prefix}ty`` with one row for each covered tile."""
    out = df.withColumn(f"{prefix}box", box)
    b = F.col(f"{prefix}box")
    out = out.withColumn(f"{prefix}tx", F.explode(_tiles(b["xmin"], b["xmax"], size)))
    return out.withColumn(f"{prefix}ty", F.explode(_tiles(b["ymin"], b["ymax"], size)))


def point_box(p: Column) -> Column:
    return F.struct(p["x"].alias("xmin"), p["y"].alias("ymin"), p["x"].alias("xmax"), p["y"].alias("ymax"))


def tile_join(left: DataFrame, right: DataFrame, left_box: Column, right_box: Column, size: float, predicate: Column | None = None) -> DataFrame:
    """Pairs whose boxes meet and that satisfy the predicate. The sides' columns must have different names."""
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    a, b = with_tiles(left, left_box, size, "_l"), with_tiles(right, right_box, size, "_r")
    pairs = a.join(b, (F.col("_ltx") == F.col("_rtx")) & (F.col("_lty") == F.col("_rty")))
    home = (F.floor(F.greatest("_lbox.xmin", "_rbox.xmin") / size) == F.col("_ltx")) & (F.floor(F.greatest("_lbox.ymin", "_rbox.ymin") / size) == F.col("_lty"))
    pairs = pairs.where(g.boxes_meet(F.col("_lbox"), F.col("_rbox")) & home)
    if predicate is not None:
        pairs = pairs.where(predicate)
    return pairs.drop("_lbox", "_ltx", "_lty", "_rbox", "_rtx", "_rty")


def prune_by_extent(df: DataFrame, box: Column, other: DataFrame, other_box: Column) -> DataFrame:
    """Rows whose box meets the whole extent of the other side (four figures, read first)."""
    e = other.agg(F.min(other_box["xmin"]), F.min(other_box["ymin"]), F.max(other_box["xmax"]), F.max(other_box["ymax"])).first()
    if e[0] is None:
        return df.limit(0)
    return df.where((box["xmin"] <= e[2]) & (box["xmax"] >= e[0]) & (box["ymin"] <= e[3]) & (box["ymax"] >= e[1]))


def edges_in_polygons(edges: DataFrame, polygons: DataFrame, size: float, line: str = "line", polygon: str = "polygon", out: str = "length", clip: Callable[[Column, Column], Column] | None = None, short: float | None = None) -> DataFrame:
    """Pairs of lines and polygons that meet, with the length inside.

    ``clip(line, polygon)`` gives the length; by default it is exact for any polygon, holes included.
    Lines no longer than ``short`` get length 0.
    """
    l, p = F.col(line), F.col(polygon)
    if clip is None:  # what the clip needs of a polygon is found once a polygon
        polygons = polygons.withColumns({"_is_box": g.is_box(p), "_bounds": g.polygon_bounds(p), "_edges": g.polygon_edges(p)})
    inside = clip(l, p) if clip else F.when(F.col("_is_box"), g.length_in_box(l, F.col("_bounds"))).otherwise(_length_inside(l, F.col("_edges")))
    some = lambda v: F.array(F.struct((F.when(g.planar_length(l) <= short, F.lit(0.0)).otherwise(v) if short is not None else v).alias("v")))
    found = F.when(g.line_meets_polygon(l, p), some(inside))
    if clip is None:  # a segment and a box need no arrays
        a, b = F.get(l, 0), F.get(l, 1)
        piece = g.line_piece_in_box(a, b, F.col("_bounds"))
        found = F.when(F.col("_is_box") & (F.size(l) == 2), F.when(piece.isNotNull(), some((piece["t1"] - piece["t0"]) * g.length(a, b)))).otherwise(found)
    # the list keeps this out of the join's condition, which is compiled without it
    pairs = tile_join(edges, polygons, g.line_bounds(l), g.polygon_bounds(p), size).withColumn("_found", found)
    pairs = pairs.withColumn("_found", F.explode_outer("_found")).where("_found is not null")
    return pairs.withColumn(out, F.col("_found.v")).drop("_is_box", "_bounds", "_edges", "_found")


def length_in_polygon(line: Column, polygon: Column) -> Column:
    """Length of a line inside any polygon: cut at all crossings, pieces kept by their midpoints."""
    return let(g.polygon_edges(polygon), lambda edges: _length_inside(line, edges))


def _length_inside(line: Column, edges: Column) -> Column:
    def one(s: Column) -> Column:
        p, q = s["p"], s["q"]

        def at(e: Column) -> Column:
            dx, dy, ex, ey = q["x"] - p["x"], q["y"] - p["y"], e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
            return F.try_divide((e["p"]["x"] - p["x"]) * ey - (e["p"]["y"] - p["y"]) * ex, dx * ey - dy * ex)

        def odd(t: Column) -> Column:
            x, y = p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"])
            passed = lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < e["p"]["x"] + (y - e["p"]["y"]) * F.try_divide(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]))
            return F.size(F.filter(edges, passed)) % 2 == 1

        cuts = F.filter(F.transform(edges, at), lambda t: (t > 0) & (t < 1))
        spans = let(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts))), g.pairs)
        inside = F.filter(spans, lambda t: let((t["p"] + t["q"]) / 2, odd))
        return F.aggregate(inside, F.lit(0.0), lambda a, t: a + t["q"] - t["p"]) * g.length(p, q)

    return F.aggregate(F.transform(g.pairs(line), one), F.lit(0.0), lambda a, v: a + v)


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, point: str = "point", polygon: str = "polygon", bbox_only: bool = False) -> DataFrame:
    """Pairs of points and polygons that hold them."""
    p, q = F.col(point), F.col(polygon)
    return tile_join(points, polygons, point_box(p), g.polygon_bounds(q), size, None if bbox_only else g.point_in_polygon(p, q))


def exposed_points(points: DataFrame, polygons: DataFrame, size: float, key: str, point: str = "point", polygon: str = "polygon", bbox_only: bool = False) -> DataFrame:
    """Points that some polygon holds, each once."""
    hit = points_in_polygons(points.select(key, point), polygons.select(polygon), size, point, polygon, bbox_only)
    return points.join(hit.select(key).distinct(), key, "left_semi")


def first_match(points: DataFrame, polygons: DataFrame, size: float, key: str, value: str, order: str, point: str = "point", polygon: str = "polygon") -> DataFrame:
    """Adds a polygon's value: of those that hold the point, the one with the least ``order``; null without any."""
    hit = points_in_polygons(points.select(key, point), polygons.select(value, order, polygon), size, point, polygon)
    return points.join(hit.groupBy(key).agg(F.min_by(value, order).alias(value)), key, "left")


#: Places in the fullest tile at the end of a search, and levels of tiles; four times as fine at each level.
LEAF_PLACES, LEVELS = 32, 24
#: Distinct places up to which they are sent to the executors; boxes that a box holds there, boxes that are tried together, points that a task remembers.
BROADCAST_PLACES, GROUP, TOGETHER, REMEMBERED = 250_000, 4, 1 << 18, 1 << 16


def _gap(dx: Column, dy: Column) -> Column:
    """Distance, alike for all differences with the same sum of squares where these neither overflow nor vanish."""
    s = dx * dx + dy * dy
    return F.when(s.between(1e-280, 1e280), F.sqrt(s)).otherwise(F.hypot(dx, dy))


def _finite(p: Column) -> Column:
    return (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf"))


def _gaps(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """:func:`_gap` of arrays."""
    s = dx * dx + dy * dy
    out = np.sqrt(s)
    odd = ~((s >= 1e-280) & (s <= 1e280))
    out[odd] = np.hypot(dx[odd], dy[odd])
    return out


class Places:
    """Distinct places, halved by x and y in turn, under boxes of ``GROUP`` places or boxes each."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
        n, cell, turn = len(x), GROUP, 0
        while cell < n:
            cell *= 2
        order = np.arange(n)
        while cell > GROUP:
            order = order[np.lexsort(((x, y)[turn % 2][order], np.arange(n) // cell))]
            cell, turn = cell // 2, turn + 1
        x, y, self.ids = x[order], y[order], ids[order]
        self.boxes = [(x, y, x, y)]
        while len(self.boxes[-1][0]) > 1:
            starts = np.arange(0, len(self.boxes[-1][0]), GROUP)
            self.boxes.append(tuple(f.reduceat(b, starts) for f, b in zip((np.minimum, np.minimum, np.maximum, np.maximum), self.boxes[-1])))

    def nearest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id of the nearest place of each point, the least of those at its distance, and the distance."""
        if not len(x):
            return self.ids[:0], np.zeros(0)
        with np.errstate(over="ignore", under="ignore"):
            return self._down(x, y, np.arange(len(x)), np.zeros(len(x), np.int64), len(self.boxes) - 1)

    def _down(self, x: np.ndarray, y: np.ndarray, of: np.ndarray, box: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """From boxes of a level and the points that they are kept for (in order) to those points' ids and distances."""
        first = lambda v: np.append(True, v[1:] != v[:-1])
        while True:
            if len(of) * GROUP > TOGETHER and of[0] != of[-1]:
                cut = np.searchsorted(of, of[len(of) // 2]) or np.searchsorted(of, of[0], "right")
                return tuple(map(np.concatenate, zip(*(self._down(x, y, of[part], box[part], level) for part in (slice(cut), slice(cut, None))))))
            x0, y0, x1, y1 = self.boxes[level]
            dx0, dy0, dx1, dy1 = x0[box] - x[of], y0[box] - y[of], x[of] - x1[box], y[of] - y1[box]
            low = _gaps(np.maximum(np.maximum(dx0, dx1), 0.0), np.maximum(np.maximum(dy0, dy1), 0.0))
            if not level:
                order = np.lexsort((self.ids[box], low, of))
                best = order[first(of[order])]
                return self.ids[box[best]], low[best]
            high = _gaps(np.maximum(np.abs(dx0), np.abs(dx1)), np.maximum(np.abs(dy0), np.abs(dy1)))
            new = first(of)
            keep = low <= np.minimum.reduceat(high, np.flatnonzero(new))[np.cumsum(new) - 1] * (1 + 1e-12)
            of, box, level = np.repeat(of[keep], GROUP), (box[keep][:, None] * GROUP + np.arange(GROUP)).ravel(), level - 1
            there = box < len(self.boxes[level][0])
            of, box = of[there], box[there]


def _few_places(places: DataFrame, x: Column, y: Column) -> Column | None:
    """``id, distance`` of the nearest place as a column, or None if there are more than ``BROADCAST_PLACES`` or ids are no integers."""
    if not isinstance(places.schema["_id"].dataType, IntegralType) or {places.schema[c].dataType.simpleString() for c in ("_nx", "_ny")} != {"double"}:
        return None
    held = places.limit(BROADCAST_PLACES + 1).toArrow()
    if held.num_rows > BROADCAST_PLACES or held.column("_id").null_count:
        return None
    if not held.num_rows:
        return F.lit(None).cast("struct<id:bigint,distance:double>")
    shared = places.sparkSession.sparkContext.broadcast(Places(*(held.column(c).to_numpy() for c in ("_nx", "_ny")), held.column("_id").to_numpy().astype(np.int64)))

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known, ids, gaps = np.zeros(0, complex), np.zeros(0, np.int64), np.zeros(0)  # points answered before, in order
        for at in columns:
            at = np.stack([pc.fill_null(c, math.nan).to_numpy(zero_copy_only=False) for c in at], 1)
            fine = np.isfinite(at).all(1)
            asked, place = np.unique(at[fine].view(complex).ravel(), return_inverse=True)
            if len(known) > REMEMBERED:
                known, ids, gaps = known[:0], ids[:0], gaps[:0]
            new = asked[~np.isin(asked, known)]
            more = shared.value.nearest(new.real, new.imag)
            known, ids, gaps = (np.concatenate(x) for x in zip((known, ids, gaps), (new, *more)))
            order = np.argsort(known)
            known, ids, gaps = known[order], ids[order], gaps[order]
            row = np.zeros(len(fine), np.int64)
            row[fine] = np.searchsorted(known, asked)[place]
            yield pa.StructArray.from_arrays([pa.array(np.append(x, 0)[row], mask=~fine) for x in (ids, gaps)], ["id", "distance"])

    run.__annotations__ = {"columns": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returnType="struct<id:bigint,distance:double>").asNondeterministic()(x, y)


def nearest(points: DataFrame, nodes: DataFrame, key: str, node_key: str, size: float, point: str = "point", node: str = "node") -> DataFrame:
    """Adds ``node_key`` and ``distance`` of the nearest node; equal distances go to the least key.

    Distinct places are searched: the least key of a place stands for its nodes. No more than
    ``BROADCAST_PLACES`` with integer keys are sent to the executors, which search them where the points are.
    Otherwise distinct points are searched by joins: tiles of ``size`` times powers of four are refined until the fullest holds few places. A place descends through
    them from the widest, and keeps the tiles whose places' box is no farther than the farthest corner of
    any other's. Points that are null or not finite get nulls, nodes of that kind are never nearest.
    """
    from terracell.sources.shared import ensure_checkpoint_dir

    ensure_checkpoint_dir(points.sparkSession)
    n, p = F.col(node), F.col(point)
    places = nodes.where(_finite(n)).groupBy(n["x"].alias("_nx"), n["y"].alias("_ny")).agg(F.min(node_key).alias("_id"))
    if {t for _, t in points.select(p["x"], p["y"]).dtypes} == {"double"} and (near := _few_places(places, p["x"], p["y"])) is not None:
        kind = nodes.schema[node_key].dataType
        return points.withColumn("_near", near).withColumns({node_key: F.col("_near.id").cast(kind), "distance": F.col("_near.distance")}).drop("_near")
    places = places.checkpoint()
    x0, y0, x1, y1 = places.agg(F.min("_nx"), F.min("_ny"), F.max("_nx"), F.max("_ny")).first()
    if x0 is None:
        return points.withColumns({node_key: F.lit(None).cast(nodes.schema[node_key].dataType), "distance": F.lit(None).cast("double")})
    width = size
    while width < max(x1 - x0, y1 - y0) < float("inf"):
        width *= 4
    for depth in range(1, LEVELS + 1):
        tile = lambda c, low: F.least(F.floor((F.col(c) - low) / width * 4.0**depth), F.lit(4**depth - 1))  # noqa: B023, E731
        leaves = places.withColumns({"_x": tile("_nx", x0), "_y": tile("_ny", y0)})
        if leaves.groupBy("_x", "_y").count().agg(F.max("count")).first()[0] <= LEAF_PLACES:
            break

    def tiles(level: int) -> DataFrame:
        """The tiles of a level, the tile above and the box of a tile's places."""
        at = leaves.groupBy(*(F.shiftright(c, 2 * (depth - level)).alias(c) for c in ("_x", "_y")))
        at = at.agg(F.min("_nx").alias("_x0"), F.min("_ny").alias("_y0"), F.max("_nx").alias("_x1"), F.max("_ny").alias("_y1"))
        return at.withColumns({"_ux": F.shiftright("_x", 2), "_uy": F.shiftright("_y", 2)})

    beyond = lambda c, low, high: F.greatest(F.col(low) - F.col(c), F.col(c) - F.col(high), F.lit(0.0))
    across = lambda c, low, high: F.greatest(F.abs(F.col(c) - F.col(low)), F.abs(F.col(c) - F.col(high)))
    asked = points.where(_finite(p)).select(p["x"].alias("_px"), p["y"].alias("_py")).distinct()
    left = asked.withColumns({"_ux": F.lit(0).cast("long"), "_uy": F.lit(0).cast("long")})
    for level in range(1, depth + 1):
        left = left.join(tiles(level), ["_ux", "_uy"])
        left = left.withColumns({"_low": _gap(beyond("_px", "_x0", "_x1"), beyond("_py", "_y0", "_y1")), "_high": _gap(across("_px", "_x0", "_x1"), across("_py", "_y0", "_y1"))})
        left = left.withColumn("_high", F.min("_high").over(Window.partitionBy("_px", "_py")))
        left = left.where(F.col("_low") <= F.col("_high") * (1 + 1e-12)).select("_px", "_py", F.col("_x").alias("_ux"), F.col("_y").alias("_uy"))
        if level % 4 == 0:
            left = left.checkpoint()
    gap = _gap(F.col("_px") - F.col("_nx"), F.col("_py") - F.col("_ny"))
    best = left.join(leaves, (F.col("_ux") == F.col("_x")) & (F.col("_uy") == F.col("_y"))).groupBy("_px", "_py").agg(F.min(F.struct(gap.alias("distance"), F.col("_id").alias("id"))).alias("_b"))
    found = best.select("_px", "_py", F.col("_b.id").alias(node_key), F.col("_b.distance").alias("distance"))
    return points.join(found, (p["x"] == F.col("_px")) & (p["y"] == F.col("_py")), "left").drop("_px", "_py")


def within_else_nearest(points: DataFrame, regions: DataFrame, nodes: DataFrame, key: str, value: str, size: float, point: str = "point", polygon: str = "polygon", node: str = "node") -> DataFrame:
    """Adds the value of the region that holds a point, or else of the nearest node."""
    inside = points_in_polygons(points.select(key, point), regions.select(value, polygon), size, point, polygon).groupBy(key).agg(F.min(value).alias("_in"))
    rest = nearest(points.join(inside, key, "left_anti").select(key, point), nodes, key, value, size, point, node).select(key, F.col(value).alias("_near"))
    both = points.join(inside, key, "left").join(rest, key, "left")
    return both.withColumn(value, F.coalesce("_in", "_near")).drop("_in", "_near")


def match_regions(lines: DataFrame, regions: DataFrame, key: str, value: str, size: float, line: str = "line", polygon: str = "polygon") -> DataFrame:
    """Adds the region of each line: that of its box's centre, or else the first that its box meets."""
    box = g.line_bounds(F.col(line))
    keyed = lines.select(key, box.alias("_b"))
    centre = keyed.select(key, g.point((F.col("_b.xmin") + F.col("_b.xmax")) / 2, (F.col("_b.ymin") + F.col("_b.ymax")) / 2).alias("_c"))
    inside = points_in_polygons(centre, regions.select(value, polygon), size, "_c", polygon).groupBy(key).agg(F.min(value).alias(value))
    rest = keyed.join(inside, key, "left_anti")
    met = tile_join(rest, regions.select(value, polygon), F.col("_b"), g.polygon_bounds(F.col(polygon)), size).groupBy(key).agg(F.min(value).alias(value))
    return lines.join(inside.unionByName(met), key, "left")
