"""Cutting features along a raster grid."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracell.functions.expr import let, pairs, upto
from terracell.functions.geometry import LINE, POLYGON, length, point, reproject_geometry
from terracell.functions.grid import GridDefinition, apply_indices, cell_indices

#: Crossings of both line families that are nearer than this, as a share of the segment, are one corner.
CORNER = 1e-12


# Preparing


def explode_parts(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One row for each part of a multi-geometry; other columns are repeated."""
    return df.withColumn(geometry, F.explode(geometry))


def merge_lines(parts: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Joins parts end to end where exactly two ends meet."""
    lines, ends = [list(p) for p in parts if len(p) > 1], {}
    for k, line in enumerate(lines):
        for p in (line[0], line[-1]):
            ends.setdefault(p, []).append(k)
    done, out = set(), []

    def follow(k: int, end: tuple[float, float]) -> list[tuple[float, float]]:
        path = []
        while True:
            others = [x for x in ends[end] if x != k]
            if len(ends[end]) != 2 or not others or others[0] in done:
                return path
            k = others[0]
            done.add(k)
            line = lines[k] if lines[k][0] == end else lines[k][::-1]
            path += line[1:]
            end = line[-1]

    for k, line in enumerate(lines):
        if k not in done:
            done.add(k)
            after = follow(k, line[-1])
            before = follow(k, line[0])
            out.append(before[::-1] + line + after)
    return out


def merged(parts: Column) -> Column:
    """:func:`merge_lines` over Arrow batches."""

    def run(column: pa.Array) -> pa.Array:
        out = [None if v is None else [[{"x": x, "y": y} for x, y in line] for line in merge_lines([[(p["x"], p["y"]) for p in line] for line in v])] for v in column.to_pylist()]
        return pa.array(out, pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))

    return F.arrow_udf(run, f"array<{LINE}>").asNondeterministic()(parts)  # else it is copied into what explodes it


def prepare_points(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    return explode_parts(df, geometry)


def prepare_lines(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    return explode_parts(df.withColumn(geometry, merged(F.col(geometry))), geometry)


def prepare_polygons(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    return explode_parts(df, geometry)


# Lines


def _family(w0: Column, w1: Column, axis: str) -> Column:
    """Crossings of a segment with the grid lines of one family: ``t`` and the level in its own coordinate."""
    levels = F.when(w0 != w1, upto(F.ceil(F.least(w0, w1)), F.floor(F.greatest(w0, w1)))).otherwise(F.array().cast("array<bigint>"))
    none = F.lit(None).cast("double")
    at = lambda k: F.struct(F.try_divide(k - w0, w1 - w0).alias("t"), (k.cast("double") if axis == "u" else none).alias("u"), (k.cast("double") if axis == "v" else none).alias("v"))
    return F.transform(levels, at)


def crossings(p: Column, q: Column, grid: GridDefinition, bounded: bool = False) -> Column:
    """Where a segment crosses the grid: ``array<struct<t, u, v>>`` in order, ends at ``t = 1`` included.

    ``u, v`` are cell coordinates; the one of the crossed family is exactly an integer.
    """

    def found(s: Column) -> Column:
        both = F.array_sort(F.concat(_family(s["u0"], s["u1"], "u"), _family(s["v0"], s["v1"], "v")))
        both = F.filter(both, lambda c: (c["t"] > 0) & (c["t"] <= 1))
        near = lambda a, b: F.coalesce(b["t"] - a["t"] <= CORNER, F.lit(False))

        def place(c: Column, other: Column) -> Column:
            t = F.when(c["t"] >= 1 - CORNER, F.lit(1.0)).otherwise(c["t"])
            level = lambda k: F.coalesce(c[k], F.when(near(c, other), other[k]))
            return F.struct(t.alias("t"), F.coalesce(level("u"), s["u0"] + t * (s["u1"] - s["u0"])).alias("u"), F.coalesce(level("v"), s["v0"] + t * (s["v1"] - s["v0"])).alias("v"))

        single = lambda a: F.transform(
            F.filter(upto(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | ~near(F.get(a, (i - 1).cast("int")), F.get(a, i.cast("int")))),
            lambda i: place(F.get(a, i.cast("int")), F.get(a, (i + 1).cast("int"))),
        )
        cuts = let(both, single)
        return F.filter(cuts, lambda c: c["u"].between(0, grid.width) & c["v"].between(0, grid.height)) if bounded else cuts

    u0, v0 = grid.to_cell_space(p["x"], p["y"])
    u1, v1 = grid.to_cell_space(q["x"], q["y"])
    (i0, j0), (i1, j1) = cell_indices(grid, p["x"], p["y"]), cell_indices(grid, q["x"], q["y"])
    none = F.array().cast("array<struct<t:double,u:double,v:double>>")
    ends = F.struct(u0.alias("u0"), v0.alias("v0"), u1.alias("u1"), v1.alias("v1"))
    return F.when((i0 == i1) & (j0 == j1), none).otherwise(let(ends, found))


def split_line(line: Column, grid: GridDefinition, bounded: bool = False) -> Column:
    """The pieces of a line: ``array<line>``. Original vertices are kept."""

    def vertices(s: Column) -> Column:
        def with_cuts(cuts: Column) -> Column:
            world = F.transform(F.filter(cuts, lambda c: c["t"] < 1), lambda c: F.struct(point(*grid.affine(c["u"], c["v"])).alias("at"), F.lit(True).alias("cut")))
            end = F.struct(s["q"].alias("at"), F.exists(cuts, lambda c: c["t"] >= 1).alias("cut"))
            return F.concat(world, F.array(end))

        return let(crossings(s["p"], s["q"], grid, bounded), with_cuts)

    def pieces(stream: Column) -> Column:
        n = F.size(stream)
        bounds = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (i == n - 1) | F.get(stream, i)["cut"])
        part = lambda b: F.transform(pairs(b), lambda s: F.transform(F.slice(stream, s["p"] + 1, s["q"] - s["p"] + 1), lambda v: v["at"]))
        return F.when(n < 2, F.array(F.transform(stream, lambda v: v["at"]))).otherwise(let(bounds, part))

    start = F.transform(F.slice(line, 1, 1), lambda p: F.struct(p.alias("at"), F.lit(False).alias("cut")))
    return let(F.concat(start, F.flatten(F.transform(pairs(line), vertices))), pieces)


def split_lines(df: DataFrame, grid: GridDefinition, bounded: bool = False, geometry: str = "geometry", ordinal: str = "split") -> DataFrame:
    """One row a piece: attributes repeated, ``split`` counts from 0."""
    rest = [c for c in df.columns if c not in (geometry, ordinal)]
    return df.select(*rest, F.posexplode(split_line(F.col(geometry), grid, bounded)).alias(ordinal, geometry))


def split_points(df: DataFrame, grid: GridDefinition | None = None) -> DataFrame:
    """Points have one cell each."""
    return df


def segment_pieces(df: DataFrame, grid: GridDefinition, ids: list[str], bounded: bool = False, geometry: str = "geometry") -> DataFrame:
    """The flat form for long lines: ``ids, segment, t0, t1, i, j, length`` for each run within a cell.

    Nothing is regrouped, so a line with millions of pieces is spread over rows.
    """
    s = df.select(*ids, F.posexplode(pairs(F.col(geometry))).alias("segment", "s"))
    p, q = F.col("s.p"), F.col("s.q")
    inner = F.transform(F.filter(crossings(p, q, grid, bounded), lambda c: c["t"] < 1), lambda c: c["t"])
    s = s.select(*ids, "segment", p.alias("p"), q.alias("q"), F.explode(pairs(F.concat(F.array(F.lit(0.0)), inner, F.array(F.lit(1.0))))).alias("t"))
    p, q, mid = F.col("p"), F.col("q"), (F.col("t.p") + F.col("t.q")) / 2
    i, j = cell_indices(grid, p["x"] + mid * (q["x"] - p["x"]), p["y"] + mid * (q["y"] - p["y"]))
    return s.select(*ids, "segment", F.col("t.p").alias("t0"), F.col("t.q").alias("t1"), i.alias("i"), j.alias("j"), ((F.col("t.q") - F.col("t.p")) * length(p, q)).alias("length"))


def segment_meets_grid(p: Column, q: Column, grid: GridDefinition) -> Column:
    """Whether a segment has a point in the grid's extent, borders included."""
    u0, v0 = grid.to_cell_space(p["x"], p["y"])
    u1, v1 = grid.to_cell_space(q["x"], q["y"])
    from terracell.functions.geometry import line_piece_in_box

    box = F.struct(F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.lit(float(grid.width)).alias("xmax"), F.lit(float(grid.height)).alias("ymax"))
    return line_piece_in_box(point(u0, v0), point(u1, v1), box).isNotNull()


def point_in_extent(p: Column, grid: GridDefinition) -> Column:
    u, v = grid.to_cell_space(p["x"], p["y"])
    return u.between(0, grid.width) & v.between(0, grid.height)


# Polygons


def _keep(d: float) -> bool:
    return d >= 0


def _half(rings: list[list[tuple[float, float]]], axis: int, level: float, above: bool) -> list[list[tuple[float, float]]]:
    """The rings on one side of a grid line. Chains are closed along the line, neighbours in order."""
    out, chains = [], []
    inside = lambda p: _keep(p[axis] - level) == above
    for ring in rings:
        flags = [inside(p) for p in ring]
        if all(flags):
            out.append(ring)
            continue
        if not any(flags):
            continue
        n = len(ring)
        start = next(k for k in range(n) if not flags[k - 1] and flags[k])
        chain: list[tuple[float, float]] = []
        for step in range(n):
            k = (start + step) % n
            a, b = ring[k - 1], ring[k]
            if flags[k - 1] != flags[k]:
                t = (level - a[axis]) / (b[axis] - a[axis])
                other = a[1 - axis] + t * (b[1 - axis] - a[1 - axis])
                cut = (level, other) if axis == 0 else (other, level)
                if flags[k]:
                    chain = [cut, b]
                else:
                    chains.append([*chain, cut])
            elif flags[k]:
                chain.append(b)
    # Along the line, ends pair up two by two: between the two of a pair lies the polygon.
    ends = sorted(((c[-1 if last else 0][1 - axis], last, k) for k, c in enumerate(chains) for last in (0, 1)))
    mate = {}
    for x, y in zip(ends[::2], ends[1::2]):
        mate[x[1:]], mate[y[1:]] = y[1:], x[1:]
    used: set[int] = set()
    for k in range(len(chains)):
        if k in used:
            continue
        ring, now, forward = [], k, True
        while True:
            used.add(now)
            ring += chains[now] if forward else chains[now][::-1]
            last, now = mate[(1 if forward else 0, now)]
            forward = last == 0
            if now in used:
                break
        out.append(ring)
    return out


def _clean(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    return [p for k, p in enumerate(ring) if p != ring[k - 1]]


def _area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def _within(p: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    odd = False
    for a, b in zip(ring, ring[1:] + ring[:1]):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
            odd = not odd
    return odd


def clip_to_cells(rings: list[list[tuple[float, float]]], width: int, height: int) -> list[tuple[int, int, list[list[tuple[float, float]]]]]:
    """Polygon in cell coordinates to ``(i, j, polygon)``, shells before their holes. First columns are cut, then rows."""
    import math

    rings = [_clean(r[:-1] if len(r) > 1 and r[0] == r[-1] else r) for r in rings]
    rings = [r for r in rings if len(r) > 2]
    out = []
    if not rings:
        return out
    span = lambda rs, axis, top: range(max(0, math.floor(min(p[axis] for r in rs for p in r))), min(top, math.floor(max(p[axis] for r in rs for p in r)) + 1))
    for i in span(rings, 0, width):
        column = _half(_half(rings, 0, float(i), True), 0, float(i + 1), False)
        if not column:
            continue
        for j in span(column, 1, height):
            cell = [_clean(r) for r in _half(_half(column, 1, float(j), True), 1, float(j + 1), False)]
            cell = sorted((r for r in cell if len(r) > 2 and abs(_area(r)) > 1e-14), key=lambda r: -abs(_area(r)))
            shells: list[list] = []
            for r in cell:  # the largest come first, so a hole finds its shell
                middle = ((r[0][0] + r[1][0]) / 2, (r[0][1] + r[1][1]) / 2)
                holder = next((s for s in shells if _within(middle, s[0]) and abs(_area(r)) < abs(_area(s[0]))), None)
                if holder is None:
                    shells.append([r])
                else:
                    holder.append(r)
            out += [(i, j, s) for s in shells]
    return out


def split_polygons(df: DataFrame, grid: GridDefinition, geometry: str = "geometry", ordinal: str = "split") -> DataFrame:
    """One row for each part of a polygon within a cell of the grid, with ``split``; parts outside are dropped.

    Only cells in the polygon's bounds are visited. Curved borders aside, areas add up.
    """
    kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    affine, inverse, width, height = grid.affine, grid.affine.inverse(), grid.width, grid.height

    @F.arrow_udf(f"array<{POLYGON}>")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for rings in column.to_pylist():
            if rings is None:
                out.append(None)
                continue
            cells = clip_to_cells([[inverse(p["x"], p["y"]) for p in r] for r in rings], width, height)
            world = lambda r: [{"x": x, "y": y} for x, y in (affine(u, v) for u, v in r + r[:1])]
            out.append([[world(r) for r in part] for _, _, part in cells])
        return pa.array(out, kind)

    rest = [c for c in df.columns if c not in (geometry, ordinal)]
    return df.select(*rest, F.posexplode(run(F.col(geometry))).alias(ordinal, geometry))


def ring_gridlines(ring: Column, grid: GridDefinition, axis: int) -> Column:
    """The parts of one family of grid lines inside a ring, cut at the other: ``array<line>``.

    ``axis`` 0: lines of constant column, 1: of constant row. An odd number of crossings raises.
    """
    closed = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    own = lambda p: let(F.struct(*(c.alias(n) for c, n in zip(grid.to_cell_space(p["x"], p["y"]), "uv"))), lambda s: s["uv"[axis]])
    other = lambda p: let(F.struct(*(c.alias(n) for c, n in zip(grid.to_cell_space(p["x"], p["y"]), "uv"))), lambda s: s["uv"[1 - axis]])

    def cut(edges: Column) -> Column:
        values = F.transform(edges, lambda e: e["a"])
        levels = upto(F.ceil(F.array_min(values)), F.floor(F.array_max(values)))

        def at_level(k: Column) -> Column:
            hit = F.filter(edges, lambda e: (e["a"] >= k) != (e["b"] >= k))  # a vertex on the line belongs above
            at = F.array_sort(F.transform(hit, lambda e: e["c"] + (k - e["a"]) * F.try_divide(e["d"] - e["c"], e["b"] - e["a"])))
            place = lambda o: point(*(grid.affine(k.cast("double"), o) if axis == 0 else grid.affine(o, k.cast("double"))))
            spans = lambda a: F.transform(upto(F.lit(0), F.size(a) / 2 - 1), lambda n: F.array(place(F.get(a, (2 * n).cast("int"))), place(F.get(a, (2 * n + 1).cast("int")))))
            odd = F.raise_error(F.lit("a grid line crosses the ring an odd number of times")).cast(f"array<{LINE}>")
            return F.when(F.size(at) % 2 == 1, odd).otherwise(let(at, spans))

        lines = F.flatten(F.transform(levels, at_level))
        lines = F.filter(lines, lambda x: F.element_at(x, 1) != F.element_at(x, 2))
        return F.flatten(F.transform(lines, lambda x: split_line(x, grid)))

    edges = F.transform(pairs(closed), lambda s: F.struct(own(s["p"]).alias("a"), own(s["q"]).alias("b"), other(s["p"]).alias("c"), other(s["q"]).alias("d")))
    return let(edges, cut)


def split_ring(ring: Column, grid: GridDefinition) -> Column:
    """The pieces of a ring and of the grid lines inside it, as lines."""
    closed = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    return F.concat(split_line(closed, grid), ring_gridlines(ring, grid, 1), ring_gridlines(ring, grid, 0))


# Several grids


def split_for_grids(df: DataFrame, grids: list[GridDefinition], kind: str = "line", crs: str | None = None, geometry: str = "geometry", bounded: bool = False, splitter: Callable | None = None) -> DataFrame:
    """Cuts by each grid in turn; adds ``i_k, j_k`` for grid ``k``, and ``split_k`` where features are cut.

    Features are taken from ``crs`` to the CRS of each grid and back. ``splitter(df, grid)`` replaces the cutting.
    Indices of earlier grids hold for all pieces of a piece.
    """
    for k, grid in enumerate(grids):
        source = crs or grid.crs
        if source.upper() != grid.crs.upper():
            df = df.withColumn(geometry, reproject_geometry(F.col(geometry), kind, source, grid.crs))
        if splitter is not None:
            df = splitter(df, grid)
        elif kind == "line":
            df = split_lines(df, grid, bounded, geometry)
        elif kind == "polygon":
            df = split_polygons(df, grid, geometry)
        if "split" in df.columns:
            df = df.withColumn(f"split_{k}", F.col("split"))
        df = apply_indices(df, grid, geometry, kind, f"i_{k}", f"j_{k}")
        if source.upper() != grid.crs.upper():
            df = df.withColumn(geometry, reproject_geometry(F.col(geometry), kind, grid.crs, source))
    return df


def renumber(df: DataFrame, ids: list[str], order: list[str], ordinal: str = "split") -> DataFrame:
    """Pieces of a feature numbered over all grids."""
    return df.withColumn(ordinal, F.row_number().over(W.partitionBy(*ids).orderBy(*order)) - 1)
