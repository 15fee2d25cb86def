"""Line and polygon cutting against known pieces, and properties."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terracell.functions import geometry as g
from terracell.functions.grid import Affine, GridDefinition, apply_indices, grid_boxes
from terracell.operators import split

UNIT2 = GridDefinition("EPSG:32630", 2, 2, (1, 0, 0, 0, 1, 0))
UNIT4 = GridDefinition("EPSG:32630", 4, 4, (1, 0, 0, 0, 1, 0))
NORTH = GridDefinition("EPSG:32630", 10000, 10000, (90, 0, 132165, 0, -90, 2055230))
FINE = GridDefinition("EPSG:27700", 120163, 259542, (5, 0, 54675, 0, -5, 1217320))


def pieces(spark, line, grid, bounded=False):
    df = spark.createDataFrame([(1, [(float(x), float(y)) for x, y in line])], f"id int, geometry {g.LINE}")
    rows = apply_indices(split.split_lines(df, grid, bounded), grid).orderBy("split").collect()
    return [[(p.x, p.y) for p in r.geometry] for r in rows], [(r.index_i, r.index_j) for r in rows]


CASES = {
    "three cells": ([(0.5, 0.5), (0.75, 0.5), (1.5, 0.5), (1.5, 1.5)], [[(0.5, 0.5), (0.75, 0.5), (1, 0.5)], [(1, 0.5), (1.5, 0.5), (1.5, 1)], [(1.5, 1), (1.5, 1.5)]]),
    "slanted": ([(0.5, 0.5), (0.75, 0.5), (1.5, 1.5)], [[(0.5, 0.5), (0.75, 0.5), (1, 0.8333333)], [(1, 0.8333333), (1.125, 1)], [(1.125, 1), (1.5, 1.5)]]),
    "starts on a line": ([(1, 0.5), (1.5, 1), (1.5, 2)], [[(1, 0.5), (1.5, 1)], [(1.5, 1), (1.5, 2)]]),
    "through a corner": ([(0.5, 0.5), (1.5, 1.5)], [[(0.5, 0.5), (1, 1)], [(1, 1), (1.5, 1.5)]]),
    "along a line": ([(0.5, 1), (2.5, 1)], [[(0.5, 1), (1, 1)], [(1, 1), (2, 1)], [(2, 1), (2.5, 1)]]),
    "on the border": ([(0, 1.1), (0, 4.7)], [[(0, 1.1), (0, 2)], [(0, 2), (0, 3)], [(0, 3), (0, 4)], [(0, 4), (0, 4.7)]]),
    "corner vertex": ([(2.9, 2.2), (2, 1.5), (0.9, 1.5)], [[(2.9, 2.2), (2.6428571, 2)], [(2.6428571, 2), (2, 1.5)], [(2, 1.5), (1, 1.5)], [(1, 1.5), (0.9, 1.5)]]),
    "inside": ([(0, 0), (0.5, 0.5)], [[(0, 0), (0.5, 0.5)]]),
}


@pytest.mark.parametrize("name", CASES)
def test_lines_on_the_unit_grid(spark, name):
    line, want = CASES[name]
    got, _ = pieces(spark, line, UNIT2)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert [v for p in a for v in p] == pytest.approx([v for p in b for v in p], abs=1e-6)


def test_touching_a_line_makes_no_empty_piece(spark):
    got, _ = pieces(spark, [(0, 0), (1, 1), (2, 0)], UNIT2)
    assert all(sum(math.dist(p, q) for p, q in zip(a, a[1:])) > 0 for a in got)
    got, _ = pieces(spark, [(0.5, 1.1), (1.5, 0.9), (2.5, 1.1)], UNIT2)
    assert sum(math.dist(a[0], a[-1]) > 1e-9 for a in got) >= 3


def test_north_up_grid(spark):
    got, _ = pieces(spark, [(191483.1328, 2044523.5153), (191618.2801, 2044419.0289)], NORTH)
    assert [round(v, 2) for a in got[1:] for v in a[0]] == [191487.68, 2044520, 191565, 2044460.22, 191604.09, 2044430]
    got, _ = pieces(spark, [(190040.9086, 2043440), (189819.8564, 2043440)], NORTH)
    assert [a[0][0] for a in got[1:]] == pytest.approx([190035, 189945, 189855])


def test_fine_grid(spark):
    got, _ = pieces(spark, [(415805.57, 430046.95), (415800, 430015)], FINE)
    assert len(got) == 8
    assert got[1][0] == pytest.approx((415805.23004, 430045), abs=1e-4) and got[2][0] == pytest.approx((415805, 430043.68043), abs=1e-4)


BOUNDED = [
    (UNIT4, [(5, 0.5), (16, 1.5)], [], [(-1, -1)]),
    (UNIT4, [(-2, 0.5), (1.5, 0.5)], [(0, 0.5), (1, 0.5)], [(-1, -1), (0, 0), (1, 0)]),
    (UNIT4, [(1.5, 0.5), (-2, 0.5)], [(1, 0.5), (0, 0.5)], [(1, 0), (0, 0), (-1, -1)]),
    (UNIT4, [(0, -12), (0, 7)], [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4)], None),
    (UNIT2, [(5, 0.5), (-5, 0.5)], [(2, 0.5), (1, 0.5), (0, 0.5)], None),
    (UNIT2, [(1, -1), (3.0000000001, 1)], [], None),
    (UNIT2, [(0, 3), (0, 5)], [], None),
    (UNIT2, [(0.3, 0.4), (1.8, 1.6)], [(1, 0.96), (1.05, 1)], None),
]


@pytest.mark.parametrize("k", range(len(BOUNDED)))
def test_bounded(spark, k):
    grid, line, cuts, cells = BOUNDED[k]
    got, index = pieces(spark, line, grid, True)
    assert [a[0] for a in got[1:]] == [pytest.approx(c) for c in cuts]
    assert cells is None or index == cells


def test_points_in_the_extent(spark):
    df = spark.createDataFrame([(2.0, 1.0), (1.0, 2.0), (0.9, 11.1)], "x double, y double")
    got = df.select(split.point_in_extent(g.point(F.col("x"), F.col("y")), UNIT2).alias("b")).collect()
    assert [r.b for r in got] == [True, True, False]


def test_affine():
    t = Affine(1, 2, 4, 1, 4, 2)
    assert (~t).coefficients() == (2, -1, -6, -0.5, 0.5, 1)
    assert (~t)(*t(3, 5)) == (3, 5) and Affine.from_gdal(4, 1, 2, 2, 1, 4) == t
    with pytest.raises(ValueError, match="not invertible"):
        ~Affine(1, 2, 0, 2, 4, 0)


def test_grids(spark):
    grid = GridDefinition.from_extent(0, 0, 10.5, 4, 2, 1.5, "EPSG:4326")
    assert (grid.width, grid.height, grid.transform) == (6, 3, (2, 0, 0, 0, 1.5, 0))
    assert GridDefinition.from_sidecar(grid.to_sidecar()) == grid
    wide = GridDefinition("EPSG:4326", 23, 14, (0.008333333347826087, 0, -1.341666667, 0, -0.008333333285714315, 51.808333333))
    b = grid_boxes(spark, wide).agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax"), F.count("cell")).first()
    assert tuple(b) == pytest.approx((-1.3416667, 51.6916667, -1.15, 51.8083333, 322), abs=1e-6)


coordinate = st.integers(-40, 240).map(lambda v: v / 16)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(coordinate, coordinate), min_size=2, max_size=8), min_size=1, max_size=12))
def test_pieces_add_up(spark, lines):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], f"id int, geometry {g.LINE}")
    rows = split.split_lines(df, NORTH_SMALL).orderBy("id", "split").collect()
    flat = {r.id: r.n for r in split.segment_pieces(df, NORTH_SMALL, ["id"]).groupBy("id").agg(F.sum("length").alias("n")).collect()}
    for k, line in enumerate(lines):
        mine = [[(p.x, p.y) for p in r.geometry] for r in rows if r.id == k]
        total = sum(math.dist(p, q) for p, q in zip(line, line[1:]))
        assert mine[0][0] == line[0] and mine[-1][-1] == line[-1]
        assert all(a[-1] == b[0] for a, b in zip(mine, mine[1:]))
        assert sum(math.dist(p, q) for a in mine for p, q in zip(a, a[1:])) == pytest.approx(total, abs=1e-9)
        assert flat[k] == pytest.approx(total, abs=1e-9)


NORTH_SMALL = GridDefinition("EPSG:32630", 6, 5, (2, 0, 0, 0, -2, 10))


def test_polygon_pieces(spark):
    ring = [(1.5, 0.25), (2.5, 1.5), (2.5, 3.5), (1.5, 2.25), (0.5, 3.5), (0.5, 1.5), (1.5, 0.25)]
    df = spark.createDataFrame([(1, [ring])], f"id int, geometry {g.POLYGON}")
    rows = split.split_polygons(df, UNIT4).select("split", "geometry", g.polygon_area(F.col("geometry")).alias("area")).collect()
    (whole,) = df.select(g.polygon_area(F.col("geometry")).alias("a")).collect()
    assert len(rows) == 11 and sum(r.area for r in rows) == pytest.approx(whole.a)
    for r in rows:
        xs, ys = [p.x for p in r.geometry[0]], [p.y for p in r.geometry[0]]
        assert max(xs) - min(xs) <= 1 + 1e-12 and max(ys) - min(ys) <= 1 + 1e-12
    odd = spark.createDataFrame([(1, None), (2, []), (3, [[(9.0, 9.0), (9.5, 9.0), (9.0, 9.5)]])], f"id int, geometry {g.POLYGON}")
    assert split.split_polygons(odd, UNIT4).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(0.5, 3.4), st.floats(0, 1)), min_size=3, max_size=14), st.booleans())
def test_polygon_areas_are_kept(spokes, hole):
    n = len(spokes)
    star = [(4.03 + r * math.cos(2 * math.pi * k / n), 4.01 + r * math.sin(2 * math.pi * k / n)) for k, (r, _) in enumerate(spokes)]
    rings = [star] + ([[(4.03 + 0.2 * math.cos(a), 4.01 + 0.2 * math.sin(a)) for a in (0, 4, 2)]] if hole and min(r for r, _ in spokes) > 1.5 and n > 4 else [])
    parts = split.clip_to_cells(rings, 8, 8)
    area = lambda rs: abs(split._area(rs[0])) - sum(abs(split._area(r)) for r in rs[1:])
    assert sum(area(p) for _, _, p in parts) == pytest.approx(area(rings), abs=1e-9)
    for i, j, p in parts:
        assert all(i - 1e-9 <= x <= i + 1 + 1e-9 and j - 1e-9 <= y <= j + 1 + 1e-9 for x, y in p[0])


def test_grid_lines_in_a_ring(spark):
    ring = [(0.5, 0.5), (2.5, 0.5), (2.5, 2.5), (0.5, 2.5)]
    df = spark.createDataFrame([(ring,)], f"r {g.LINE}")
    for axis in (0, 1):
        (r,) = df.select(split.ring_gridlines(F.col("r"), UNIT4, axis).alias("x")).collect()
        assert len(r.x) == 6 and sum(math.dist(*[(p.x, p.y) for p in line]) for line in r.x) == pytest.approx(4)
    (r,) = df.select(F.size(split.split_ring(F.col("r"), UNIT4)).alias("n")).collect()
    assert r.n == 8 + 12 + 1 - 0 or r.n >= 20


def test_two_grids_refine(spark):
    df = spark.createDataFrame([("a", [(0.5, 0.5), (3.5, 0.5)])], f"name string, geometry {g.LINE}")
    half = GridDefinition("EPSG:32630", 8, 8, (0.5, 0, 0, 0, 0.5, 0))
    rows = split.split_for_grids(df, [UNIT4, half]).collect()
    assert sorted((r.i_0, r.i_1) for r in rows) == [(k // 2, k) for k in range(1, 7)]
    assert {r.split_0 for r in rows} == {0, 1, 2, 3}


def test_merge_lines():
    assert split.merge_lines([[(0, 0), (1, 1)], [(2, 2), (1, 1)], [(5, 5), (6, 6)]]) == [[(0, 0), (1, 1), (2, 2)], [(5, 5), (6, 6)]]
    assert len(split.merge_lines([[(0, 0), (1, 1)], [(1, 1), (2, 2)], [(1, 1), (3, 3)]])) == 3
    assert split.merge_lines([[(0, 0), (1, 0)], [(1, 0), (0, 0)]]) == [[(0, 0), (1, 0), (0, 0)]]


def test_prepare(spark):
    df = spark.createDataFrame([("m", [[(0.0, 0.0), (1.0, 1.0)], [(1.0, 1.0), (2.0, 0.0)], [(9.0, 9.0), (8.0, 8.0)]])], f"name string, geometry array<{g.LINE}>")
    assert sorted(len(r.geometry) for r in split.prepare_lines(df).collect()) == [2, 3]
