"""Segments clipped by rectangles, which need neither arrays nor a test of each edge."""

import random

import pytest
from pyspark.sql import functions as F

from terracell.functions import geometry as g
from terracell.operators import spatial_join


@pytest.fixture(scope="module")
def layers(spark):
    rng = random.Random(8)
    at = lambda: (rng.randrange(25) * 0.5, rng.randrange(25) * 0.25)
    lines = [(k, [at(), at()]) for k in range(250)] + [(900, [(2.0, 1.0), (2.0, 1.0)]), (901, [(0.0, 3.0), (2.0, 1.0), (4.0, 3.0)]), (902, None), (903, [(3.0, 1.0)])]
    boxes = [(k, [[(x, y), (x + 3.0, y), (x + 3.0, y + 1.5), (x, y + 1.5), (x, y)]]) for k, (x, y) in enumerate((i * 4.0, j * 2.0) for i in range(3) for j in range(3))]
    return spark.createDataFrame(lines, f"id int, line {g.LINE}"), spark.createDataFrame(boxes, f"k int, polygon {g.POLYGON}")


@pytest.mark.parametrize("short", [None, 1.0])
def test_same_pairs_as_the_clip_for_any_polygon(layers, short):
    got = {(r.id, r.k): r.length for r in spatial_join.edges_in_polygons(*layers, 2.0, short=short).collect()}
    want = {(r.id, r.k): r.length for r in spatial_join.edges_in_polygons(*layers, 2.0, clip=lambda a, b: g.length_in_box(a, g.polygon_bounds(b)), short=short).collect()}
    assert got == pytest.approx(want) and {k for k, _ in got} >= {900, 901}


def test_join_condition_has_no_function_of_arrays(spark, layers):
    pairs = spatial_join.edges_in_polygons(*layers, 2.0).where("length > 0").groupBy("k").agg(F.sum("length"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    joins = [row for row in plan.splitlines() if "Join" in row]
    assert joins and not any("lambda" in row for row in joins)
