"""Nearest nodes where many share a tile or a place."""

import random

from terracell.functions import geometry as g
from terracell.operators import spatial_join


def _most_rows(spark, after):
    """The most rows that an operator put out in the executions from ``after`` on, and how many executions there are."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, most = store.executionsList(), 0
    for i in range(after, runs.size()):
        values = store.executionMetrics(runs.apply(i).executionId())
        metrics = runs.apply(i).metrics()
        for j in range(metrics.size()):
            m = metrics.apply(j)
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most, runs.size()


def _check(spark, points, nodes, size):
    want = {i: min(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2, k) for k, b in nodes)[1] for i, a in points}
    p = spark.createDataFrame([(i, tuple(map(float, a))) for i, a in points], f"id int, point {g.POINT}")
    n = spark.createDataFrame([(k, tuple(map(float, b))) for k, b in nodes], f"node_id int, node {g.POINT}")
    _, before = _most_rows(spark, 0)
    got = {r.id: r.node_id for r in spatial_join.nearest(p, n, "id", "node_id", size).collect()}
    assert got == want
    return _most_rows(spark, before)[0]


def test_dense_tiles_make_few_pairs(spark):
    rng = random.Random(3)
    at = lambda: (rng.randrange(200), rng.randrange(200))
    points = [(i, at()) for i in range(1500)] + [(5000 + i, (7, 7)) for i in range(1000)] + [(9000, (90000, -4000))]
    nodes = [(k, at()) for k in range(1500)] + [(5000 + k, (8, 8)) for k in range(1000)] + [(9000, (-70000, 5))]
    assert _check(spark, points, nodes, 1000.0) < 300_000  # 6.25 million pairs share a tile


def test_ties_of_unlike_differences_go_to_the_least_key(spark):
    corners = [(dx * s, dy * t) for a in range(1, 50) for b in range(1, 50) for dx, dy in [(a, b)] if a * a + b * b == 1105 * 2 for s in (1, -1) for t in (1, -1)]
    for turn in range(2):
        nodes = list(enumerate(corners[::-1] if turn else corners))
        _check(spark, [(0, (0, 0))], nodes, 4.0)


def test_odd_coordinates(spark):
    nan, inf = float("nan"), float("inf")
    points = [(1, (0.0, 0.0)), (1, (3.0, 0.0)), (2, (-0.0, 0.0)), (3, (nan, 0.0)), (4, (inf, 0.0)), (5, None), (6, (3e9, -4e9))]
    nodes = [(9, (nan, 0.0)), (8, (0.0, -inf)), (7, None), (6, (0.0, 0.0)), (5, (2.5, 0.0))]
    p, n = spark.createDataFrame(points, f"id int, point {g.POINT}"), spark.createDataFrame(nodes, f"node_id int, node {g.POINT}")
    rows = spatial_join.nearest(p, n, "id", "node_id", 1.0).collect()
    assert sorted((r.id, r.node_id or 0, r.distance) for r in rows if r.id != 6 and r.node_id) == [(1, 5, 0.5), (1, 6, 0.0), (2, 6, 0.0)]
    assert len(rows) == 7 and {r.node_id for r in rows if r.id in (3, 4, 5)} == {None}


def test_dense_points_outside_of_all_regions_make_few_pairs(spark):
    points = [(i, (i % 90 * 1.0, i % 7 * 1.0)) for i in range(3000)]
    nodes = [(100 + k, (k % 80 * 1.0, k % 3 * 1.0)) for k in range(3000)]
    p, n = spark.createDataFrame(points, f"id int, point {g.POINT}"), spark.createDataFrame(nodes, f"k int, node {g.POINT}")
    box = [(0.0, 0.0), (10.0, 0.0), (10.0, 9.0), (0.0, 9.0)]
    _, before = _most_rows(spark, 0)
    rows = spatial_join.within_else_nearest(p, spark.createDataFrame([(1, [box])], f"k int, polygon {g.POLYGON}"), n, "id", "k", 50.0).collect()
    least = {}
    for k, b in reversed(nodes):
        least[b] = k
    near = lambda a: min(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2, k) for b, k in least.items())[1]
    assert {r.id: r.k for r in rows} == {i: 1 if a[0] < 10 else near(a) for i, a in points}
    assert _most_rows(spark, before)[0] < 300_000
