"""Nearest nodes by places sent to the executors, and the same cases by joins."""

import random

import numpy as np
import pytest

from terracell.functions import geometry as g
from terracell.operators import spatial_join
from tests import test_nearest_at_scale as cases


def test_few_places_take_one_execution(spark):
    rng = random.Random(5)
    points = spark.createDataFrame([(i, (rng.random() * 50, rng.random() * 9)) for i in range(300)], f"id int, point {g.POINT}")
    nodes = spark.createDataFrame([(k, (rng.random() * 50, rng.random() * 9)) for k in range(900)], f"node_id int, node {g.POINT}")
    runs = spark._jsparkSession.sharedState().statusStore()
    before = runs.executionsCount()
    near = spatial_join.nearest(points, nodes, "id", "node_id", 2.0)
    assert runs.executionsCount() - before <= 1
    assert near.schema["node_id"].dataType.simpleString() == "int" and near.count() == 300


@pytest.mark.parametrize("case", [cases.test_dense_tiles_make_few_pairs, cases.test_ties_of_unlike_differences_go_to_the_least_key, cases.test_odd_coordinates, cases.test_dense_points_outside_of_all_regions_make_few_pairs])
def test_cases_by_joins(spark, monkeypatch, case):
    monkeypatch.setattr(spatial_join, "BROADCAST_PLACES", 0)
    case(spark)


@pytest.mark.parametrize("n, together", [(1, 1 << 18), (17, 1 << 18), (4000, 1 << 18), (4000, 1 << 10)])
def test_places_match_all_pairs(monkeypatch, n, together):
    monkeypatch.setattr(spatial_join, "TOGETHER", together)
    rng = np.random.default_rng(n)
    at = np.unique(np.concatenate([rng.integers(0, 60, (n // 2, 2)), rng.normal(0, 1e-3, (n - n // 2, 2))]).astype(float), axis=0)
    x, y, ids = at[:, 0], at[:, 1], rng.permutation(len(at))
    px, py = np.concatenate([rng.integers(-5, 65, 500), rng.normal(0, 2e-3, 200), [1e300, -3e9]]), np.concatenate([rng.integers(-5, 65, 500), rng.normal(0, 2e-3, 200), [-1e300, 4e9]])
    found, gap = spatial_join.Places(x, y, ids).nearest(px.astype(float), py.astype(float))
    for i in range(len(px)):
        with np.errstate(over="ignore"):
            every = spatial_join._gaps(px[i] - x, py[i] - y)
        assert gap[i] == every.min() and found[i] == ids[every == every.min()].min()


def test_points_on_a_circle_are_all_near_its_center():
    turn = np.arange(5000) * 0.001
    found, _ = spatial_join.Places(np.cos(turn), np.sin(turn), np.arange(5000)).nearest(np.array([0.0, 2.0]), np.array([0.0, 0.0]))
    assert found[1] == 0
