"""Rasters, curves, costs, risk, networks, routing and spatial joins."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terracell.functions import geometry as g
from terracell.functions.grid import GridDefinition
from terracell.operators import costs, curves, network, raster, risk, routing, spatial_join

# Rasters

SPLITS = [(0, 0), (1, 0), (2, 1), (-1, -1)]
VALUES = [(j, i, 100.0 * (j + 1) + i) for j in range(2) for i in range(3)]


def test_lookup(spark):
    s = spark.createDataFrame(SPLITS, "index_i long, index_j long")
    v = spark.createDataFrame(VALUES, "j long, i long, value double")
    got = {(r.index_i, r.index_j): r.value for r in raster.lookup(s, v).collect()}
    assert got == {(0, 0): 100, (1, 0): 101, (2, 1): 202, (-1, -1): None}
    with pytest.raises(Exception, match="outside of the raster"):
        raster.lookup(spark.createDataFrame([(5, 5)], "index_i long, index_j long"), v, strict=True).collect()
    with pytest.raises(KeyError):
        raster.lookup(s.drop("index_j"), v)
    with pytest.raises(ValueError):
        raster.band(v, band_number=0)


def test_rasterise(spark):
    grid = GridDefinition("", 3, 2, (1, 0, 0, 0, 1, 0))
    rows = [(0, 0, 1.0), (0, 0, 2.0), (2, 1, 4.1), (1, 1, 0.0), (-1, 0, 9.0), (None, 0, 9.0), (1, 0, float("nan"))]
    df = spark.createDataFrame(rows, "index_i int, index_j int, v double")
    dense = lambda **k: [r.value for r in raster.rasterise_dense(df, "v", grid, **k).orderBy("j", "i").collect()]
    assert dense() == [3, 0, 0, 0, 0, 4.1]
    assert dense(fill=-99.0) == [3, 0, -99, -99, 0, 4.1]
    assert dense(dtype="int") == [3, 0, 0, 0, 0, 4]
    with pytest.raises(KeyError):
        raster.rasterise(df, "w", grid)


def test_wide_lookup_and_names(spark):
    names = raster.column_names([("a", [1]), ("b", [1, 2])])
    assert list(names.values()) == ["a", "b_1", "b_2"]
    long = spark.createDataFrame([("a", 1, 0, 0, 1.0), ("b", 1, 0, 0, 2.0), ("b", 2, 0, 1, 3.0)], "raster_key string, band int, j long, i long, value double")
    s = spark.createDataFrame(SPLITS[:2], "index_i long, index_j long")
    got = {r.index_i: (r.a, r.b_1, r.b_2) for r in raster.lookup_wide(s, long, names).collect()}
    assert got == {0: (1, 2, None), 1: (None, None, 3)}


def test_catalogue_shares_equal_grids():
    a, b = GridDefinition("x", 1, 1, (1, 0, 0, 0, 1, 0)), GridDefinition("x", 2, 1, (1, 0, 0, 0, 1, 0))
    rows, grids = raster.extend_catalogue([{"path": p, "key": p} for p in "pqr"], {"p": (b, [1]), "q": (a, [1, 2]), "r": (b, [1])})
    assert [r["grid_id"] for r in rows] == [0, 1, 0] and rows[1]["bands"] == (1, 2) and grids == [b, a]


# Curves

BASE = curves.PiecewiseLinearCurve([(0, 0), (10, 0.1), (20, 0.2), (30, 1)])


def test_curve_values(spark):
    inf = float("inf")
    xs = [5, 15, 25, -inf, -999, -0.0, 0, 30, 999, inf]
    want = [0.05, 0.15, 0.6, 0, 0, 0, 0, 1, 1, 1]
    df = spark.createDataFrame([(float(x),) for x in xs] + [(float("nan"),), (None,)], "x double")
    got = [r[0] for r in df.select(BASE.damage_fraction(F.col("x"))).collect()]
    assert got[:-2] == pytest.approx(want) and math.isnan(got[-2]) and got[-1] is None
    assert [BASE(x) for x in xs] == pytest.approx(want)
    falling = curves.PiecewiseLinearCurve([(1, 0.9), (2, 0.1)])
    assert falling(0) == 0.1 and falling(9) == 0.9


@pytest.mark.parametrize(
    "made, points",
    [
        (lambda: BASE.translate_y(0.1), [(0, 0.1), (10, 0.2), (20, 0.3), (28.75, 1), (30, 1)]),
        (lambda: BASE.translate_y(-0.1), [(0, 0), (10, 0), (20, 0.1), (30, 0.9)]),
        (lambda: BASE.scale_y(2), [(0, 0), (10, 0.2), (20, 0.4), (23.75, 1), (30, 1)]),
        (lambda: BASE.scale_y(0.1), [(0, 0), (10, 0.01), (20, 0.02), (30, 0.1)]),
        (lambda: BASE.translate_x(5), [(5, 0), (15, 0.1), (25, 0.2), (35, 1)]),
        (lambda: BASE.scale_x(0.1), [(0, 0), (1, 0.1), (2, 0.2), (3, 1)]),
        (lambda: curves.PiecewiseLinearCurve.interpolate(BASE.scale_y(0.5), BASE, 0.5), [(x, y * 0.75) for x, y in BASE.points]),
        (lambda: curves.PiecewiseLinearCurve.interpolate(curves.PiecewiseLinearCurve([(0, 0), (10, 1)]), curves.PiecewiseLinearCurve([(0, 0), (5, 0.1), (10, 0.8)]), 0.5), [(0, 0), (5, 0.3), (10, 0.9)]),
    ],
)
def test_curve_transforms(made, points):
    got = made().points
    assert [v for p in got for v in p] == pytest.approx([v for p in points for v in p])


def test_curve_equality_and_checks():
    assert BASE == curves.PiecewiseLinearCurve(BASE.points) and BASE != BASE.scale_x(2)
    with pytest.raises(ValueError):
        curves.PiecewiseLinearCurve([(0, 0), (0, 1)])


def test_many_curves_match_single_ones(spark):
    made = {"a": BASE, "b": BASE.scale_y(0.5).translate_x(3), "c": curves.PiecewiseLinearCurve([(5, 0.3)])}
    long = spark.createDataFrame([(k, x, y) for k, c in made.items() for x, y in c.points], "curve_id string, intensity double, damage double")
    xs = [-1.0, 0.0, 3.0, 5.0, 9.9, 10.0, 30.0, 33.0, 50.0]
    rows = spark.createDataFrame([(k, x) for k in [*made, "none"] for x in xs] + [("a", None), ("a", float("nan"))], "curve_id string, x double")
    for r in curves.evaluate(rows, long, "x").collect():
        if r.curve_id == "none" or r.x is None:
            assert r.damage is None
        elif math.isnan(r.x):
            assert math.isnan(r.damage)
        else:
            assert r.damage == pytest.approx(made[r.curve_id](r.x)), r


def test_curve_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("# about\nintensity,damage_ratio\n0,0 # first\n\n10,0.5\n")
    assert curves.PiecewiseLinearCurve.from_csv(spark, str(tmp_path / "c.csv")).points == ((0, 0), (10, 0.5))
    (tmp_path / "c.tsv").write_text("# x\ninundation_depth_(m)\troad_unpaved\tother\n0\t0\t1\n1\t.28\t2\n2\t.46\t3\n")
    c = curves.PiecewiseLinearCurve.from_csv(spark, str(tmp_path / "c.tsv"), "inundation_depth_(m)", "road_unpaved", sep="\t")
    assert c.damage == [0, 0.28, 0.46]
    with pytest.raises(KeyError):
        curves.PiecewiseLinearCurve.from_csv(spark, str(tmp_path / "c.csv"), damage="nope")


def test_curve_catalogue(spark):
    needed = {n: "x" for n, must in curves.METADATA.items() if must}
    rows = [{**{n: None for n in curves.METADATA}, **needed, "curve_id": k, "hazard_type": h, "curve_type": t} for k, h, t in (("F1.1", "Flooding", "a"), ("F2.1", "flooding", None), ("W1", "Windstorm", "b"))]
    meta = spark.createDataFrame([tuple(r[n] for n in curves.METADATA) for r in rows], curves.METADATA_SCHEMA)
    ids = lambda **k: sorted(r.curve_id for r in curves.available_curves(meta, **k).collect())
    assert ids() == ["F1.1", "F2.1", "W1"] and ids(hazard_type="FLOOD") == ["F1.1", "F2.1"] and ids(curve_type=["a", "b"]) == ["F1.1", "W1"] and ids(curve_type="a") == ["F1.1"]
    assert curves.curve_metadata(meta, "W1")["hazard_type"] == "Windstorm"
    points = curves.curve_points(spark.createDataFrame([("0", "0", "x"), ("1", "0.8", "0.5"), ("n/a", "1", "1")], "d string, `F1.1` string, W9 string"), "d", ["F1.1", "W9"])
    assert curves.load_curve(points, "F1.1").points == ((0, 0), (1, 0.8))
    for f in (lambda: curves.load_curve(points, "no"), lambda: curves.curve_metadata(meta, "no")):
        with pytest.raises(KeyError):
            f()
    kept, kept_points = curves.build_catalogue(meta, points, ["a"])
    assert [r.curve_id for r in kept.collect()] == ["F1.1"] and kept_points.count() == 2
    assert curves.normalise_header(" Hazard  Type (x)") == "hazard_type_x"


# Risk


def test_trapezoid(spark):
    rows = [("a", 0.5, 2.0), ("a", 0.1, 4.0), ("b", 0.2, 3.0), ("c", 0.9, 1.0)]
    df = spark.createDataFrame(rows, "k string, p double, d double")
    got = {r.k: r.ead for r in risk.expected_damage(df, ["k"], "p", "d").collect()}
    assert got == pytest.approx({"a": 0.4 * 3, "b": 0.3, "c": 0.45})
    got = {r.k: r.ead for r in risk.expected_damage(df, ["k"], "p", "d", threshold=0.5).collect()}
    assert got == pytest.approx({"a": 0.5 * 0.1 * 4, "b": 0.3, "c": 0})


@pytest.mark.parametrize("x", [[0, 1], [0, 1, 3], [0, 0.5, 2, 3], [0, 1, 1.5, 4, 4.25]])
def test_simpson_is_exact_on_parabolas(x):
    w = risk.simpson_weights(x)
    for k in range(2 if len(x) == 2 else 3):
        assert sum(a * v**k for a, v in zip(w, x)) == pytest.approx((x[-1] ** (k + 1) - x[0] ** (k + 1)) / (k + 1))


def test_small_numbers():
    assert risk.n_choose_k(5, 2) == 10 and risk.n_choose_k(2, 5) == 0
    assert risk.total_discount(2020, 2021, 10) == pytest.approx(1 + 1 / 1.1)


def test_unknown_surface_has_no_damage(spark):
    df = spark.createDataFrame([("paved", 2.0), ("mud", 2.0), (None, 2.0), ("unpaved", None)], "s string, d double")
    assert [r[0] for r in df.select(costs.road_damage_by_surface(F.col("d"), F.col("s"))).collect()] == [30, None, None, None]


# Geometry


def test_geodesic_length(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0)],), ([(10.0, 50.0), (10.0, 51.0), (11.0, 51.0)],), (None,), ([],)], f"line {g.LINE}")
    got = [r[0] for r in df.select(g.geodesic_length(F.col("line"))).collect()]
    assert got[:2] == pytest.approx([111319.4908, 111239.6 + 70197.1], abs=60) and got[2] is None and got[3] == 0
    assert g.vincenty([-3.0], [50.0], [-3.0], [50.0])[0] == 0
    # Flinders Peak to Buninyong, a published check
    assert g.vincenty([144.42486789], [-37.95103342], [143.92649552], [-37.65282114])[0] == pytest.approx(54972.271, abs=0.05)


def test_projections_round_trip(spark):
    df = spark.createDataFrame([(3.0, 50.0), (1.5, -20.0), (5.9, 0.1)], "x double, y double")
    p = g.point(F.col("x"), F.col("y"))
    for crs in ("EPSG:3857", "EPSG:32631", "EPSG:32731"):
        back = g.reproject(g.reproject(p, "EPSG:4326", crs), crs, "EPSG:4326")
        for r in df.select("x", "y", back.alias("b")).collect():
            assert (r.b.x, r.b.y) == pytest.approx((r.x, r.y), abs=1e-8)
    (r,) = df.limit(1).select(g.reproject(p, "EPSG:4326", "EPSG:32631").alias("u"), g.reproject(p, "EPSG:4326", "EPSG:3857").alias("m")).collect()
    assert (r.u.x, r.u.y) == pytest.approx((500000, 5538630.70), abs=0.05) and (r.m.x, r.m.y) == pytest.approx((333958.472, 6446275.841), abs=0.01)
    with pytest.raises(ValueError):
        g.reproject(p, "EPSG:4326", "EPSG:27700")


def test_polygon_measures(spark):
    ring, hole = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    bow = [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]
    df = spark.createDataFrame([([ring, hole], bow)], f"p {g.POLYGON}, b {g.LINE}")
    c = g.polygon_centroid(F.col("p"))
    inside = lambda x, y: g.point_in_polygon(g.point(F.lit(x), F.lit(y)), F.col("p"))
    r = df.select(g.polygon_area(F.col("p")), c["x"], inside(0.5, 0.5), inside(1.5, 1.5), inside(5.0, 1.0), g.ring_is_simple(F.col("p")[0]), g.ring_is_simple(F.col("b"))).first()
    assert r[0] == 15 and r[1] == pytest.approx((32 - 1.5) / 15) and list(r[2:]) == [True, False, False, True, False]


def test_almost_equal_and_repeats(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 2e-16, [1, 1, 2, 1])], "a double, b double, c array<int>")
    r = df.select(g.almost_equal(F.col("a"), F.col("b")), g.almost_equal(F.col("a"), F.col("b") + 1e-9), g.drop_repeats(F.col("c"))).first()
    assert list(r) == [True, False, [1, 2, 1]]


# Routing

RING = [(0, "n0", "n1", 1.0), (1, "n1", "n2", 1.0), (2, "n2", "n3", 1.0), (3, "n3", "n4", 3.0), (4, "n4", "n0", 1.0)]


def test_ring(spark):
    edges = spark.createDataFrame(RING, "edge_id long, from_node string, to_node string, weight double")
    pairs = spark.createDataFrame([("n0", "n4"), ("n0", "n3"), ("n2", "n4"), ("n2", "n3"), ("n2", "n2"), ("n0", "zz")], "source string, destination string")
    want = {("n0", "n4"): [4], ("n0", "n3"): [0, 1, 2], ("n2", "n4"): [1, 0, 4], ("n2", "n3"): [2], ("n2", "n2"): [], ("n0", "zz"): []}
    for limit in (100, 2):
        rows = routing.shortest_paths(pairs, edges, limit=limit).collect()
        assert {(r.source, r.destination): r.path for r in rows} == want
        assert {r.destination: r.cost for r in rows if r.path == []} == {"n2": 0, "zz": None}
    paths = routing.shortest_paths(pairs, edges)
    sums = routing.path_sums(paths, edges.withColumn("km", F.col("weight") * 2), ["km"])
    assert {(r.source, r.destination): r.km for r in sums.collect()}["n2", "n4"] == 6
    nodes = spark.createDataFrame([("p", ["n0", "n1", "n2"])], "key string, nodes array<string>")
    assert [r.edge_id for r in network.edges_of_path(nodes, edges, "key").orderBy("step").collect()] == [0, 1]


def test_failures(spark):
    edges = spark.createDataFrame([*RING, (9, "n0", "n5", 1.0)], "edge_id long, from_node string, to_node string, weight double")
    pairs = spark.createDataFrame([("n0", "n1"), ("n0", "n5")], "source string, destination string")
    failed = edges.where("edge_id in (0, 9)").select("edge_id")
    got = {r.destination: (r.path, r.cost) for r in routing.route_with_failures(edges, failed, pairs).collect()}
    assert got == {"n1": ([4, 3, 2, 1], 6.0), "n5": ([9], float("inf"))}
    got = {r.destination: r.path for r in routing.route_with_failures(edges, failed, pairs, drop=True).collect()}
    assert got == {"n1": [4, 3, 2, 1], "n5": []}


def test_both_ways_of_routing_agree(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(30), rng.randrange(30), float(rng.randint(1, 6))) for k in range(70)]
    edges = spark.createDataFrame(rows, "edge_id long, from_node long, to_node long, weight double")
    pairs = spark.createDataFrame([(s, t) for s in (0, 7, 11) for t in range(30)], "source long, destination long")
    key = lambda df: {(r.source, r.destination): (r.cost, tuple(r.path)) for r in df.collect()}
    assert key(routing.shortest_paths(pairs, edges)) == key(routing.relaxed_paths(pairs, edges))


def test_samples_are_stable(spark):
    edges = spark.range(500).select(F.col("id").alias("edge_id"))
    a = routing.failure_samples(edges, 4, 25, seed=3)
    got = sorted(map(tuple, a.collect()))
    assert got == sorted(map(tuple, routing.failure_samples(edges.repartition(7), 4, 25, seed=3).collect()))
    assert {s: sum(x == s for x, _ in got) for s in range(4)} == dict.fromkeys(range(4), 25) and len(set(got)) == 100


def test_topology(spark):
    lines = [("a", [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]), ("b", [(1.0, 0.0), (1.0, 5.0)]), ("c", [(2.0, 0.0), (0.0, 0.0)])]
    df = spark.createDataFrame(lines, f"id string, line {g.LINE}")
    nodes, edges = network.topology(df, "id")
    assert [tuple(r) for r in nodes.orderBy("node_id").collect()] == [(0, 0, 0), (1, 1, 0), (2, 1, 5), (3, 2, 0)]
    assert {r.id: (r.from_node, r.to_node) for r in edges.collect()} == {"a": (0, 3), "b": (1, 2), "c": (3, 0)}
    cut = network.split_at_nodes(df, "id", size=2.0).orderBy("id", "split").collect()
    assert [(r.id, r.split, [(p.x, p.y) for p in r.line]) for r in cut if r.id != "b"] == [
        ("a", 0, [(0, 0), (1, 0)]), ("a", 1, [(1, 0), (2, 0)]), ("c", 0, [(2, 0), (1, 0)]), ("c", 1, [(1, 0), (0, 0)]),
    ]
    near = network.link_near(nodes, 1.0).collect()
    assert sorted((r.from_node, r.to_node) for r in near) == [(0, 1), (1, 3)]


# Spatial joins


def random_boxes(rng, n, prefix):
    corners = [(rng.uniform(-5, 20), rng.uniform(-5, 20)) for _ in range(n)]
    return [(f"{prefix}{k}", x, y, x + rng.uniform(0.1, 4), y + rng.uniform(0.1, 4)) for k, (x, y) in enumerate(corners)]


def test_tile_join_finds_each_pair_once(spark):
    rng = random.Random(8)
    a, b = random_boxes(rng, 60, "a"), random_boxes(rng, 60, "b")
    make = lambda rows, key: spark.createDataFrame(rows, f"{key} string, {key}0 double, {key}1 double, {key}2 double, {key}3 double")
    box = lambda k: F.struct(*(F.col(f"{k}{n}").alias(c) for n, c in enumerate(("xmin", "ymin", "xmax", "ymax"))))
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    for size in (0.7, 3.0, 50.0):
        rows = spatial_join.tile_join(make(a, "p"), make(b, "q"), box("p"), box("q"), size).select("p", "q").collect()
        assert sorted(map(tuple, rows)) == want


def test_nearest_matches_all_pairs(spark):
    rng = random.Random(6)
    points = [(k, (rng.uniform(0, 100), rng.uniform(0, 5))) for k in range(80)] + [(900, (5000.0, -3000.0))]
    nodes = [(k, (rng.uniform(0, 60), rng.uniform(0, 5))) for k in range(25)]
    p = spark.createDataFrame(points, f"id int, point {g.POINT}")
    n = spark.createDataFrame(nodes, f"node_id int, node {g.POINT}")
    got = {r.id: r.node_id for r in spatial_join.nearest(p, n, "id", "node_id", 3.0).collect()}
    assert got == {i: min((math.dist(a, b), k) for k, b in nodes)[1] for i, a in points}
    assert {r.node_id for r in spatial_join.nearest(p, n.limit(0), "id", "node_id", 3.0).collect()} == {None}


def test_lengths_in_polygons(spark):
    lines = [("x", [(-1.0, 1.0), (5.0, 1.0)]), ("y", [(9.0, 9.0), (10.0, 9.0)]), ("z", [(0.5, 3.5), (0.5, 0.5), (3.5, 0.5)])]
    l_shape = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(1.0, 0.75), (1.5, 0.75), (1.5, 1.5), (1.0, 1.5), (1.0, 0.75)]
    a = spark.createDataFrame(lines, f"id string, line {g.LINE}")
    b = spark.createDataFrame([(7, [l_shape, hole])], f"k int, polygon {g.POLYGON}")
    rows = spatial_join.edges_in_polygons(a, b, 1.5, clip=spatial_join.length_in_polygon).collect()
    assert {r.id: r.length for r in rows} == pytest.approx({"x": 3.5, "z": 6.0})
    assert spatial_join.prune_by_extent(a, g.line_bounds(F.col("line")), b, g.polygon_bounds(F.col("polygon"))).count() == 2
    pts = spark.createDataFrame([("in", (1.0, 3.0)), ("out", (3.0, 3.0))], f"id string, point {g.POINT}")
    assert [r.id for r in spatial_join.exposed_points(pts, b, 1.5, "id").collect()] == ["in"]
    assert spatial_join.exposed_points(pts, b, 1.5, "id", bbox_only=True).count() == 2
    named = b.withColumn("name", F.lit("l"))
    assert {r.id: r.name for r in spatial_join.first_match(pts, named, 1.5, "id", "name", "k").collect()} == {"in": "l", "out": None}
