"""Clips in any polygon, other CRS, and what files say of theirs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from terracell import cli
from terracell.functions import geometry as g
from terracell.functions.grid import GridDefinition
from terracell.operators import raster, spatial_join, split
from terracell.sources import rasters, vector

L_SHAPE = [[(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0)]]
HOLED = [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]]


def polygon(rings):
    return F.array(*(F.array(*(g.point(F.lit(x), F.lit(y)) for x, y in r)) for r in rings))


def line(points):
    return F.array(*(g.point(F.lit(x), F.lit(y)) for x, y in points))


def plain_length(points, rings, steps=20000):
    """The length inside by many points of each segment."""
    total = 0.0
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        hits = 0
        for k in range(steps):
            t = (k + 0.5) / steps
            x, y = x0 + t * (x1 - x0), y0 + t * (y1 - y0)
            crossed = sum(((a[1] > y) != (b[1] > y)) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for r in rings for a, b in zip(r, r[1:]))
            hits += crossed % 2
        total += hits / steps * ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
    return total


@pytest.mark.parametrize("rings", [L_SHAPE, HOLED])
def test_default_length_is_exact(spark, rings):
    rng = random.Random(4)
    lines = [[(rng.uniform(-1, 5), rng.uniform(-1, 5)) for _ in range(3)] for _ in range(4)] + [[(0.5, 3.5), (3.5, 0.5)]]
    polygons = spark.range(1).select(polygon(rings).alias("polygon"))
    for points in lines:
        edges = spark.range(1).select(line(points).alias("line"))
        found = spatial_join.edges_in_polygons(edges, polygons, 2.0).select("length").collect()
        assert sum(r.length for r in found) == pytest.approx(plain_length(points, rings), abs=2e-3)


def test_is_box(spark):
    shapes = {"box": [[(0, 0), (2, 0), (2, 1), (0, 1), (0, 0)]], "open": [[(0, 0), (2, 0), (2, 1), (0, 1)]], "l": L_SHAPE, "hole": HOLED, "turned": [[(0, 1), (1, 0), (2, 1), (1, 2), (0, 1)]], "bow": [[(0, 0), (2, 1), (2, 0), (0, 1), (0, 0)]]}
    got = {n: spark.range(1).select(g.is_box(polygon(r))).first()[0] for n, r in shapes.items()}
    assert got == {"box": True, "open": True, "l": False, "hole": False, "turned": False, "bow": False}


UTM = GridDefinition("EPSG:32631", 10, 10, (100.0, 0, 499500.0, 0, -100.0, 1000.0))


def test_all_kinds_are_reprojected(spark):
    east = g.from_utm(g.point(F.lit(500050.0), F.lit(650.0)), 31)
    far = g.from_utm(g.point(F.lit(500090.0), F.lit(610.0)), 31)
    ring = lambda a, b: F.array(F.array(a, g.point(b["x"], a["y"]), b, g.point(a["x"], b["y"]), a))
    values = spark.createDataFrame([("r", 1, 3, 5, 7.0)], "raster_key string, band int, j long, i long, value double")
    catalogue = [{"key": "r", "bands": (1,), "grid_id": 0}]
    for kind, shape in (("point", east), ("line", F.array(east, far)), ("polygon", ring(east, far))):
        rows = spark.range(1).select(shape.alias("geometry"))
        got = raster.associate(rows, catalogue, [UTM], values, kind, "EPSG:4326").collect()
        assert [(r.i_0, r.j_0, r.r) for r in got] == [(5, 3, 7.0)], kind
        lost = raster.associate(rows, catalogue, [UTM], values, kind).collect()
        assert all(r.r is None for r in lost)


def test_crs_of_files(spark, tmp_path):
    named = lambda n: json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": n}}, "features": []})
    for k, (text, want) in enumerate([(named("urn:ogc:def:crs:EPSG::32631"), "EPSG:32631"), (named("urn:ogc:def:crs:OGC:1.3:CRS84"), "EPSG:4326"), ('{"type": "FeatureCollection", "features": []}', "EPSG:4326")]):
        (tmp_path / f"{k}.geojson").write_text(text)
        assert vector.layer_crs(spark, str(tmp_path / f"{k}.geojson")) == want
    (tmp_path / "s.shp").write_bytes(b"")
    assert vector.layer_crs(spark, str(tmp_path / "s.shp")) is None
    (tmp_path / "s.prj").write_text('PROJCS["WGS_1984_UTM_Zone_31N",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]]')
    assert vector.layer_crs(spark, str(tmp_path / "s.shp")) == "EPSG:32631"
    assert vector.crs_name('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]') == "EPSG:4326"
    assert vector.crs_name('PROJCS["Other",AUTHORITY["EPSG","3035"]]') == "EPSG:3035"
    assert vector.layer_crs(spark, "x.parquet") is None


def test_process_takes_the_crs_of_a_layer(spark, tmp_path):
    rasters.write_raster(spark.createDataFrame([(1, 3, 5, 7.0)], "band int, j long, i long, value double"), str(tmp_path / "r"), UTM)
    at = spark.range(1).select(g.from_utm(g.point(F.lit(500050.0), F.lit(650.0)), 31).alias("p")).first()["p"]
    feature = {"type": "Feature", "properties": {"n": 1}, "geometry": {"type": "Point", "coordinates": [at["x"], at["y"]]}}
    (tmp_path / "p.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    (tmp_path / "rasters.csv").write_text("path,key\nr,depth\n")
    (tmp_path / "features.csv").write_text("path,output_path\np.geojson,o.parquet\n")
    cli.main(["process", "-d", str(tmp_path), "-fs", str(tmp_path / "features.csv"), "-rs", str(tmp_path / "rasters.csv")], spark)
    row = spark.read.parquet(str(tmp_path / "o.parquet")).first()
    assert (row.i_0, row.j_0, row.depth) == (5, 3, 7.0)
    assert (row.geometry.x, row.geometry.y) == pytest.approx((at["x"], at["y"]))


def test_other_pairs_raise(spark):
    rows = spark.range(1).select(g.point(F.lit(1.0), F.lit(1.0)).alias("geometry"))
    with pytest.raises(ValueError):
        split.split_for_grids(rows, [UTM], "point", "EPSG:9999")
