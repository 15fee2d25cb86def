"""Layers that hold single and multi geometries."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from terracell import cli
from terracell.sources import vector

SQUARE, OTHER = [[[0, 0], [2, 0], [2, 1], [0, 1], [0, 0]]], [[[4, 0], [5, 0], [5, 1], [4, 1], [4, 0]]]
ROAD, PATH = [[0.5, 0.5], [2.5, 0.5]], [[0.5, 1.5], [1.5, 1.5]]
MIXES = {
    "MultiPolygon": [("Polygon", SQUARE), ("MultiPolygon", [SQUARE, OTHER]), ("Polygon", OTHER)],
    "MultiLineString": [("LineString", ROAD), ("MultiLineString", [ROAD, PATH])],
    "MultiPoint": [("Point", [1, 2.5]), ("MultiPoint", [[0, 0], [3, 4]])],
}


def written(at, shapes, lines):
    rows = [{"type": "Feature", "properties": {"v": k}, "geometry": s and {"type": s[0], "coordinates": s[1]}} for k, s in enumerate(shapes)]
    path = at / ("a.geojsonl" if lines else "a.geojson")
    path.write_text("\n".join(map(json.dumps, rows)) if lines else json.dumps({"type": "FeatureCollection", "features": rows}))
    return str(path)


def plain(value):
    return [value.x, value.y] if hasattr(value, "x") else [plain(x) for x in value]


@pytest.mark.parametrize("lines", [False, True])
@pytest.mark.parametrize("kind", MIXES)
def test_single_geometries_are_lifted(spark, tmp_path, kind, lines):
    for shapes in (MIXES[kind], MIXES[kind][::-1], [None, *MIXES[kind]]):
        df, found = vector.read_typed(spark, written(tmp_path, shapes, lines))
        want = [s[1] if s[0] == kind else [s[1]] for s in shapes if s]
        assert found == kind and [plain(r.geometry) for r in df.orderBy("v").collect()] == want


def test_wkb_is_lifted(spark, tmp_path):
    tuples = lambda v: tuple(v) if not isinstance(v[0], list) else [tuples(x) for x in v]
    for kind, shapes in MIXES.items():
        rows = [(k, bytearray(vector.write_wkb(n, tuples(v)))) for k, (n, v) in enumerate(shapes)]
        path = str(tmp_path / f"{kind}.parquet")
        spark.createDataFrame(rows, "v int, geometry binary").write.parquet(path)
        df, found = vector.read_typed(spark, path)
        assert found == kind and [plain(r.geometry) for r in df.orderBy("v").collect()] == [v if n == kind else [v] for n, v in shapes]


@pytest.mark.parametrize("lines", [False, True])
def test_other_types_raise(spark, tmp_path, lines):
    for shapes in ([("Point", [1, 2]), ("LineString", ROAD)], [("Blob", [1, 2])]):
        with pytest.raises(ValueError):
            vector.read_features(spark, written(tmp_path, shapes, lines))
    with pytest.raises(PySparkException):
        vector.read_features(spark, written(tmp_path, MIXES["MultiPolygon"], lines), kind="Polygon").collect()
    with pytest.raises(PySparkException):
        vector.read_features(spark, written(tmp_path, [("LineString", ROAD), ("LineString", [3, 4])], lines)).collect()


@pytest.mark.parametrize("lines", [False, True])
def test_split_cuts_all_features(spark, tmp_path, lines):
    out = str(tmp_path / "o.parquet")
    for kind, n in (("MultiLineString", 3 + 3 + 2), ("MultiPolygon", 2 + 2 + 1 + 1), ("MultiPoint", 3)):
        at = written(tmp_path, MIXES[kind], lines)
        cli.main(["split", "-f", at, "-t", "1", "0", "0", "0", "1", "0", "-w", "6", "-g", "6", "-o", out], spark)
        assert spark.read.parquet(out).where(F.col("geometry").isNotNull()).count() == n, kind
