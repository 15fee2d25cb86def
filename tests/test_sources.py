"""Files, commands, streams and table functions."""

import json
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from terracell import cli
from terracell.functions import geometry as g
from terracell.functions.grid import GridDefinition
from terracell.functions.udtf import register
from terracell.sources import rasters, vector, xlsx
from terracell.streaming import exposure

SHAPES = {
    "Point": (1.0, 2.0),
    "LineString": [(0.0, 0.0), (1.5, 2.0)],
    "Polygon": [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 0.5), (2.0, 0.5), (2.0, 1.0), (1.0, 0.5)]],
    "MultiPoint": [(0.0, 1.0), (2.0, 3.0)],
    "MultiLineString": [[(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 6.0)]],
    "MultiPolygon": [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]],
}


@pytest.mark.parametrize("name", SHAPES)
def test_codecs(name):
    assert vector.read_wkb(vector.write_wkb(name, SHAPES[name])) == (name, SHAPES[name])
    assert vector.read_wkt(vector.write_wkt(name, SHAPES[name])) == (name, SHAPES[name])


def test_wkb_with_heights():
    data = struct.pack("<BII6d", 1, 1002, 2, 0, 1, 9, 2, 3, 9)
    assert vector.read_wkb(data) == ("LineString", [(0, 1), (2, 3)])
    with pytest.raises(ValueError):
        vector.read_wkb(struct.pack("<BI", 1, 7))


def features(kind, shapes):
    return {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": f"n{k}", "v": k}, "geometry": s and {"type": kind, "coordinates": s}} for k, s in enumerate(shapes)]}


def test_geojson_and_parquet(spark, tmp_path):
    path = tmp_path / "lines.geojson"
    path.write_text(json.dumps(features("LineString", [[[0, 0, 7], [1, 2, 7]], None, [[3, 3], [4, 4]]])))
    df = vector.read_features(spark, str(path))
    assert [(r.name, [(p.x, p.y) for p in r.geometry]) for r in df.orderBy("v").collect()] == [("n0", [(0, 0), (1, 2)]), ("n2", [(3, 3), (4, 4)])]
    df.withColumn("geometry", vector.to_wkb(F.col("geometry"), "LineString")).write.parquet(str(tmp_path / "l.parquet"))
    assert vector.read_features(spark, str(tmp_path / "l.parquet")).orderBy("v").collect() == df.select("name", "v", "geometry").orderBy("v").collect()
    vector.write_geojson(df, str(tmp_path / "out.geojsonl"), "LineString")
    assert vector.read_features(spark, str(tmp_path / "out.geojsonl")).orderBy("v").select("v", "geometry").collect() == df.orderBy("v").select("v", "geometry").collect()


def test_geopackage_and_shapefile(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
        c.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        c.execute("INSERT INTO gpkg_contents VALUES ('roads', 'features')")
        c.execute("INSERT INTO gpkg_geometry_columns VALUES ('roads', 'geom')")
        c.execute("CREATE TABLE roads (fid INTEGER, name TEXT, width REAL, geom BLOB)")
        head = b"GP\0\x01" + struct.pack("<i", 4326)
        c.execute("INSERT INTO roads VALUES (1, 'a', 2.5, ?), (2, 'b', 1.5, NULL)", (head + vector.write_wkb("LineString", SHAPES["LineString"]),))
    (r,) = vector.read_features(spark, path, "roads").collect()
    assert (r.fid, r.name, r.width, [(p.x, p.y) for p in r.geometry]) == (1, "a", 2.5, SHAPES["LineString"])
    body = struct.pack("<i4d2ii", 3, 0, 0, 1, 1, 1, 2, 0) + struct.pack("<4d", 0, 0, 1, 1)
    (tmp_path / "s.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    field = lambda n, t, w: n.ljust(11, "\0").encode() + t.encode() + b"\0" * 4 + bytes([w]) + b"\0" * 15
    (tmp_path / "s.dbf").write_bytes(b"\x03" + b"\0" * 3 + struct.pack("<IHH", 1, 32 + 64 + 1, 9) + b"\0" * 20 + field("ID", "C", 4) + field("N", "N", 4) + b"\r" + b" ab    12")
    (r,) = vector.read_features(spark, str(tmp_path / "s.shp")).collect()
    assert (r.ID, r.N, [[(p.x, p.y) for p in x] for x in r.geometry]) == ("ab", 12, [[(0, 0), (1, 1)]])


def test_xlsx(tmp_path):
    path = tmp_path / "a.xlsx"
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>intensity</t></si><si><t>damage_ratio</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>0</v></c><c r="C2"><v>0</v></c></row><row><c r="A3"><v>2</v></c><c r="C3"><v>0.5</v></c></row></sheetData></worksheet>')
    assert xlsx.sheet_names(path) == ["One"] and xlsx.read_sheet(path)[1] == [0, None, 0]
    from terracell.operators.curves import PiecewiseLinearCurve

    assert PiecewiseLinearCurve.from_excel(path).points == ((0, 0), (2, 0.5))
    with pytest.raises(KeyError):
        xlsx.read_sheet(path, "Two")


GRID = GridDefinition("EPSG:32630", 3, 2, (1, 0, 0, 0, 1, 0))


def make_raster(spark, path):
    rows = [(b, j, i, 100.0 * b + 10 * j + i) for b in (1, 2) for j in range(2) for i in range(3) if (j, i) != (1, 1)]
    rasters.write_raster(spark.createDataFrame(rows, "band int, j long, i long, value double"), path, GRID)


def test_rasters(spark, tmp_path):
    path = str(tmp_path / "r")
    make_raster(spark, path)
    assert rasters.read_metadata(spark, path) == (GRID, (1, 2))
    assert rasters.read_band(spark, path, 2).where("j = 0 and i = 2").first().value == 202
    for b in (0, 3):
        with pytest.raises(ValueError):
            rasters.read_band(spark, path, b)
    with pytest.raises(ValueError):
        rasters.write_raster(spark.createDataFrame([(1,)], "value int"), path, GRID)
    rasters.write_raster(rasters.read_band(spark, path, 1), str(tmp_path / "f"), GRID, nodata=-9.0, dtype="float")
    assert rasters.read_band(spark, str(tmp_path / "f")).where("j = 1 and i = 1").first().value == -9
    (tmp_path / "a.asc").write_text("ncols 2\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 5\nNODATA_value -1\n1 2\n-1 4\n")
    grid, values = rasters.ascii_grid(spark, str(tmp_path / "a.asc"))
    assert grid.transform == (5, 0, 10, 0, -5, 30) and sorted(map(tuple, values.collect())) == [(0, 0, 1), (0, 1, 2), (1, 1, 4)]
    store = tmp_path / "z.zarr"
    store.mkdir()
    meta = {"attributes": {}, "consolidated_metadata": {"metadata": {"v": {"node_type": "array", "shape": [4, 181, 361], "attributes": {}}, "crs": {"attributes": {"GeoTransform": "-180.5 1 0 90.5 0 -1", "crs_wkt": "GEOGCS"}}}}}
    (store / "zarr.json").write_text(json.dumps(meta))
    assert rasters.zarr_grid(spark, str(store)) == (GridDefinition("GEOGCS", 361, 181, (1, 0, -180.5, 0, -1, 90.5)), (1, 2, 3, 4))
    assert [p.rpartition("/")[2] for p in rasters.list_files(spark, str(tmp_path), ".asc")] == ["a.asc"]


#: The layers are in the CRS of the grid; a GeoJSON that names none is in EPSG:4326.
NAMED = {"crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::32630"}}}


def test_commands(spark, tmp_path, capsys):
    assert cli.main([], spark) == 0 and "split" in capsys.readouterr().out
    make_raster(spark, str(tmp_path / "r"))
    (tmp_path / "l.geojson").write_text(json.dumps(features("LineString", [[[0.5, 0.5], [2.5, 0.5]]]) | NAMED))
    (tmp_path / "p.geojson").write_text(json.dumps(features("Point", [[0.5, 1.5], [9, 9]]) | NAMED))
    (tmp_path / "m.geojson").write_text(json.dumps(features("MultiPolygon", [[[[[0, 0], [2, 0], [2, 1], [0, 1], [0, 0]]]]]) | NAMED))
    out = str(tmp_path / "o.parquet")
    cli.main(["split", "-f", str(tmp_path / "l.geojson"), "-r", str(tmp_path / "r"), "-a", "-c", "d", "-o", out], spark)
    assert [tuple(r) for r in spark.read.parquet(out).orderBy("split").select("name", "split", "index_i", "index_j", "d_1", "d_2").collect()] == [("n0", k, k, 0, 100.0 + k, 200.0 + k) for k in range(3)]
    cli.main(["split", "-f", str(tmp_path / "l.geojson"), "-t", "1", "0", "0", "0", "1", "0", "-w", "2", "-g", "2", "-o", str(tmp_path / "o.geojsonl")], spark)
    assert vector.read_features(spark, str(tmp_path / "o.geojsonl")).count() == 3
    (tmp_path / "rasters.csv").write_text('path,bands,hazard,rp\nr,"1",flood,10\nr,"1,2",flood,100\n')
    (tmp_path / "features.csv").write_text("path,output_path\n" + "".join(f"{n}.geojson,{n}.out.parquet\n" for n in "lpm"))
    cli.main(["process", "-d", str(tmp_path), "-fs", str(tmp_path / "features.csv"), "-rs", str(tmp_path / "rasters.csv")], spark)
    lines = spark.read.parquet(str(tmp_path / "l.out.parquet"))
    assert {"hazard:flood|rp:10", "hazard:flood|rp:100_1", "hazard:flood|rp:100_2", "i_0", "j_0", "split"} <= set(lines.columns) and lines.count() == 3
    points = spark.read.parquet(str(tmp_path / "p.out.parquet")).orderBy("v").collect()
    assert [(r.i_0, r["hazard:flood|rp:10"]) for r in points] == [(0, 110), (-1, None)]
    assert spark.read.parquet(str(tmp_path / "m.out.parquet")).count() == 2


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 00:0{k}:00", float(k % 3), 0.5, 1.0) for k in range(8)], "t string, x double, y double, v double").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    values = spark.createDataFrame([(0, i, 10.0 * i) for i in range(2)], "j long, i long, value double")
    out = exposure.windowed(exposure.exposed(stream, GRID, values), "t", "1 minute", "4 minutes", "v")
    q = out.writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start.minute, r.index_i): r.n for r in spark.table("cells").collect()}
    want = exposure.windowed(exposure.exposed(rows, GRID), "t", "1 minute", "4 minutes", "v").collect()
    assert got == {(r.start.minute, r.index_i): r.n for r in want} and sum(got.values()) == 8


def test_table_function(spark):
    register(spark)
    spark.createDataFrame([([(0.5, 0.5), (2.5, 0.5)],)], f"line {g.LINE}").createOrReplaceTempView("udtf_lines")
    rows = spark.sql("SELECT s.* FROM udtf_lines, LATERAL split_line(line, 3, 2, array(1D, 0D, 0D, 0D, 1D, 0D)) s ORDER BY split").collect()
    assert [[(p.x, p.y) for p in r.piece] for r in rows] == [[(0.5, 0.5), (1, 0.5)], [(1, 0.5), (2, 0.5)], [(2, 0.5), (2.5, 0.5)]]
