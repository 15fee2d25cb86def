"""Vector layers: GeoJSON, Parquet with WKB, GeoPackage, Shapefile; and their codecs.

Layers become tables with a ``geometry`` column of plain nested arrays. Multi-geometries of a layer
have one level more; where a layer has both, single ones count as multi ones. Rows without a geometry
are dropped, other types raise.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from terracell.functions.geometry import LINE, POINT, POLYGON

#: WKB codes and our types.
KINDS = {
    1: ("Point", POINT),
    2: ("LineString", LINE),
    3: ("Polygon", POLYGON),
    4: ("MultiPoint", LINE),
    5: ("MultiLineString", POLYGON),
    6: ("MultiPolygon", f"array<{POLYGON}>"),
}
TYPES = {name: kind for name, kind in KINDS.values()}
_CODES = {name: code for code, (name, _) in KINDS.items()}
_DEPTH = {"Point": 0, "LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}


# Codecs


def read_wkb(data: bytes) -> tuple[str, object]:
    """Type name and nested ``(x, y)`` tuples; heights and measures are left out."""

    def item(at: int) -> tuple[str, object, int]:
        order = "<" if data[at] == 1 else ">"
        (code,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        extra = bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            at += 4
        code &= 0x0FFFFFFF
        extra += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
        code %= 1000
        size = 8 * (2 + extra)

        def count(at: int) -> int:
            return struct.unpack_from(order + "I", data, at)[0]

        def points(at: int) -> tuple[list, int]:
            n = count(at)
            return [struct.unpack_from(order + "2d", data, at + 4 + size * k) for k in range(n)], at + 4 + size * n

        if code == 1:
            return "Point", struct.unpack_from(order + "2d", data, at), at + size
        if code == 2:
            line, at = points(at)
            return "LineString", line, at
        if code == 3:
            n, at, rings = count(at), at + 4, []
            for _ in range(n):
                ring, at = points(at)
                rings.append(ring)
            return "Polygon", rings, at
        if code in (4, 5, 6):
            n, at, parts = count(at), at + 4, []
            for _ in range(n):
                _, part, at = item(at)
                parts.append(part)
            return KINDS[code][0], parts, at
        raise ValueError(f"geometry type {code} is not supported")

    name, value, _ = item(0)
    return name, value


def write_wkb(name: str, value) -> bytes:
    head = struct.pack("<BI", 1, _CODES[name])
    line = lambda pts: struct.pack("<I", len(pts)) + b"".join(struct.pack("<2d", *p) for p in pts)
    if name == "Point":
        return head + struct.pack("<2d", *value)
    if name == "LineString":
        return head + line(value)
    if name == "Polygon":
        return head + struct.pack("<I", len(value)) + b"".join(map(line, value))
    part = name.removeprefix("Multi")
    return head + struct.pack("<I", len(value)) + b"".join(write_wkb(part, v) for v in value)


def write_wkt(name: str, value) -> str:
    def text(v, depth: int) -> str:
        if depth == 0:
            return f"{v[0]:.17g} {v[1]:.17g}"
        return "(" + ", ".join(text(x, depth - 1) for x in v) + ")"

    if name == "Point":
        return f"POINT ({text(value, 0)})"
    return f"{name.upper()} {text(value, _DEPTH[name])}" if value else f"{name.upper()} EMPTY"


def read_wkt(text: str) -> tuple[str, object]:
    head, _, body = text.partition("(")
    name = next(n for n in KINDS.values() if n[0].upper() == head.strip().split()[0].upper())[0]
    if not body:
        return name, []
    quoted = "[" + body.rpartition(")")[0] + "]"
    out, number = [], ""
    for c in quoted:
        if c in "()[],":
            if number.strip():
                out.append("[" + ",".join(number.split()[:2]) + "]")
            number = ""
            out.append({"(": "[", ")": "]"}.get(c, c))
        else:
            number += c
    value = json.loads("".join(out))
    pairs = lambda v: tuple(v) if v and isinstance(v[0], (int, float)) else [pairs(x) for x in v]
    value = pairs(value)
    if name == "MultiPoint":
        value = [p[0] if isinstance(p, list) else p for p in value]
    return name, value[0] if name == "Point" else value


def _nested(value, depth: int):
    if value is None:
        return None
    return {"x": float(value[0]), "y": float(value[1])} if depth == 0 else [_nested(v, depth - 1) for v in value]


def _tuples(value, depth: int):
    return (value["x"], value["y"]) if depth == 0 else [_tuples(v, depth - 1) for v in value]


def _arrow_type(depth: int) -> pa.DataType:
    kind = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    for _ in range(depth):
        kind = pa.list_(kind)
    return kind


def from_wkb(column: Column, kind: str) -> Column:
    """Geometry of one type name; single geometries become multi ones where asked. Other types raise."""
    depth, ddl = _DEPTH[kind], TYPES[kind]

    @F.arrow_udf(ddl)
    def run(data: pa.Array) -> pa.Array:
        out = []
        for b in data.to_pylist():
            if b is None:
                out.append(None)
                continue
            name, value = read_wkb(b)
            if name != kind:
                if "Multi" + name != kind:
                    raise ValueError(f"the layer has {kind}, a row has {name}")
                value = [value]
            out.append(_nested(value, depth))
        return pa.array(out, _arrow_type(depth))

    return run(column)


def to_wkb(column: Column, kind: str) -> Column:
    depth = _DEPTH[kind]

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else write_wkb(kind, _tuples(v, depth)) for v in values.to_pylist()], pa.binary())

    return run(column)


# Files


def _coordinates(depth: int) -> str:
    kind = "array<double>"
    for _ in range(depth):
        kind = f"array<{kind}>"
    return kind


def _from_arrays(c: Column, depth: int) -> Column:
    if depth == 0:
        return F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))
    return F.transform(c, lambda v: _from_arrays(v, depth - 1))


def _to_arrays(c: Column, depth: int) -> Column:
    return F.array(c["x"], c["y"]) if depth == 0 else F.transform(c, lambda v: _to_arrays(v, depth - 1))


def layer_kind(names: Iterable[str]) -> str | None:
    """The type of a layer whose features have these types: the multi type where single and multi ones occur. Others raise."""
    names = set(names)
    multi = {"Multi" + n.removeprefix("Multi") for n in names}
    if len(multi) > 1 or not names <= _DEPTH.keys():
        raise ValueError(f"a layer of {', '.join(sorted(names))} is not supported")
    return next(iter(names if len(names) == 1 else multi), None)


def _kind_in(names: DataFrame) -> str | None:
    """:func:`layer_kind` of the rows of a table with one column."""
    return layer_kind(r[0] for r in names.distinct().collect() if r[0] is not None)


def _geometry_text(schema: StructType) -> StructType:
    """The properties and the geometry of a feature, the geometry as the text it is written in."""
    kept = [f for f in schema.fields if f.name == "properties" and isinstance(f.dataType, StructType)]
    return StructType([*kept, StructField("geometry", StringType())])


def _shape(text: Column, kind: str) -> Column:
    """The geometry of ``kind`` in a GeoJSON geometry; single ones become multi ones where asked. Others raise."""

    def read(name: str) -> Column:
        c = F.from_json(text, f"coordinates {_coordinates(_DEPTH[name])}")["coordinates"]
        return F.when(c.isNull(), F.raise_error(F.concat(F.lit(f"no coordinates of a {name}: "), text))).otherwise(_from_arrays(c, _DEPTH[name]))

    name, single = F.get_json_object(text, "$.type"), kind.removeprefix("Multi")
    found = F.when(text.isNull(), F.lit(None)).when(name == kind, read(kind))
    if single != kind:
        found = found.when(name == single, F.array(read(single)))
    return found.otherwise(F.raise_error(F.concat(F.lit(f"the layer has {kind}, a row has "), F.coalesce(name, F.lit("no type"))))).cast(TYPES[kind])


def _parsed(rows: DataFrame, kind: str | None) -> tuple[DataFrame, str]:
    """Rows of :func:`_geometry_text` as properties and ``geometry``, and its type."""
    rows = rows.where("geometry is not null")
    kind = kind or _kind_in(rows.select(F.coalesce(F.get_json_object("geometry", "$.type"), F.lit("no type")))) or "Point"
    named = [F.col("properties")[n].alias(n) for n in rows.schema["properties"].dataType.names] if "properties" in rows.columns else []
    return rows.select(*named, _shape(F.col("geometry"), kind).alias("geometry")), kind


def read_geojson(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Properties as columns and ``geometry``, of the type of the layer."""
    return _geojson(spark, path, kind)[0]


def _geojson(spark: SparkSession, path: str, kind: str | None) -> tuple[DataFrame, str]:
    feature = spark.read.option("multiLine", True).json(path).schema["features"].dataType.elementType
    schema = StructType([StructField("features", ArrayType(_geometry_text(feature if isinstance(feature, StructType) else StructType())))])
    return _parsed(spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("features")), kind)


def write_geojson(df: DataFrame, path: str, kind: str, geometry: str = "geometry") -> None:
    """One feature a line, in as many files as partitions; each line is a GeoJSON feature."""
    rest = [c for c in df.columns if c != geometry]
    shape = F.struct(F.lit(kind).alias("type"), _to_arrays(F.col(geometry), _DEPTH[kind]).alias("coordinates"))
    properties = F.struct(*rest) if rest else F.struct(F.lit(None).cast("string").alias("_"))
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), shape.alias("geometry"))).alias("value")).write.mode("overwrite").text(path)


def _wkb_layer(df: DataFrame, geometry: str, kind: str | None) -> tuple[DataFrame, str]:
    @F.arrow_udf("string")
    def name(data: pa.Array) -> pa.Array:
        return pa.array([None if b is None else read_wkb(b)[0] for b in data.to_pylist()], pa.string())

    kind = kind or _kind_in(df.where(F.col(geometry).isNotNull()).select(name(F.col(geometry)))) or "Point"
    return df.withColumn(geometry, from_wkb(F.col(geometry), kind)), kind


def read_features(spark: SparkSession, path: str, layer: str | None = None, kind: str | None = None, geometry: str = "geometry") -> DataFrame:
    """A layer by the ending of its path: Parquet (nested or WKB), GeoJSON, lines of features, GeoPackage, Shapefile."""
    return read_typed(spark, path, layer, kind, geometry)[0]


def read_typed(spark: SparkSession, path: str, layer: str | None = None, kind: str | None = None, geometry: str = "geometry") -> tuple[DataFrame, str | None]:
    """:func:`read_features` and the type of the layer, which nested Parquet doesn't tell."""
    lower = path.lower().rstrip("/")
    if lower.endswith((".parquet", ".geoparquet")):
        df = spark.read.parquet(path)
        if dict(df.dtypes)[geometry] == "binary":
            df, kind = _wkb_layer(df, geometry, kind)
    elif lower.endswith((".geojson", ".json")):
        df, kind = _geojson(spark, path, kind)
    elif lower.endswith((".geojsonl", ".ndjson")):
        df, kind = _parsed(spark.read.schema(_geometry_text(spark.read.json(path).schema)).json(path), kind)
    elif lower.endswith((".gpkg", ".shp")):
        spark.dataSource.register(VectorFile)
        df = spark.read.format("terracell_vector").option("path", path).option("layer", layer or "").load()
        df, kind = _wkb_layer(df, "geometry", kind)
    else:
        raise ValueError(f"unknown kind of file: {path}")
    return df.where(F.col(geometry).isNotNull()), kind


def crs_name(text: str) -> str | None:
    """``EPSG:code`` of a CRS name or a well-known text, or null."""
    if re.search(r"CRS:?84", text):
        return "EPSG:4326"
    if found := re.findall(r"""EPSG\W+(?:[\d.]+\W+)?(\d{4,6})""", text):
        return f"EPSG:{found[-1]}"
    if found := re.search(r"UTM[ _]zone[ _](\d{1,2})([NS])", text, re.I):
        return f"EPSG:{326 if found[2].upper() == 'N' else 327}{int(found[1]):02d}"
    if "PROJCS" in text:
        return "EPSG:3857" if re.search("Pseudo.?Mercator|Web_Mercator", text) else None
    return "EPSG:4326" if re.search("WGS[ _]?(19)?84", text) else None


def layer_crs(spark: SparkSession, path: str, layer: str | None = None) -> str | None:
    """The CRS of a layer, or null where its file doesn't tell.

    GeoJSON has EPSG:4326 unless it names another; a GeoPackage has a table of them, a Shapefile a
    text beside it; plain Parquet doesn't tell.
    """
    lower = path.lower().rstrip("/")
    if lower.endswith((".geojson", ".json")):
        named = spark.read.schema("crs struct<properties:struct<name:string>>").option("multiLine", True).json(path).first()
        return crs_name(named["crs"]["properties"]["name"]) if named and named["crs"] and named["crs"]["properties"] and named["crs"]["properties"]["name"] else "EPSG:4326"
    if lower.endswith((".geojsonl", ".ndjson")):
        return "EPSG:4326"
    if lower.endswith(".gpkg"):
        import sqlite3

        local = path.removeprefix("file://")
        with sqlite3.connect(f"file:{local}?mode=ro", uri=True) as c:
            asked = "SELECT s.organization || ':' || s.organization_coordsys_id FROM gpkg_geometry_columns g JOIN gpkg_spatial_ref_sys s ON g.srs_id = s.srs_id WHERE g.table_name = ?"
            found = c.execute(asked, (layer or gpkg_layers(local)[0],)).fetchone()
        return crs_name(found[0].upper()) if found and found[0] else None
    if lower.endswith(".shp"):
        text = spark.read.option("wholetext", True).text(path[:-4] + ".prj").first() if _there(spark, path[:-4] + ".prj") else None
        return crs_name(text[0]) if text else None
    return None


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


# GeoPackage and Shapefile, as a Python data source


def gpkg_layers(path: str) -> list[str]:
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        return [r[0] for r in c.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name")]


def _gpkg_wkb(blob: bytes | None) -> bytes | None:
    if blob is None:
        return None
    return blob[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7] :]


def _shp_shape(record: bytes) -> bytes | None:
    (code,) = struct.unpack_from("<i", record)
    if code == 0:
        return None
    base = code % 10
    if base == 1:
        return write_wkb("Point", struct.unpack_from("<2d", record, 4))
    if base == 8:
        (n,) = struct.unpack_from("<i", record, 36)
        return write_wkb("MultiPoint", [struct.unpack_from("<2d", record, 40 + 16 * k) for k in range(n)])
    parts, n = struct.unpack_from("<2i", record, 36)
    starts = [*struct.unpack_from(f"<{parts}i", record, 44), n]
    points = [struct.unpack_from("<2d", record, 44 + 4 * parts + 16 * k) for k in range(n)]
    lines = [points[a:b] for a, b in zip(starts, starts[1:])]
    if base == 3:
        return write_wkb("MultiLineString", lines)
    turn = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))
    polygons: list[list] = []
    for ring in lines:  # shells turn right
        if turn(ring) <= 0 or not polygons:
            polygons.append([ring])
        else:
            polygons[-1].append(ring)
    return write_wkb("MultiPolygon", polygons)


def _dbf(path: str) -> tuple[list[str], list[list]]:
    with open(path, "rb") as f:
        data = f.read()
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 13:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(data[at + 11]), data[at + 16]))
        at += 32
    rows = []
    for k in range(n):
        at, row = head + size * k + 1, []
        for _, kind, width in fields:
            text = data[at : at + width].decode("utf-8", "replace").strip().strip("\0")
            row.append(None if not text or text[0] == "*" else float(text) if kind in "NF" else text)
            at += width
        rows.append(row)
    return [f[0] for f in fields], rows


class _Rows(InputPartition):
    pass


class _VectorReader(DataSourceReader):
    def __init__(self, source: VectorFile) -> None:
        self.source = source

    def partitions(self):
        return [_Rows(0)]  # these formats have one file and no splits

    def read(self, partition) -> Iterator[tuple]:
        s = self.source
        if s.path.lower().endswith(".gpkg"):
            import sqlite3

            with sqlite3.connect(f"file:{s.path}?mode=ro", uri=True) as c:
                name, geometry, columns = s.gpkg(c)
                quoted = ", ".join(f'"{x}"' for x in [*columns, geometry])
                for row in c.execute(f'SELECT {quoted} FROM "{name}"'):
                    yield (*(str(v) if kind == "string" and v is not None else v for v, kind in zip(row[:-1], columns.values())), _gpkg_wkb(row[-1]))
            return
        _, rows = _dbf(s.path[:-4] + ".dbf")
        with open(s.path, "rb") as f:
            f.seek(100)
            for row in rows:
                head = f.read(8)
                if len(head) < 8:
                    return
                yield (*(v if v is None or isinstance(v, float) else str(v) for v in row), _shp_shape(f.read(2 * struct.unpack(">2i", head)[1])))


class VectorFile(DataSource):
    """``spark.read.format("terracell_vector")`` for GeoPackage and Shapefile; geometry comes as WKB."""

    @property
    def path(self) -> str:
        return self.options["path"].removeprefix("file://")

    @classmethod
    def name(cls) -> str:
        return "terracell_vector"

    def gpkg(self, c) -> tuple[str, str, dict[str, str]]:
        name = self.options.get("layer") or gpkg_layers(self.path)[0]
        (geometry,) = c.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (name,)).fetchone()
        kind = lambda t: "bigint" if "INT" in t.upper() else "double" if t.upper().split("(")[0] in ("REAL", "DOUBLE", "FLOAT") else "string"
        return name, geometry, {r[1]: kind(r[2]) for r in c.execute(f'PRAGMA table_info("{name}")') if r[1] != geometry}

    def schema(self) -> str:
        if self.path.lower().endswith(".gpkg"):
            import sqlite3

            with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
                columns = self.gpkg(c)[2]
        else:
            names, rows = _dbf(self.path[:-4] + ".dbf")
            columns = {n: "double" if any(isinstance(r[k], float) for r in rows) else "string" for k, n in enumerate(names)}
        return ", ".join([*(f"`{n}` {k}" for n, k in columns.items()), "geometry binary"])

    def reader(self, schema) -> DataSourceReader:
        return _VectorReader(self)
