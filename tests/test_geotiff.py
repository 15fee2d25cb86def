"""GeoTIFF: files of many layouts, made here by hand, and the writer's round trip."""

import struct
import zlib

import numpy as np
import pytest

from terracell import cli
from terracell.functions.grid import GridDefinition
from terracell.sources import geotiff, rasters, vector

GRID = GridDefinition("EPSG:32631", 11, 7, (2.0, 0.0, 100.0, 0.0, -2.0, 50.0))


def lzw(data):
    """A plain packer."""
    out, table, last, width = [], {}, b"", 9

    def reset():
        table.clear()
        table.update({bytes([i]): i for i in range(256)})

    reset()
    out.append((256, 9))
    size = 258
    for byte in data:
        if last + bytes([byte]) in table:
            last += bytes([byte])
            continue
        out.append((table[last], width))
        table[last + bytes([byte])] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            out.append((256, width))
            reset()
            size, width = 258, 9
        last = bytes([byte])
    out.append((table[last], width))
    size += 1
    out.append((257, 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12))
    bits = "".join(f"{c:0{w}b}" for c, w in out)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def packbits(data):
    return b"".join(bytes([len(c) - 1]) + c for c in (data[k : k + 100] for k in range(0, len(data), 100)))


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}


def tiff(path, x, order="<", compression=1, predictor=1, tile=None, rows=3, planar=False, point=False):
    """``x`` is ``(bands, height, width)``."""
    bands, height, width = x.shape
    kind = x.dtype.newbyteorder(order)
    bw, bh = tile or (width, rows)
    blocks = []
    for plane in range(bands) if planar else [slice(None)]:
        part = x[[plane]] if planar else x
        for r in range(0, height, bh):
            for c in range(0, width, bw):
                b = part[:, r : r + bh, c : c + bw].transpose(1, 2, 0)
                if tile:
                    b = np.pad(b, ((0, bh - b.shape[0]), (0, bw - b.shape[1]), (0, 0)))
                if predictor == 2:
                    b = np.diff(b, axis=1, prepend=np.zeros_like(b[:, :1]))
                if predictor == 3:
                    raw = np.ascontiguousarray(b).astype(b.dtype.newbyteorder(">")).view(np.uint8).reshape(b.shape[0], b.shape[1] * b.shape[2], -1).transpose(0, 2, 1).reshape(b.shape[0], -1, b.shape[2])
                    data = np.diff(raw, axis=1, prepend=np.zeros_like(raw[:, :1])).tobytes()
                else:
                    data = b.astype(kind).tobytes()
                blocks.append(PACK[compression](data))
    a, _, c, _, e, f = GRID.transform
    shift = 0.5 if point else 0
    keys = (1, 1, 0, 2, 1025, 0, 1, 2 if point else 1, 3072, 0, 1, 32631)
    tags = {256: ("I", (width,)), 257: ("I", (height,)), 258: ("H", (8 * x.dtype.itemsize,) * bands), 259: ("H", (compression,)), 277: ("H", (bands,)), 284: ("H", (2 if planar else 1,)), 317: ("H", (predictor,)), 339: ("H", ({"u": 1, "i": 2, "f": 3}[x.dtype.kind],) * bands), 33550: ("d", (a, -e, 0.0)), 33922: ("d", (0.0, 0.0, 0.0, c + a * shift, f + e * shift, 0.0)), 34735: ("H", keys), 42113: ("s", (b"-9999\0",))}
    tags |= {322: ("I", (bw,)), 323: ("I", (bh,))} if tile else {278: ("I", (rows,))}
    body, offsets = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0), []
    for b in blocks:
        offsets.append(len(body))
        body += b
    tags |= {324 if tile else 273: ("I", tuple(offsets)), 325 if tile else 279: ("I", tuple(map(len, blocks)))}
    entries = b""
    for tag, (form, value) in sorted(tags.items()):
        data = value[0] if form == "s" else struct.pack(f"{order}{len(value)}{form}", *value)
        n = len(data) if form == "s" else len(value)
        if len(data) > 4:
            data, at = b"", (body := body + data) and struct.pack(order + "I", len(body) - len(data))
        else:
            at = data.ljust(4, b"\0")
        entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[form], n) + at
    at = len(body)
    body += struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0)
    path.write_bytes(body[:4] + struct.pack(order + "I", at) + body[8:])


def sample(dtype, bands=1):
    x = np.random.default_rng(3).integers(0, 200, (bands, GRID.height, GRID.width))
    return (x / 3).astype(dtype) if np.dtype(dtype).kind == "f" else x.astype(dtype)


LAYOUTS = [
    ("f4", 1, {}), ("f8", 1, {"order": ">"}), ("u1", 1, {"compression": 32773}), ("i2", 3, {"compression": 8, "predictor": 2}), ("i4", 2, {"planar": True, "compression": 5}),
    ("f4", 1, {"tile": (16, 16), "compression": 8, "predictor": 3}), ("f4", 2, {"tile": (4, 4), "compression": 5, "predictor": 1}), ("u2", 2, {"tile": (8, 4), "planar": True, "order": ">", "compression": 8, "predictor": 2}), ("f8", 1, {"compression": 8, "predictor": 3, "rows": 7}), ("f4", 1, {"point": True}),
]


@pytest.mark.parametrize(("dtype", "bands", "layout"), LAYOUTS)
def test_blocks_decode(tmp_path, dtype, bands, layout):
    x = sample(dtype, bands)
    tiff(tmp_path / "a.tif", x, **layout)
    found = geotiff.read_tiff(str(tmp_path / "a.tif"))
    assert (found.grid, found.bands, found.nodata) == (GRID, bands, -9999.0)
    import pyarrow as pa

    job = geotiff._read_job(found, tuple(range(1, bands + 1)))
    got = np.full(x.shape, np.nan)
    for b in job(iter([pa.record_batch({"id": list(range(len(found.offsets)))})])):
        for band, j, i, v in zip(*(b.column(c).to_pylist() for c in ("band", "j", "i", "value"))):
            assert np.isnan(got[band - 1, j, i])
            got[band - 1, j, i] = v
    assert (got == x.astype(float)).all()


def test_lzw_of_long_data():
    data = np.random.default_rng(1).integers(0, 50, 60000).astype(np.uint8).tobytes()
    assert geotiff._lzw(lzw(data)) == data


def test_reads_by_spark_and_commands(spark, tmp_path):
    x = sample("f4", 2)
    tiff(tmp_path / "r.tif", x, tile=(4, 4), compression=8)
    path = str(tmp_path / "r.tif")
    assert rasters.read_metadata(spark, path) == (GRID, (1, 2)) and rasters.read_grid(spark, path) == GRID
    got = {(r.j, r.i): r.value for r in rasters.read_band(spark, path, 2).collect()}
    assert got == {(j, i): float(x[1, j, i]) for j in range(GRID.height) for i in range(GRID.width)}
    with pytest.raises(ValueError):
        rasters.read_band(spark, path, 3)
    (tmp_path / "l.geojson").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": 1}, "geometry": {"type": "LineString", "coordinates": [[101.0, 49.0], [105.0, 49.0]]}}]}')
    cli.main(["split", "-f", str(tmp_path / "l.geojson"), "-r", path, "-a", "-b", "1", "-c", "d", "-o", str(tmp_path / "o.parquet")], spark)
    rows = spark.read.parquet(str(tmp_path / "o.parquet")).orderBy("split").collect()
    assert [(r.index_i, r.index_j, r.d) for r in rows] == [(k, 0, float(x[0, 0, k])) for k in range(3)]


@pytest.mark.parametrize("dtype", ["double", "int"])
def test_round_trip(spark, tmp_path, dtype):
    grid = GridDefinition("EPSG:4326", 5, 150, (0.5, 0.0, -10.0, 0.0, -0.25, 40.0))
    rows = [(j, i, float(j * 10 + i)) for j in range(grid.height) for i in range(grid.width) if (j + i) % 3 and j not in range(64, 128)]
    geotiff.write_geotiff(spark.createDataFrame([*rows, (999, 0, 1.0), (0, -1, 1.0)], "j long, i long, value double"), str(tmp_path / "o" / "w.tif"), grid, -1.0, dtype)
    path = str(tmp_path / "o" / "w.tif")
    assert rasters.read_metadata(spark, path) == (grid, (1,))
    got = {(r.j, r.i): r.value for r in rasters.read_band(spark, path).collect()}
    want = {(j, i): v for j, i, v in rows}
    assert got == {(j, i): want.get((j, i), -1.0) for j in range(grid.height) for i in range(grid.width)}


def test_others_raise(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"no tiff at all, this")
    with pytest.raises(ValueError):
        geotiff.read_tiff(str(tmp_path / "a.tif"))
    with pytest.raises(ValueError):
        geotiff.write_geotiff(spark.createDataFrame([(1,)], "x int"), str(tmp_path / "b.tif"), GRID)
    assert vector.crs_name("EPSG:4326") == "EPSG:4326"
