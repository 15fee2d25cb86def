"""GeoTIFF: metadata, values and a writer.

A file is a directory of tags and blocks (strips or tiles). The driver reads the tags; blocks are
dealt to tasks, and each task seeks to its own, so a large file is read in parallel and a block is
all that a worker holds. Paths are those of a folder that all machines mount.

Read: classic and BigTIFF, either byte order, one or more bands in either layout, integers and
floats of 8 to 64 bits, no compression, LZW, deflate or PackBits, horizontal and floating point
predictors. Cells with the value of no data are returned as they are stored. A file without blocks
of some area (sparse) has no cells there. Written: deflated strips of float64 or int32.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.functions.grid import GridDefinition

#: The formats of the file's types, and the numbers of its tags and keys.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR = 256, 257, 258, 259, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT, SCALE, TIEPOINT, MATRIX, KEYS, NODATA = 317, 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
RASTER_TYPE, GEOGRAPHIC, PROJECTED = 1025, 2048, 3072
#: Bytes of cells of a task, and rows of a written strip.
TASK, STRIP = 16 << 20, 64


@dataclass(frozen=True)
class Tiff:
    """What the tags say: the grid, bands, and how blocks are laid out and packed."""

    path: str
    grid: GridDefinition
    bands: int
    dtype: str
    block: tuple[int, int]
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    planar: bool
    tiled: bool
    compression: int
    predictor: int
    nodata: float | None

    @property
    def across(self) -> int:
        return -(-self.grid.width // self.block[0])

    @property
    def down(self) -> int:
        return -(-self.grid.height // self.block[1])


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _tags(path: str) -> tuple[str, dict[int, tuple]]:
    with open(_local(path), "rb") as f:
        head = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or (kind := struct.unpack_from(order + "H", head, 2)[0]) not in (42, 43):
            raise ValueError(f"{path} is no TIFF")
        big = kind == 43
        f.seek(struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0])
        (n,) = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))
        size, room = (20, 8) if big else (12, 4)
        entries, found = f.read(n * size), {}
        for k in range(n):
            tag, code, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), entries, k * size)
            if code not in _TYPES:
                continue
            form = f"{order}{count}s" if code == 2 else order + _TYPES[code] * count if code in (5, 10) else f"{order}{count}{_TYPES[code]}"
            value = entries[(k + 1) * size - room : (k + 1) * size]
            if struct.calcsize(form) > room:
                f.seek(struct.unpack(order + ("Q" if big else "I"), value)[0])
                value = f.read(struct.calcsize(form))
            found[tag] = struct.unpack_from(form, value)
    return order, found


def _transform(tags: dict[int, tuple], path: str, point: bool) -> tuple[float, ...]:
    if MATRIX in tags:
        m = tags[MATRIX]
        a, b, c, d, e, f = m[0], m[1], m[3], m[4], m[5], m[7]
    elif SCALE in tags and TIEPOINT in tags:
        (sx, sy), (i, j, _, x, y) = tags[SCALE][:2], tags[TIEPOINT][:5]
        a, b, c, d, e, f = sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy
    else:
        raise ValueError(f"{path} has no transform")
    return (a, b, c - (a + b) / 2, d, e, f - (d + e) / 2) if point else (a, b, c, d, e, f)


def read_tiff(path: str) -> Tiff:
    """The tags of a GeoTIFF. One without a CRS or a transform raises."""
    order, t = _tags(path)
    keys = t.get(KEYS, ())
    held = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    code = next((held[k] for k in (PROJECTED, GEOGRAPHIC) if 0 < held.get(k, 0) < 32767), None)
    if code is None:
        raise ValueError(f"{path} has no CRS of a known code")
    width, height, bands = t[WIDTH][0], t[HEIGHT][0], t.get(SAMPLES, (1,))[0]
    bits, kinds = set(t.get(BITS, (1,))), set(t.get(FORMAT, (1,)))
    if len(bits) > 1 or len(kinds) > 1 or (bits | {8, 16, 32, 64}) != {8, 16, 32, 64} or not kinds <= {1, 2, 3}:
        raise ValueError(f"{path}: bands of this type are not read")
    tiled = TILE_OFFSETS in t
    block = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (width, min(t.get(ROWS, (height,))[0], height))
    nodata = t[NODATA][0].split(b"\0")[0].strip().decode() if NODATA in t else ""
    compression, predictor = t.get(COMPRESSION, (1,))[0], t.get(PREDICTOR, (1,))[0]
    if compression not in (1, 5, 8, 32773, 32946) or predictor not in (1, 2, 3):
        raise ValueError(f"{path}: compression {compression} with predictor {predictor} is not read")
    grid = GridDefinition(f"EPSG:{code}", width, height, tuple(float(x) for x in _transform(t, path, held.get(RASTER_TYPE) == 2)))
    return Tiff(
        path, grid, bands, order + "uif"[kinds.pop() - 1] + str(bits.pop() // 8), block, t[TILE_OFFSETS if tiled else OFFSETS], t[TILE_COUNTS if tiled else COUNTS],
        t.get(PLANAR, (1,))[0] == 2, tiled, compression, predictor, float(nodata) if nodata else None,
    )


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 starts anew, 257 ends."""
    out, table, width, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
    value, held = 0, 0
    for byte in data:
        value, held = (value << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code, value = value >> held, value & ((1 << held) - 1)
        if code == 256:
            del table[258:]
            width, last = 9, b""
        elif code == 257:
            break
        else:
            if code > len(table) or (code == len(table) and not last):
                raise ValueError("a block has a broken LZW code")
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last:
                table.append(last + entry[:1])
            last = entry
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def decode(tiff: Tiff, data: bytes, rows: int) -> np.ndarray:
    """A block as ``(rows, columns, samples)``."""
    raw = {1: bytes, 5: _lzw, 32773: _packbits}.get(tiff.compression, zlib.decompress)(data)
    kind, columns, samples = np.dtype(tiff.dtype), tiff.block[0], 1 if tiff.planar else tiff.bands
    n = rows * columns * samples
    if len(raw) < n * kind.itemsize:
        raise ValueError(f"{tiff.path}: a block is cut short")
    if tiff.predictor == 3:  # bytes of a row by significance, each the difference to the one before
        b = np.frombuffer(raw, np.uint8, n * kind.itemsize).reshape(rows, -1, samples)
        b = np.cumsum(b, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, columns * samples)
        return np.ascontiguousarray(b.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, columns, samples)
    x = np.frombuffer(raw, kind, n).reshape(rows, columns, samples)
    return np.cumsum(x, axis=1, dtype=kind.newbyteorder("=")) if tiff.predictor == 2 else x


def _read_job(tiff: Tiff, bands: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = tiff.across * tiff.down
        with open(_local(tiff.path), "rb") as f:
            for batch in batches:
                for k in batch.column("id").to_pylist():
                    plane, at = divmod(k, each)
                    row, column = at // tiff.across * tiff.block[1], at % tiff.across * tiff.block[0]
                    chosen = [b for b in bands if not tiff.planar or b == plane + 1]
                    if not chosen or not tiff.counts[k]:
                        continue
                    rows = tiff.block[1] if tiff.tiled else min(tiff.block[1], tiff.grid.height - row)
                    f.seek(tiff.offsets[k])
                    x = decode(tiff, f.read(tiff.counts[k]), rows)[: tiff.grid.height - row, : tiff.grid.width - column]
                    j, i = (c.ravel() for c in np.mgrid[row : row + x.shape[0], column : column + x.shape[1]])
                    for b in chosen:
                        v = x[:, :, 0 if tiff.planar else b - 1].ravel().astype(np.float64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), b, np.int32)), pa.array(j), pa.array(i), pa.array(v)], ["band", "j", "i", "value"])

    return run


def read_values(spark: SparkSession, path: str, bands: tuple[int, ...] | None = None) -> DataFrame:
    """``band, j, i, value`` of some bands, or of all."""
    tiff = read_tiff(path)
    bands = tuple(bands or range(1, tiff.bands + 1))
    if not set(bands) <= set(range(1, tiff.bands + 1)):
        raise ValueError(f"{path} has the bands 1 to {tiff.bands}")
    size = tiff.grid.width * tiff.grid.height * tiff.bands * np.dtype(tiff.dtype).itemsize
    tasks = max(1, min(len(tiff.offsets), -(-size // TASK)))
    return spark.range(0, len(tiff.offsets), 1, tasks).mapInArrow(_read_job(tiff, bands), "band int, j long, i long, value double")


def write_geotiff(values: DataFrame, path: str, grid: GridDefinition, fill: float = 0.0, dtype: str = "double") -> None:
    """``j, i, value`` as a GeoTIFF of one band: strips are packed in tasks, the driver appends one after another."""
    if dtype not in ("double", "int"):
        raise ValueError("values are written as double or int")
    missing = {"j", "i", "value"} - set(values.columns)
    if missing:
        raise ValueError(f"a raster has the columns j, i, value; missing: {', '.join(sorted(missing))}")
    code = grid.crs.upper().removeprefix("EPSG:")
    if not code.isdigit():
        raise ValueError("the grid's CRS has no EPSG code")
    kind, width, height, strips = np.dtype("<f8" if dtype == "double" else "<i4"), grid.width, grid.height, -(-grid.height // STRIP)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        first = key[0].as_py() * STRIP
        x = np.full((min(STRIP, height - first), width), fill, kind)
        there = table.filter(table.column("j").is_valid())
        if len(there):
            x[np.asarray(there.column("j")) - first, np.asarray(there.column("i"))] = np.asarray(there.column("value")).astype(kind)
        return pa.table({"strip": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([zlib.compress(x.tobytes())], pa.binary())})

    spark = values.sparkSession
    inside = values.where(f"j >= 0 and j < {height} and i >= 0 and i < {width} and value is not null")
    rows = inside.select(F.floor(F.col("j") / STRIP).cast("long").alias("strip"), F.col("j").cast("long").alias("j"), F.col("i").cast("long").alias("i"), F.col("value").cast("double").alias("value"))
    none = F.lit(None)
    every = spark.range(strips).select(F.col("id").alias("strip"), none.cast("long").alias("j"), none.cast("long").alias("i"), none.cast("double").alias("value"))
    packed = rows.unionByName(every).groupBy("strip").applyInArrow(pack, "strip long, data binary").orderBy("strip")
    a, b, c, d, e, f = grid.transform
    geographic = int(code) in range(4000, 5000)
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, RASTER_TYPE, 0, 1, 1, GEOGRAPHIC if geographic else PROJECTED, 0, 1, int(code))
    os.makedirs(os.path.dirname(os.path.abspath(_local(path))), exist_ok=True)
    with open(_local(path), "wb") as out:
        out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
        offsets, counts = [], []
        for r in packed.toLocalIterator():
            offsets.append(out.tell())
            counts.append(len(r["data"]))
            out.write(r["data"])
        tags = {
            WIDTH: ("I", (width,)), HEIGHT: ("I", (height,)), BITS: ("H", (8 * kind.itemsize,)), COMPRESSION: ("H", (8,)), 262: ("H", (1,)), OFFSETS: ("Q", tuple(offsets)), SAMPLES: ("H", (1,)),
            ROWS: ("I", (STRIP,)), COUNTS: ("Q", tuple(counts)), PLANAR: ("H", (1,)), FORMAT: ("H", (3 if dtype == "double" else 2,)), MATRIX: ("d", (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)), KEYS: ("H", keys),
        }
        codes, entries = {"H": 3, "I": 4, "d": 12, "Q": 16}, []
        for tag, (form, value) in sorted(tags.items()):
            data = struct.pack(f"<{len(value)}{form}", *value)
            if len(data) > 8:
                at = out.tell()
                out.write(data)
                data = struct.pack("<Q", at)
            entries.append(struct.pack("<HHQ", tag, codes[form], len(value)) + data.ljust(8, b"\0"))
        at = out.tell()
        out.write(struct.pack("<Q", len(entries)) + b"".join(entries) + struct.pack("<Q", 0))
        out.seek(8)
        out.write(struct.pack("<Q", at))
