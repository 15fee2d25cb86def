"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine ``c`` have the squared distance ``2 - 2c``. Vectors are turned by a fixed
random rotation and cut into blocks of ``BLOCK`` dimensions; each block has a share of the squared
distance in proportion to its dimensions, so a similar pair keeps to the share in one block at
least. In each block a range join finds the pairs within the block's radius: a grid over the
block's first two coordinates sends a vector to its own cell and to all cells that its radius
reaches. A pair counts in the first block in which it keeps to the share, once for each side, and
its cosine is then computed in double precision.

Pairs are counted and joined to trees where they are found; only counts and tree edges leave a
task. Coordinates of unit vectors are bounded, so the grid has at most ``(2 / width + 3) ** 2``
cells a block, whatever the number of vectors; the counts of its cells are read by the driver, and
cells with more vectors than a :func:`chunk` are dealt as pairs of chunks. Equal vectors are one class.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component, or
whose length is not finite, links with nothing; vectors of different dimensions don't link;
repeated rows are links of each other; rows without a vec_id take no part and are returned with
nulls; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.llm.components import components
from terracell.llm.shared import materialise

COSINE, BLOCK, CHUNK, SEED = 0.95, 8, 1 << 15, 17
#: Width of a cell in radii: wider cells send fewer copies of a vector, narrower ones compare fewer pairs.
WIDTH, TILE = 2.0, 256
#: Numbers of a chunk's vectors together.
CHUNK_NUMBERS = 1 << 22
_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(d: int) -> np.ndarray:
    """The rotation of ``d`` dimensions."""
    if d not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng(SEED + d).standard_normal((d, d)))
        _ROTATIONS[d] = q * np.sign(np.diag(r))
    return _ROTATIONS[d]


def chunk(d: int) -> int:
    """Vectors of a chunk: ``CHUNK``, or fewer where they are long."""
    return max(min(CHUNK, CHUNK_NUMBERS // d), 256)


def blocks_of(d: int) -> list[tuple[int, int]]:
    return [(a, min(a + BLOCK, d)) for a in range(0, d, BLOCK)]


def budgets(d: int, cosine: float) -> np.ndarray:
    """The squared distance that each block may hold, with room for rounding."""
    return np.array([(2 - 2 * cosine) * (b - a) / d for a, b in blocks_of(d)]) * (1 + 1e-9) + 1e-12


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, d)


def cells(turned: np.ndarray, block: int, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, cells, own)``: the cells that each vector's radius reaches, and whether it is its own."""
    a, b = blocks_of(turned.shape[1])[block]
    width, reach = WIDTH * radius, radius * (1 + 1e-9) + 1e-12
    span = 2 * math.ceil(1 / width) + 4
    home = np.zeros((len(turned), 2), np.int64)
    low, high = home.copy(), home.copy()
    for axis in range(min(2, b - a)):
        c = turned[:, a + axis]
        home[:, axis], low[:, axis], high[:, axis] = (np.floor(v / width).astype(np.int64) for v in (c, c - reach, c + reach))
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            at = home + (dx, dy)
            rows = np.flatnonzero(((at >= low) & (at <= high)).all(1))
            cell = (at[rows, 0] + span // 2) * span + at[rows, 1] + span // 2
            yield rows, (cell << 16) | block, np.full(len(rows), dx == 0 and dy == 0)


def _place(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        sizes = np.asarray(batch.column("d"))
        for d in np.unique(sizes):
            rows = batch.filter(pa.array(sizes == d))
            turned = unit(_matrix(rows.column("embedding"), int(d))) @ rotation(int(d))
            for block, share in enumerate(budgets(int(d), cosine)):
                for at, cell, own in cells(turned, block, math.sqrt(share)):
                    yield rows, at, cell, own


def _count_job(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, cell, own in _place(batches, cosine):
            value, n = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), rows.column("d")[0].as_py() if len(rows) else 0)), pa.array(value), pa.array(n), pa.array(n * bool(own.any()))], ["d", "cell", "n", "own"])

    return run


def _deal_job(cosine: float, chunks: dict[tuple[int, int], tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at, cell, own in _place(batches, cosine):
            if not len(at):
                continue
            d, ids = rows.column("d")[0].as_py(), np.asarray(rows.column("vec_id"))
            dice = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            first = bool(own[0])
            for value in np.unique(cell):
                chosen = at[cell == value]
                n_own, n_all = chunks[(d, int(value))]
                i, j = dice[chosen] % np.uint64(max(n_own, 1)), dice[chosen] % np.uint64(n_all)
                for left in range(n_own):
                    for right in range(n_all):
                        is_x, is_y = (i == left) & first, j == right
                        use = is_x | is_y
                        if use.any():
                            part = rows.take(pa.array(chosen[use]))
                            n = len(part)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(n, value)), pa.array(np.full(n, left, np.int32)), pa.array(np.full(n, right, np.int32)), pa.array(is_x[use]), pa.array(is_y[use]), part.column("d"), part.column("vec_id"), part.column("copies"), part.column("embedding")],
                                ["cell", "left", "right", "is_x", "is_y", "d", "vec_id", "copies", "embedding"],
                            )

    return run


class Forest:
    """Joins links to trees, many at a time."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            while (self.parent[self.parent] != self.parent).any():
                self.parent = self.parent[self.parent]
            x, y = self.parent[a], self.parent[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))

    def roots(self) -> np.ndarray:
        while (self.parent[self.parent] != self.parent).any():
            self.parent = self.parent[self.parent]
        return self.parent


def links_in(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, block: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of ``x`` and ``y`` (rows of ``vectors``) that count in this block, bit by bit."""
    d = vectors.shape[1]
    own, share = unit(vectors), budgets(d, cosine)
    turned = own @ rotation(d)
    norm = np.sqrt((vectors * vectors).sum(1))
    spans = blocks_of(d)
    a, b = spans[block]
    # The squared distances of a tile come from one product in single precision, with room for its
    # rounding. Both sides are in order of the block's last coordinate, which bounds the tile's partners.
    part = turned[:, a:b].astype(np.float32)
    square, one = (part * part).sum(1, keepdims=True), np.ones((len(part), 1), np.float32)
    left, right = np.hstack([-2 * part, square, one]), np.hstack([part, one, square])
    last, room = turned[:, b - 1], math.sqrt(share[block]) * (1 + 1e-9) + 1e-12
    x, y = x[np.argsort(last[x], kind="stable")], y[np.argsort(last[y], kind="stable")]
    every, sorted_right = y, right[y]
    for at in range(0, len(x), TILE):
        xs = x[at : at + TILE]
        low, high = np.searchsorted(last[every], [last[xs[0]] - room, last[xs[-1]] + room])
        y = every[low : high + 1]
        near = left[xs] @ sorted_right[low : high + 1].T <= np.float32(share[block] + 1e-5)
        p, q = np.nonzero(near)
        p, q = xs[p], y[q]
        for k in range(0, len(p), 1 << 16):
            u, v = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
            u, v = u[u != v], v[u != v]
            gap = (turned[u] - turned[v]) ** 2
            within = [gap[:, s:e].sum(1) <= share[n] for n, (s, e) in enumerate(spans[: block + 1])]
            use = within[block] & ~np.any([*within[:block], np.zeros(len(u), bool)], axis=0)
            u, v = u[use], v[use]
            linked = np.einsum("ij,ij->i", vectors[u], vectors[v]) / (norm[u] * norm[v]) >= cosine
            yield u[linked], v[linked]


def _join_job(cosine: float):
    def run(group: pa.Table) -> pa.Table:
        d = group.column("d")[0].as_py()
        group = group.combine_chunks()
        vectors = np.asarray(pa.concat_arrays(group.column("embedding").chunks).flatten(), np.float64).reshape(-1, d)
        ids, copies = np.asarray(group.column("vec_id")), np.asarray(group.column("copies"))
        x, y = (np.flatnonzero(np.asarray(group.column(c))) for c in ("is_x", "is_y"))
        block = int(group.column("cell")[0].as_py()) & 0xFFFF
        scale = np.abs(vectors).max(1, keepdims=True)  # exact cosine does not need the lengths
        vectors = vectors / np.exp2(np.floor(np.log2(scale)))
        n, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        for u, v in links_in(vectors, x, y, block, cosine):
            np.add.at(n, u, copies[v])
            forest.add(u, v)
        root = forest.roots()
        keep = (n > 0) | (root != np.arange(len(ids)))
        return pa.table({"vec_id": ids[keep], "n": n[keep], "root": ids[root][keep]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector."""
    rows = vectors.select("vec_id", "embedding")
    numbers = F.col("embedding").cast("array<double>")
    fine = F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(numbers, lambda v: v != 0)
    sound = F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("sound", sound)
    classes = rows.where("sound").groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes.select("vec_id", "copies", "embedding", F.size("embedding").cast("long").alias("d")), "vector-classes")
    given = classes.select("d", "vec_id", "copies", "embedding")
    kind = classes.schema["embedding"].dataType.simpleString()  # single precision travels as such
    counted = given.mapInArrow(_count_job(cosine), "d long, cell long, n long, own long").groupBy("d", "cell").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    chunks = {(r["d"], r["cell"]): (math.ceil(r["own"] / chunk(r["d"])), math.ceil(r["n"] / chunk(r["d"]))) for r in counted.collect()}
    dealt = given.mapInArrow(_deal_job(cosine, chunks), f"cell long, left int, right int, is_x boolean, is_y boolean, d long, vec_id long, copies long, embedding {kind}")
    found = materialise(dealt.groupBy("d", "cell", "left", "right").applyInArrow(_join_job(cosine), "vec_id long, n long, root long"), "vector-links")
    reach = components(found.where("root <> vec_id").select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    one = classes.select("vec_id", "copies", "embedding").join(counts, "vec_id", "left").join(reach, classes["vec_id"] == reach["node"], "left")
    one = one.select(F.col("embedding").alias("_e"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("root", "vec_id").alias("root"))
    joined = rows.join(one, F.col("sound") & (F.col("embedding") == F.col("_e")), "left")
    component = F.coalesce("root", "vec_id")
    return joined.select(
        "vec_id",
        F.when(F.col("vec_id").isNotNull(), F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), (F.col("vec_id") == component).alias("kept"),
    )
