"""Words, shingles and n-grams of whole Arrow batches of texts, as arrays.

A batch is handled as one run of UTF-8 bytes; nothing loops over words in Python. Hashes are
64 bits wide and depend on the bytes only, not on the process or the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_P, _PINV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_A = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Texts of so many bytes, or one longer text, are handled together.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """``(first row, texts)`` of at most ``limit`` bytes, or one text; null texts become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at, base = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, texts[at:to]
        at, base = to, int(ends[to - 1])


@dataclass
class Words:
    """Bytes of a slice (A-Z lower-cased) and its words: where they start and end, and their row."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    n_rows: int

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of bytes, which are in order and don't overlap."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(end, start[at] + SLICE, "right")))
        base, top = int(start[at]), int(end[to - 1])
        n = top - base
        power, back = _powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data[base:top]] * power[:n], out=total[1:])
        s, e = start[at:to] - base, end[at:to] - base
        out[at:to] = mix((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64) * _A)
        at = to
    return out


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to ``n``; those of a slice are kept."""
    if not _POWERS or len(_POWERS[0]) <= n:
        found = []
        for base in (_P, _PINV):
            power = np.full(max(n, SLICE) + 1, base, np.uint64)
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            found.append(power)
        if n > SLICE:
            return found[0], found[1]
        _POWERS[:] = found
    return _POWERS[0], _POWERS[1]


def words(texts: pa.Array) -> Words:
    """The words of a slice of texts (as :func:`slices` yields them)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | first[1:]
    end[:-1] &= ~solid[1:] | first[1:]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(_LOWER[data], offsets, start, end, np.searchsorted(offsets, start, "right") - 1, len(texts))


def grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words within a row, and their rows."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, row.dtype)
    whole = row[: len(row) - n + 1] == row[n - 1 :]
    value = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        value = value * _A + hashes[i : len(hashes) - n + 1 + i]
    return mix(value[whole] + np.uint64(n)), row[: len(row) - n + 1][whole]


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingles of each text: values sorted within each row, and row offsets.

    A text with fewer words has all of them as its one shingle; a text without words has none.
    """
    w = words(texts)
    h = w.hashes()
    value, row = grams(h, w.row, n)
    count = np.bincount(w.row, minlength=w.n_rows)
    for m in range(1, n):
        short = count[w.row] == m
        if short.any():
            v, r = grams(h[short], w.row[short], m)
            value, row = np.concatenate([value, v]), np.concatenate([row, r])
    order = np.argsort(row, kind="stable")
    value, row = value[order], row[order]
    bounds = np.searchsorted(row, np.arange(w.n_rows + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a > 1:
            value[a:b].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[keep], np.searchsorted(row[keep], np.arange(w.n_rows + 1))


def scorer(text: Column, of_slice: Callable[[pa.Array], pa.Array], kind: str, limit: int = SLICE) -> Column:
    """``of_slice`` as a column: a value of the type ``kind`` for each text.

    Other columns stay in the JVM. The column is evaluated where it is named, once.
    """

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            parts = [of_slice(part) for _, part in slices(texts, limit)]
            yield pa.concat_arrays(parts) if parts else of_slice(pa.array([], pa.large_string()))

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returnType=kind).asNondeterministic()(text)
