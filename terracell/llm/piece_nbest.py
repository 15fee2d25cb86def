"""SentencePiece encoding and decoding with the n best segmentations.

The pieces of a vocabulary form a lattice over a text. Forward Viterbi scores are the exact cost
from the start to each position; a backward A-star search from the end with these scores as its
heuristic finds complete segmentations in order of their scores, without a dead end.

No piece reaches over a word start or a line end, so the lattice of a text is a chain of the
lattices of its units. The best segmentation of a text joins the best of its units. The n best of
a text differ from it only in the n - 1 units whose second segmentation costs least, so the search
runs in those. The forward scores of all units of a slice of texts are computed together, length by
length; results for units are kept in a bounded store of each worker.

Spaces become the word mark, one mark is put in front, and characters without a piece become the
pieces of their UTF-8 bytes, the word mark itself too: decoding restores every text exactly.
Scores: those of the model if it is a unigram model; for merge-ranked vocabularies, whose scores
are merge ranks only, ``-log(rank + 2)``.

A column holds the ids of the best segmentation and, for each other one, what it replaces in the
best; :func:`segmentations` makes whole lists of them.

Defined results: null and empty texts have no pieces, score 0 and one segmentation; of a unit's
segmentations of equal best score that of the forward pass is first, others are ordered by their ids; lone surrogates don't occur in Spark strings; an empty
table gives no rows; extra columns are kept.
"""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm import textbatch
from terracell.llm.shared import arrow_bytes, free_name

MODEL, N_BEST, MARK, STORE = "/opt/tokenizers/piece_bpe_32k.model", 4, "▁", 200_000
#: ``others``: for each segmentation after the best, what it has in place of ``count`` ids of the best from ``at`` on, in order.
RESULT = "struct<ids:array<int>,scores:array<double>,exact:boolean,others:array<array<struct<at:int,count:int,ids:array<int>>>>>"
_NONE = -math.inf


@dataclass
class Vocabulary:
    """``pieces``: text to (id, score); ``raw``: bytes of each id; ``octets``: ids of the 256 bytes."""

    pieces: dict[str, tuple[int, float]]
    raw: list[bytes]
    octets: list[int]
    octet_score: float
    _prefixes: set | None = field(default=None, repr=False)
    _store: dict = field(default_factory=dict, repr=False)
    _units: object = field(default=None, repr=False)

    def __getstate__(self):
        return (self.pieces, self.raw, self.octets, self.octet_score)

    def __setstate__(self, state):
        self.pieces, self.raw, self.octets, self.octet_score = state
        self._prefixes, self._store, self._units = None, {}, None

    @property
    def prefixes(self) -> set:
        if self._prefixes is None:
            self._prefixes = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}
        return self._prefixes

    def units(self, text: str) -> list[str]:
        """Parts of a marked text that no piece reaches over."""
        if self._units is None:
            over_mark = any(MARK in p.lstrip(MARK) for p in self.pieces)
            over_line = any("\n" in p and len(p) > 1 for p in self.pieces)
            self._units = re.compile(r"(?s).+" if over_mark or over_line else f"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall
        return self._units(text)


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece model file, read where this is called."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    ids = range(sp.vocab_size())
    octets = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    scores = {i: sp.get_score(i) for i in plain}
    ranked = all(s == round(s) for s in scores.values())
    scores = {i: -math.log(2 - s) if ranked else s for i, s in scores.items()}
    raw = [b""] * len(ids)
    for b, i in enumerate(octets):
        raw[i] = bytes([b])
    for i in plain:
        raw[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
    return Vocabulary({sp.id_to_piece(i): (i, s) for i, s in scores.items()}, raw, octets, min(scores.values()) - 10)


#: A mark of the text itself, while marks stand for spaces.
_OWN = ""


def marked(text: str) -> str:
    """The text with word marks; its own marks stand apart (and private characters are doubled)."""
    if MARK in text or _OWN in text:
        text = text.replace(_OWN, _OWN + _OWN).replace(MARK, _OWN + "m")
    return MARK + text.replace(" ", MARK)


def edges_from(v: Vocabulary, unit: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
    """For each position, the pieces that start there: ``(end, score, ids)``."""
    out, pieces, prefixes, n = [], v.pieces, v.prefixes, len(unit)
    for i in range(n):
        found = []
        for j in range(i + 1, n + 1):
            part = unit[i:j]
            if part not in prefixes:
                break
            hit = pieces.get(part)
            if hit is not None:
                found.append((j, hit[1], (hit[0],)))
        if not found or found[0][0] != i + 1:
            size, data = 1, unit[i]
            if data == _OWN and i + 1 < n:
                size, data = 2, MARK if unit[i + 1] == "m" else _OWN
            data = data.encode("utf-8", "surrogatepass")
            found.append((i + size, v.octet_score * len(data), tuple(v.octets[b] for b in data)))
        out.append(found)
    return out


def viterbi(v: Vocabulary, unit: str) -> tuple[float, tuple[int, ...], float]:
    """Best score, its ids, and how much less the second best has (infinite where there is none)."""
    edges, n = edges_from(v, unit), len(unit)
    best, back = [_NONE] * (n + 1), [None] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        here = best[i]
        if here == _NONE:
            continue
        for e in edges[i]:
            total = here + e[1]
            if total > best[e[0]]:
                best[e[0]], back[e[0]] = total, (i, e)
    rest = [_NONE] * (n + 1)
    rest[n] = 0.0
    for i in range(n - 1, -1, -1):
        rest[i] = max([e[1] + rest[e[0]] for e in edges[i]])
    path, at = [], n
    while at:
        at, e = back[at]
        path.append((at, e))
    path.reverse()
    used, second = {(i, e[0], e[2]) for i, e in path}, _NONE
    for i in range(n):
        if best[i] == _NONE:
            continue
        for e in edges[i]:
            if (i, e[0], e[2]) not in used:
                second = max(second, best[i] + e[1] + rest[e[0]])
    ids = tuple(x for _, e in path for x in e[2])
    return best[n], ids, best[n] - second


def n_best(v: Vocabulary, unit: str, n: int = N_BEST) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best segmentations of a unit, by backward A-star search."""
    edges, size = edges_from(v, unit), len(unit)
    into: list[list] = [[] for _ in range(size + 1)]
    best = [_NONE] * (size + 1)
    best[0] = 0.0
    for i in range(size):
        if best[i] == _NONE:
            continue
        for e in edges[i]:
            into[e[0]].append((i, e[1], e[2]))
            best[e[0]] = max(best[e[0]], best[i] + e[1])
    found: list[tuple[float, tuple[int, ...]]] = []
    heap = [(-best[size], 0.0, size, ())]
    while heap and (len(found) < n or -heap[0][0] >= found[-1][0] - 1e-9):  # ties at the end are ordered below
        cost, done, at, ids = heapq.heappop(heap)
        if at == 0:
            found.append((done, ids))
            if len(found) > 4 * n:
                break
            continue
        for i, score, part in into[at]:
            heapq.heappush(heap, (-(best[i] + score + done), done + score, i, part + ids))
    found.sort(key=lambda f: (-round(f[0], 9), f[1]))
    return found[:n]


def ways_of(v: Vocabulary, unit: str, best: tuple[int, ...], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """How much less than the best each of the n best segmentations of a unit has, and its ids; ``best`` is the first."""
    found = n_best(v, unit, n)
    top = found[0][0]
    return [(0.0, best), *[(w - top, ids) for w, ids in found if ids != best]][:n]


def encode(v: Vocabulary, text: str | None, n: int = N_BEST) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of a text: ``(score, ids)``, best first."""
    if not text:
        return [(0.0, [])]
    units, store, kept = v.units(marked(text)), v._store, []
    for u in units:
        hit = store.get(u)
        if hit is None:
            hit = viterbi(v, u)
            if len(store) >= STORE:
                store.clear()
            if len(u) < 64:
                store[u] = hit
        kept.append(hit)
    score = math.fsum([k[0] for k in kept])
    ids = [x for k in kept for x in k[1]]
    out = [(score, ids)]
    if n > 1:
        near = [(g, i) for g, i in heapq.nsmallest(n - 1, ((k[2], i) for i, k in enumerate(kept))) if g < math.inf]
        combos: list[tuple[float, dict[int, tuple[int, ...]]]] = [(0.0, {})]
        for _, i in sorted(near, key=lambda x: x[1]):
            ways = ways_of(v, units[i], kept[i][1], n)
            combos = heapq.nlargest(n, [(s + w, c | {i: p}) for s, c in combos for w, p in ways], key=lambda x: x[0])
        for gap, changed in combos[1:]:
            out.append((score + gap, [x for i, k in enumerate(kept) for x in changed.get(i, k[1])]))
    return out


def decode(v: Vocabulary, ids: list[int]) -> str:
    """The text of ids."""
    return b"".join([v.raw[i] for i in ids]).decode("utf-8", "replace")[1:]


_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Longer units, and units with characters that have no piece, are handled one by one.
LONGEST, SLICE = 40, 2 << 20


class Lattices:
    """Viterbi over many units at once, with the results of units seen before."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        keys = np.array([self._hash(p) for p in v.pieces], np.uint64)
        order = np.argsort(keys)
        assert len(np.unique(keys)) == len(keys)
        self.keys = keys[order]
        self.ids = np.array([i for i, _ in v.pieces.values()], np.int32)[order]
        self.scores = np.array([s for _, s in v.pieces.values()])[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.longest = max(map(len, v.pieces))
        self.raw_start = np.concatenate([[0], np.cumsum([len(r) for r in v.raw])])
        self.raw = np.frombuffer(b"".join(v.raw), np.uint8)
        self.ways: dict[str, list] = {}
        self.forget()

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
        return int(textbatch.mix(np.array([h], np.uint64))[0])

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.score, self.gap = np.zeros(0), np.zeros(0)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (minus infinity without a piece) and ids."""
        score, piece = np.full(len(h), -np.inf), np.full(len(h), -1, np.int32)
        h = textbatch.mix(h)
        some = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
        hit = self.keys[at] == h[some]
        score[some[hit]], piece[some[hit]] = self.scores[at[hit]], self.ids[at[hit]]
        return score, piece

    def _solve(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Units of one length as rows of codes: score, gap to the second best, ids (row by row), pieces of each.

        Rows with a character that has no piece get a score of minus infinity.
        """
        rows, n = c.shape
        prefix = np.zeros((n + 1, rows), np.uint64)
        for k in range(n):
            prefix[k + 1] = prefix[k] * _BASE + (c[:, k].astype(np.uint64) + np.uint64(1))
        power = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(n + 1)]
        best = np.full((n + 1, rows), -np.inf)
        best[0] = 0
        back, of = np.zeros((n + 1, rows), np.int16), np.full((n + 1, rows), -1, np.int32)
        edge: dict[tuple[int, int], np.ndarray] = {}
        whole = np.ones(rows, bool)
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                score, piece = self._lookup(prefix[j] - prefix[i] * power[j - i])
                if i == j - 1:
                    whole &= piece >= 0
                edge[i, j] = score
                total = best[i] + score
                better = total > best[j]
                best[j][better], back[j][better], of[j][better] = total[better], i, piece[better]
        rest = np.full((n + 1, rows), -np.inf)
        rest[n] = 0
        for i in range(n - 1, -1, -1):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                np.maximum(rest[i], edge[i, j] + rest[j], out=rest[i])
        on = np.zeros((n + 1, rows), bool)
        on[n] = True
        for j in range(n, 0, -1):
            at = np.flatnonzero(on[j])
            on[back[j][at], at] = True
        second = np.full(rows, -np.inf)
        for (i, j), score in edge.items():
            through = best[i] + score + rest[j]
            through[on[j] & (back[j] == i)] = -np.inf
            np.maximum(second, through, out=second)
        used = on[1:].T
        gap = np.where(whole, best[n], 0) - second
        return np.where(whole, best[n], -np.inf), gap, of[1:].T[used & whole[:, None]], used.sum(1) * whole

    def add(self, keys: np.ndarray, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Solves units that are not known: their keys, and where their characters are in ``codes``."""
        if len(self.known) + len(keys) > STORE * 2:
            self.forget()
        parts: list[tuple] = []
        alone = list(np.flatnonzero(size > LONGEST))
        for n in np.unique(size[size <= LONGEST]):
            mine = np.flatnonzero(size == n)
            for k in range(0, len(mine), 1 << 15):
                at = mine[k : k + (1 << 15)]
                score, gap, ids, count = self._solve(codes[start[at][:, None] + np.arange(n)])
                fine = count > 0
                alone += list(at[~fine])
                parts.append((keys[at[fine]], score[fine], gap[fine], ids, count[fine]))
        for u in alone:
            score, ids, gap = viterbi(self.v, codes[start[u] : start[u] + size[u]].astype(np.uint32).tobytes().decode("utf-32-le"))
            parts.append((keys[u : u + 1], np.array([score]), np.array([gap]), np.array(ids, np.int32), np.array([len(ids)])))
        count = np.concatenate([self.count, *(p[4] for p in parts)]).astype(np.int64)
        new = np.concatenate([p[4] for p in parts]).astype(np.int64)
        first = np.concatenate([self.start, len(self.pool) + np.cumsum(new) - new])
        self.pool = np.concatenate([self.pool, *(p[3] for p in parts)])
        known = np.concatenate([self.known, *(p[0] for p in parts)])
        order = np.argsort(known)
        self.known, self.count, self.start = known[order], count[order], first[order]
        self.score = np.concatenate([self.score, *(p[1] for p in parts)])[order]
        self.gap = np.concatenate([self.gap, *(p[2] for p in parts)])[order]

    def encode_slice(self, texts: pa.Array, n: int) -> pa.Array:
        """``RESULT`` of a slice of texts."""
        plain = texts.to_pylist()
        odd = {i for i, t in enumerate(plain) if MARK in t or _OWN in t}
        given = [b"" if not t or i in odd else b" " + t.encode("utf-8", "replace") for i, t in enumerate(plain)]
        data = np.frombuffer(b"".join(given), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in given])]).astype(np.int64)
        ids, bounds, scores, exact = np.zeros(0, np.int32), np.zeros(len(plain) + 1, np.int64), [[0.0] for _ in plain], np.ones(len(plain), bool)
        others: list[list[list[tuple[int, int, bytes]]]] = [[] for _ in plain]
        if len(data):
            line, space = data == 10, data == 32
            starts = line | space
            starts[1:] = line[1:] | line[:-1] | (space[1:] & ~space[:-1])
            starts[offsets[:-1][offsets[:-1] < len(data)]] = True
            start = np.flatnonzero(starts)
            end = np.append(start[1:], len(data))
            key = textbatch.span_hashes(data, start, end)
            distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
            new = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
            codes = np.frombuffer(b"".join(given).decode().encode("utf-32-le"), np.uint32).copy()
            codes[codes == 32] = ord(MARK)
            char = np.cumsum((data & 0xC0) != 0x80)
            char = np.concatenate([[0], char])
            if len(new):
                if len(self.known) + len(new) > STORE * 2:
                    self.forget()
                    new = np.arange(len(distinct))
                f = first[new]
                self.add(distinct[new], codes, char[start[f]], char[end[f]] - char[start[f]])
            at = np.searchsorted(self.known, distinct)[which]
            row = np.searchsorted(offsets, start, "right") - 1
            count = self.count[at]
            ends = np.cumsum(count)
            ids = self.pool[np.repeat(self.start[at] - (ends - count), count) + np.arange(int(ends[-1]))]
            bounds = np.concatenate([[0], np.cumsum(np.bincount(row, count, len(plain)))]).astype(np.int64)
            total = np.bincount(row, self.score[at], len(plain))
            # decoding restores the bytes
            size = (self.raw_start[1:] - self.raw_start[:-1])[ids]
            stop = np.cumsum(size)
            decoded = self.raw[np.repeat(self.raw_start[ids] - (stop - size), size) + np.arange(int(stop[-1]))]
            if len(decoded) != len(data) or (decoded != data).any():
                for i in range(len(plain)):
                    exact[i] = i in odd or decode(self.v, ids[bounds[i] : bounds[i + 1]].tolist()) == plain[i]
            gap = self.gap[at]
            order = np.lexsort((gap, row))
            head = np.searchsorted(row[order], np.arange(len(plain) + 1))
            for i in range(len(plain)):
                if head[i] == head[i + 1]:
                    continue
                near = [int(u) for u in order[head[i] : min(head[i] + n - 1, head[i + 1])] if gap[u] < np.inf]
                combos: list[tuple[float, tuple]] = [(0.0, ())]
                for u in sorted(near):
                    ways, same = self._ways(codes[char[start[u]] : char[end[u]]].tobytes().decode("utf-32-le"), ids[ends[u] - count[u] : ends[u]], n)
                    exact[i] &= same
                    here = (int(ends[u] - count[u] - bounds[i]), int(count[u]))
                    combos = heapq.nlargest(n, [(s + w, c if k == 0 else (*c, (*here, p))) for s, c in combos for k, (w, p) in enumerate(ways)], key=lambda x: x[0])
                scores[i] = [float(total[i]) + s for s, _ in combos]
                others[i] = [c for _, c in combos[1:]]
        if odd:
            lists = [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(plain))]
            for i in odd:
                ways = encode(self.v, plain[i], n)
                lists[i], scores[i], exact[i] = ways[0][1], [w[0] for w in ways], all(decode(self.v, w[1]) == plain[i] for w in ways)
                others[i] = [[(0, len(lists[i]), np.array(w[1], np.int32).tobytes())] for w in ways[1:]]
            found = pa.array(lists, pa.list_(pa.int32()))
        else:
            found = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
        return pa.StructArray.from_arrays([found, pa.array(scores, pa.list_(pa.float64())), pa.array(exact), _replaced(others)], ["ids", "scores", "exact", "others"])

    def _ways(self, unit: str, best: np.ndarray, n: int) -> tuple[list[tuple[float, bytes]], bool]:
        """:func:`ways_of` a unit, with the bytes of the ids, and whether all decode alike."""
        hit = self.ways.get(unit)
        if hit is None:
            if len(self.ways) >= STORE // 2:
                self.ways.clear()
            found = ways_of(self.v, unit, tuple(best.tolist()), n)
            same = len({b"".join([self.v.raw[x] for x in p]) for _, p in found}) == 1
            hit = self.ways[unit] = [(w, np.array(p, np.int32).tobytes()) for w, p in found], same
        return hit


def _replaced(others: list[list[list[tuple[int, int, bytes]]]]) -> pa.Array:
    """The column ``others`` of ``RESULT``."""
    bounds = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int32))
    ways = [c for row in others for c in row]
    changes = [x for c in ways for x in c]
    put = pa.array(np.frombuffer(b"".join([x[2] for x in changes]), np.int32))
    put = pa.ListArray.from_arrays(bounds([len(x[2]) // 4 for x in changes]), put)
    facts = [pa.array([x[k] for x in changes], pa.int32()) for k in (0, 1)]
    changes = pa.StructArray.from_arrays([*facts, put], ["at", "count", "ids"])
    return pa.ListArray.from_arrays(bounds([len(row) for row in others]), pa.ListArray.from_arrays(bounds([len(c) for c in ways]), changes))


def segmentations(pieces: Column) -> Column:
    """The ids of all the n best segmentations of a column of ``RESULT``, best first."""

    def put(ids: Column, x: Column) -> Column:
        rest = x["at"] + x["count"]
        return F.concat(F.slice(ids, F.lit(1), x["at"]), x["ids"], F.slice(ids, rest + 1, F.size(ids) - rest))

    # from the last change on, so that places in the best hold
    whole = F.transform(pieces["others"], lambda c: F.aggregate(F.reverse(c), pieces["ids"], put))
    return F.concat(F.array(pieces["ids"]), whole)


_BUILT: dict[int, Lattices] = {}


def tokenise(docs: DataFrame, model: str = MODEL, n: int = N_BEST) -> DataFrame:
    """Columns of ``docs``, then ``_pieces`` (with an underscore more where that name is taken): the n best segmentations (``RESULT``), their scores, and whether decoding each restores the text."""
    spark = docs.sparkSession
    arrow_bytes(spark, SLICE)
    shared = spark.sparkContext.broadcast(load(model))  # as large as the vocabulary
    of_slice = _encoder(shared, n)
    return docs.withColumn(free_name(docs.columns, "_pieces"), textbatch.scorer(F.col("text"), of_slice, RESULT, SLICE))


def _encoder(shared, n: int):
    def of_slice(texts: pa.Array) -> pa.Array:
        v = shared.value  # the same object in all tasks of a worker
        if id(v) not in _BUILT:
            _BUILT.clear()
            _BUILT[id(v)] = Lattices(v)
        return _BUILT[id(v)].encode_slice(texts, n)

    return of_slice
