"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct word shingles. Two sets with Jaccard similarity of at least
``t`` differ in at most ``k = (1 - t) / (1 + t) * (|r| + |s|)`` elements. Sizes are cut into bands;
band ``i`` covers the sets from its lower bound up to its upper bound over ``t``, so any similar
pair meets in the band of its smaller set. In a band the domain of shingles is parted in ``n1``
parts, each in three. Of ``n1 = k / 2 + 1 + spare`` parts, ``spare + 1`` at least hold no more than
one difference, and there one of the three pairs of thirds is equal: the signatures are the hashes
of the set's projections on those pairs of thirds. Projections with few elements meet by chance, so
a set leaves out all with fewer than ``m`` elements, ``m`` being the most for which no more than
``spare`` parts hold such a one: of two similar sets the one with the larger ``m`` has a part left
where the projections are equal and hold ``m`` elements at least, so that both sign it. Sets with an
empty projection in more than ``spare`` parts sign the others and, to meet each other, sign again
with the domain parted anew; only in the last of ``LEVELS`` ways are empty projections signatures.

Sets that are equal become one class. Classes that share a signature are candidates. The class of
each signature that shares most signatures is compared with all others first, which makes stars.
Members that share a signature with a member that this left in another component are then compared with those
that :func:`remaining` can't tell apart from them. Comparisons read whole sets,
so no link between different sets is missed and none is made up; pairs inside a component that
already holds together are not listed.

Defined results: null texts and texts without words have no shingles, no links, and are their own
component; a text with fewer words than a shingle has all of them as one shingle; repeated rows
are equal sets; rows without a doc_id take no part and have a null component; an empty table gives no rows; extra
columns are ignored. Texts of any length are whole sets. Shingles and classes are 64-bit hashes; a second hash of each class
tells a collision of classes, which raises.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm import textbatch
from terracell.llm.components import components
from terracell.llm.shared import arrow_bytes, discard, materialise

GRAM, PERCENT = 4, 85
#: Growth of the sizes of a band, share of spare parts, and how often sets with too many bare parts are signed anew.
RATIO, SPARE, LEVELS = 1.3, 0.15, 10
#: Signatures that are handled together, those of a bucket on average, and classes that a task remembers.
FLUSH, BUCKET, SEEN = 1 << 18, 1 << 17, 1 << 17
#: Bits of a class that travel with its signatures.
SHORT = 32
#: Further centers of a signature that all its classes are compared with before sets are taken apart.
CENTERS = 3
#: Members of a star up to which its pairs are listed one by one.
DIRECT = 64
#: Repeated rows of sets up to which their numbers are broadcast.
AGAIN = 1 << 17
#: Bits of the Bloom filter for each element, the least and the most of them, its hashes, bins of a sketch.
BLOOM_EACH, BLOOM_LEAST, BLOOM_MOST, BLOOM_HASHES, SKETCH = 16, 1 << 20, 1 << 28, 4, 512
#: Least and most buckets in which the elements of members are counted.
COUNTS_LEAST, COUNTS_MOST = 1 << 16, 1 << 24
_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


@lru_cache(maxsize=4096)
def band(i: int, percent: int = PERCENT) -> tuple[int, int, int, int]:
    """Of band ``i``: least size, end, first-level parts (0: the whole set is its signature), spare parts."""
    low, end = math.ceil(RATIO**i), math.ceil(RATIO ** (i + 1))
    most = (end - 1) + (end - 1) * 100 // percent  # of the sizes of a pair together
    k = (100 - percent) * most // (100 + percent)
    if k <= 0:
        return low, end, 0, 0
    parts = k // 2 + 1
    spare = math.ceil(SPARE * parts)
    return low, end, parts + spare, spare


def bands_of(size: np.ndarray) -> np.ndarray:
    """The band of each size (at least 1)."""
    top = 1 + int(math.log(max(int(size.max(initial=1)), 1), RATIO)) + 2
    ends = np.array([band(i)[1] for i in range(top)])
    return np.searchsorted(ends, size, "right")


#: The two thirds of a part that a signature is made of.
_PAIRS = ((0, 1), (0, 2), (1, 2))


def signatures(value: np.ndarray, bounds: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets ``value[bounds[r]:bounds[r + 1]]``, and the row of each."""
    size = np.diff(bounds)
    own = bands_of(np.maximum(size, 1))
    lows = np.array([band(i, percent)[0] for i in range(int(own.max(initial=0)) + 1)])
    row_of = np.repeat(np.arange(len(size)), size)
    out, rows = [], []
    at, chosen = own.copy(), size > 0
    while chosen.any():
        weak = np.flatnonzero(chosen)
        for level in range(LEVELS):
            if not len(weak):
                break
            sig, row, weak = _level(value, row_of, at, weak, level, percent)
            out.append(sig)
            rows.append(row)
        chosen &= at > 0
        at = np.maximum(at - 1, 0)  # the band below, if within reach of its sets
        chosen &= size * percent <= (np.append(lows[1:], 0)[at] - 1) * 100
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(rows)


def _level(value: np.ndarray, row_of: np.ndarray, at: np.ndarray, rows: np.ndarray, level: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of ``rows`` in their bands ``at``, the row of each, and the rows that the next level must sign too."""
    info = np.array([band(int(i), percent) for i in range(int(at[rows].max()) + 1)])
    n1, spare = info[at[rows], 2], info[at[rows], 3]
    parts = np.maximum(n1, 1)
    start = np.concatenate([[0], np.cumsum(parts)[:-1]])
    base, mine = np.full(len(at), -1, np.int64), np.ones(len(at), np.uint64)
    base[rows], mine[rows] = start, parts.astype(np.uint64)
    use = base[row_of] >= 0
    v, r = value[use], row_of[use]
    h = textbatch.mix(v + (at[r].astype(np.uint64) + np.uint64(1 + 1000 * level)) * np.uint64(0xA0761D6478BD642F))
    cell = (base[r] + (h % mine[r]).astype(np.int64)) * 3 + ((h >> np.uint64(40)) % np.uint64(3)).astype(np.int64)
    cells = 3 * int(parts.sum())
    count = np.bincount(cell, minlength=cells).reshape(-1, 3)
    e = textbatch.mix(v ^ np.uint64(0xE7037ED1A0B428DB))
    low = np.bincount(cell, (e & _LOW).astype(np.float64), cells).astype(np.uint64)
    high = np.bincount(cell, (e >> _HALF).astype(np.float64), cells).astype(np.uint64)
    total = ((high << _HALF) + low).reshape(-1, 3)
    which = np.repeat(np.arange(len(rows)), parts)
    part_no = (np.arange(len(which)) - start[which]).astype(np.uint64)
    salt = textbatch.mix(part_no * np.uint64(0x8EBC6AF09C88C6E3) + (at[rows][which].astype(np.uint64) << np.uint64(48)) + (np.uint64(level) << np.uint64(40)))
    single = n1[which] == 0
    out, of = [textbatch.mix(total[single].sum(1, dtype=np.uint64) + salt[single])], [rows[which[single]]]
    held = np.stack([count[:, a] + count[:, b] for a, b in _PAIRS])
    # Parts in order of the fewest elements of a pair of thirds: the one after the spare parts sets the row's least.
    fewest = held.min(0)
    least = fewest[np.lexsort((fewest, which))][start + spare]
    weak = (n1 > 0) & (least == 0)
    if level + 1 < LEVELS:
        least = np.maximum(least, 1)
    for j, (a, b) in enumerate(_PAIRS):
        sign = ~single & (held[j] >= least[which])
        out.append(textbatch.mix(textbatch.mix(total[sign, a] + total[sign, b]) + salt[sign] + np.uint64(j + 1)))
        of.append(rows[which[sign]])
    return np.concatenate(out), np.concatenate(of), rows[weak]


def _class_of(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    found = []
    for salt in (0x589965CC75374CC3, 0x1D8E4E27C47D124F):
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(textbatch.mix(value ^ np.uint64(salt)), out=total[1:])
        found.append(textbatch.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))
    return found[0], found[1]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at, texts in textbatch.slices(batch.column("text")):
            yield (batch.slice(at, len(texts)), *textbatch.shingle_sets(texts, gram))


def _sizes_job(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, value, bounds in _sets(batches, gram):
            one, two = _class_of(value, bounds)
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), pa.array(one.view(np.int64), mask=n == 0), _long(two)], ["doc_id", "n_shingles", "cls", "other"])

    return run


def _signature_job(gram: int, percent: int, buckets: int):
    """Texts to blobs of a bucket: 32 bits of each signature and 32 bits of its class (``SHORT``).

    Buckets hold about ``BUCKET`` signatures whatever the number of texts, so 32 bits beside the
    bucket make two signatures equal by chance in one of 30000 cases at most, at every size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for _, value, bounds in _sets(batches, gram):
            cls, _ = _class_of(value, bounds)
            fresh = np.zeros(len(cls), bool)
            for i, c in enumerate(cls.tolist()):  # copies of a text are signed once a task
                if c not in seen:
                    fresh[i] = True
                    seen.add(c)
            if len(seen) > SEEN:
                seen.clear()
            size = np.diff(bounds)
            value = value[np.repeat(fresh, size)]
            sig, row = signatures(value, np.concatenate([[0], np.cumsum(size[fresh])]), percent)
            held.append((sig, cls[fresh][row]))
            n += len(sig)
            if n >= FLUSH:
                yield _blobs(held, buckets)
                held, n = [], 0
        if n:
            yield _blobs(held, buckets)

    return run


def _blobs(held: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    sig, cls = (np.concatenate(x) for x in zip(*held))
    bucket = ((sig >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, low, short = bucket[order], sig[order].astype(np.uint32), (cls[order] >> np.uint64(64 - SHORT)).astype(np.uint32)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(starts[1:], len(bucket))
    blob = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), blob(low), blob(short)], ["bucket", "sigs", "shorts"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs in order of ``bucket`` to ``sig, center, cls``: one class of each signature and each other one.

    A bucket is read by pieces of ``FLUSH`` signatures; of each piece one class a signature is held,
    so a signature of very many classes needs no more memory.
    """
    now, sig, center = None, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def step() -> Iterator[pa.RecordBatch]:
        nonlocal sig, center, held, n
        s, c = (np.concatenate([first, *rest]) for first, rest in zip((sig, center), zip(*held)))
        old = np.zeros(len(s), np.uint8)
        old[len(sig) :] = 1  # a class that was chosen before stays
        order = np.lexsort((c, old, s))
        s, c = s[order], c[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        keep = ~new & (c != c[first])
        keep[1:] &= c[1:] != c[:-1]
        sig, center, held, n = s[new], c[new], [], 0
        if keep.any():
            yield pa.RecordBatch.from_arrays([_long(s[keep]), _long(c[first][keep]), _long(c[keep])], ["sig", "center", "cls"])

    for batch in batches:
        for bucket, *blobs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sigs", "shorts"))):
            if bucket != now:
                if n:
                    yield from step()
                now, sig, center = bucket, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            value, short = (np.frombuffer(x, np.uint32).astype(np.uint64) for x in blobs)
            value += np.uint64(bucket) << np.uint64(32)
            held.append((value, short))
            n += len(value)
            if n >= FLUSH:
                yield from step()
    if n:
        yield from step()


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    """The bits of ids in the filter, ``(BLOOM_HASHES, ids)``."""
    h = textbatch.mix(ids.view(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    return np.stack([((h >> np.uint64(32)) + np.uint64(k) * (h & _LOW)) % np.uint64(bits) for k in range(BLOOM_HASHES)]).astype(np.int64)


def _bits_job(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(np.asarray(batch.column("doc_id")), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at // 32), pa.array(np.left_shift(1, at % 32))], ["word", "bits"])

    return run


def bloom(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter over ``doc_id``. Its words are joined by bit; at most ``BLOOM_MOST / 32`` rows reach the driver."""
    bits = min(max(1 << (BLOOM_EACH * wanted.count()).bit_length(), BLOOM_LEAST), BLOOM_MOST)
    words = wanted.mapInArrow(_bits_job(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[np.asarray(words.column("word"))] = np.asarray(words.column("bits")).astype(np.uint32)
    return out


def _set_job(gram: int, filter_words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = filter_words.value
        for batch in batches:
            at = _places(np.asarray(batch.column("doc_id")), 32 * len(words))
            batch = batch.filter(pa.array(((words[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1)).all(0)))
            for _, value, bounds in _sets(iter([batch]), gram):
                rows = np.flatnonzero(np.diff(bounds))
                if not len(rows):
                    continue
                cls, _ = _class_of(value, bounds)
                sketches = [np.minimum(np.bincount((value[bounds[r] : bounds[r + 1]] >> np.uint64(7)) % np.uint64(SKETCH), minlength=SKETCH), 127).astype(np.int8).tobytes() for r in rows]
                ends = np.concatenate([[0], bounds[1:][rows]])
                sets = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), _long(value))
                yield pa.RecordBatch.from_arrays([_long(cls[rows]), pa.array(np.diff(bounds)[rows]), pa.array(sketches, pa.binary()), sets], ["cls", "size", "sketch", "shingles"])

    return run


def shingle_table(wanted: DataFrame, docs: DataFrame, gram: int) -> DataFrame:
    """``cls, size, sketch, shingles`` of the classes in ``wanted`` (``cls, doc_id``: a document of each), once each.

    Texts stay where they are read, and sets are written there: a Bloom filter picks the documents
    that may be wanted before their words are looked at. The few others that it lets through are
    classes that nobody asks for; a filter that is full is followed by an exact join. Rows of a class
    that came before (repeated rows, or chance) are left out where sets are read; sets are written
    again without them only where they are many.
    """
    words = bloom(wanted)
    full = np.unpackbits(words.view(np.uint8)).mean() > 0.5
    words = docs.sparkSession.sparkContext.broadcast(words)
    sets = docs.select("doc_id", "text").mapInArrow(_set_job(gram, words), "cls long, size long, sketch binary, shingles array<long>")
    if full:
        sets = sets.join(wanted, "cls", "left_semi")
    sets = materialise(sets.withColumn("row", F.monotonically_increasing_id()), "shingle-sets")
    ids = sets.select("cls", "row")
    least = ids.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("least")).where("n > 1").select("cls", "least")
    again = materialise(ids.join(least, "cls").where("row > least").select("row"), "shingle-sets-again")
    found = again.count()
    if not found:
        return sets
    if found > AGAIN:
        once = materialise(sets.join(again, "row", "left_anti"), "shingle-sets")
        discard(sets, again)
        return once
    once = sets.join(F.broadcast(again), "row", "left_anti")
    once.written_to = sets.written_to
    return once


def _sketch_job(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int8).reshape(-1, SKETCH).astype(np.int16) for c in ("p", "q"))
            total = np.asarray(batch.column("m")) + np.asarray(batch.column("n"))
            keep = np.abs(x - y).sum(1) * (100 + percent) <= (100 - percent) * total
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the class pairs ``a, b`` whose sets are similar.

    A sketch counts a set's elements in ``SKETCH`` bins. The differences of two sketches are no more
    than those of the sets, so only pairs whose sketches allow it are compared as sets. Sets that are
    in none of these pairs stay where they are read; sizes are columns of their own, as a size taken of
    ``shingles`` would make the joins before it carry whole sets.
    """
    of = lambda c, these: sets.join(these.select(F.col(c).alias("cls")), "cls", "left_semi")
    side = lambda c, s, n: of(c, pairs).select(F.col("cls").alias(c), F.col("sketch").alias(s), F.col("size").alias(n))
    near = pairs.join(side("a", "p", "m"), "a").join(side("b", "q", "n"), "b").where(f"100 * m >= {percent} * n and 100 * n >= {percent} * m")
    near = materialise(near.select("a", "b", "p", "q", "m", "n").mapInArrow(_sketch_job(percent), "a long, b long"), "jaccard-near")
    if near.isEmpty():
        return near
    whole = lambda c, s: of(c, near).select(F.col("cls").alias(c), F.col("shingles").alias(s))
    found = near.join(whole("b", "y"), "b").join(whole("a", "x"), "a")
    common = F.size(F.array_intersect("x", "y"))
    return found.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def stars(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each signature, its class that shares most signatures with others, and each other one.

    ``a, b``, and ``sig, a, cls, w`` (signatures shared by ``cls``) for the signatures of more than one other class: only there can
    two classes share a signature without one of them being its center.
    """
    members = shared.select("sig", "cls").unionByName(shared.select("sig", F.col("center").alias("cls")).distinct())
    weight = members.groupBy("cls").agg(F.count(F.lit(1)).alias("w"))
    members = materialise(members.join(weight, "cls"), "jaccard-members")
    best = members.groupBy("sig").agg(F.max(F.struct("w", "cls"))["cls"].alias("a"), F.count(F.lit(1)).alias("n"))
    placed = materialise(members.join(best, "sig").where("cls <> a").select("sig", "a", "cls", "w", "n"), "jaccard-placed")
    discard(members)
    found = materialise(placed.select("a", F.col("cls").alias("b")).distinct(), "jaccard-stars")
    crowded = materialise(placed.where("n > 2").select("sig", "a", "cls", "w"), "jaccard-crowded")
    discard(placed)
    return found, crowded


def same_short(full: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of classes that no signature can tell apart, as they share ``short``."""
    several = full.groupBy("short").agg(F.sort_array(F.collect_list("cls")).alias("c")).where(F.size("c") > 1)
    return several.select(F.posexplode("c").alias("i", "a"), "c").select("a", F.explode(F.expr("slice(c, i + 2, size(c))")).alias("b"))


def unsettled(crowded: DataFrame, first: DataFrame, found: DataFrame, full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs with further centers, and the members of stars that may be similar to another one even so; both ``a, b``.

    Two similar classes share a signature; if one is its center, they were compared. So all others
    that may be similar share a signature with a member of another component. Such a signature gets
    ``CENTERS`` more centers, one by one, and a pair of each with every member of another component;
    the members are what is left when the centers are taken out.
    """
    roots = found.select(F.col("node").alias("cls"), "root")
    tagged = crowded.withColumnRenamed("cls", "short").join(full, "short").join(roots, "cls", "left")
    tagged = materialise(tagged.select("sig", "a", "cls", "w", F.coalesce("root", "cls").alias("root")), "jaccard-tagged")
    pairs = []
    for i in range(CENTERS + 1):
        mixed = tagged.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.struct("w", "cls", "root")).alias("c"))
        last, tagged = tagged, materialise(tagged.join(mixed.where("low <> high").select("sig", "c"), "sig"), "jaccard-tagged")
        discard(last)
        if i < CENTERS:
            pair = tagged.where("root <> c.root").select(F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b"))
            pairs.append(materialise(pair.distinct(), "jaccard-pair"))
            last, tagged = tagged, materialise(tagged.where("cls <> c.cls").drop("c"), "jaccard-tagged")
            discard(last)
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = pairs[0]
    for p in pairs[1:]:
        more = more.unionByName(p)
    more = materialise(more.distinct().join(done, ["a", "b"], "left_anti"), "jaccard-further")
    live = tagged.select(F.col("a").alias("short"), F.col("cls").alias("b")).distinct()
    live = live.join(full.withColumnRenamed("cls", "a"), "short").where("a <> b").select("a", "b").distinct()
    live = materialise(live, "jaccard-unsettled")
    discard(tagged, *pairs)
    return more, live


def _kept_job(percent: int, filter_words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = filter_words.value
        for batch in batches:
            sets = batch.column("shingles")
            at = _places(np.asarray(sets.flatten()), 32 * len(words))
            held = ((words[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1)).all(0)
            size = np.asarray(sets.value_lengths())
            common = np.bincount(np.repeat(np.arange(len(size)), size), held, len(size)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("cls").filter(pa.array(100 * common >= percent * size))], ["cls"])

    return run


def partnered(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the members ``a, b`` whose sets may be similar to that of another member at all.

    A similar set holds ``percent`` of a member's elements, so as many of them must occur in some
    other member. Elements that several members hold make a Bloom filter; where chance lets an
    element through, a member stays that could go, but none goes that could be similar.
    """
    mine = sets.join(live.select(F.col("b").alias("cls")), "cls", "left_semi")
    several = mine.select(F.explode("shingles").alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    several = materialise(several, "jaccard-several")
    words = live.sparkSession.sparkContext.broadcast(bloom(several))
    kept = materialise(mine.select("cls", "shingles").mapInArrow(_kept_job(percent, words), "cls long"), "jaccard-kept")
    found = materialise(live.join(kept.withColumnRenamed("cls", "b"), "b", "left_semi").select("a", "b"), "jaccard-partnered")
    discard(several, kept)
    return found


def _buckets(elements: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each element, of ``n`` (a power of two)."""
    return (textbatch.mix(elements.view(np.uint64) + np.uint64(0x5851F42D4C957F2D)) & np.uint64(n - 1)).astype(np.int32)


def _count_job(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, n = np.unique(_buckets(np.asarray(batch.column("shingles").flatten()), buckets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], ["bucket", "n"])

    return run


def frequencies(members: DataFrame) -> np.ndarray:
    """Elements of ``shingles`` in each bucket (1 where there are none); at most ``COUNTS_MOST`` rows reach the driver."""
    elements = members.agg(F.sum(F.size("shingles"))).first()[0] or 0
    buckets = min(max(1 << (2 * elements).bit_length(), COUNTS_LEAST), COUNTS_MOST)
    counts = members.select("shingles").mapInArrow(_count_job(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = counts.where("n > 1").select("bucket", F.least("n", F.lit(65535)).cast("int").alias("n")).toArrow()
    out = np.ones(buckets, np.uint16)
    out[np.asarray(counts.column("bucket"))] = np.asarray(counts.column("n")).astype(np.uint16)
    return out


def _rare_job(percent: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often_of = counts.value
        for batch in batches:
            sets = batch.column("shingles")
            size, g = np.asarray(sets.value_lengths()).astype(np.int64), np.asarray(sets.flatten())
            row = np.repeat(np.arange(len(size)), size)
            often = often_of[_buckets(g, len(often_of))]
            order = np.lexsort((g, often, row))
            at = 1 + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            keep = (at <= (100 - percent) * size[row] // 100 + 1) & (often[order] > 1)
            mine = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([batch.column("cls").take(mine), batch.column("root").take(mine), pa.array(size[row[keep]]), pa.array(g[order][keep]), pa.array(at[keep])], ["cls", "root", "size", "g", "at"])

    return run


def remaining(live: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` that may be similar though stars left them in different components.

    Of a star with no more than ``DIRECT`` members (those of :func:`partnered`) all pairs whose sizes allow it are listed,
    fewer than ``DIRECT`` rows a member. Members of larger stars are taken once each, however many stars they are
    in. A similar set lacks at most ``100 - percent`` of a member's elements, so of two similar ones each holds some
    same element among that many and one more, in any order of all elements: here those of rare buckets
    come first. The elements before a shared one tell how many can be common. Of the members that have an
    element, those of the component that most are in are not compared with each other.
    """
    roots = found.select(F.col("node").alias("cls"), "root")
    rooted = live.join(roots.select(F.col("cls").alias("a"), F.col("root").alias("a_root")), "a", "left").join(roots.select(F.col("cls").alias("b"), F.col("root").alias("b_root")), "b", "left")
    rooted = rooted.select("a", F.col("b").alias("cls"), F.coalesce("b_root", "b").alias("root"), (F.coalesce("b_root", "b") != F.coalesce("a_root", "a")).alias("apart"))
    rooted = materialise(rooted, "jaccard-rooted")
    groups = rooted.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("some")).where("n > 1 and some")
    small = rooted.join(groups.where(F.col("n") <= DIRECT).select("a"), "a").join(sets.select("cls", F.size("shingles").alias("size")), "cls")
    small = materialise(small, "jaccard-small")
    x = small.where("apart").select("a", *(F.col(c).alias(f"x_{c}") for c in ("cls", "root", "size")))
    fits = (F.col("x_root") != F.col("root")) & (100 * F.col("x_size") >= percent * F.col("size")) & (100 * F.col("size") >= percent * F.col("x_size"))
    direct = x.join(small, "a").where(fits).select(F.least("x_cls", "cls").alias("a"), F.greatest("x_cls", "cls").alias("b"))
    members = rooted.join(groups.where(F.col("n") > DIRECT).select("a"), "a").select("cls", "root").distinct()
    members = materialise(members.join(sets.select("cls", "shingles"), "cls"), "jaccard-apart")
    counts = live.sparkSession.sparkContext.broadcast(frequencies(members))
    tokens = materialise(members.mapInArrow(_rare_job(percent, counts), "cls long, root long, size long, g long, at long"), "jaccard-tokens")
    most = tokens.groupBy("g", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.max(F.struct("n", "root"))["root"].alias("most"), F.count(F.lit(1)).alias("roots"))
    keyed = materialise(tokens.join(most.where("roots > 1").select("g", "most"), "g"), "jaccard-keyed")
    x = keyed.where("root <> most").select("g", *(F.col(c).alias(f"x_{c}") for c in ("cls", "root", "size", "at")))
    common = 1 + F.least(F.col("x_size") - F.col("x_at"), F.col("size") - F.col("at"))
    pairs = x.join(keyed, "g").where(fits & ((100 + percent) * common >= percent * (F.col("x_size") + F.col("size"))))
    pairs = pairs.select(F.least("x_cls", "cls").alias("a"), F.greatest("x_cls", "cls").alias("b"))
    found = materialise(pairs.unionByName(direct).distinct(), "jaccard-rest")
    discard(members, tokens, keyed, small, rooted)
    return found


def jaccard_groups(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the least doc_id that links reach."""
    return jaccard_rows(docs, gram, percent).select("doc_id", "n_shingles", "component_id")


def class_of(text: Column, gram: int) -> Column:
    """The class of each text; null without a shingle."""

    def of_slice(texts: pa.Array) -> pa.Array:
        value, bounds = textbatch.shingle_sets(texts, gram)
        return pa.array(_class_of(value, bounds)[0].view(np.int64), mask=np.diff(bounds) == 0)

    return textbatch.scorer(text, of_slice, "long")


def jaccard_rows(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """:func:`jaccard_groups`, then ``cls``, the class of the row's own text, and ``root``, one class of its component."""
    docs = docs.select("doc_id", "text")
    arrow_bytes(docs.sparkSession)
    sized = materialise(docs.mapInArrow(_sizes_job(gram), "doc_id long, n_shingles long, cls long, other long"), "jaccard-sizes")
    classes = materialise(sized.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), (F.min("other") != F.max("other")).alias("clash")), "jaccard-classes")
    if not classes.where("clash").isEmpty():
        raise ValueError("two different shingle sets share a 64-bit class hash")
    classes = classes.select("cls", "first")
    buckets = max(1 << 8, math.ceil((sized.agg(F.sum("n_shingles")).first()[0] or 0) / BUCKET))
    sigs = docs.where("doc_id is not null").mapInArrow(_signature_job(gram, percent, buckets), "bucket int, sigs binary, shorts binary")
    sigs = sigs.repartition("bucket").sortWithinPartitions("bucket")
    shared = materialise(sigs.mapInArrow(_shared, "sig long, center long, cls long"), "jaccard-shared")
    short, crowded = stars(shared)
    # Signatures came with 32 bits of each class; classes that share these are all meant, and are compared with each other.
    full = classes.select(F.shiftrightunsigned("cls", 64 - SHORT).alias("short"), "cls")
    sides = [full.select(F.col("short").alias(f"short_{c}"), F.col("cls").alias(c)) for c in "ab"]
    first = short.withColumnsRenamed({"a": "short_a", "b": "short_b"}).join(sides[0], "short_a").join(sides[1], "short_b")
    first = materialise(first.select("a", "b").unionByName(same_short(full)).distinct(), "jaccard-first")
    discard(shared, short)
    wanted = first.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes, "cls").select("cls", F.col("first").alias("doc_id"))
    sets = shingle_table(materialise(wanted, "wanted"), docs.where("doc_id is not null"), gram)
    links = materialise(verify(first, sets, percent), "jaccard-links")
    found = components(links)
    more, live = unsettled(crowded, first, found, full)
    discard(crowded)
    unpruned, live = live, partnered(live, sets, percent)
    discard(unpruned)
    further = materialise(verify(more, sets, percent), "jaccard-links")
    if not further.isEmpty():
        links = materialise(links.unionByName(further), "jaccard-links")
        found = components(links)
    rest = remaining(live, found, sets, percent)
    if not rest.isEmpty():
        found = components(links.unionByName(verify(rest, sets, percent)))
    placed = classes.join(found, classes["cls"] == found["node"], "left").select("cls", "first", F.coalesce("root", "cls").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = materialise(placed.join(least, "root").select("cls", "root", "component_id"), "jaccard-components")
    discard(sets, first, more, live)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return sized.join(placed, "cls", "left").select("doc_id", "n_shingles", component.alias("component_id"), "cls", "root")
