"""Toxicity by a weighted lexicon.

Texts are folded first: letters that look alike (accents, Cyrillic, Greek, full width) and digits
that stand for letters become one form, anything that is no letter becomes a space. One
Aho-Corasick automaton then finds the lexicon's words and word beginnings and the exception
phrases; a hit inside an exception phrase doesn't count. The weights of the hits are summed,
divided by a power of the number of words, and turned into a probability by a logistic curve.

The lexicon, its weights, the learned exception phrases, the power and the curve are fitted on a
bounded sample of labelled documents, drawn by hash: about ``MAX_TOXIC`` toxic and ``MAX_CLEAN``
clean ones of at most ``MAX_TEXT`` characters. It holds the ``MAX_ENTRIES`` stems that tell most and
as many of the most frequent phrases. Whole texts are scored.

Defined results: null and empty texts have no hit and the score of no hit; of several labels of a
document the greatest holds; null labels are none; rows without a doc_id are not learned from;
with no toxic or no clean document in the sample every score is 0; an empty table gives no rows;
extra columns are kept, and a column
``_score`` of the caller too: the score then has an underscore more.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm import textbatch
from terracell.llm.shared import arrow_bytes, fitted, free_name

MAX_TOXIC, MAX_CLEAN, MAX_TEXT, MIN_STEM, MAX_STEM, MAX_ENTRIES, MIN_ODDS = 2500, 5000, 1 << 15, 4, 12, 400, 1.2
#: Characters of other scripts and digits, and the letters they stand for.
ALIKE = dict(zip("аеорсухкмтвнізѕјԁɡαεορυνικτ", "aeopcyxkmtbhizsjdgaeopuvikt")) | dict(zip("0134578@", "oieastba"))
#: Phrases whose words are no insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "taking out the trash", "clown fish", "idiot proof", "pond scum", "sore loser rule")
_FOLD: np.ndarray | None = None
#: Folded form of what is dropped: marks that join a letter, and characters without a width.
_NONE = 0


def _folded(i: int) -> int:
    """The folded code of a code point; 32 for what is no letter."""
    if 0xD800 <= i < 0xE000:
        return 32
    c = chr(i)
    if unicodedata.category(c) in ("Mn", "Cf"):
        return _NONE
    plain = unicodedata.normalize("NFKD", c).lower()[:1] if not c.isascii() else c.lower()
    plain = ALIKE.get(plain, plain)
    if plain == "l":
        plain = "i"  # as digit one stands for either
    return ord(plain) if plain.isalpha() else 32


def _fold_table() -> np.ndarray:
    """The folded code of each code point below 65536."""
    global _FOLD
    if _FOLD is None:
        _FOLD = np.array([_folded(i) for i in range(1 << 16)], np.uint32)
    return _FOLD


def fold(text: str) -> str:
    """The folded text; combining marks and characters without a width are dropped."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = _fold_table()[np.minimum(code, 0xFFFF)]
    high = code > 0xFFFF
    if high.any():
        some, at = np.unique(code[high], return_inverse=True)
        out[high] = np.array([_folded(int(i)) for i in some], np.uint32)[at]
    return out[out != _NONE].tobytes().decode("utf-32-le")


@dataclass
class Lexicon:
    """Folded stems (found at the start of a word) and their weights, exception phrases, and the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    power: float = 0.5
    slope: float = 0.0
    offset: float = -30.0
    _found: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_found"}

    def __setstate__(self, state):
        self.__dict__.update(state, _found=None)

    def automaton(self):
        if self._found is None:
            a = ahocorasick.Automaton()
            for stem, weight in self.weights.items():
                a.add_word(" " + stem, (len(stem) + 1, weight))
            for phrase in self.exceptions:
                a.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
            if len(a):
                a.make_automaton()
            self._found = a
        return self._found

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """``(start, end, weight)`` of the entries in `` text ``, exceptions with weight 0, longest entry a start."""
        a = self.automaton()
        if not len(a):
            return []
        found: dict[int, tuple[int, int, float]] = {}
        cover: list[tuple[int, int]] = []
        for end, (size, weight) in a.iter(f" {folded} "):
            start = end - size + 1
            if weight == 0:
                cover.append((start, end))
            else:
                found[start] = max(found.get(start, (start, 0, 0.0)), (start, end, weight))  # the longest
        if not cover:
            return list(found.values())
        cover.sort()
        starts, reach = [s for s, _ in cover], list(accumulate((e for _, e in cover), max))
        return [h for h in found.values() if not (at := bisect_right(starts, h[0])) or reach[at - 1] <= h[0]]

    def raw(self, text: str) -> tuple[float, int]:
        """Sum of the weights of the hits, number of words."""
        folded = fold(text)
        codes = np.frombuffer(folded.encode("utf-32-le"), np.uint32) != 32
        n = int(codes[:1].sum() + (codes[1:] & ~codes[:-1]).sum())
        if self.exceptions:
            folded = re.sub(" +", " ", folded)
        return sum(h[2] for h in self.hits(folded)), n

    def feature(self, raw: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.asarray(raw, float) / (np.asarray(n, float) + 20) ** self.power

    def score(self, raw: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.feature(raw, n) + self.offset, -30, 30)))


def _beginnings(words: list[str]) -> Counter[str]:
    return Counter(w[:n] for w in words for n in range(MIN_STEM, min(len(w), MAX_STEM) + 1))


def stems(toxic: Iterable[list[str]], clean: Iterable[list[str]]) -> list[str]:
    """Word beginnings that are more frequent in toxic documents than in clean ones. The words of one document are held at a time."""
    seen, used, docs = Counter(), Counter(), Counter()
    size, n = [1, 1], 0
    for words in toxic:
        found = _beginnings(words)
        seen.update(found)
        docs.update(found.keys())
        size[0] += len(words)
        n += 1
    least = max(3, n // 100)
    often = {s for s, c in docs.items() if c >= least}
    for words in clean:
        used.update({s: c for s, c in _beginnings(words).items() if s in often})
        size[1] += len(words)
    odds = {s: math.log((seen[s] + 0.5) / size[0]) - math.log((used[s] + 0.5) / size[1]) for s in often}
    good = {s for s in often if odds[s] >= MIN_ODDS}
    # Of beginnings that start alike keep the longest that is about as frequent as the shortest.
    chosen = []
    for s in sorted(good, key=lambda s: (len(s), s)):
        if any(s[:n] in good for n in range(MIN_STEM, len(s))):
            continue
        best = s
        while longer := [x for x in good if len(x) == len(best) + 1 and x.startswith(best) and seen[x] >= 0.9 * seen[best]]:
            best = max(longer, key=lambda x: (seen[x], x))
        chosen.append(best)
    return sorted(chosen, key=lambda s: (-odds[s] * math.sqrt(docs[s]), s))[:MAX_ENTRIES]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights and, last, the constant, of a ridge logistic regression."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * beta)
        beta -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(rows: list[tuple[str, int]], exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from ``(text, label)``."""
    docs = [(" ".join(fold(t).split()), y) for t, y in rows]
    y = np.array([v for _, v in docs], float)
    if not 0 < y.sum() < len(y):
        return Lexicon()
    entries = stems((t.split() for t, v in docs if v), (t.split() for t, v in docs if not v))
    exempt = tuple(sorted({" ".join(fold(p).split()) for p in exceptions}))
    lex = Lexicon(dict.fromkeys(entries, 1.0), exempt)
    phrases: dict[str, list[int]] = {}
    for t, v in docs:  # a hit and the next word, in clean documents but hardly in toxic ones
        for start, _, _ in lex.hits(t):
            phrases.setdefault(" ".join(f" {t} "[start + 1 :].split(" ", 2)[:2]), [0, 0])[v] += 1
    often = [p for p, (c, x) in phrases.items() if c >= 10 and x == 0 and " " in p]
    lex.exceptions += tuple(sorted(often, key=lambda p: (-phrases[p][0], p))[:MAX_ENTRIES])
    lex = Lexicon(lex.weights, lex.exceptions)
    place = {s: j for j, s in enumerate(entries)}
    count, n = np.zeros((len(docs), len(entries)), np.float32), np.array([len(t.split()) for t, _ in docs])
    for i, (t, _) in enumerate(docs):
        for start, end, _ in lex.hits(t):
            count[i, place[f" {t} "[start + 1 : end + 1]]] += 1
    best, test = None, np.arange(len(docs)) % 5 == 4
    scaled = lambda power, scale, rows: count[rows] * (scale / (n[rows] + 20.0) ** power)[:, None]
    for power in (0.25, 0.5, 0.75, 1.0):
        scale = float(np.mean((n + 20.0) ** power))
        beta = _logistic(scaled(power, scale, ~test), y[~test])
        p = np.clip(1 / (1 + np.exp(-np.clip(scaled(power, scale, test) @ beta[:-1] + beta[-1], -30, 30))), 1e-9, 1 - 1e-9)
        loss = -np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))
        if best is None or loss < best[0]:
            best = (loss, power, scale)
    _, power, scale = best
    beta = _logistic(scaled(power, scale, slice(None)), y)
    return Lexicon({s: float(w) for s, w in zip(entries, beta) if w > 0.01}, lex.exceptions, power, scale, float(beta[-1]))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Lexicon:
    """A lexicon from a bounded sample of the labels that may be learned from."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in usable.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return Lexicon()
    share = F.when(F.col("toxic") == 1, F.lit(max_toxic / counts[1])).when(F.col("toxic") == 0, F.lit(max_clean / counts[0]))
    dice = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.where(dice < share).limit(2 * (max_toxic + max_clean))
    short = F.coalesce(F.length("text") <= MAX_TEXT, F.lit(True))
    texts = docs.select("doc_id", "text").where(short).join(F.broadcast(chosen), "doc_id")  # bounded by the sample
    texts = texts.select("text", "toxic").limit(2 * (max_toxic + max_clean))
    return fitted(texts, lambda rows: fit(sorted((r["text"] or "", r["toxic"]) for r in rows)))


def score_name(docs: DataFrame) -> str:
    return free_name(docs.columns, "_score")


def score_texts(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Columns of ``docs``, then the score, under :func:`score_name`."""
    spark = docs.sparkSession
    arrow_bytes(spark)
    shared = spark.sparkContext.broadcast(lexicon)  # at most MAX_ENTRIES entries and phrases

    def of_slice(texts: pa.Array) -> pa.Array:
        lex = shared.value
        found = np.array([lex.raw(t) for t in texts.to_pylist()], float).reshape(-1, 2)
        return pa.array(lex.score(found[:, 0], found[:, 1]), pa.float64())

    return docs.withColumn(score_name(docs), textbatch.scorer(F.col("text"), of_slice, "double"))
