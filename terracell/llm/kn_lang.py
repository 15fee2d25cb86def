"""Language identification by interpolated Kneser-Ney character models.

One model a language, order four, over letters and word bounds: digits, marks and spaces are
bounds, and no context reaches past the start of a word. All n-grams of all models are kept in
one sorted array of 64-bit keys an order, with the log-probabilities of every language beside it;
n-grams that are in no model fall back through the context weights. A text gets the language with
the lowest cross-entropy per symbol. A text is rejected if its cross-entropy is far above what
documents of that language have (calibrated on documents the models did not see), or if it has no
letter.

The models are fitted on a bounded sample: about ``SAMPLE`` labelled documents a language of at most
``MAX_TEXT`` characters, drawn by hash over all that may be learned from; languages share
``MAX_SAMPLE`` in all, at least 20 each, so that the ``MAX_SAMPLE / 20`` most frequent ones are learned. Whole texts are
scored; equal words of a batch are scored once.

Defined results: a null text or one without letters is ``und`` with score 0 and rejected; with no
labelled rows every text is ``und``; rows without a doc_id are not learned from; ties go to the
language that is first by code point; an empty table gives no rows; extra columns are kept, and
a column ``_lang`` of the caller too: the result then has an underscore more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm import textbatch
from terracell.llm.shared import arrow_bytes, fitted, free_name

ORDER, SAMPLE, MAX_SAMPLE, MAX_TEXT, UNKNOWN, Z = 4, 800, 8000, 1 << 15, "und", 6.0
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """The symbol of each code point below 65536: itself for letters, else 0."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([i if chr(i).isalpha() else 0 for i in range(1 << 16)], np.uint64)
    return _LETTER


def symbols(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters as numbers, anything else as 0; and the number of line ends before each."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    out = _letters()[np.minimum(code, 0xFFFF)]
    for i in np.flatnonzero(code > 0xFFFF):
        out[i] = (int(code[i]) & 0x7FFF) + 1 if chr(code[i]).isalpha() else 0
    ends = code == 10
    return out, np.cumsum(ends) - ends


def ngram_keys(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the 4-grams that end at each letter or at the bound behind a letter, and where they end.

    Sixteen bits a symbol, the last symbol lowest.
    """
    s = np.concatenate([np.zeros(3, np.uint64), s, np.zeros(1, np.uint64)])
    c, one, two, three = s[3:], s[2:-1], s[1:-2], s[:-3]
    two = np.where(one == 0, 0, two)
    three = np.where(two == 0, 0, three)
    at = np.flatnonzero((c != 0) | (one != 0))
    key = (three << np.uint64(48)) | (two << np.uint64(32)) | (one << np.uint64(16)) | c
    return key[at], at


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (16 * order)) - 1)


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
    return at, (keys[at] == asked) if len(keys) else np.zeros(len(asked), bool)


@dataclass
class Models:
    """For each order: sorted n-gram keys with log-probabilities, sorted contexts with log-weights (languages in columns)."""

    langs: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    base: np.ndarray
    limit: np.ndarray | None = None
    noise: np.ndarray | None = None
    sharpness: float = 1.0

    def log_prob(self, asked: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log-probabilities of the last symbols, ``(n-grams, languages)``."""
        if order == 0:
            return np.broadcast_to(self.base, (len(asked), len(self.langs)))
        asked = asked & _mask(order)
        at, hit = _find(self.keys[order - 1], asked)
        out = self.logp[order - 1][at] if len(self.keys[order - 1]) else np.zeros((len(asked), len(self.langs)), np.float32)
        if not hit.all():
            missed = asked[~hit]
            lower = np.array(self.log_prob(missed, order - 1))
            at, seen = _find(self.contexts[order - 1], missed >> np.uint64(16))
            if seen.any():
                lower[seen] += self.weights[order - 1][at[seen]]
            out[~hit] = lower
        return out


def fit(samples: dict[str, list[str]]) -> Models:
    """Interpolated Kneser-Ney models of each language's texts."""
    langs = sorted(samples)
    tops = {}
    for lang in langs:
        tops[lang] = np.unique(ngram_keys(symbols("\n".join(samples[lang]))[0])[0], return_counts=True)
    n_symbols = len(np.unique(np.concatenate([k & _mask(1) for k, _ in tops.values()] or [np.zeros(0, np.uint64)]))) + 1
    m = Models(langs, [], [], [], [], np.full(len(langs), -np.log(n_symbols), np.float32))
    levels: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for lang, (key, count) in tops.items():
        mine = [(key, count)]
        for order in range(ORDER - 1, 0, -1):  # lower orders count the different symbols in front
            mine.append(np.unique(mine[-1][0] & _mask(order), return_counts=True))
        levels[lang] = mine[::-1]
    for order in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([levels[x][order - 1][0] for x in langs]))
        contexts = np.unique(keys >> np.uint64(16))
        lower = np.exp(np.asarray(m.log_prob(keys, order - 1), np.float64))
        logp, weights = np.empty((len(keys), len(langs)), np.float32), np.zeros((len(contexts), len(langs)), np.float32)
        for j, lang in enumerate(langs):
            key, count = levels[lang][order - 1]
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            own = np.searchsorted(contexts, key >> np.uint64(16))
            total, kinds = np.bincount(own, count, len(contexts)), np.bincount(own, minlength=len(contexts))
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            seen = np.zeros(len(keys))
            seen[np.searchsorted(keys, key)] = count - discount
            of = np.searchsorted(contexts, keys >> np.uint64(16))
            logp[:, j] = np.log(seen / np.maximum(total[of], 1) + weight[of] * lower[:, j])
            weights[:, j] = np.log(weight)
        for part, value in ((m.keys, keys), (m.logp, logp), (m.contexts, contexts), (m.weights, weights)):
            part.append(value)
    return m


def entropies(m: Models, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per symbol ``(texts, languages)`` and the number of symbols, of a slice of texts.

    A text without letters has no symbols.
    """
    w = textbatch.words(texts)
    _, first, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
    data = w.data.tobytes()
    distinct = b"\n".join([data[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist())])
    s, word = symbols(distinct.decode("utf-8", "replace"))
    key, at = ngram_keys(s)
    word = np.append(word, word[-1] if len(word) else 0)[at]
    logp = m.log_prob(key)
    n = np.bincount(word, minlength=len(first))[which] if len(first) else np.zeros(0)
    n = np.bincount(w.row, n, w.n_rows)
    out = np.zeros((w.n_rows, len(m.langs)))
    for j in range(len(m.langs)):
        score = np.bincount(word, logp[:, j], len(first))
        out[:, j] = -np.bincount(w.row, score[which], w.n_rows) / np.maximum(n, 1)
    return out, n


def calibrate(m: Models, texts: list[str], langs: list[str]) -> None:
    """Sets the limits of rejection and the sharpness of scores from texts that were not learned from."""
    found = [entropies(m, part) for _, part in textbatch.slices(pa.array(texts, pa.large_string()))]
    h, n = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    true = np.array([m.langs.index(x) for x in langs])
    m.limit, m.noise = -m.base.astype(float), np.zeros(len(m.langs))
    for j in range(len(m.langs)):
        own, size = h[(true == j) & (n > 0), j], n[(true == j) & (n > 0)]
        if not len(own):
            continue
        mean = np.average(own, weights=size)
        long = size >= np.median(size)
        spread = np.sqrt(np.mean((own[long] - mean) ** 2))
        m.noise[j] = np.sqrt(np.mean((own - mean) ** 2 * np.minimum(size, 1000)))
        # Beyond all that was seen, and half of the way to symbols drawn alike at least.
        m.limit[j] = max(mean + Z * spread, own[long].max(), (mean - m.base[j]) / 2)
    use, best = n > 0, (np.inf, 1.0)
    for sharp in 2.0 ** np.arange(-6, 3):
        logit = -h[use] * np.minimum(n[use], 1000)[:, None] * sharp
        logit -= logit.max(1, keepdims=True)
        loss = -np.mean(np.maximum(logit[np.arange(use.sum()), true[use]] - np.log(np.exp(logit).sum(1)), -30)) if use.any() else 0.0
        best = min(best, (loss, sharp))
    m.sharpness = best[1]


def predict(m: Models, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of a slice of texts."""
    h, n = entropies(m, texts)
    best = h.argmin(1)
    logit = -h * np.minimum(n, 1000)[:, None] * m.sharpness
    logit -= logit.max(1, keepdims=True)
    score = np.where(n > 0, 1 / np.exp(logit).sum(1), 0.0)
    limit = m.limit[best] + Z * m.noise[best] / np.sqrt(np.maximum(n, 1))
    rejected = (n == 0) | (h[np.arange(len(h)), best] > limit)
    return [m.langs[b] if k else UNKNOWN for b, k in zip(best, n)], score, rejected


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE, max_sample: int = MAX_SAMPLE) -> Models | None:
    """Models from a bounded sample of the labelled documents that may be learned from."""
    short = F.length("text") <= MAX_TEXT
    known = docs.where(F.col("lang").isNotNull() & short & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_sample // 20).collect()}
    if not counts:
        return None
    each = min(sample, max(20, max_sample // len(counts)))
    share = F.lit(0.0)
    for lang, count in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, each / count))).otherwise(share)
    dice = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return fitted(known.where(dice < share).select("doc_id", "lang", "text").limit(2 * max_sample), fit_rows)


def fit_rows(rows: list[dict]) -> Models:
    """Models of four fifths of the rows, calibrated on the others."""
    samples: dict[str, list[str]] = {}
    kept = []
    for i, r in enumerate(sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["text"]))):
        if i % 5 == 4:
            kept.append(r)
        else:
            samples.setdefault(r["lang"], []).append(r["text"])
    m = fit(samples)
    kept = [r for r in kept if r["lang"] in samples]
    if kept:
        calibrate(m, [r["text"] for r in kept], [r["lang"] for r in kept])
    else:
        m.limit, m.noise = np.full(len(m.langs), np.inf), np.zeros(len(m.langs))
    return m


def lang_name(docs: DataFrame) -> str:
    return free_name(docs.columns, "_lang")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Columns of ``docs``, then ``struct<lang, score, rejected>`` under :func:`lang_name`."""
    spark = docs.sparkSession
    arrow_bytes(spark)
    m = learn(docs, sample)
    if m is None:
        return docs.withColumn(lang_name(docs), F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")))
    shared = spark.sparkContext.broadcast(m)  # bounded by the sample

    def of_slice(texts: pa.Array) -> pa.Array:
        lang, score, rejected = predict(shared.value, texts)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["lang", "score", "rejected"])

    return docs.withColumn(lang_name(docs), textbatch.scorer(F.col("text"), of_slice, "struct<lang:string,score:double,rejected:boolean>"))
