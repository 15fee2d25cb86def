"""Quality rules that are judged per document and per host.

Rule failures are summed by host, each host's rate is shrunk by a beta prior fitted to all hosts
by moments, and the verdict on the host is joined back to its documents.

Defined results: null text has no words and fails; a null host is judged by its documents only;
repeated rows count each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm.shared import WORD, let, materialise, upto, words_of

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT, HOST_LIMIT = 8, 20, 30, 0.5


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that a text holds twice or more.

    Hashes of the windows tell the many texts without a repeat; only for others are the windows
    themselves sorted and compared.
    """
    n = F.size(words)
    count = n - window + 1

    def covered(starts: Column) -> Column:
        steps = F.aggregate(
            upto(F.lit(1), F.size(starts) - 1), F.lit(0), lambda total, t: total + F.least(F.lit(window), F.get(starts, t) - F.get(starts, t - 1))
        )
        return F.when(F.size(starts) > 0, steps + window).otherwise(F.lit(0))

    def exact(ordered: Column) -> Column:
        key = lambda j: F.get(ordered, j)["k"]
        same = lambda i, j: F.coalesce(key(i) == key(j), F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return let(F.sort_array(F.transform(twice, lambda j: F.get(ordered, j)["p"])), covered)

    keyed = lambda: F.sort_array(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.array_join(F.slice(words, i + 1, window), " ").alias("k"), i.alias("p"))))
    hashes = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(count < 2, F.lit(0)).when(let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(let(keyed(), exact))


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, source`` and the counts that the rules read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    counts = let(
        words_of(F.col("text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words")),
    )
    rows = docs.select(
        "doc_id", "source", counts.alias("c"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return rows.select("doc_id", "source", "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words")


#: The rules: a document fails one where the expression is true.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repetitive": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
}


def shrunk_rates(hosts: DataFrame, failed: str, total: str) -> Column:
    """Posterior mean of a host's failure rate under a beta prior fitted by moments over all hosts."""
    n, x = F.col(total), F.col(failed)
    seen = hosts.agg(F.sum(n).alias("n"), F.sum(x).alias("x"), F.count(F.lit(1)).alias("hosts"), F.sum(x * x / n).alias("squares")).first()
    if not seen["n"]:
        return F.lit(0.0)
    mean = seen["x"] / seen["n"]
    noise = mean * (1 - mean)
    between = seen["squares"] / seen["n"] - mean * mean - noise * seen["hosts"] / seen["n"]
    strength = min(max(noise / between - 1, 1.0), 1e6) if between > 1e-12 else 1e6
    return (x + mean * strength) / (n + strength)


def host_verdicts(judged: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Hosts whose shrunk rate of some rule reaches ``limit``: ``source``. Null hosts have no verdict."""
    hosts = judged.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f"fails_{r}").cast("long")).alias(r) for r in RULES))
    hosts = materialise(hosts, "hosts")
    worst = F.greatest(*(shrunk_rates(hosts, r, "n") for r in RULES), F.lit(0.0))
    return hosts.where(worst >= limit).select("source")


def quality(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` for every document."""
    judged = features(docs)
    judged = judged.select("*", *(F.expr(e).alias(f"fails_{r}") for r, e in RULES.items()))
    judged = materialise(judged, "quality")
    bad = host_verdicts(judged, limit).select("source", F.lit(True).alias("bad_host"))
    rows = judged.join(bad, "source", "left")
    failed = F.col("fails_short") | F.col("fails_repetitive")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.col("bad_host").isNull()).alias("kept"),
    )
