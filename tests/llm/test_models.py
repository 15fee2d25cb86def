"""Language identification, toxicity and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terracell.llm import kn_lang, toxicity
from terracell.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
TEXTS = {"xx": ["abab abba baab bab", "abba abab aab"] * 6, "yy": ["cdcd dccd cdd", "ddcc cdcd dcdc"] * 6}


def brute_log_prob(texts, n_symbols, context, symbol, order=4):
    """Interpolated Kneser-Ney by its definition, for one language."""
    from collections import Counter

    grams = Counter()
    for word in " ".join(texts).split():
        padded = "___" + word + "_"
        grams.update(padded[i - 3 : i + 1] for i in range(3, len(padded)))
    levels = {4: grams}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(k, h, c):
        if k == 0:
            return 1 / n_symbols
        count = levels[k]
        once, twice = sum(v == 1 for v in count.values()), sum(v == 2 for v in count.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        mine = {g: v for g, v in count.items() if g[:-1] == h}
        lower = p(k - 1, h[1:], c)
        if not mine:
            return lower
        total = sum(mine.values())
        return max(count[h + c] - d, 0) / total + d * len(mine) / total * lower

    return np.log(p(order, context, symbol))


def test_kneser_ney_by_definition():
    m = kn_lang.fit(TEXTS)
    code = lambda s: sum((0 if c == "_" else ord(c)) << (16 * (3 - i)) for i, c in enumerate(s))
    grams = ["___a", "__ab", "_aba", "abab", "aba_", "cccc", "zzza", "abaz", "_cdc", "dcdc"]
    got = m.log_prob(np.array([code(g) for g in grams], np.uint64))
    for j, lang in enumerate(m.langs):
        want = [brute_log_prob(TEXTS[lang], 6, g[:3], g[3]) for g in grams]
        assert got[:, j] == pytest.approx(want, abs=1e-4)
    for j, lang in enumerate(m.langs):  # sums to one over all symbols but the unseen one
        total = sum(np.exp(brute_log_prob(TEXTS[lang], 6, "_ab", c)) for c in "_abcd")
        assert 0.8 < total <= 1


def test_odd_texts_have_a_defined_language(spark):
    rows = [(i, t, lang) for i, (lang, x) in enumerate((k, v) for k, v in TEXTS.items()) for i, t in enumerate(x, 100 * i)]
    rows += [(900, None, None), (901, "", None), (902, "12 %% 3", None), (903, "abab", None), (904, "ȁ𝒳", None), (None, "cdcd", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r._lang for r in kn_lang.identify(df).collect()}
    assert all(got[i].lang == "und" and got[i].rejected for i in (900, 901, 902))
    assert got[903].lang == "xx" and got[None].lang == "yy" and got[904].lang in ("xx", "yy")
    none = kn_lang.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r._lang.lang for r in none} == {"und"}
    assert kn_lang.identify(df.limit(0)).collect() == []


def test_held_out_languages(spark):
    rows = QUERIES["op5_language_id"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.01 and all(0 <= r.score <= 1 for r in rows)


def test_fold():
    assert toxicity.fold("Ídіоt 1D10T ｉｄｉｏｔ") == "idiot idiot idiot"
    assert toxicity.fold("l0ser!") == toxicity.fold("1oser ")


def test_lexicon_and_exceptions():
    place = ("home", "town", "sea", "hill", "trash can here")
    clean = [f"the {a} sat by the long winding road near {b}" for a in ("cat", "dog", "cow", "hen") for b in place] * 40
    toxic = [f"you {a} are {b} trash" for a in ("big", "sad", "odd", "old") for b in ("pure", "real", "such", "just")] * 40
    lex = toxicity.fit([(t, 0) for t in clean] + [(t, 1) for t in toxic])
    score = lambda t: float(lex.score(*zip(lex.raw(t)))[0])
    assert score("you old trash") > 0.5 > score("put it in the trash can now")
    assert score("tr4sh trаsh") > 0.5 and score("") < 0.5 and lex.raw("") == (0, 0)


def test_scores_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert all(r._score < 0.5 for r in toxicity.score_texts(docs, toxicity.learn(docs, labels)).collect())
    assert toxicity.score_texts(docs.limit(0), toxicity.Lexicon()).collect() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(-1, "12 34", "en", "src0", 5), (-2, None, None, None, None)], docs.schema)
    now = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, DATA)
        assert out.columns == docs.columns, name
        before, now = now, spark.createDataFrame(out.collect(), docs.schema)
        ids = [r.doc_id for r in now.select("doc_id").collect()]
        known = {r.doc_id for r in before.select("doc_id").collect()}
        assert set(ids) <= known
        if name == "language_id":
            assert known - set(ids) >= {-1, -2} and len(ids) > 985
        if name == "jaccard_join":
            assert len(ids) == len(set(ids)) < len(known)
        if name == "source_mixing":
            assert len(set(ids)) < len(ids)
    rows = corpus_pipeline.STAGES[-1][1](spark, now, DATA).collect()
    assert len(rows) == now.count() and all(r.exact and r.n_pieces == len(r.ids) for r in rows)


def test_near_copies_of_repeated_rows(spark):
    rows = [(1, "a b c d e", "en", "s", 1), (1, "a b c d e", "en", "s", 1), (2, "A b c d e", "en", "s", 1), (None, "q", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.jaccard_dedup(spark, df, DATA).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1]
