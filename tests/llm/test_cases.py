"""Clashing names, ties, repeated rows, long texts and empty tables."""

import time

import pytest
from pyspark.sql import functions as F

from terracell.llm import chat_format, kn_lang, license_scan, mixing, piece_nbest, queries, shared, toxicity


def test_free_name_ignores_case():
    assert shared.free_name(["a", "_Score"], "_score") == "__score"
    assert shared.free_name(["a"], "_score") == "_score"


def test_callers_columns_stay(spark):
    docs = spark.createDataFrame([(1, "MIT License\nsome text", 7, 8, 9)], "doc_id long, text string, _score int, _licenses int, _pieces int")
    assert toxicity.score_texts(docs, toxicity.Lexicon()).columns[-1] == "__score"
    scanned = license_scan.scan(docs).first()
    assert scanned["_licenses"] == 8 and len(scanned["__licenses"]) == 1
    assert piece_nbest.tokenise(docs).first()["_pieces"] == 9
    assert kn_lang.lang_name(docs.withColumn("_lang", F.lit(1))) == "__lang"


def test_mix_keeps_clashing_columns(spark):
    names = ["_p", "_shard", "_times", "_source", "_block", "_at", "plan", "times", "place", "row", "copy", "part", "size"]
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 3).cast("string").alias("source"), *(F.lit(i).alias(n) for i, n in enumerate(names)))
    rows = mixing.mixed_rows(docs)
    assert rows.columns == [*docs.columns, "__shard", "__at"]
    assert {tuple(r[n] for n in names) for r in rows.collect()} == {tuple(range(len(names)))}


def test_equal_rows_are_taken_by_number(spark):
    docs = spark.range(200).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("x").alias("source"))
    other = spark.range(400).select("id", F.lit("a b").alias("text"), F.lit("y").alias("source"))
    rows = mixing.mix(docs.union(other).repartition(7)).where("size = 4").collect()
    taken, target = sum(r.taken for r in rows), rows[0].target
    assert abs(taken - target) <= 4, (taken, target)
    assert {r.taken for r in rows} <= {0, 4}


def test_split_tree_halves_every_node(spark):
    draws = spark.range(1003).select((F.col("id") % 5).cast("string").alias("source"), F.col("id").cast("int").alias("block"), F.lit(0).alias("copy"))
    found = mixing.split_tree(draws, 8, 3).groupBy("shard").count().collect()
    assert len(found) == 8 and sum(r["count"] for r in found) == 1003
    assert max(r["count"] for r in found) - min(r["count"] for r in found) <= 1


def test_marks_without_width_join_words():
    for t in ("id​iot", "id­iot", "ídiot", "id⁠iot"):
        assert toxicity.fold(t) == "idiot", t


def plain_hits(lex, text):
    """Every entry by a plain search; the longest of a start, unless an exception phrase covers it."""
    t = f" {' '.join(toxicity.fold(text).split())} "
    cover = [(i, i + len(p) + 1) for p in lex.exceptions for i in range(len(t)) if t.startswith(f" {p} ", i)]
    total = 0.0
    for i in range(len(t)):
        found = [(len(s), w) for s, w in lex.weights.items() if t.startswith(f" {s}", i)]
        if found and not any(a <= i < b for a, b in cover):
            total += max(found)[1]
    return total


def test_automaton_matches_plain_search():
    lex = toxicity.Lexicon({"trash": 1.0, "trashy": 2.5, "idiot": 4.0}, ("trash can", "idiot proof"), 0.5, 1.0, 0.0)
    for t in ("trash can trash", "TRASHY idiot proof idiots", "", "trash trash can trash can idiot", "1d10t trash cans", "idiot idiot proof trash"):
        assert lex.raw(t)[0] == pytest.approx(plain_hits(lex, t)), t


def test_long_text_takes_time_in_proportion():
    lex = toxicity.Lexicon({"trash": 1.0}, ("trash can",), 0.5, 1.0, 0.0)
    began = time.perf_counter()
    assert lex.raw("trash can trash " * 100_000) == (100_000.0, 300_000)
    assert time.perf_counter() - began < 30


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert piece_nbest.tokenise(empty).count() == 0
    assert license_scan.scan(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    turns = turns.select("conv_id", "turn", "role", F.array(chat_format.text_part(F.col("text"))).alias("parts"))
    assert chat_format.digest(chat_format.format_conversations(turns)).count() == 0


def test_repeated_rows_are_judged_alike(spark):
    docs = spark.createDataFrame([(1, "MIT License"), (1, "MIT License"), (2, None), (3, "")], "doc_id long, text string")
    hits = [(r.doc_id, len(r["_licenses"])) for r in license_scan.scan(docs).collect()]
    assert sorted(hits) == [(1, 1), (1, 1), (2, 0), (3, 0)]
    assert sorted(r["_score"] for r in toxicity.score_texts(docs, toxicity.Lexicon({"mit": 5.0}, (), 0.5, 20.0, -2.0)).collect())[-2:][0] > 0.5


def test_query_of_toxicity_finds_held_out_labels(spark):
    found = queries.op6_toxicity(spark, "/root/testdata/sf0.01").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("toxic is not null")
    pairs = found.join(labels, "doc_id").select("predicted", "toxic").collect()
    assert pairs and sum(r.predicted == r.toxic for r in pairs) >= 0.95 * len(pairs)
