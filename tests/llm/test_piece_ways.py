"""All n best segmentations reach a DataFrame."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terracell.llm import piece_nbest as p
from terracell.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def replaced(row):
    """The whole id lists of a row of ``RESULT``, best first."""
    out = [row.ids]
    for way in row.others:
        ids = list(row.ids)
        for x in sorted(way, key=lambda x: -x.at):
            ids[x.at : x.at + x["count"]] = x.ids
        out.append(ids)
    return out


def score(v, ids, of):
    return sum(of.get(i, v.octet_score) for i in ids)


def test_every_segmentation_is_returned_and_decodes(spark):
    v = p.load()
    of = dict(v.pieces.values())
    docs = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(60).collect()]
    texts = ["the cat sat", "aaa aaaa ----- ===", "\n\n a", "▁ odd", "日本 ńń x", "y" * 90, "a", *docs]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = p.tokenise(df).withColumn("whole", p.segmentations(F.col("_pieces"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ways = replaced(r._pieces)
        assert ways == r.whole and len(ways) == len(r._pieces.scores) and r._pieces.exact
        assert len({tuple(w) for w in ways}) == len(ways)
        assert [p.decode(v, w) for w in ways] == [r.text] * len(ways)
        assert [score(v, w, of) for w in ways] == pytest.approx(r._pieces.scores)


def test_equal_scores_are_different_segmentations():
    v = p.load()
    for text in ("aaa", "-----", "zzzzzzz zzz", "=== ===="):
        ways = p.encode(v, text, 4)
        assert len({tuple(ids) for _, ids in ways}) == len(ways), text


def test_null_and_empty_texts_have_one(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    for r in p.tokenise(df).withColumn("whole", p.segmentations(F.col("_pieces"))).collect():
        assert r._pieces.others == [] and r.whole == [[]]


def test_query_digests_all_and_pipeline_returns_them(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    best = {r.doc_id: r.h for r in p.tokenise(docs).select("doc_id", F.xxhash64("_pieces.ids", "_pieces.others").alias("h")).collect()}
    found = {r.doc_id: r.ids_hash for r in QUERIES["op9_sentencepiece"](spark, DATA).where(F.col("doc_id").isin(list(best))).collect()}
    assert found == best
    for r in corpus_pipeline.sentencepiece(spark, docs, DATA).collect():
        assert len(r.others) == len(r.scores) - 1 and (r.score, r.last_score) == (r.scores[0], r.scores[-1])
