"""From raw documents to token ids: language, toxicity, near-copies, mixing, pieces.

Each stage takes what the one before kept and returns the columns of documents; the last returns
token ids. ``run`` applies all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm import kn_lang, mixing, partenum, piece_nbest, toxicity
from terracell.llm.shared import materialise, table

#: Words of a shingle and least similarity of near-copies; op3_jaccard_join has its own.
GRAM, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those learned; null texts, texts without letters and strange texts go.

    Rows are judged one by one: repeated ones alike, and an empty table stays empty.
    """
    return kn_lang.identify(docs).where(~F.col(kn_lang.lang_name(docs))["rejected"]).select(docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.

    Null and empty texts have no hit and stay, unless no hit is toxic by itself; repeated rows are
    judged alike; without labels of both kinds every document stays; an empty table stays empty.
    """
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, lexicon).where(F.col(toxicity.score_name(docs)) < 0.5).select(docs.columns)


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: the one with the least doc_id. Rows without a doc_id stay."""
    groups = materialise(partenum.jaccard_rows(docs, GRAM, PERCENT), "pipeline-groups").where("doc_id is not null")
    again = materialise(groups.groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-again")
    if again.isEmpty():
        gone = materialise(groups.where("doc_id <> component_id").select("doc_id"), "pipeline-gone")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # A doc_id may stand for several texts: rows go by doc_id and class of their own text.
    classes = groups.where("cls is not null").select("doc_id", F.col("cls").alias("_cls"), "root").distinct()
    least = classes.groupBy("root").agg(F.min(F.struct("doc_id", "_cls")).alias("least"))
    gone = classes.join(least, "root").where("struct(doc_id, _cls) <> least").select("doc_id", "_cls")
    gone = materialise(gone, "pipeline-gone")
    rows = materialise(docs.withColumn("_cls", partenum.class_of(F.col("text"), GRAM)), "pipeline-classes")
    kept = rows.join(gone, ["doc_id", "_cls"], "left_anti")
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "_cls"]).select(docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Null texts and texts without words are taken with their block and add no words; a null source is
    a source; of rows of equal id and text as many are taken as come nearest; an empty table stays empty.
    """
    return mixing.mixed_rows(docs).select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the best segmentation, what the others of the n best replace in it, their scores, and the round trip.

    Null and empty texts have no ids and the score 0; repeated rows give equal rows; an empty table gives none.
    """
    p = piece_nbest.tokenise(docs.select("doc_id", "lang", "source", "text"))
    p = p.select("doc_id", "lang", "source", F.col("_pieces").alias("p"))
    return p.select("doc_id", "lang", "source", F.col("p.ids").alias("ids"), F.size("p.ids").cast("long").alias("n_pieces"), F.get("p.scores", F.lit(0)).alias("score"), F.element_at("p.scores", -1).alias("last_score"), F.col("p.exact").alias("exact"), F.col("p.scores").alias("scores"), F.col("p.others").alias("others"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("jaccard_join", jaccard_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
