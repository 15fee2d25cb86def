"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm import chat_format, embed_join, host_quality, kn_lang, license_scan, mixing, partenum, piece_nbest, toxicity, url_rules
from terracell.llm.oracle import ORACLE_SQL
from terracell.llm.shared import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_groups(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.quality(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kn_lang.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return docs.select("doc_id", kn_lang.held_out(F.col("doc_id")).alias("held_out"), F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score"), F.col("_lang.rejected").alias("rejected"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_texts(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


#: The conversation that the contract adds to the table.
EXTRA_TEXT = r"\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nth = F.col("id")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), nth.alias("turn"), F.when(nth == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text")
    )
    turns = turns.unionByName(extra).select("conv_id", "turn", "role", F.array(chat_format.text_part(F.col("text"))).alias("parts"))
    return chat_format.digest(chat_format.format_conversations(turns))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = piece_nbest.tokenise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = docs.select("doc_id", F.col("_pieces").alias("p"))
    return found.select(
        "doc_id", F.size("p.ids").cast("long").alias("n_pieces"), F.get("p.scores", F.lit(0)).alias("score"), F.size("p.scores").cast("long").alias("n_best"),
        (F.get("p.scores", F.lit(0)) - F.element_at("p.scores", -1)).alias("margin"), F.xxhash64("p.ids", "p.others").alias("ids_hash"), F.col("p.exact").alias("exact"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("_licenses").alias("h"))
    return docs.select(
        "doc_id", F.size("h").cast("long").alias("n_hits"), F.array_join(F.array_sort(F.array_distinct("h.family")), ",").alias("families"),
        F.array_max("h.similarity").alias("similarity"), F.array_max("h.probability").alias("probability"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_embedding_near_dedup, op3_jaccard_join, op4_quality_rules, op5_language_id,
        op6_toxicity, op7_source_mixing, op8_chat_format, op9_sentencepiece, op10_license_scan,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
