"""The registered queries: each applies one operator to its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill.llm import byte_bpe, chat_format, exact_dedup, hard_negatives, jaccard_join, language, mixing, oracles, quality, sharding, spelling, substring_dedup, toxicity, vector_dedup
from jobmill.llm.common import fold, table

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of a repeat that op10 reports, though it removes from 400 on: 50 words of four letters and a space.
PASSAGE = 250


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_manifest(table(spark, sf_dir, "documents"), [1.0] * 8)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=90)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), [5, 2, 1]).select("doc_id", "size", "source_size", "target", "taken")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copy_report(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat_format.turns_as_calls(table(spark, sf_dir, "conversations"))
    return chat_format.link_tool_calls(calls, results, chat_format.SCHEMAS)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language.fit(docs.filter(~held_out))
    return language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), report=PASSAGE)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = quality.fit(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    return quality.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    v = v.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(v, F.col("id") % 100 == 0)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_sharding": op2_sharding,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_mixing": op4_mixing,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_vector_dedup": op6_vector_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_language": op9_language,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_quality": op11_quality,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op2_sharding": oracles.OP2,
    "op3_jaccard_join": oracles.OP3,
    "op4_mixing": oracles.OP4,
    "op6_vector_dedup": oracles.OP6,
    "op7_exact_dedup": oracles.OP7,
    "op8_chat_format": oracles.OP8,
    "op12_hard_negatives": oracles.OP12,
    "op13_spelling": oracles.OP13,
}
