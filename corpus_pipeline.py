"""A corpus from raw documents in five stages: language, exact copies, near copies, mixture, tokens.

Each stage reads what its predecessor kept, as Parquet; all but the last return
the columns of documents.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill.llm import byte_bpe, exact_dedup, jaccard_join, language, mixing
from jobmill.llm.common import cut, fold, table

#: Shingle length and similarity of the near-duplicate stage.
WORDS, PERCENT = 5, 80
#: Weights that the sources take in turn, and how often a document may repeat.
WEIGHTS, CAP = [5, 2, 1], 3.0


def keep_recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not recognised: without letters, or no language likelier than all others.

    Learns from the documents themselves, but for the held-out quarter.
    """
    model = language.fit(docs.filter(fold(F.col("doc_id"), 4) != 2))
    scored = language.predict(docs.select(F.struct("*").alias("d"), "text"), model)
    return scored.filter(language.accepted(F.col("lang_pred"), F.col("score"))).select("d.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of near copies join: the one with the smallest id, null ids last.

    Documents with an empty shingle set are in no group and stay. Documents
    that share an id stand for themselves.
    """
    return jaccard_join.drop_near_copies(docs, n=WORDS, percent=PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, as many times as each is taken."""
    return mixing.mixed_documents(docs, WEIGHTS, CAP)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the text decoded from them."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_recognised),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode_texts),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
