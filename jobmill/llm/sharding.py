"""Sharding by weighted rendezvous hashing of record keys. DataFrame functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmill.llm.common import spread_rank

#: Stands for a null key; no key's text is this.
NULL_KEY = "\x00null"
#: Slots are numbered within so many hash ranges of each shard.
RANGES = 4096


def unit_hash(text: Column) -> Column:
    """A double strictly between 0 and 1 from the first 52 bits of the MD5."""
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard with the highest score -weight / ln(u(key, shard)); ties go to the higher number.

    Adding a shard leaves all other scores as they are, so rows move only into
    the new one, in proportion to its weight.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    scores = [F.struct((-w / F.ln(unit_hash(F.concat(key, F.lit(f"|{i}"))))).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights)]
    return F.array_max(F.array(*scores))["i"]


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(NULL_KEY))


def assign_shards(docs: DataFrame, weights: list[float], key: str = "doc_id", out: str = "shard") -> DataFrame:
    """Every row of docs with its shard: the key and the weights decide, nothing else.

    A null key is a key of its own, so such rows share a shard. Equal keys
    share a shard. No shuffle.
    """
    return docs.withColumn(out, rendezvous(key_text(F.col(key)), weights))


def shard_manifest(docs: DataFrame, weights: list[float], extra_weight: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 1. slot: gapless from 0
    within the shard, in order of the key's MD5, key, checksum and size.
    grown_shard: the shard when one more of ``extra_weight`` is added. A null
    text has the checksum of the empty one. Repeated rows are counted first
    and numbered as a run, so a key with very many rows is one row while slots
    are dealt. An empty table gives an empty result.
    """
    k = key_text(F.col(key))
    rows = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    ).groupBy(key, "size", "text_crc32").agg(F.count("*").alias("_m"))
    rows = rows.select(
        "*",
        rendezvous(k, weights).alias("shard"),
        rendezvous(k, [*weights, extra_weight]).alias("grown_shard"),
        F.md5(k).alias("_h"),
    )
    rows = rows.withColumn("_range", (F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * RANGES / float(1 << 32)).cast("int"))
    rows = spread_rank(rows, ["shard"], "_range", ["_h", key, "text_crc32", "size"], "_m", "_first")
    return rows.select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence("_first", F.col("_first") + F.col("_m") - 1)).alias("slot"), "grown_shard",
    )
