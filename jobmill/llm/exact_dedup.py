"""Exact deduplication by recipes of content-defined chunks. DataFrame functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmill.llm.common import SPACE, cut, drop_rows, free, only

#: A chunk runs to the first sentence mark after so many characters, or to the longest length.
LEAST, MOST = 512, 4096
CHUNK = rf"(?s).{{{LEAST},{MOST}}}?[.!?;:,、。]|.{{1,{MOST}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def chunk_id(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk.cast("binary")))


def verified_chunks(pieces: DataFrame) -> DataFrame:
    """pieces(digest, chunk) to one row per digest: digest, id.

    Chunks are compared in full: distinct (digest, chunk) pairs are formed
    first, and a digest that two contents share stops the job, so equal
    identifiers always mean equal chunks.
    """
    store = pieces.select("digest", "chunk").distinct()
    counted = store.groupBy("digest").agg(F.count("*").alias("n"))
    clash = F.raise_error(F.concat(F.lit("two chunks share the digest "), F.hex("digest"))).cast("binary")
    return counted.select("digest", F.when(F.col("n") == 1, F.col("digest")).otherwise(clash).alias("id"))


def copy_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct (key, text) of docs, with its group of copies.

    Columns: key, _h (xxhash64 of the text), text_sha256 (of the normalised
    text), chars, n_rows (rows of docs behind this one), keep_id, keep_chars, group_size (rows of docs in the group), leads (this
    row is the group's keeper).

    Texts are equal when their white space deleted forms are. Each text is cut
    where its content says; its recipe is the ordered list of its chunks'
    identifiers, and rows are compared by recipe. Equal texts have equal
    recipes, so only texts whose recipe another text has too can be equal:
    their chunks are deduplicated and compared in full, before an identifier
    counts. No other text moves. Null texts count as empty. The keeper has the
    most characters before deletion, then the smallest key (null keys last),
    then the smallest hash of the text. Repeated rows are one row here with n_rows above 1. Rows of an empty table
    give none.
    """
    chunks = F.regexp_extract_all("_norm", F.lit(CHUNK), F.lit(0))
    rows = docs.select(F.col(key), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"), F.xxhash64(text).alias("_h"), normalised(F.col(text)).alias("_norm"))
    rows = rows.select(key, "chars", "_h", F.unhex(F.sha2(F.col("_norm").cast("binary"), 256)).alias("_sha"), F.transform(chunks, chunk_id).alias("recipe"))
    rows = cut(rows.groupBy(key, "_sha", "chars", "_h", "recipe").agg(F.count("*").alias("n_rows")))

    # written before the joins, so that Spark can split a large group of copies
    best = F.min(F.struct((-F.col("chars")).alias("neg"), F.col(key).isNull().alias("nul"), F.col(key).alias("k"), F.col("_h").alias("h")))
    groups = cut(rows.groupBy("recipe").agg(best.alias("_best"), F.sum("n_rows").alias("group_size")))
    copied = groups.filter((F.col("group_size") > 1) & (F.size("recipe") > 0)).select("recipe")
    suspects = cut(rows.join(copied, "recipe").select("_h").distinct())
    again = only(docs.select(F.xxhash64(text).alias("_h"), F.col(text).alias("_t")), suspects, ["_h"]).select(normalised(F.col("_t")).alias("_norm"))
    pieces = again.select(F.explode(chunks).alias("chunk")).select(chunk_id(F.col("chunk")).alias("digest"), "chunk")
    verified_chunks(pieces).agg(F.count("id")).first()  # from here on, digests of copied texts are identifiers
    free(suspects)

    return rows.join(groups, "recipe").select(
        key, F.hex("_sha").alias("_sha"), "chars", "n_rows", F.col("_best.k").alias("keep_id"), (-F.col("_best.neg")).alias("keep_chars"), "group_size",
        (F.col(key).eqNullSafe(F.col("_best.k")) & (F.col("_h") == F.col("_best.h"))).alias("leads"), "_h",
    ).withColumn("text_sha256", F.lower("_sha")).drop("_sha")


def copy_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256. One row of each group is kept."""
    g = copy_groups(docs, key, text).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return g.select(key, "keep_id", "group_size", (F.col("leads") & (F.col("_i") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns; of rows that agree in key and text, the smallest by their other columns."""
    g = copy_groups(docs, key, text).select(F.col(key).alias("k"), F.col("_h").alias("h"), "leads", "n_rows")
    return drop_rows(docs, key, F.xxhash64(text), cut(g.filter("not leads").select("k", "h")), cut(g.filter("leads and n_rows > 1").select("k", "h")))
