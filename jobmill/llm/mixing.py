"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmill.llm.common import WORD, cut, few, spread_rank

#: Documents of one size class are numbered within so many hash ranges.
RANGES = 256


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def size_class(size: Column) -> Column:
    """Eight classes an octave, exact in integers: bits of the size, then the three bits below the first."""
    bits = F.length(F.bin(size))
    # sizes under 8 are classes of their own
    top = F.when(bits > 3, F.floor(size / F.pow(F.lit(2.0), (bits - 4).cast("double"))).cast("long") % 8).otherwise(size)
    return (bits * 8 + top).cast("int")


def targets(sizes: DataFrame, weights: list[int], cap: float) -> DataFrame:
    """sizes(source, source_size) with target: shares by weight, none above cap * source_size.

    Sources in code point order, null last, take the weights in turn. Of the
    sources in order of cap * size / weight a prefix stops at its cap; the rest
    share what is left by weight. One row per source, so one task is enough.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    s = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1).cast("long"))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "_total": F.sum("source_size").over(every).cast("double"),
        "_all_w": F.sum("_w").over(every).cast("double"),
        "_full": F.coalesce(F.sum("source_size").over(fill), F.lit(0)).cast("double") * cap,
        "_full_w": F.coalesce(F.sum("_w").over(fill), F.lit(0)).cast("double"),
    })
    s = s.withColumn("_capped", F.col("source_size") * cap * (F.col("_all_w") - F.col("_full_w")) <= F.col("_w") * (F.col("_total") - F.col("_full")))
    s = s.withColumns({
        "_left": F.col("_total") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("source_size"))).over(every), F.lit(0)) * cap,
        "_left_w": F.coalesce(F.sum(F.when(~F.col("_capped"), F.col("_w"))).over(every), F.lit(0)),
    })
    target = F.when(F.col("_capped"), F.col("source_size") * F.lit(float(cap))).otherwise(F.col("_w") * F.col("_left") / F.col("_left_w"))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights: list[int], cap: float = 3.0, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of docs: key, size, source_size, target, copies, taken.

    size: words of the text (null: 0). Within a source, documents in order of
    size class and the MD5 of the key have expected copies target / source_size
    each; a document is emitted once for each integer that its stretch of their
    prefix sum, shifted by the source's one random offset, crosses. As sizes
    rise along the prefix sum, the words taken stay near the target. The offset
    is hashed from seed and source, so reruns agree. taken = copies * size.

    A null source is a source of its own, ordered last. Repeated rows get
    stretches one after the other. A source whose texts hold no word has target
    0 and takes nothing. An empty table gives an empty result.
    """
    base = docs.select(F.col(key), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    base = base.groupBy(key, "source", "size").agg(F.count("*").alias("_m"))
    base = base.withColumns({
        "_src": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")),
        "_class": size_class(F.col("size")),
        "_h": F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))),
    }).withColumn("_range", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int"))
    base = cut(base)  # texts are read once

    sizes = base.groupBy("_src", "source").agg(F.sum(F.col("size") * F.col("_m")).alias("source_size"))
    rate = targets(sizes.select("source", "source_size"), weights, cap).withColumn("_src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "_src")), 1, 5), 16, 10).cast("double") / float(1 << 20)
    rate = rate.withColumns({
        "_rate": F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0), F.lit(float(cap))),
        "_offset": unit,
    })

    before = Window.partitionBy("_src").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    classes = base.groupBy("_src", "_class").agg(F.sum("_m").alias("_n"))
    classes = classes.select("_src", "_class", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = spread_rank(base, ["_src", "_class"], "_range", ["_h", key, "size"], "_m", "_rank")
    ranked = ranked.join(classes, ["_src", "_class"]).join(rate, "_src")
    first = F.col("_base") + F.col("_rank")
    ranked = ranked.withColumn("_at", F.explode(F.sequence(first, first + F.col("_m") - 1)))
    crossed = F.floor((F.col("_at") + 1) * F.col("_rate") + F.col("_offset")) - F.floor(F.col("_at") * F.col("_rate") + F.col("_offset"))
    return ranked.select(key, "source", "size", "source_size", "target", crossed.cast("long").alias("copies"), (crossed * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: list[int], cap: float = 3.0, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix, each as many times as it is emitted.

    Rows that agree in key, source and size share the copies of all of them.
    """
    taken = mix(docs, weights, cap, seed, key, text, source).groupBy(key, "source", "size").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    taken = cut(taken.filter("_copies > 0").select(F.col(key).alias("_k"), F.col("source").alias("_s"), F.col("size").alias("_z"), "_copies", "_rows"))
    taken = F.broadcast(taken) if few(taken) else taken  # so that texts of a small mix don't move
    d = docs.select(F.struct("*").alias("d"), F.col(key).alias("key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("hash"))
    joined = d.join(taken, d["key"].eqNullSafe(F.col("_k")) & d["source"].eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    once = joined.filter("_rows = 1").withColumn("_times", F.col("_copies"))
    # rows that share key, source and size split the copies evenly, the first ones taking the remainder
    w = Window.partitionBy("key", "source", "size").orderBy("hash")
    many = joined.filter("_rows > 1").withColumn("_r", F.row_number().over(w))
    many = many.withColumn("_times", F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_r") <= F.col("_copies") % F.col("_rows")).cast("long")).drop("_r")
    every = once.unionByName(many).filter("_times > 0")
    return every.select("d", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("d.*")
