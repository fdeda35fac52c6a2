"""Helpers shared by the operators: reading, held-out folds, cut points, ranks."""

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of every contract: the space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of rows that a Python worker gets at a time.
BATCH = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands Python workers at most about BATCH bytes of rows at a time, or one longer row.

    Spark's own bounds are 10,000 rows and 64 MB, which the executor and each
    of its workers hold in several forms at once, and workers keep what they
    once took. A lower bound of the session's own stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH:
        spark.conf.set(name, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, mod n; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _at_exit(spark: SparkSession, root: str) -> None:
    try:
        _remove(spark, root)
    except Exception:  # noqa: BLE001  the session was stopped before: the folder is the cluster's to clear
        pass


_roots: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """This application's folder in the shared folder of ``spark.checkpoint.dir``; it is removed when the driver's program ends.

    Where that setting is empty, a local temporary folder takes its place, but
    only if driver and executors are one process, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    root = f"{base.rstrip('/')}/jobmill-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_at_exit, spark, root)
    return root


def clear_scratch(spark: SparkSession) -> None:
    """Removes all tables that operators have written for themselves. For callers who have written every result they want."""
    _remove(spark, scratch_root(spark))


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read back.

    What is built on the result neither repeats the work behind df nor depends
    on files of an executor that may be lost.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def free(*tables: DataFrame | None) -> None:
    """Removes tables that cut has written, once nothing that is still to run reads them."""
    for t in tables:
        if path := getattr(t, "written_to", None):
            _remove(t.sparkSession, path)


def same(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Null-safe equality of left's columns with right's."""
    cond = F.lit(True)
    for a, b in keys.items():
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def spread_rank(rows: DataFrame, part: list[str], bucket: str, order: list[str], weight: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over the rows before this one within ``part``.

    The order is (bucket, order). No task holds a whole part: rows are summed
    before them within (part, bucket), buckets before them from one row per
    bucket. ``part`` and ``bucket`` must hold no nulls.
    """
    before = Window.partitionBy(*part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*part, bucket).agg(F.sum(weight).alias("_n"))
    offsets = offsets.select(*part, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*part, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return rows.join(offsets, [*part, bucket]).withColumn(out, F.col("_inside") + F.col("_before")).drop("_inside", "_before")


#: A side of so many bytes is small enough for every task to hold.
FEW = 16 << 20


def few(keys: DataFrame) -> bool:
    """Whether keys, already written, take at most FEW bytes, counting each value as its type's size and a string or binary as 24."""
    width = sum({"LongType": 8, "DoubleType": 8, "IntegerType": 4}.get(type(f.dataType).__name__, 24) + 8 for f in keys.schema)
    return keys.count() * width <= FEW


def only(df: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """The rows of df whose ``on`` columns occur in keys (null-safe), keys being narrow, distinct and already written.

    keys are counted first: up to FEW bytes they are broadcast, so that df is
    filtered where it is read; beyond it both sides are shuffled.
    """
    small = keys.select(*[F.col(c).alias(f"_k_{c}") for c in on])
    small = F.broadcast(small) if few(small) else small
    cond = F.lit(True)
    for c in on:
        cond = cond & df[c].eqNullSafe(small[f"_k_{c}"])
    return df.join(small, cond, how)


def without(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of df whose ``on`` columns don't occur in keys; otherwise like ``only``."""
    return only(df, keys, on, "left_anti")


def drop_rows(docs: DataFrame, key: str, mark: Column, gone: DataFrame, tied: DataFrame) -> DataFrame:
    """docs without the rows whose key and mark are in gone(k, h); of rows that share a key and mark in tied(k, h), the smallest.

    Both tables hold distinct pairs and are written. Where they are few, no row
    of docs moves. Rows with map columns can't be put in order: any one stays.
    """
    kept = without(docs.select(F.struct("*").alias("d"), F.col(key).alias("k"), mark.alias("h")), gone, ["k", "h"])
    if not tied.isEmpty():
        one = F.first if "map<" in docs.schema.simpleString() else F.min
        many = only(kept, tied, ["k", "h"]).groupBy("k", "h").agg(one("d").alias("d"))
        kept = without(kept, tied, ["k", "h"]).unionByName(many.select(*kept.columns))
    return kept.select("d.*")
