"""Registered queries on tables larger than the small ones."""

import duckdb
import pytest
from pyspark.sql import functions as F

from jobmill.plans import more_queries, series_queries  # noqa: F401
from jobmill.plans import queries as jobs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [4096 * 256 + 100, 4097 * 256])
def test_fingerprint_sql_of_two_levels(spark, tmp_path, n):
    """Rows about as many as a level more begins with: the SQL has as many levels as the operator."""
    orders = spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), (F.col("id") % 100 + 0.5).alias("o_totalprice"), F.lit("2024-01-02").cast("timestamp_ntz").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{SF}/region.parquet").write.parquet(f"{tmp_path}/region.parquet")
    con = duckdb.connect()
    for t in ("region", "orders"):
        con.sql(f"create view {t} as from '{tmp_path}/{t}.parquet/*.parquet'")
    got = {(r["name"], r["n"], r["fingerprint"]) for r in jobs.QUERIES["rowset_fingerprint"](spark, str(tmp_path)).collect()}
    assert got == set(con.sql(f"select name, n, fingerprint from ({jobs.ORACLES['rowset_fingerprint']})").fetchall())


@pytest.mark.parametrize("name", ["page_completeness", "replayed_runs", "page_lineage"])
def test_partitions_follow_the_rows(spark, monkeypatch, name):
    """Last steps run in partitions of so many rows, not in the set number of shuffle partitions; the result stays."""
    from jobmill.operators import spread

    want = sorted(map(tuple, jobs.QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(spread, "ROWS", 500)
    df = jobs.QUERIES[name](spark, SF)
    assert df.rdd.getNumPartitions() >= spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500 > 10
    assert sorted(map(tuple, df.collect())) == want
