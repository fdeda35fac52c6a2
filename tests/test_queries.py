"""Every registered query against its SQL on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from jobmill.plans import more_queries  # noqa: F401
from jobmill.plans import queries as jobs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(jobs.ORACLES))
def test_matches_sql(spark, con, name):
    df = jobs.QUERIES[name](spark, SF)
    r = con.sql(jobs.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert Counter(tuple(shown(x[c]) for c in columns) for x in df.collect()) == Counter(tuple(shown(x[i]) for i in at) for x in r.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(jobs.QUERIES) <= set(__spark_entry__.queries())
