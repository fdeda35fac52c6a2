"""Registered corpus queries against their SQL, and their contracts' columns, on the smallest tables."""

import duckdb
import pytest

from jobmill.llm import queries as q
from tests.test_queries import SF, TABLES, shown

COLUMNS = {
    "op1_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op5_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op9_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op11_quality": {"doc_id", "held_out", "score", "predicted"},
    "op10_substring_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_matches_sql(spark, con, name):
    df, r = q.QUERIES[name](spark, SF), con.sql(q.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    got = sorted(tuple(shown(x[c]) for c in columns) for x in df.collect())
    assert got == sorted(tuple(shown(x[i]) for i in at) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_a_document(spark, name):
    df = q.QUERIES[name](spark, SF)
    assert set(df.columns) >= COLUMNS[name]
    ids = sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids == sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
