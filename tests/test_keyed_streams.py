"""Keyed streams on random requests: any split into micro-batches gives what the batch operator gives."""

import random

import pytest
from pyspark.sql import functions as F

from jobmill.operators import state
from jobmill.streaming import keyed


def streamed(spark, tmp_path, rows, schema, splits, of, name):
    """The result of a stream that gets rows in closed ranges of seq, a micro-batch each, shuffled within it."""
    bounds = [0, *sorted(random.Random(len(rows)).sample(range(1, len(rows)), splits - 1)), len(rows)]
    path, out = str(tmp_path / "in"), []
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        part = rows[a:b]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(schema).parquet(path)
        q = of(source).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    return out


def as_set(rows):
    return {tuple(str(v) for v in r.asDict().values()) for r in rows}


@pytest.mark.parametrize("splits", [1, 3])
def test_claim_stream(spark, tmp_path, splits):
    r = random.Random(splits)
    kinds = ["acquire", "acquire", *state.STATES, "CONFIRMED"]
    rows = [(r.randrange(6), i % 2, i, r.choice(["r1", "r2"]), r.choice(["acc", "acc", "acc", " "]), r.choice(kinds), 1000 + i, r.choice([None, "E"]), r.choice([None, '{"a":1}'])) for i in range(250)]
    schema = "a int, b int, seq long, run_id string, account_key string, kind string, s long, error_type string, evidence string"
    key = ["a", "b"]

    def asked(df):
        return df.withColumn("at", F.timestamp_seconds("s"))

    got = streamed(spark, tmp_path, rows, schema, splits, lambda df: keyed.claim_stream(asked(df), key), "claims")
    want = state.decide_claims(asked(spark.createDataFrame(rows, schema)), key).collect()
    assert len(got) == len(rows) and as_set(got) == as_set(want)
    assert {x["reason"] for x in want} >= {None, "held", "other_owner", "no_account", "unknown_state", "not_claimed", "not_from_SUBMITTED"}
    assert {x["status"] for x in want if x["granted"]} == set(state.STATES)


def test_cursor_stream(spark, tmp_path):
    r = random.Random(9)
    rows = [(r.randrange(3), i, r.choice(["a", "a", "a", "b"]), r.choice([5, 5, 5, 4]), r.randint(1, 7)) for i in range(150)]
    schema = "p int, i long, sig string, size int, win int"
    got = streamed(spark, tmp_path, rows, schema, 3, lambda df: keyed.cursor_stream(df, ["p"], "i", "sig", "size", "win"), "cursors")
    want = state.reserve_windows(spark.createDataFrame(rows, schema), ["p"], "i", "sig", "size", "win").select("p", F.col("i").alias("seq"), "epoch", "start_offset", "next_offset", "wrapped").collect()
    assert len(got) == len(rows) and as_set(got) == as_set(want)
