"""The raw tree: contracts, whole runs, streaming."""

import json
import uuid

from pyspark.sql import functions as F

from jobmill.plans.contracts import CONTRACTS, check, split
from jobmill.sources import raw

SIGNATURE = "a" * 64


def run_object(run_id, **over):
    binding = {"source_resume_id": "s1", "binding_key": "b1", "target_key": "t1", "binding_version": 1, "query_sets": ["set"], "auto_apply": False}
    base = {
        "event_type": "run_started", "schema_version": 3, "run_id": run_id, "runtime_mode": "observe", "account_key": "acc", "profile_id": "p", "enabled_resume_keys": ["b1"], "source_resume_ids": ["s1"], "target_keys": ["t1"],
        "active_bindings": [binding], "query_set_keys": ["set"], "query_keys": ["q1"], "query_catalog_size": 3, "query_catalog_signature": SIGNATURE, "max_queries_per_run": 1, "query_cursor_start": 2, "query_cursor_next": 0,
        "query_rotation_wrapped": True, "discovery_config_version": 1, "area": 1, "period": 1, "pages": 1, "per_page": 50, "max_unique_vacancies_per_run": 10, "max_full_fetch_per_run": 5, "search_query_delay_seconds": 1.0,
        "full_fetch_min_delay_seconds": 1.0, "full_fetch_max_delay_seconds": 2.0, "started_at": "2026-08-30T08:00:00+0300", "external_writes_allowed": False,
    }
    return base | over


def summary_object(run_id, **over):
    base = {"event_type": "run_finished", "schema_version": 3, "run_id": run_id, "runtime_mode": "observe", "account_key": "acc", "profile_id": "p", "query_catalog_size": 3, "query_catalog_signature": SIGNATURE, "query_cursor_start": 2, "query_cursor_next": 0,
            "query_rotation_wrapped": True, "candidate_count": 1, "evaluation_candidate_count": 1, "submitted": 0, "confirmed": 0, "finished_at": "2026-08-30T09:00:00+0300"}
    return base | over


def put(root, run_id, name, value, date="2026-08-30"):
    p = root / f"batches/date={date}/run_id={run_id}"
    p.mkdir(parents=True, exist_ok=True)
    (p / f"{name}.json").write_text(json.dumps(value))


def test_contract_violations(spark):
    run_id = str(uuid.uuid4())
    bodies = [run_object(run_id), run_object(run_id, extra=1), run_object(run_id, started_at="2026-08-30T08:00:00"), run_object(run_id, query_cursor_next=1), run_object(run_id, external_writes_allowed=True), "no object"]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i int, body string")
    good, bad = split(check(df, CONTRACTS["observe_run"]), ["i"])
    assert [r["i"] for r in good.collect()] == [0]
    rules = {}
    for r in bad.collect():
        rules.setdefault(r["i"], set()).add(r["rule"])
    assert rules[1] == {"unknown_keys"} and rules[2] == {"started_zoned"} and rules[3] == {"window_next"} and rules[4] == {"no_external_writes"} and "not_a_json_object" in rules[5]


def test_outcome_keeps_write_attempt(spark):
    body = json.dumps({"run_id": "r", "vacancy_id": "v", "status": "uncertain", "external_write_attempted": True, "created_at": "2026-08-30T08:00:00Z"})
    assert check(spark.createDataFrame([(body,)], "body string"), CONTRACTS["outcome"]).first()["violations"] == []


def test_keys_and_checksums(spark, tmp_path):
    run_id = str(uuid.uuid4())
    put(tmp_path, run_id, "run", run_object(run_id))
    o = raw.classify(raw.read_objects(spark, str(tmp_path)))
    r = o.first()
    assert r["key"] == f"batches/date=2026-08-30/run_id={run_id}/run.json" and r["kind"] == "run" and r["run_id"] == run_id
    wrong = spark.createDataFrame([(r["key"], "b" * 64, None)], "key string, sha256 string, collected_at timestamp")
    assert raw.verify(o, wrong).first()["error"] == "checksum"
    right = spark.createDataFrame([(r["key"], r["sha256"].upper(), None)], "key string, sha256 string, collected_at timestamp")
    assert raw.verify(o, right).first()["error"] is None
    times = spark.createDataFrame([(r["key"], r["sha256"], t) for t in ("2026-08-30T08:00:00+03:00", "2026-08-30T08:00:00", "noon Z", None)], "key string, sha256 string, collected_at string")
    assert sorted(str((x["error"], x["observed_at"] and x["observed_at"].hour)) for x in raw.verify(o, times.filter("collected_at is not null")).collect()) == ["('time_without_zone', None)", "('time_without_zone', None)", "(None, 5)"]
    assert raw.verify(o, times.filter("collected_at is null")).first()["observed_at"] == r["last_modified"]
    uris = spark.createDataFrame([("s3://b/p/x.json",), ("s3://o/p/x.json",), ("p/x.json",), ("x.json",), ("s3://b/q/x.json",), ("s3://b/p/x.json?v=1",)], "u string")
    got = [tuple(x["k"]) for x in uris.select(raw.relative_key(F.col("u"), "b", "p").alias("k")).collect()]
    assert got == [("x.json", None), (None, "foreign_bucket"), ("x.json", None), ("x.json", None), (None, "foreign_prefix"), (None, "query_or_fragment")]


def test_digest_and_visible_text(spark):
    df = spark.createDataFrame([('{"b":1.0,"a":"é"}', "<p>a</p><script>x()</script>tail &am"), ("nope", None)], "j string, h string")
    got = raw.exact_visible_text(raw.canonical_digest(df, "j"), "h").collect()
    import hashlib

    assert got[0]["digest"] == hashlib.sha256('{"a":"é","b":1.0}'.encode()).hexdigest() and got[1]["digest"] is None
    assert got[0]["visible"] == "a\nx()\ntail &am" and got[1]["visible"] == ""


def test_first_candidates(spark):
    keys = spark.createDataFrame([("r1", "v3"), ("r1", "v1"), ("r1", "v2"), ("r2", "v9")], "run_id string, vacancy_id string")
    assert sorted(tuple(x) for x in raw.first_candidates(keys, 2).collect()) == [("r1", "v1", 1), ("r1", "v2", 2), ("r2", "v9", 1)]
