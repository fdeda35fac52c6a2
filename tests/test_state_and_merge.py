"""Merges, reconciliation and state machines."""

import random

from pyspark.sql import functions as F

from jobmill.operators import merge, quality, reconcile, routing, state


def brute_coalesce(rows):
    out = {}
    for key, ts, _, value, uri, full in sorted(rows, key=lambda r: r[2]):
        s = out.setdefault(key, {"ts": None, "value": None, "uri": None})
        if s["ts"] is not None and ts < s["ts"]:
            continue
        s["ts"], s["uri"] = ts, uri
        if full or value is not None:
            s["value"] = value
    return {k: (s["value"], s["uri"]) for k, s in out.items()}


def test_arrival_merge_equals_fold(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40), rng.randrange(6), i, rng.choice([None, f"v{i}"]), f"u{i}", rng.random() < 0.3) for i in range(800)]
    df = spark.createDataFrame(rows, "k int, ts int, seq int, value string, uri string, full boolean")
    got = merge.coalesce_merge(df, ["k"], "ts", "seq", ["value"], ["uri"], is_full="full")
    assert {r["k"]: (r["value"], r["uri"]) for r in got.collect()} == brute_coalesce(rows)


def test_event_time_merge_ignores_arrival(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(10), t, t, rng.choice([None, f"v{t}"]), f"u{t}") for t in range(200)]
    schema = "k int, ts int, seq int, value string, uri string"
    a = merge.coalesce_merge(spark.createDataFrame(rows, schema), ["k"], "ts", "seq", ["value"], ["uri"], mode="event_time")
    order = list(range(200))
    rng.shuffle(order)
    b = merge.coalesce_merge(spark.createDataFrame([(r[0], r[1], s, r[3], r[4]) for r, s in zip(rows, order, strict=True)], schema), ["k"], "ts", "seq", ["value"], ["uri"], mode="event_time")
    assert sorted(a.collect()) == sorted(b.collect())


def test_replay_and_rollback(spark):
    rows = spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 3)], "run string, v int")
    bad = spark.createDataFrame([("r2", "rule")], "run string, rule string")
    loaded = merge.whole_runs(rows, bad, ["run"])
    once = merge.replace_runs(rows.limit(0), loaded, ["run"])
    twice = merge.replace_runs(once, loaded, ["run"])
    assert sorted(once.collect()) == sorted(twice.collect()) == [("r1", 1), ("r1", 2)]


def test_run_status_never_falls_back(spark):
    df = spark.createDataFrame([(1, 1, "running", 5), (1, 2, "finished", None), (1, 3, "incomplete", 7)], "run int, seq int, status string, n int").withColumns({"s": F.lit(1), "f": F.lit(None).cast("int"), "c": F.lit("x")})
    a = merge.run_merge(df, ["run"], "seq", "status", ["c"], ["n"], "s", "f").first()
    b = merge.run_merge(df, ["run"], "seq", "status", ["c"], ["n"], "s", "f", regress=True).first()
    assert (a["status"], a["n"], b["status"]) == ("finished", 7, "incomplete")


def test_reconcile(spark):
    p = spark.createDataFrame([("a", "t", "active", None, 1, 5), ("b", "t", "active", None, 1, 5), ("c", "t", "deleted", 3, 1, 2), ("d", "t", "deleted", 3, 1, 2), ("e", "t", "active", None, 1, 5)], "id string, title string, lifecycle string, inactive_at int, first_seen_at int, last_seen_at int")
    c = spark.createDataFrame([("a", "t", 9), ("b", "new", 9), ("c", "t", 9), ("f", "t", 9)], "id string, title string, observed_at int")
    got = {r["id"]: (r["change"], r["lifecycle"], r["inactive_at"], r["last_seen_at"]) for r in reconcile.reconcile(p, c, ["id"], ["title"]).collect()}
    assert got == {"a": ("unchanged", "active", None, 9), "b": ("updated", "active", None, 9), "c": ("reactivated", "active", None, 9), "d": ("still_deleted", "deleted", 3, 2), "e": ("deleted", "deleted", 9, 5), "f": ("registered", "active", None, 9)}


def test_claims(spark):
    """Each state by hand: who owns, when it was claimed, submitted and finished, what an attempt leaves behind, and why a request was refused."""
    rows = [
        ("k", 1, "r1", "a", "acquire", 1, None, None, None), ("k", 2, "r2", "a", "acquire", 2, None, None, None), ("k", 3, "r2", "a", "SUBMITTING", 3, None, None, None), ("k", 4, "r1", "a", "FAILED_SAFE_TO_RETRY", 4, "OSError", "no space", '{"x":1}'),
        ("k", 5, "r1", "a", "SUBMITTED", 5, None, None, None), ("k", 6, "r2", " b ", "acquire", 6, None, None, None), ("u", 1, "r1", "a", "acquire", 1, None, None, None), ("u", 2, "r1", "a", "SUBMITTING", 2, None, None, '{"pre":0}'),
        ("u", 3, "r1", "a", "FAILED_SAFE_TO_RETRY", 3, None, None, None), ("u", 4, "r1", "a", "SUBMITTED", 4, None, None, '{"seen":1}'), ("u", 5, "r2", "a", "acquire", 5, None, None, None), ("x", 1, "r1", "a", "SUBMITTED", 1, None, None, None),
        ("x", 2, "r1", "", "acquire", 2, None, None, None), ("y", 1, "r1", "a", "acquire", 1, None, None, None), ("y", 2, "r1", "a", "CONFIRMED", 2, None, None, None), ("y", 3, "r1", "a", "UNCERTAIN", 3, "Timeout", "?", None), (None, 1, "r1", "a", "acquire", 1, None, None, None)]
    df = spark.createDataFrame(rows, "k string, seq long, run_id string, account_key string, kind string, s long, error_type string, error_message string, evidence string").withColumn("at", F.timestamp_seconds("s"))
    decided = state.decide_claims(df, ["k"]).cache()

    def sec(t):
        return t and t.second

    got = {r["k"]: (r["run_id"], r["account_key"], r["status"], r["attempt_count"], sec(r["claimed_at"]), sec(r["changed_at"]), sec(r["submitted_at"]), sec(r["finished_at"]), r["error_type"], r["evidence"], r["granted"], r["refused"]) for r in state.claims_after(decided, ["k"]).collect()}
    assert got == {
        "k": ("r2", "b", "CLAIMED", 2, 6, 6, None, None, None, "{}", 3, 3), "u": ("r1", "a", "SUBMITTED", 1, 1, 4, 4, 4, None, '{"seen":1}', 3, 2), "y": ("r1", "a", "UNCERTAIN", 1, 1, 3, None, 3, "Timeout", "{}", 2, 1)}
    assert {(r["k"], r["seq"], r["reason"], r["held_by"]) for r in state.refusals(decided, ["k"]).collect()} == {
        ("k", 2, "held", "r1"), ("k", 3, "other_owner", "r1"), ("k", 5, "not_from_FAILED_SAFE_TO_RETRY", "r1"), ("u", 3, "not_from_SUBMITTING", "r1"), ("u", 5, "held", "r1"), ("x", 1, "not_claimed", None), ("x", 2, "no_account", None), ("y", 2, "unknown_state", "r1")}
    assert state.fold_claims(df.limit(0), ["k"]).count() == 0


def test_cursor_wraps_and_resets(spark):
    rows = [(1, 1, "a", 5, 3), (1, 2, "a", 5, 3), (1, 3, "a", 5, 3), (1, 4, "b", 5, 3), (1, 5, "b", 4, 3)]
    df = spark.createDataFrame(rows, "p int, seq int, sig string, size int, win int")
    got = [(r["start_offset"], r["next_offset"], r["wrapped"]) for r in state.reserve_windows(df, ["p"], "seq", "sig", "size", "win").orderBy("seq").collect()]
    assert got == [(0, 3, False), (3, 1, True), (1, 4, False), (0, 3, False), (0, 3, False)]


def test_candidates(spark):
    rows = [(1, "v1", "q1", "i1"), (2, "v2", "q1", "i2"), (3, "v1", "q2", "i3"), (4, "v3", "q2", "i4")]
    df = spark.createDataFrame(rows, "pos int, v string, q string, item string")
    u = routing.union_candidates(df, ["v"], "pos", ["item"], {"queries": "q"})
    got = {r["v"]: (r["item"], r["queries"]) for r in u.collect()}
    assert got == {"v1": ("i1", ["q1", "q2"]), "v2": ("i2", ["q1"]), "v3": ("i4", ["q2"])}
    caps = routing.technical_caps(u.withColumn("run", F.lit(1)), ["run"], "first_pos", 2, 1)
    assert {r["v"]: r["status"] for r in caps.collect()} == {"v1": "attempted", "v2": "technical_limit", "v3": "beyond_unique"}


def test_quality(spark):
    df = spark.createDataFrame([(1, "ab"), (None, "ab"), (-1, None)], "n int, h string")
    v = {r["rule"]: r["violations"] for r in quality.violations(df, {"n": F.col("n") >= 0, "h": quality.hex64(F.col("h"))}).collect()}
    assert v == {"n": 2, "h": 3}
    assert quality.violations(df.limit(0), {"n": F.col("n") >= 0}).first()["violations"] == 0
    a, b = (quality.rowset_fingerprint(x, ["n", "h"]).first()["fingerprint"] for x in (df, df.orderBy(F.desc("n"))))
    assert a == b
