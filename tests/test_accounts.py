"""Accounts, inventories, mapping, ad-hoc SQL."""

from pyspark.sql import functions as F

from jobmill.operators import accounts, mapping, reconcile, report
from jobmill.plans.adhoc import export_csv, preview, run_sql


def test_account_facts(spark):
    a = spark.createDataFrame([("x", True, 2, 5, 10), ("y", True, 1, 5, 10), ("z", False, 9, 9, 1)], "account_key string, enabled boolean, apply_runs_per_day int, max_apply_per_run int, apply_daily_cap int")
    b = spark.createDataFrame([("x", 2, True, ["b", "a"]), ("x", 1, True, ["a", "c"]), ("x", 3, False, ["d"])], "account_key string, binding_pos int, enabled boolean, query_sets array<string>")
    got = {r["account_key"]: (r["query_sets"], r["cap_reachable"]) for r in accounts.account_facts(a, b).collect()}
    assert got == {"x": (["a", "c", "b"], True), "y": ([], False)}


def test_queues(spark):
    n = spark.createDataFrame([("n1", "r", "2024-01-09", "invitation", 1), ("n2", None, "2024-01-09", "invitation", 1), ("n3", "r", "2023-01-01", "invitation", 1), ("n4", "r", "2024-01-09", "discard", 1), ("n5", "r", "2024-01-09", "response", 1), ("n6", "r", "2024-01-09", "invitation", 2)],
                              "id string, resume_id string, updated_at string, state string, employer_id int").withColumn("updated_at", F.to_timestamp("updated_at"))
    black = spark.createDataFrame([(2,)], "employer_id int")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    assert {r["id"] for r in accounts.reply_queue(n, black, now, 5, True).collect()} == {"n1"}
    assert {r["id"] for r in accounts.reply_queue(n, black, now, 5, False).collect()} == {"n1", "n5"}
    stay, gone = accounts.purge_skipped(spark.createDataFrame([("a",), ("b",), (None,)], "reason string"), "a")
    assert stay.count() == 2 and gone.first()["purged"] == 1


def test_bindings_by_identifier(spark):
    inv = spark.createDataFrame([("r1", "old"), ("r2", "kept")], "source_resume_id string, target_key string")
    b = spark.createDataFrame([("r1", "new", True)], "source_resume_id string, target_key string, enabled boolean")
    got = {r["source_resume_id"]: (r["target_key"], r["enabled"]) for r in reconcile.attach_bindings(inv, b, "source_resume_id", ["target_key"]).collect()}
    assert got == {"r1": ("new", True), "r2": ("kept", False)}
    items = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("c", None)], "account string, id string")
    assert {r["account"]: r["sound"] for r in reconcile.sound_snapshot(items, ["account"], "id").collect()} == {"a": False, "b": True, "c": False}


def test_canonical_posting(spark):
    schema = "v struct<id:string,name:string,employer:struct<id:string,name:string>,description:string,salary:struct<from:double,to:double,currency:string>,salary_range:struct<from:double,to:double,currency:string>,schedule:struct<id:string>,work_format:array<struct<id:string>>,employment:struct<id:string>,employment_form:struct<id:string>,published_at:string,has_test:boolean>"
    rows = [((" 1 ", "ML", ("e", "Acme"), "<p>Hi</p> there", None, (10.5, None, "RUR"), ("x",), [("REMOTE",)], None, ("full",), "2024-01-01T00:00:00+0300", None),), (("2", "ML", (None, " "), None, (1.0, 2.0, "USD"), None, ("Remote",), None, (" ",), None, "2024-01-01T00:00:00", True),)]
    df = spark.createDataFrame(rows, schema)
    a, b = mapping.canonical_posting(df, "v").orderBy("source_entity_id").collect()
    assert (a["source_entity_id"], a["company_name"], a["description"], float(a["salary_from"]), a["salary_currency"], a["remote"], a["employment_type"], str(a["published_at"]), a["valid"]) == ("1", "Acme", "Hi\nthere", 10.5, "RUR", True, "full", "2023-12-31 21:00:00", True)
    assert (b["company_name"], float(b["salary_to"]), b["remote"], b["employment_type"], b["published_at"], b["valid"], b["area_name"]) == (None, 2.0, True, None, None, False, None)
    flags = df.select(mapping.operational_flags(df, "v").alias("f")).collect()
    assert flags[0]["f"]["has_test"] is False and flags[1]["f"]["has_test"] is True and flags[0]["f"]["relations"] == []
    m = mapping.mapped(spark.createDataFrame([(("7", "x"),), (("q", None),)], "p struct<a:string,b:string>"), {"a": ("a", "int", 0), "b": ("b", "string", "none"), "c": ("c.d", "string", None)}, "p").collect()
    assert [(r["a"], r["b"], r["c"], r["cast_failures"]) for r in m] == [(7, "x", None, 0), (0, "none", None, 1)] and m[1]["uncast"] == {"a": "q"}


def test_adhoc(spark, tmp_path):
    df = run_sql(spark, {"t_adhoc": spark.range(20)}, "select id * 2 as x from t_adhoc order by id")
    rows, more = preview(df)
    assert [r["x"] for r in rows] == list(range(0, 20, 2)) and more
    export_csv(df.limit(3), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


def test_client_tables(spark):
    from jobmill.plans import client_tables as C

    schema = "v struct<id:string,name:string,salary:struct<from:int,to:int,currency:string>,contacts:struct<email:string,name:string,phones:array<struct<number:string,formatted:string>>>,employer:struct<id:string>>"
    df = spark.createDataFrame([(("1", "p", (None, 5, None), ("a@b.c", None, [("1", "+1"), (None, "x"), ("2", "+2")]), ("7",)),), (("2", "q", None, None, None),)], schema)
    r = C.contact_rows(df, "v").collect()
    assert len(r) == 1 and (r[0]["vacancy_salary_from"], r[0]["vacancy_salary_to"], r[0]["vacancy_currency"], r[0]["phone_numbers"], r[0]["employer_id"]) == (5, 5, "RUR", "+1, +2", 7)
    n = spark.createDataFrame([((3, ("invitation",), (8, (9,)), ("r",), "2024-01-01T00:00:00+0000"),)], "v struct<id:int,state:struct<id:string>,vacancy:struct<id:int,employer:struct<id:int>>,resume:struct<id:string>,created_at:string>")
    m = mapping.mapped(n, C.NEGOTIATION, "v").first()
    assert (m["state"], m["vacancy_id"], m["employer_id"], m["resume_id"], str(m["created_at"]), m["chat_id"]) == ("invitation", 8, 9, "r", "2024-01-01 00:00:00", None)
    assert spark.range(1).select(C.coded(F.lit(" Полный День "), "schedule").alias("c")).first()["c"] == "fullDay"


def test_pending_runs(spark):
    from jobmill.sources import raw

    runs = spark.createDataFrame([("a", "2024-01-02", True, False), ("b", "2024-01-01", True, False), ("c", "2024-01-01", False, False), ("d", "2024-01-01", True, False)], "run_id string, date string, has_summary boolean, clash boolean")
    heads = spark.createDataFrame([(r, "run_started", 3, "observe") for r in "abc"] + [("d", "run_started", 2, "observe")], "run_id string, event_type string, schema_version int, runtime_mode string")
    loaded = spark.createDataFrame([("b", "finished"), ("a", "incomplete")], "run_id string, status string")
    assert [r["run_id"] for r in raw.pending_runs(raw.eligible_runs(runs, heads), loaded).collect()] == ["a"]


def test_without_nulls(spark):
    df = spark.createDataFrame([(([1, None, 2], {"a": None, "b": [(None, "x")]}, None),)], "v struct<l:array<int>,m:map<string,array<struct<p:int,q:string>>>,n:string>")
    assert df.select(mapping.without_nulls(df, "v").alias("j")).first()["j"] == '{"l":[1,2],"m":{"b":[{"q":"x"}]}}'
