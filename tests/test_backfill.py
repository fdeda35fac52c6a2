"""The backfill from raw objects to current state: own small trees in the shape of the wire objects."""

import copy
import json

from pyspark.sql import functions as F

from jobmill.plans import backfill as B
from jobmill.sources import raw
from jobmill.streaming import materialise as M

DAY, BUCKET, PREFIX = "2026-08-30", "raw", "board"
OBSERVE, APPLY, SENT = ("00000000-0000-4000-8000-00000000000" + c for c in "123")


def batch(run_id):
    return f"batches/date={DAY}/run_id={run_id}"


def uri(key):
    return f"s3://{BUCKET}/{PREFIX}/{key}"


def posting(**over):
    return {"id": "v1", "name": "Engineer", "employer": {"id": "e1", "name": "Firm"}, "area": {"id": "1", "name": "Town"}, "alternate_url": "https://x/v1", "published_at": "2026-08-29T12:30:00+0300",
            "description": "<p>Python</p>", "salary": {"from": 10, "to": 15, "currency": "RUR"}, "schedule": {"id": "remote"}, "employment": {"id": "full"}, "relations": [], "has_test": False, "response_url": None, "extra": 1} | over


# Field names and literals of the wire objects in the trees below.
def observe_tree(run_id=OBSERVE):
    bindings = [{"source_resume_id": f"r{i}", "binding_key": f"b{i}", "target_key": f"t{i}", "binding_version": i, "query_sets": [f"s{i}"], "auto_apply": False} for i in (2, 1)]
    ids = {"run_id": run_id, "account_key": "acc"}
    rotation = {"query_catalog_size": 2, "query_catalog_signature": "c" * 64, "query_cursor_start": 0, "query_cursor_next": 0, "query_rotation_wrapped": True}
    run = ids | rotation | {
        "event_type": "board.batch.started", "schema_version": 3, "runtime_mode": "observe", "profile_id": "p", "enabled_resume_keys": ["b2", "b1"], "source_resume_ids": ["r2", "r1"], "target_keys": ["t2", "t1"], "active_bindings": bindings,
        "query_set_keys": ["s1", "s2"], "query_keys": ["q1", "q2"], "max_queries_per_run": 5, "discovery_config_version": 1, "area": 1, "period": 14, "pages": 3, "per_page": 100, "max_unique_vacancies_per_run": 250, "max_full_fetch_per_run": 100,
        "search_query_delay_seconds": 1.0, "full_fetch_min_delay_seconds": 1.5, "full_fetch_max_delay_seconds": 3.0, "started_at": f"{DAY}T08:00:00+00:00", "external_writes_allowed": False}
    summary = ids | rotation | {
        "event_type": "board.batch.finished", "schema_version": 3, "runtime_mode": "observe", "profile_id": "p", "queries_executed": 1, "queries_selected": 2, "search_observation_count": 1, "unique_vacancy_count": 1, "candidate_count": 1, "full_fetch_attempted": 1,
        "full_fetched": 1, "evaluation_candidate_count": 2, "submitted": 0, "confirmed": 0, "external_writes_attempted": 0, "failed": 0, "stopped_on_captcha": False, "reasons": {"fetched": 1}, "finished_at": f"{DAY}T08:05:00+00:00", "s3_prefix": batch(run_id)}
    at = f"{batch(run_id)}/candidates/vacancy_id=v1"
    work = [{
        "event_type": "board.vacancy_resume.evaluation_candidate", "schema_version": 1, "account_key": "acc", "source_profile": "p", "source_resume_id": b["source_resume_id"], "vacancy_id": "v1", "binding_key": b["binding_key"], "target_key": b["target_key"],
        "binding_version": b["binding_version"], "auto_apply": False, "duplicate_key": {"account_key": "acc", "source_profile": "p", "source_resume_id": b["source_resume_id"], "vacancy_id": "v1"}, "matched_query_keys": ["q1"], "matched_query_sets": ["s1"],
        "resume_query_sets": b["query_sets"], "full_fetch_status": "fetched", "evaluation_status": "pending_filtering_v2",
        "provenance_overlap": {"has_overlap": b["query_sets"] == ["s1"], "matched_query_keys": ["q1"] if b["query_sets"] == ["s1"] else [], "matched_query_sets": ["s1"] if b["query_sets"] == ["s1"] else []}} for b in bindings]
    seen = ids | {
        "event_type": "board.vacancy.observed", "schema_version": 3, "runtime_mode": "observe", "profile_id": "p", "vacancy_id": "v1", "candidate_resume_keys": ["b2", "b1"], "candidate_source_resume_ids": ["r2", "r1"], "candidate_target_keys": ["t2", "t1"],
        "candidate_bindings": [{k: b[k] for k in ("source_resume_id", "binding_key", "target_key", "binding_version", "auto_apply")} for b in bindings], "evaluation_candidate_count": 2, "evaluation_candidates_uri": uri(f"{at}/evaluation_candidates.json"),
        "matched_query_keys": ["q1"], "matched_query_sets": ["s1"], "query_page_uris": [], "search_item_uri": uri(f"{at}/search_item.json"), "vacancy_uri": uri(f"{at}/vacancy.json"), "full_fetch_status": "fetched", "observed_at": f"{DAY}T08:04:00+00:00"}
    envelope = ids | {"event_type": "board.vacancy_resume.evaluation_candidates", "schema_version": 1, "runtime_mode": "observe", "source_profile": "p", "vacancy_id": "v1", "evaluation_semantics": "routing_only_no_relevance_decision", "evaluations": work,
                      "created_at": f"{DAY}T08:04:00+00:00"}
    return {f"{batch(run_id)}/run.json": run, f"{batch(run_id)}/summary.json": summary, f"{at}/search_item.json": posting(), f"{at}/vacancy.json": posting(), f"{at}/observation.json": seen, f"{at}/evaluation_candidates.json": envelope}


def apply_tree():
    at, app = f"{batch(APPLY)}/candidates/vacancy_id=v1", f"applications/date={DAY}/run_id={SENT}/vacancy_id=v1"
    who = {"run_id": SENT, "profile_id": "p", "resume_id": "r1", "vacancy_id": "v1", "submission_mode": "api", "schema_version": 2, "extra": {"x": 1}}
    return {
        f"{batch(APPLY)}/run.json": {"event_type": "board.batch.started", "schema_version": 2, "run_id": APPLY, "profile_id": "p", "resume_id": "r1", "search": "x", "area": 1, "period": 14, "pages": 1, "per_page": 50, "professional_roles": [96, 165],
                                     "max_responses": 25, "cover_letter_mode": "m", "live": True, "started_at": f"{DAY}T10:00:00+03:00"},
        f"{batch(APPLY)}/summary.json": {"event_type": "board.batch.finished", "schema_version": 2, "run_id": APPLY, "live": True, "discovered": 1, "prefiltered": 0, "full_fetched": 1, "accepted": 1, "submitted": 1, "confirmed": 1, "failed": 0,
                                         "stopped_on_captcha": False, "reasons": {"accepted": 1}, "finished_at": f"{DAY}T10:05:00+03:00", "s3_prefix": batch(APPLY) + "/"},
        f"{at}/search_item.json": posting(), f"{at}/vacancy.json": posting(),
        f"{at}/decision.json": {"event_type": "board.vacancy.decision", "schema_version": 2, "stage": "full", "run_id": APPLY, "vacancy_id": "v1", "accepted": True, "reason": "accepted", "matched_domains": ["ml"], "blocked_terms": [],
                                "vacancy_title": "Engineer", "other": 1, "created_at": f"{DAY}T10:02:00+03:00"},
        f"{at}/outcome.json": {"event_type": "board.batch.application_completed", "schema_version": 2, "run_id": APPLY, "vacancy_id": "v1", "status": "submitted", "confirmed": True, "submission_mode": "api", "application_run_id": SENT,
                               "application_result_uri": uri(f"{app}/application_result.json"), "cover_letter_uri": uri(f"{at}/letter.json"), "created_at": f"{DAY}T10:04:00+03:00"},
        f"{app}/application_request.json": who | {"event_type": "board.application.requested", "requested_at": f"{DAY}T10:03:00+03:00"},
        f"{app}/application_result.json": who | {"event_type": "board.application.submitted", "status": "submitted", "confirmed": True, "relations": ["got_response"], "finished_at": f"{DAY}T10:03:05+03:00"},
        f"{app}/vacancy_before.json": posting(), f"{app}/vacancy_after.json": posting(relations=["got_response"]),
    }


def objects(spark, *trees):
    rows = [(k, bytearray(json.dumps(v).encode())) for t in trees for k, v in t.items()]
    o = spark.createDataFrame(rows, "key string, body binary").withColumns({"size_bytes": F.octet_length("body").cast("long"), "sha256": F.sha2("body", 256), "last_modified": F.lit(f"{DAY} 12:00:00").cast("timestamp")})
    return raw.classify(o)


def changed(tree, name, drop=(), **over):
    t = copy.deepcopy(tree)
    key = next(k for k in t if k.endswith(f"/{name}.json"))
    t[key] |= over
    for d in drop:
        del t[key][d]
    return t


def test_tree_to_current_state(spark, tmp_path):
    """From files through the stream to tables; twice the same; both kinds of run; a broken run adds nothing and stops no other."""
    third = json.loads(json.dumps(observe_tree()).replace(OBSERVE, OBSERVE[:-1] + "9"))
    bad = changed(third, "observation", candidate_target_keys=["t1", "t2"])
    for key, value in (observe_tree() | apply_tree() | bad).items():
        (tmp_path / "raw" / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw" / key).write_text(json.dumps(value))
    wanted = {"profiles": 1, "resumes": 2, "vacancies": 1, "runs": 2, "observations": 1, "work_items": 2, "decisions": 1, "applications": 1, "quarantine": 1, "run_log": 3}
    for _ in range(2):
        M.materialise(spark, str(tmp_path / "raw"), str(tmp_path / "cp"), 100, M.store_objects(str(tmp_path / "landed"))).awaitTermination()
        B.backfill(spark.read.parquet(str(tmp_path / "landed")), str(tmp_path / "out"), BUCKET, PREFIX)
        t = {n: spark.read.parquet(str(tmp_path / "out" / n)) for n in wanted}
        assert {n: d.count() for n, d in t.items()} == wanted
    assert t["quarantine"].first()["rule"] == "target_projection"
    assert {(r["run_id"], r["verdict"], r["candidates"], r["work_items"], r["decisions"], r["applications"]) for r in t["run_log"].collect()} == {
        (OBSERVE, "loaded", 1, 2, 0, 0), (APPLY, "loaded", 1, 0, 1, 1), (OBSERVE[:-1] + "9", "failed", 0, 0, 0, 0)}
    v, a, d = t["vacancies"].first(), t["applications"].first(), t["decisions"].first()
    assert (v["source_entity_id"], v["title"], v["company_id"], v["remote"], v["salary_to"], v["flags"]["has_test"]) == ("v1", "Engineer", "e1", True, 15, False)
    assert (a["resume_id"], a["status"], a["after_uri"]) == ("r1", "submitted", uri(f"applications/date={DAY}/run_id={SENT}/vacancy_id=v1/vacancy_after.json")) and a["upstream"]["relations"] == ["got_response"]
    assert d["metadata"] == {"vacancy_title": "Engineer"} and {(r["run_id"], r["status"], r["professional_roles"] and tuple(r["professional_roles"])) for r in t["runs"].collect()} == {(OBSERVE, "finished", None), (APPLY, "finished", ("96", "165"))}
    assert {(r["resume_id"], r["overlap"]["has_overlap"]) for r in t["work_items"].collect()} == {("r1", True), ("r2", False)}


OBSERVE_FAULTS = [
    ("observation", {"account_key": "other"}, "observation_identity"), ("observation", {"candidate_resume_keys": ["b1", "b2"]}, "binding_projection"), ("observation", {"search_item_uri": uri("elsewhere.json")}, "search_item_uri_mismatch"),
    ("observation", {"vacancy_id": "v2"}, "path_vacancy_id"), ("observation", {"matched_query_keys": ["q2"]}, "provenance"), ("observation", {"full_fetch_status": "failed"}, "fan_out"), ("vacancy", {"id": "v2"}, "path_vacancy_id"),
    ("vacancy", {"employer": None}, "posting_incomplete"), ("summary", {"candidate_count": 2}, "candidate_count"), ("summary", {"evaluation_candidate_count": 1}, "work_item_total"), ("summary", {"queries_selected": 1}, "rotation"),
    ("summary", {"s3_prefix": "elsewhere"}, "prefix"), ("summary", {"finished_at": f"{DAY}T07:00:00+00:00"}, "finished_before_start"), ("run", {"started_at": "2026-08-29T08:00:00+00:00"}, "path_date"), ("run", {"schema_version": 4}, "unknown_version"),
    ("evaluation_candidates", {"source_profile": "q"}, "work_items_identity"), ("evaluation_candidates", {"schema_version": 3}, "version"),
]
APPLY_FAULTS = [
    ("outcome", {"confirmed": False}, "status"), ("outcome", {"submission_mode": "form"}, "mode"), ("outcome", {"application_run_id": None}, "proof_missing"), ("outcome", {"application_result_uri": uri("x.json")}, "result_uri"),
    ("outcome", {"cover_letter_uri": "s3://foreign/x"}, "cover_letter_uri"), ("application_request", {"resume_id": "r2"}, "profile_or_resume"), ("application_request", {"requested_at": f"{DAY}T11:00:00+03:00"}, "times_reversed"),
    ("vacancy_before", {"id": "v2"}, "before"), ("vacancy_after", {"id": "v2"}, "after"), ("run", {"account_key": "acc"}, "account"), ("summary", {"live": False}, "live"), ("decision", {"run_id": OBSERVE}, "path_run_id"),
]


def test_rules(spark):
    """Each fault in a run of its own: its rule fires for that run; sound runs between them have none."""
    trees, wanted = [], {}
    for i, (faults, tree) in enumerate(((OBSERVE_FAULTS, observe_tree()), (APPLY_FAULTS, apply_tree()))):
        for n, (name, over, rule) in enumerate([*faults, ("summary", {}, None)]):
            text, own = json.dumps(changed(tree, name, **over)), f"00000000-0000-4000-801{i}-{n:012d}"
            trees.append(json.loads(text.replace(OBSERVE if i == 0 else APPLY, own).replace(SENT, own.replace("-4000-", "-4001-"))))
            wanted[own] = rule
    got = {}
    for r in B.parse(objects(spark, *trees), BUCKET, PREFIX)[1].collect():
        got.setdefault(r["run_id"], set()).add(r["rule"])
    assert {k: v for k, v in wanted.items() if v not in got.get(k, {None})} == {}
    assert not any(k in got for k, v in wanted.items() if v is None)


def test_odd_trees(spark):
    """A failed outcome is no application; without the snapshot after, its error must say so; no sidecar, no header, no tree."""
    own = [f"00000000-0000-4000-8002-{n:012d}" for n in range(5)]
    no_after = {k: v for k, v in apply_tree().items() if "vacancy_after" not in k}
    trees = [changed(apply_tree(), "outcome", event_type="board.batch.application_failed", application_run_id=None, status="failed"), no_after, changed(no_after, "application_result", confirmation_error={"stage": "vacancy_after"}),
             {k: v for k, v in observe_tree().items() if "observation" not in k}, {k: v for k, v in observe_tree().items() if not k.endswith("run.json")}]
    trees = [json.loads(json.dumps(t).replace(OBSERVE, i).replace(APPLY, i).replace(SENT, i.replace("-4000-", "-4001-"))) for t, i in zip(trees, own, strict=True)]
    o = objects(spark, *trees)
    parts, bad = B.parse(o, BUCKET, PREFIX)
    rows = bad.collect()
    assert {(r["run_id"], r["rule"]) for r in rows} == {(own[1], "after"), (own[3], "observation_missing"), (own[3], "work_item_total")}
    bad = spark.createDataFrame(rows, B.RULE)
    assert [r["batch_run_id"] for r in B.current_state(parts, bad, uri(""))["applications"].collect()] == [own[2]]
    assert {r["run_id"]: r["verdict"] for r in B.run_log(o, parts, bad).collect()} == dict(zip(own, ["loaded", "failed", "loaded", "failed", "no_header"], strict=True))


def test_empty_tree(spark):
    o = objects(spark, observe_tree()).limit(0)
    assert B.parse(o, BUCKET, PREFIX)[1].count() == 0
