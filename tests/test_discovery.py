"""Pages to candidates with lineage, and audits of reconciliation: own small trees, a fault at a time."""

import copy
import json

from jobmill.plans import discovery as D
from jobmill.sources import raw
from tests.test_backfill import BUCKET, DAY, OBSERVE, PREFIX, batch, objects, uri

SHA = "a" * 64


def page_key(query, page):
    return f"{batch(OBSERVE)}/discovery/queries/query={query}/page={page:03d}.json"


# Field names and literals of the wire objects.
def tree():
    pages = {("q2", 0): {"items": [{"id": " v1 ", "n": 1}, {"id": "v2"}, "text", {"name": "no id"}, {"id": ""}, None]}, ("q2", 1): {"items": [{"id": "v1", "n": 2}]}, ("q1", 0): {"items": [{"id": 3}, {"id": "v1", "n": 3}]}, ("q1", 1): {"found": 0}, ("q3", 0): {"items": {"id": "x"}}}
    sets = {"q1": "s1", "q2": "s2", "q3": "s1"}

    def seen(vacancy, *places):
        return {"vacancy_id": vacancy, "matched_query_keys": list(dict.fromkeys(q for q, _ in places)), "matched_query_sets": list(dict.fromkeys(sets[q] for q, _ in places)), "query_page_uris": [uri(page_key(*p)) for p in places]}

    found = {
        "event_type": "board.batch.discovery", "schema_version": 3, "run_id": OBSERVE, "account_key": "acc", "queries_executed": 3, "max_queries_per_run": 5, "query_catalog_size": 3, "query_catalog_signature": SHA, "query_cursor_start": 0, "query_cursor_next": 0,
        "query_rotation_wrapped": True, "query_sets": ["s2", "s1"], "query_pages": [{"query_key": q, "query_set": sets[q], "page": n, "uri": uri(page_key(q, n))} for q, n in pages],
        "query_errors": [{"query_key": "q3", "error_type": "InvalidSearchPayload", "error": "x", "reason": "invalid_search_payload"}], "search_observation_count": 5, "unique_vacancy_count": 3, "selected_candidate_count": 2, "truncated_by_max_unique": True,
        "vacancies": [seen("v1", ("q2", 0), ("q2", 1), ("q1", 0)), seen("v2", ("q2", 0)), seen("3", ("q1", 0))], "created_at": f"{DAY}T08:01:00+00:00"}
    return {page_key(q, n): v for (q, n), v in pages.items()} | {f"{batch(OBSERVE)}/discovery.json": found}


def rules(spark, t, observed=None):
    return {r["rule"] for r in D.lineage_violations(objects(spark, t), BUCKET, PREFIX, observed).collect()}


def test_candidates_and_lineage(spark):
    o = objects(spark, tree())
    pages, items = D.page_rows(o)
    assert {(r["query_key"], r["page"]): r["error"] for r in pages.collect()} == {("q2", 0): None, ("q2", 1): None, ("q1", 0): None, ("q1", 1): None, ("q3", 0): "invalid_search_payload"}
    c = {r["vacancy_id"]: r for r in D.candidates(items, D.discoveries(o)[1]).collect()}
    assert set(c) == {"v1", "v2", "3"} and json.loads(c["v1"]["item"])["n"] == 1 and c["v1"]["observations"] == 3
    assert c["v1"]["query_keys"] == ["q2", "q1"] and c["v1"]["query_sets"] == ["s2", "s1"] and c["v1"]["page_keys"] == [page_key("q2", 0), page_key("q2", 1), page_key("q1", 0)]
    seen = spark.createDataFrame([(OBSERVE, "v2", "k", (["q2"], ["s2"], [uri(page_key("q2", 0))])), (OBSERVE, "3", "k3", (["q2"], ["s1"], []))], "run_id string, vacancy_id string, key string, o struct<matched_query_keys:array<string>,matched_query_sets:array<string>,query_page_uris:array<string>>")
    assert rules(spark, tree()) == set() and rules(spark, tree(), seen.filter("key = 'k'")) == set() and rules(spark, tree(), seen) == {"observation_lineage"}


def test_faults(spark):
    """Each fault in a run of its own, checked at once: its rule fires there, and a sound run has none."""
    good = tree()[f"{batch(OBSERVE)}/discovery.json"]
    swapped = [good["vacancies"][1], good["vacancies"][0], good["vacancies"][2]]
    lineage = copy.deepcopy(good["vacancies"])
    lineage[0]["matched_query_keys"] = ["q1", "q2"]
    faults = [({"search_observation_count": 4}, "counts"), ({"vacancies": swapped}, "vacancies"), ({"vacancies": lineage}, "lineage"), ({"query_errors": []}, "page_error"), ({"schema_version": 2}, "version"), ({}, "page_uri"), ({}, None)]
    trees, wanted = [], {}
    for n, (over, rule) in enumerate(faults):
        t, own = copy.deepcopy(tree()), f"00000000-0000-4000-8030-{n:012d}"
        t[f"{batch(OBSERVE)}/discovery.json"] |= over
        if rule == "page_uri":
            del t[page_key("q1", 1)]
        trees.append(json.loads(json.dumps(t).replace(OBSERVE, own)))
        wanted[own] = rule
    got = {}
    for r in D.lineage_violations(objects(spark, *trees), BUCKET, PREFIX).collect():
        got.setdefault(r["run_id"], set()).add(r["rule"])
    assert all(rule in got.get(run, {None}) for run, rule in wanted.items()) and got["00000000-0000-4000-8030-000000000005"] == {"page_uri"}


def test_reconciliations(spark):
    def resume(i, lifecycle="active", on=False):
        return {"source_resume_id": i, "current_title": "t", "upstream_status": "published", "lifecycle": lifecycle, "content_sha256": SHA, "binding_key": None, "binding_enabled": on, "target_key": None, "query_sets": [], "auto_apply": False,
                "selectable_for_evaluation": False, "selectable_for_auto_apply": False, "binding_version": 1}

    audit = {"event_type": "board.account.resumes.reconciled", "schema_version": 1, "account_key": "acc", "source_profile": "p", "reconciled_at": f"{DAY}T08:00:00+00:00", "registered_ids": ["r1", "r2"], "updated_ids": [], "reactivated_ids": [], "deleted_ids": ["r3"],
             "resumes": [resume("r1", on=True), resume("r2"), resume("r3", "deleted")]}
    key = f"{batch(OBSERVE)}/resume_reconciliation.json"
    changes, inventories, bad = D.reconciliations(objects(spark, {key: audit}))
    assert {(r["resume_id"], r["change"]) for r in changes.collect()} == {("r1", "registered"), ("r2", "registered"), ("r3", "deleted")} and bad.count() == 0
    assert {(r["source_resume_id"], r["lifecycle"], r["binding_enabled"]) for r in inventories.collect()} == {("r1", "active", True), ("r2", "active", False), ("r3", "deleted", False)}
    faults = [({"deleted_ids": ["r1"]}, "deleted_gone"), ({"registered_ids": ["r2", "r1"]}, "ids_sorted"), ({"updated_ids": ["r9"]}, "ids_known"), ({"resumes": [resume("r1"), resume("r2"), resume("r3", "deleted", True)]}, "gone_not_selectable"), ({"reconciled_at": "2026-08-30T08:00:00"}, "reconciled_zoned")]
    trees = [{key.replace(OBSERVE, f"run{n}"): audit | over} for n, (over, _) in enumerate(faults)]
    changes, _, bad = D.reconciliations(objects(spark, *trees))
    found = {(r["run_id"], r["rule"]) for r in bad.collect()}
    assert {(f"run{n}", rule) for n, (_, rule) in enumerate(faults)} <= found and changes.count() == 0
    none = raw.classify(spark.createDataFrame([], raw.OBJECTS))
    assert [d.count() for d in D.reconciliations(none)] == [0, 0, 0] and D.page_rows(none)[1].count() == 0
