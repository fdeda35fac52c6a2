"""New runs merged into stored state: only they and touched buckets are read, loads change all or nothing, replays change no byte."""

import hashlib
import json
import shutil
from pathlib import Path

import pytest

from jobmill.plans import backfill as B
from jobmill.streaming import materialise as M
from jobmill.streaming import state_tables as S
from tests.test_backfill import BUCKET, OBSERVE, PREFIX, apply_tree, changed, objects, observe_tree

#: Rows whose order of loading decides: first a full posting, then newer and older ones, partial ones too.
RUNS = [OBSERVE[:-1] + c for c in "3456"]


def tree(run_id, vacancy="v1", minute=4, **over):
    """A sound run that saw one posting."""
    t = json.loads(json.dumps(observe_tree()).replace(OBSERVE, run_id).replace('"v1"', f'"{vacancy}"').replace("vacancy_id=v1", f"vacancy_id={vacancy}").replace("T08:04:00", f"T08:{minute:02d}:00"))
    for k in t:
        if k.endswith(("vacancy.json", "search_item.json")):
            t[k] |= over
    return t


def put(spark, landed, batch, *trees):
    S.land(str(landed))(objects(spark, *trees), batch)


def content(spark, tables, name):
    df = tables.read(name)
    return sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.select(*sorted(df.columns)).collect())


def files(root):
    return {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(Path(root).rglob("*")) if p.is_file() and "_staged" not in p.parts}


def test_loads_only_what_is_new(spark, tmp_path):
    landed, root = tmp_path / "landed", tmp_path / "state"
    tables = S.StateTables(spark, str(root), buckets=16)
    with pytest.raises(ValueError):
        S.load_pending(tables, str(landed), BUCKET, PREFIX, limit=0)
    put(spark, landed, 0, tree(RUNS[0], "v1", description="<p>first</p>"), tree(RUNS[1], "v2"), apply_tree(), {k: v for k, v in tree(RUNS[3], "v9").items() if "summary" not in k})
    one = S.load_pending(tables, str(landed), BUCKET, PREFIX, limit=2)
    assert (one.discovered, one.eligible, one.pending, one.selected, one.loaded, one.failed, one.version) == (4, 2, 2, RUNS[:2], RUNS[:2], [], 1)
    assert [p.split("_run=")[1] for p in one.read] == RUNS[:2]
    before, m = files(root), tables.manifest()
    # nothing pending: no byte changes
    assert S.load_pending(tables, str(landed), BUCKET, PREFIX).version is None and files(root) == before

    # the objects of loaded runs are gone, buckets without new rows can't be read: the next load needs neither
    for r in RUNS[:2]:
        shutil.rmtree(landed / "objects" / "batch=0" / f"_run={r}")
    third = tree(RUNS[2], "v1", minute=3, name="Newer title", description="<p>third</p>", salary=None)
    put(spark, landed, 1, third)
    touched = {r["b"] for r in spark.sql(f"select pmod(xxhash64('board', 'v1'), 16) as b").collect()}
    kept = {b: p for b, p in m["tables"]["vacancies"]["folders"].items() if int(b) not in touched}
    assert kept
    hidden = {p: [f for f in (root / p).iterdir() if f.suffix == ".parquet"] for p in kept.values()}
    for fs in hidden.values():
        for f in fs:
            f.rename(f.with_suffix(".hidden"))
    three = S.load_pending(tables, str(landed), BUCKET, PREFIX)
    for fs in hidden.values():
        for f in fs:
            f.with_suffix(".hidden").rename(f)
    assert three.loaded == [RUNS[2]] and [p.split("objects/")[1] for p in three.read] == [f"batch=1/_run={RUNS[2]}"] and set(three.rewritten["vacancies"]) == touched
    now = tables.manifest()["tables"]["vacancies"]["folders"]
    assert {b: now[b] for b in kept} == kept
    v = {r["source_entity_id"]: r for r in tables.read("vacancies").collect()}
    assert set(v) == {"v1", "v2"} and v["v1"]["title"] == "Newer title" and v["v1"]["description"] == "third"
    assert {r["run_id"]: r["status"] for r in tables.read("runs").collect()} == dict.fromkeys(RUNS[:3], "finished")
    assert {r["resume_id"] for r in tables.read("resumes").collect()} == {"r1", "r2"} and tables.read("work_items").count() == 6
    assert tables.vacuum() > 0
    # the same as one backfill of the whole tree
    whole = [tree(RUNS[0], "v1", description="<p>first</p>"), tree(RUNS[1], "v2"), third]
    parts, bad = B.store_parts(*B.parse(objects(spark, *whole), BUCKET, PREFIX, (3,)), str(tmp_path / "parts"))
    for name, df in B.current_state(parts, bad, f"s3://{BUCKET}/{PREFIX}").items():
        assert content(spark, tables, name) == sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.select(*sorted(df.columns)).collect()), name


def test_crash_and_broken_run(spark, tmp_path, monkeypatch):
    """A load that dies between tables, or before its manifest, leaves the state before; a broken run is rolled back alone and loads once mended."""
    landed, tables = tmp_path / "landed", S.StateTables(spark, str(tmp_path / "state"), buckets=4)
    put(spark, landed, 0, tree(RUNS[0], "v1"))
    S.load_pending(tables, str(landed), BUCKET, PREFIX)
    before = {n: content(spark, tables, n) for n in ("vacancies", "runs", "work_items")}
    bad = changed(tree(RUNS[1], "v2"), "observation", candidate_target_keys=["t1", "t2"])
    put(spark, landed, 1, bad, tree(RUNS[2], "v3"))
    whole, calls = S.StateTables.rewrite, []

    def dies(self, manifest, name, *rest):
        calls.append(name)
        if len(calls) == 3:
            raise OSError("lost")
        return whole(self, manifest, name, *rest)

    with monkeypatch.context() as p:
        p.setattr(S.StateTables, "rewrite", dies)
        with pytest.raises(OSError):
            S.load_pending(tables, str(landed), BUCKET, PREFIX)
    assert {n: content(spark, tables, n) for n in before} == before and tables.manifest()["version"] == 1
    got = S.load_pending(tables, str(landed), BUCKET, PREFIX)
    assert (got.loaded, got.failed, got.version) == ([RUNS[2]], [RUNS[1]], 2)
    assert {r["source_entity_id"] for r in tables.read("vacancies").collect()} == {"v1", "v3"}
    assert [(r["run_id"], r["rule"]) for r in tables.read("quarantine").collect()] == [(RUNS[1], "target_projection")]
    # another writer was faster
    stale = tables.manifest() | {"version": 2}
    with pytest.raises(RuntimeError):
        tables.commit(stale)


def test_sink_over_a_stream(spark, tmp_path):
    """Files arrive in two rounds; a run whose summary comes late loads then, with the candidates that came before."""
    raw, landed, tables = tmp_path / "raw", tmp_path / "landed", S.StateTables(spark, str(tmp_path / "state"), buckets=4)

    def arrive(t, late):
        for k, v in t.items():
            if k.endswith("summary.json") == late:
                (raw / k).parent.mkdir(parents=True, exist_ok=True)
                (raw / k).write_text(json.dumps(v))

    def run():
        seen = []
        M.materialise(spark, str(raw), str(tmp_path / "cp"), 100, S.merging_sink(tables, str(landed), BUCKET, PREFIX, seen=seen)).awaitTermination()
        return [r for x in seen for r in x.loaded]

    arrive(tree(RUNS[0], "v1"), False)
    arrive(tree(RUNS[1], "v2"), False)
    arrive(tree(RUNS[1], "v2"), True)
    assert run() == [RUNS[1]]
    arrive(tree(RUNS[0], "v1"), True)
    assert run() == [RUNS[0]] and run() == []
    assert {r["source_entity_id"] for r in tables.read("vacancies").collect()} == {"v1", "v2"}
