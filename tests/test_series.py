"""Long sequences against plain Python: logs, snapshot series, hot keys, nested texts, fingerprints, fan-out counts."""

import json
import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from jobmill.functions import text as T
from jobmill.operators import merge, quality, reconcile, report, routing


def tracebacks_by_hand(lines, after, last):
    out, time, open_, prev = deque(maxlen=last), None, False, (None, None)
    for pos, text in lines:
        if m := re.match(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", text):
            time, open_ = m.group(), False
        if text.startswith("Traceback (most recent call last):") and time and time >= after:
            out.append((0, *prev))
            open_ = True
        if open_:
            out.append((1, pos, text))
        prev = (pos, text)
    return list(out)


@pytest.mark.parametrize("span", [3, 1 << 16])
def test_log_tracebacks(spark, span):
    r = random.Random(span)
    logs, want = [], {}
    for log in range(6):
        day = 1
        lines = []
        for pos in range(log * 60):
            day += r.random() < 0.3
            lines.append((pos * 2, r.choice(["Traceback (most recent call last):", "  File x", "ValueError: y", "", f"2024-01-{min(day, 28):02d} 00:00:00 - INFO", "After Traceback (most recent call last):"])))
        logs += [(log, *x) for x in lines]
        want[log] = tracebacks_by_hand(lines, "2024-01-05 00:00:00", 40)
    df = spark.createDataFrame(logs, "log int, pos long, line string")
    got = {}
    for x in report.traceback_lines(df, ["log"], "pos", "line", "2024-01-05 00:00:00", last=40, span=span).orderBy("head_or_line", "place").collect():
        got.setdefault(x["log"], []).append((x["place"], x["pos"], x["line"]))
    assert got == {k: v for k, v in want.items() if v} and len(got) > 3


def find(data, key):
    if isinstance(data, dict):
        if key in data:
            return data[key]
        data = list(data.values())
    for x in data if isinstance(data, list) else []:
        if (found := find(x, key)) is not None:
            return found
    return None


def test_first_of_key(spark):
    r = random.Random(8)

    def value(depth):
        kind = r.random()
        if depth and kind < 0.4:
            return {r.choice(["k", "a", "b", "c", "x:k", 'q"k', "К"]): value(depth - 1) for _ in range(r.randint(0, 4))}
        if depth and kind < 0.7:
            return [value(depth - 1) for _ in range(r.randint(0, 3))]
        return r.choice([None, 0, 1.5, True, "k", 'a "quoted" {text}: [x]', "", "é\\"])

    rows = [(i, json.dumps(value(5), ensure_ascii=i % 2 == 0)) for i in range(400)] + [(1000, "no json {"), (1001, None), (1002, '{"k": 1, "k": 2}'), (1003, '{"\\u006b": 7}'), (1004, '"k"'), (1005, '{"a": ' * 60 + '{"k": "deep"}' + "}" * 60)]
    rows.append((1006, json.dumps({"a": "x" * 200_000, "b": [{"k": ["y" * 100_000]}]})))
    got = {x["i"]: x["v"] for x in spark.createDataFrame(rows, "i int, j string").select("i", T.first_of_key(F.col("j"), "k").alias("v")).collect()}
    for i, j in rows:
        try:
            want = find(json.loads(j), "k") if j else None
        except ValueError:
            want = None
        if want is None or isinstance(want, str):
            assert got[i] == want, (j, got[i])
        else:
            assert json.loads(got[i]) == want, (j, got[i])


def chosen_by_hand(text, pick):
    while (new := re.sub(r"{([^{}]+)}", lambda m: pick(m.group(1)), text)) != text:
        text = new
    return text


def test_choice_text(spark):
    """Groups of equal alternatives leave no choice, so the regular expression of the rule is the brute force; a thousand nested groups."""
    r = random.Random(1)

    def made(depth):
        return "".join(r.choice(["x", "|", "{", "}", "{}", "{y|y}", "{" + made(depth - 1) + "}" if depth else "z"]) for _ in range(r.randint(0, 5)))

    texts = [made(4) for _ in range(300)] + ["{" * 1000 + "end" + "}" * 1000, "{a{}b}", "}{", "", "{{a}"]
    texts = [t for t in texts if "|" not in t.replace("{y|y}", "")]
    got = [x["c"] for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.choice_text(F.col("t"), F.lit("s")).alias("c")).collect()]
    assert got == [chosen_by_hand(t, lambda g: g.split("|")[0]) for t in texts]
    one = spark.createDataFrame([(str(i),) for i in range(60)], "s string").select(T.choice_text(F.lit("{a|{b|c}} {d|e}"), F.col("s")).alias("c")).collect()
    assert {x["c"] for x in one} == {f"{a} {d}" for a in "abc" for d in "de"}


def test_series_equals_repeated_reconcile(spark):
    r = random.Random(12)
    snapshots, sightings = [], []
    for account in range(3):
        for at in range(1, 8):
            sound = r.random() < 0.75
            snapshots.append((account, at, sound))
            sightings += [(account, f"i{i}", at, r.choice("xy")) for i in range(8) if r.random() < 0.55]
    got = reconcile.lifecycle_events(spark.createDataFrame(snapshots, "account int, observed_at int, sound boolean"), spark.createDataFrame(sightings, "account int, item string, observed_at int, title string"), ["account"], "item", ["title"]).cache()
    inventory, want, audit = {}, set(), set()
    for account, at, sound in sorted(snapshots, key=lambda s: s[1]):
        if not sound:
            continue
        now = {(account, i): v for a, i, t, v in sightings if (a, t) == (account, at)}
        lists = {"registered": [], "updated": [], "reactivated": [], "deleted": []}
        for k in {*now, *(k for k in inventory if k[0] == account)}:
            old = inventory.get(k)
            if k in now:
                change = "registered" if old is None else "reactivated" if old["lifecycle"] == "deleted" else "unchanged" if old["title"] == now[k] else "updated"
                inventory[k] = {"lifecycle": "active", "inactive_at": None, "first": old["first"] if old else at, "last": at, "title": now[k]}
            elif old["lifecycle"] == "active":
                change = "deleted"
                old |= {"lifecycle": "deleted", "inactive_at": at}
            else:
                continue
            want.add((*k, at, change, inventory[k]["title"]))
            if change in lists:
                lists[change].append(k[1])
        if any(lists.values()):
            audit.add((account, at, *(tuple(sorted(v)) for v in lists.values())))
    assert {tuple(x) for x in got.collect()} == want
    state = {(x["account"], x["item"]): (x["lifecycle"], x["inactive_at"], x["first_seen_at"], x["last_seen_at"], x["title"]) for x in reconcile.lifecycle_state(got, ["account"], "item", ["title"]).collect()}
    assert state == {k: tuple(v.values()) for k, v in inventory.items()}
    assert {(x["account"], x["observed_at"], *(tuple(x[f"{c}_ids"]) for c in ("registered", "updated", "reactivated", "deleted"))) for x in reconcile.reconciliation_audit(got, ["account"], "item").collect()} == audit


def test_hot_key_is_split(spark):
    """A key with a third of all rows: its history in many chunks gives what one fold gives; no window is over the key alone."""
    r = random.Random(2)
    rows = [(r.choice([0, 0, 0, r.randint(1, 50)]), r.randrange(60), i, r.choice([None, f"v{i}"]), r.random() < 0.2) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, ts int, seq long, v string, full boolean")
    state = {}
    for k, ts, i, v, full in rows:
        s = state.setdefault(k, [ts, None])
        if ts >= s[0]:
            s[0] = ts
            if full or v is not None:
                s[1] = v
    got = merge.coalesce_merge(df, ["k"], "ts", "seq", ["v"], is_full="full", chunk=F.floor(F.col("seq") / 64))
    assert {x["k"]: x["v"] for x in got.collect()} == {k: s[1] for k, s in state.items()}
    with pytest.raises(ValueError):
        merge.coalesce_merge(df.withColumn("seq", F.col("seq").cast("string")), ["k"], "ts", "seq", ["v"])


def test_fingerprint(spark, monkeypatch):
    base = [(i % 50, f"x{i % 7}", None if i % 11 == 0 else i) for i in range(3000)]

    def of(rows):
        return tuple(quality.rowset_fingerprint(spark.createDataFrame(rows, "a int, b string, c int").repartition(3), ["a", "b", "c"], leaf=5).first())

    mixed = base[:]
    random.Random(1).shuffle(mixed)
    one = of(base)
    assert of(mixed) == one and one[0] == 3000
    other = [base[:-1], [*base, base[5]], [(base[0][0] + 1, *base[0][1:]), *base[1:]], [*base[:-1], base[0]], [(base[0][0], "null", base[0][2]), *base[1:]]]
    assert len({of(x) for x in other} | {one}) == 6
    a = spark.createDataFrame([("a|b", "c")], "x string, y string")
    b = spark.createDataFrame([("a", "b|c")], "x string, y string")
    assert quality.rowset_fingerprint(a, ["x", "y"]).first() != quality.rowset_fingerprint(b, ["x", "y"]).first()
    assert quality.rowset_fingerprint(a.limit(0), ["x", "y"]).first()["n"] == 0


def test_fan_out_counts(spark):
    r = random.Random(7)
    sets = ["s0", "s1", "s2", "s3"]
    v = [(r.randrange(3), i, r.sample(["q0", "q1", "q2", "q3", "q4"], r.randint(0, 4))) for i in range(80)] + [(9, 1000, ["q0"])]
    names = {"q0": "s0", "q1": "s1", "q2": "s1", "q3": "s2"}
    df = spark.createDataFrame([(a, i, k, sorted({names[q] for q in k if q in names})) for a, i, k in v], "account int, v int, keys array<string>, sets array<string>").withColumn("of", F.create_map(*[F.lit(x) for p in names.items() for x in p]))
    b = spark.createDataFrame([(r.randrange(4), i, r.sample(sets, r.randint(0, 3))) for i in range(30)], "account int, b int, own array<string>")
    for size in (0, 1 << 20):
        rows = routing.fan_out(df, b, ["account"], "keys", "sets", "of", "own", broadcast_bytes=size)
        want = {tuple(x) for x in rows.groupBy("account").agg(F.count("*"), F.count_if("has_overlap"), F.sum(F.size("overlap_keys"))).collect()}
        assert {tuple(x) for x in routing.fan_out_counts(df, b, ["account"], "keys", "sets", "of", "own").collect()} == want and len(want) == 3


def test_latency_is_exact(spark):
    r = random.Random(3)
    days = {g: [r.randint(-5, 400) for _ in range(n)] for g, n in (("a", 1), ("b", 10), ("c", 997))}
    df = spark.createDataFrame([(g, d) for g, x in days.items() for d in x] + [("a", None)], "g string, d int").select("g", F.lit("2024-01-01").cast("date").alias("s"), F.expr("date_add(date'2024-01-01', d)").alias("e"))
    got = {x["g"]: (x["n"], x["p50"], x["p90"]) for x in report.latency(df, ["g"], "s", "e", [0.5, 0.9]).collect()}
    assert got == {g: (len(x), sorted(x)[-(-len(x) // 2) - 1], sorted(x)[-(-len(x) * 9 // 10) - 1]) for g, x in days.items()}


def test_area_tree(spark):
    """Random forests against parents followed one by one; a long chain, a missing parent, a cycle with areas below it, no areas."""
    rng = random.Random(4)
    parents = {i: rng.choice([None, *range(i)]) if i else None for i in range(300)} | {1000: None} | {i: i - 1 for i in range(1001, 1150)}
    parents |= {2000: 1999, 2001: 2000, 3000: 3002, 3001: 3000, 3002: 3001, 3003: 3002}

    def line(i):
        out = []
        while i is not None:
            if i not in parents or i in out:
                return None
            out.append(i)
            i = parents[i]
        return out[::-1]

    rows = spark.createDataFrame([(i, p, f"a{i}") for i, p in parents.items()], "id int, parent int, name string")
    got = {r["id"]: r for r in report.area_tree(rows, "id", "parent", "name").collect()}
    want = {i: w for i in parents if (w := line(i))}
    assert {i: r["path"] for i, r in got.items()} == {i: [f"a{x}" for x in w] for i, w in want.items()}
    assert all(r["depth"] == len(r["path"]) - 1 and r["label"] == "  " * r["depth"] + r["name"] for r in got.values()) and 2000 not in got and 3003 not in got
    assert report.area_tree(rows.limit(0), "id", "parent", "name").count() == 0
