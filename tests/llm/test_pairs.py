"""Jaccard join, vector join, repeated strings and components against brute force."""

import functools
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobmill.llm import jaccard_join, substring_dedup, vector_dedup
from jobmill.llm import passages as passages_
from jobmill.llm import queries as q
from jobmill.llm.components import components
from tests.test_queries import SF

CLASH = ("node", "doc", "t", "h", "n", "window", "key", "span", "label2", "m", "v")


def union_find(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find({x for l in links for x in l}, links)
    assert got == {x: r for x, r in want.items() if any(x in l for l in links if l[0] != l[1])}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("n, percent, small", [(3, 90, 32), (5, 80, 32), (2, 60, 2)])
def test_jaccard_join(spark, monkeypatch, n, percent, small):
    for name, value in {"SMALL": small, "TINY": 4, "TILE": small}.items():
        monkeypatch.setattr(jaccard_join, name, value)  # regions of any size must come out the same
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 60, 140]))] for _ in range(12)]
    rows = []
    for i in range(170):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\n"]).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \t"), (503, "one"), (504, "ONE"), (505, "one two"), (None, "one two"), (None, None), (7, rows[8][1]), (506, "x " * 60_000), (507, "é É"), (508, "é é")]
    sets = [shingles(t, n) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = union_find(range(len(rows)), links)
    low = {}
    for i, r in root.items():
        low[r] = min([x for x in (low.get(r), rows[i][0]) if x is not None], default=None)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in CLASH})
    got = jaccard_join.near_duplicates(df, n, percent).collect()
    assert Counter(map(tuple, got)) == Counter((rows[i][0], len(sets[i]), low[root[i]]) for i in range(len(rows)))
    assert jaccard_join.near_duplicates(df.limit(0), n, percent).count() == 0


@pytest.mark.parametrize("n, percent, size", [(3, 90, 9), (5, 80, 4), (3, 90, 10), (3, 90, 8), (5, 80, 3), (1, 50, 1), (2, 100, 6)])
def test_jaccard_join_one_word_longer(spark, n, percent, size):
    """A set of `size` shingles inside one of a shingle more, and a chain that hangs on such a link."""
    words = [f"w{i}" for i in range(size + n - 1)]
    rows = [(1, words), (2, [*words, "behind"]), (3, ["ahead", *[f"v{w}" for w in words]]), (4, [f"v{w}" for w in words]), (5, ["ahead", *words]), (6, [f"u{w}" for w in words])]
    sets = [shingles(" ".join(w), n) for _, w in rows]
    assert len(sets[0]) == size and len(sets[1]) == size + 1
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = union_find(range(len(rows)), links)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = jaccard_join.near_duplicates(df, n, percent).collect()
    assert sorted(map(tuple, got)) == [(rows[i][0], len(sets[i]), rows[root[i]][0]) for i in range(len(rows))]


@pytest.mark.parametrize("tile", [2, 512])
def test_jaccard_join_between_pivots(spark, monkeypatch, tile):
    """Chains of copies of copies in one region, where members that two pivots took in are near each other and nothing else joins them."""
    for name, value in {"SMALL": 1, "TINY": 1, "TILE": tile}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(5)
    rows = []
    for g in range(150):
        made = [[f"g{g}w{i}" for i in range(20)]]
        for _ in range(rng.randrange(6, 16)):
            w = list(rng.choice(made))
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(20)] = f"g{g}v{rng.randrange(8)}"
            made.append(w)
        rows += [(100 * g + i, " ".join(w)) for i, w in enumerate(made)]
    sets = [shingles(t, 1) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(max(0, i - 16), i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = union_find(range(len(rows)), links)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(df, 1, 80).collect()}
    assert got == {d: rows[root[i]][0] for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("block, leaf", [(512, 128), (16, 4)])
def test_vector_join(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "LEAF", leaf)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = []
    for i in range(400):
        v = centres[rng.integers(20)] + rng.normal(size=16) * rng.choice([0.05, 0.2, 1])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 1e-3, 50])], int(rng.integers(3))))
    rows += [(900 + i, rows[0][1], rows[0][2]) for i in range(30)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [float("inf")] + [0.0] * 15, 1), (1005, rows[0][1], None), (1006, rows[0][1][:8], rows[0][2]), (1007, [None] * 16, 1), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).withColumns({c: F.lit(1) for c in CLASH})
    ok = [i for i, (_, v, l) in enumerate(rows) if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in ok}
    links = [(i, j) for i in ok for j in ok if j < i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    root, n = union_find(range(len(rows)), links), Counter(x for l in links for x in l)
    low = {}
    for i, r in root.items():
        low[r] = min([x for x in (low.get(r), rows[i][0]) if x is not None], default=None)
    got = vector_dedup.near_vectors(df).collect()
    assert Counter(map(tuple, got)) == Counter((rows[i][0], n[i], low[root[i]], rows[i][0] == low[root[i]]) for i in range(len(rows)))
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def brute_repeats(rows, length, first):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen if first else count[w] > 1:
                mark[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((d, len(b), sum(mark), sum(1 for i in range(len(mark)) if mark[i] and not (i and mark[i - 1])), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@functools.cache
def brute_passages(rows, length):
    """Rows of over 50 words in a row that a row with another key or text holds too."""
    holders = {}
    for d, t in rows:
        w = re.sub("[A-Z]+", lambda m: m[0].lower(), t or "").split()
        for i in range(len(w) - length + 1):
            holders.setdefault(tuple(w[i : i + length]), set()).add((d, t))
    return {r for h in holders.values() if len(h) > 1 for r in h}


def test_shared_passages(spark):
    """Passages of 49 to 60 words, inside other text, at its ends, in repeated rows, and of one word over and over."""
    rng = random.Random(8)

    def words(n):
        return [f"{rng.choice('abcdefg')}{rng.randrange(3000)}" for _ in range(n)]

    passages = [words(n) for n in (49, 50, 51, 52, 60, 200)]
    rows = [(i, " ".join(words(rng.randrange(40)) + passages[i % 6] + words(rng.randrange(40)))) for i in range(40)]
    rows += [(100 + i, " ".join(words(300))) for i in range(10)] + [(200, "na " * 70), (201, "na " * 51), (202, "la " * 80), (202, "la " * 80), (203, "ha " * 60), (203, "Ha " * 60), (None, None), (None, ""), (204, " ".join(passages[5][:51])), (205, " ".join(passages[5][:50]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in (*CLASH, "row")})
    got = {r["doc"] for r in passages_.shared_passages(df, 51).collect()}
    want = {d for d, _ in brute_passages(tuple(rows), 51)}
    assert got == want and {200, 201, 203, 204} <= want and not {202, 205} & want
    assert passages_.shared_passages(df.limit(0), 51).count() == 0


def test_windows_whose_hashes_agree_by_chance(monkeypatch):
    """Removal is decided on bytes: with a hash that says nothing, the result is the same."""
    monkeypatch.setattr(substring_dedup.GramRanges, "of", lambda self, start, stop: np.zeros(len(start), np.uint64))
    test_suffix_order_of_windows()


@pytest.mark.parametrize("length, large, first", [(400, 1 << 20, False), (400, 3000, False), (100, 1 << 20, True)])
def test_repeats(spark, monkeypatch, length, large, first):
    monkeypatch.setattr(substring_dedup, "LARGE", large)
    monkeypatch.setattr(substring_dedup, "SORTED", 20_000)
    monkeypatch.setattr(substring_dedup, "LONG", 5000)
    rng = random.Random(length)

    def noise(n):
        return "".join(rng.choice("xyz ü") for _ in range(n))

    passages = ["".join(rng.choice("abcdé ") for _ in range(900)) for _ in range(3)]
    rows = [(i, noise(rng.randrange(300)) + rng.choice(passages)[rng.randrange(300) : rng.randrange(400, 900)] + noise(rng.randrange(300))) for i in range(90)]
    rows += [(100, "a" * 1500), (101, "ab" * 700), (102, None), (103, ""), (104, "ab" * 700), (105, noise(9000) + passages[0] + noise(7000))]
    if not first:
        rows += [(None, passages[1]), (104, "ab" * 700), (104, passages[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit(1) for c in CLASH})
    got = substring_dedup.remove_repeats(df, length, first).collect()
    assert Counter(map(tuple, got)) == brute_repeats(rows, length, first)
    assert substring_dedup.remove_repeats(df.limit(0), length).count() == 0


@pytest.mark.parametrize("first", [False, True])
def test_repeats_reported(spark, monkeypatch, first):
    """Repeats below the removed length are counted and stay; what is removed is the same as without the report."""
    monkeypatch.setattr(substring_dedup, "LARGE", 3000)
    rng = random.Random(5)

    def noise(n):
        return "".join(rng.choice("xyz ü") for _ in range(n))

    passages = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (110, 150, 200, 290, 295, 300, 301, 900)]
    rows = [(i, noise(rng.randrange(200)) + passages[i % 8] + noise(rng.randrange(200))) for i in range(40)]
    rows += [(50, passages[7][:299] + "!" + passages[7][299:598]), (51, noise(90) * 4), (52, None), (53, ""), (54, noise(500)), (None, passages[3]), (55, passages[4]), (55, passages[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit(1) for c in CLASH})
    got = substring_dedup.remove_repeats(df, 300, first, report=120).collect()
    sizes = Counter((r[0], r[1], r[2]) for r in brute_repeats(rows, 120, False).elements())
    assert Counter((r["doc_id"], r["n_bytes"], r["n_repeated"]) for r in got) == sizes
    assert Counter(tuple(r)[:5] for r in got) == brute_repeats(rows, 300, first)
    assert sum(r["n_repeated"] > 0 and r["n_removed"] == 0 for r in got) > 10
    assert substring_dedup.remove_repeats(df.limit(0), 300, report=120).count() == 0


def test_planted_passages_reported(spark, tmp_path):
    """Benchmark passages of over 50 words, all below 400 bytes, in two documents each: reported by the query, and left in the text as its contract says."""
    rng = random.Random(6)
    passages = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len((r["text"] or "").split()) > 50]
    assert passages and max(len(p.encode()) for p in passages) < 400

    def noise(n):
        return " ".join(f"{rng.choice('abcdefg')}{rng.randrange(10**6)}" for _ in range(n))

    rows = [(i, f"{noise(30)}\n{passages[i // 2 % len(passages)]}\n{noise(30)}") for i in range(2 * len(passages))] + [(1000 + i, noise(150)) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in q.op10_substring_dedup(spark, str(tmp_path)).collect():
        passage = len(passages[r["doc_id"] // 2].encode()) if r["doc_id"] < 1000 else 0
        assert r["n_removed"] == 0 and (r["n_repeated"] >= passage if passage else r["n_repeated"] == 0)


def test_suffix_order_of_windows():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[2000:2600] = data[:600]
    starts = np.arange(len(data) - 40 + 1)
    earlier, later = substring_dedup.repeated_starts(data, starts, starts, 40)
    raw = data.tobytes()
    first, last = {}, {}
    for i in starts:
        first.setdefault(raw[i : i + 40], i)
        last[raw[i : i + 40]] = i
    assert earlier.tolist() == [first[raw[i : i + 40]] < i for i in starts] and later.tolist() == [last[raw[i : i + 40]] > i for i in starts]
