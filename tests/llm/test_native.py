"""Sharding, mixing and exact dedup against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from jobmill.llm import exact_dedup, mixing, sharding

ROWS = [
    (1, "a b  c", "s1"), (2, "ab c", "s1"), (3, None, "s1"), (4, "", None), (5, " \t\n", None), (1, "a b  c", "s1"), (None, "abc", "s2"), (None, None, None),
    (6, "x " * 40_000, "s3"), (7, "x" * 40_000, "s3"), (8, "é.ü " * 3000, "s2"), (9, "é.ü" * 3000, "s2"), (10, " ", "s2"), (10, "other", "s4"),
]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names the operators might use themselves
    clash = {c: F.lit(7) for c in ("size", "shard", "n_rows", "_k", "d", "score", "lang_pred", "_rows", "kept", "chars")}
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns(clash)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[norm(t)].append((-len(t or ""), i is None, i))
    want = Counter()
    for i, t, _ in ROWS:
        g = sorted(groups[norm(t)], key=lambda x: (x[0], x[1], x[2] or 0))
        want[(i, g[0][2], len(g), hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    rows = exact_dedup.copy_report(docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == want
    assert sum(r["kept"] for r in rows) == len(groups)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and Counter(norm(r["text"]) for r in kept.collect()) == Counter(dict.fromkeys(groups, 1))
    assert exact_dedup.copy_report(docs.limit(0)).count() == 0


def test_chunks_join_to_the_text(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé.\n") for _ in range(n)) for n in (0, 1, 511, 512, 5000, 20_000)] + ["q" * 10_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract_all("t", F.lit(exact_dedup.CHUNK), F.lit(0)).alias("c"))
    for r in df.collect():
        assert "".join(r["c"]) == r["t"] and all(len(c) <= exact_dedup.MOST for c in r["c"])


def test_digest_clash_stops(spark):
    pieces = spark.createDataFrame([(b"1", "a"), (b"1", "b"), (b"2", "a")], "digest binary, chunk string")
    with pytest.raises(Exception, match="share the digest"):
        exact_dedup.verified_chunks(pieces).collect()


def test_sharding(docs):
    rows = sharding.shard_manifest(docs, [1.0] * 8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in ROWS)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r["doc_id"], r["shard"]) for r in rows}) == len({i for i, _, _ in ROWS})
    assert sharding.shard_manifest(docs.limit(0), [1.0]).count() == 0


def test_weights_share_the_keys(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    n = Counter(r["shard"] for r in sharding.assign_shards(df, [1.0, 2.0, 1.0]).collect())
    assert abs(n[1] / 20_000 - 0.5) < 0.02 and abs(n[0] / 20_000 - 0.25) < 0.02


def water_fill(sizes, weights, cap):
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        t = [cap * s if i in capped else weights[i] * left / w for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in capped and t[i] > cap * s}
        if not over:
            return t
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 3, 50, 1000, 20_000]) for _ in range(7)]
    df = spark.createDataFrame([(f"s{i}" if i < 6 else None, s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df, [5, 2, 1], 3.0).collect()}
    want = water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(7)], 3) if sum(sizes) else [0] * 7
    for i, t in enumerate(want):
        assert got[f"s{i}" if i < 6 else None] == pytest.approx(t, abs=1e-6)


def test_mixing(spark, docs):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([1, 5, 50, 300]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df, [5, 2, 1]).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(df.repartition(5), [5, 2, 1]).collect()))
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    for r in out:
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    for s, t in target.items():
        assert abs(taken[s] - t) <= 2 * most[s]
    copies = Counter({r["doc_id"]: r["copies"] for r in out if r["copies"]})
    assert Counter(r["doc_id"] for r in mixing.mixed_documents(df, [5, 2, 1]).collect()) == copies
    odd = mixing.mix(docs, [5, 2, 1]).collect()
    assert len(odd) == len(ROWS)
    mixed = mixing.mixed_documents(docs, [5, 2, 1])
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in odd)
    assert mixing.mix(docs.limit(0), [5]).count() == 0
