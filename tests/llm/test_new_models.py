"""Quality classifier, hard negatives and spelling variants against brute force and plain Python."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobmill.llm import hard_negatives, quality, spelling
from jobmill.llm import queries as q
from jobmill.llm.common import fold
from tests.test_queries import SF

# ---- quality


def test_quality_features():
    """Pieces of a long text give the counts of the whole; nothing but the intercept for empty and null texts."""
    words = random.Random(5).choices(["ab", "Cd", "EF", "!!", "7", "ab"], k=3000)
    text = " ".join(words)
    whole = quality.features(text)
    piece = quality.PIECE
    try:
        quality.PIECE = 40
        parts = quality.features(text)
    finally:
        quality.PIECE = piece
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])
    assert math.isclose((whole[1][:-1] ** 2).sum(), 1.0)
    for t in (None, "", " \n "):
        at, x = quality.features(t)
        assert at.tolist() == [quality.BUCKETS] and x.tolist() == [1.0]


def test_quality_step_is_ftrl():
    """The vectorised update equals the textbook one, coordinate by coordinate."""
    z, n = np.zeros(quality.BUCKETS + 1), np.zeros(quality.BUCKETS + 1)
    zs, ns = Counter(), Counter()

    def weight(i):
        l1, l2 = (0, 0) if i == quality.BUCKETS else (quality.L1, quality.L2)
        if abs(zs[i]) <= l1:
            return 0.0
        return -(zs[i] - math.copysign(l1, zs[i])) / ((quality.BETA + math.sqrt(ns[i])) / quality.ALPHA + l2)

    r = random.Random(3)
    for _ in range(200):
        at = np.array(sorted(r.sample(range(12), 4)) + [quality.BUCKETS])
        x, y = np.array([r.random() for _ in range(4)] + [1.0]), float(r.random() < 0.4)
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in zip(at.tolist(), x, strict=True))))
        for i, v in zip(at.tolist(), x, strict=True):
            w, g = weight(i), (p - y) * v
            zs[i] += g - (math.sqrt(ns[i] + g * g) - math.sqrt(ns[i])) / quality.ALPHA * w
            ns[i] += g * g
        quality.step(z, n, at, x, y)
    assert all(math.isclose(z[i], zs[i], abs_tol=1e-9) and math.isclose(n[i], ns[i], abs_tol=1e-9) for i in zs)


def test_quality_held_out(spark):
    """Held-out accuracy; nothing but the text of a row decides its score; reruns agree."""
    got = q.op11_quality(spark, SF.replace("0.001", "0.01"))
    rows = got.join(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet"), "doc_id").filter("held_out and quality is not null").collect()
    low, high = [r for r in rows if r["quality"] == 0], [r for r in rows if r["quality"] == 1]
    assert len(low) > 10 and len(high) > 50
    assert sum(r["predicted"] for r in low) <= 0.1 * len(low) and sum(r["predicted"] for r in high) >= 0.98 * len(high)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(i, ("good words here and there " if i % 2 else "bad$$$ words### here!! ") * (1 + i % 5)) for i in range(200)] + [(7, "another text with the key of one"), (None, "x"), (300, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (1, None), (300, 0), (301, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    odd = spark.createDataFrame([(1, "good words here"), (2, "bad$$$ words###"), (3, None), (4, ""), (5, "good words here " * 200_000), (5, "good words here")], "doc_id long, text string").withColumns({"score": F.lit("x"), "y": F.lit(1), "label": F.lit(2)})
    got = quality.score(odd, model)
    assert got.columns == ["doc_id", "text", "score", "y", "label", "predicted"]
    rows = {(r["doc_id"], len(r["text"] or "")): r["score"] for r in got.collect()}
    assert rows[1, 15] > 0.7 > 0.5 > rows[2, 15] and rows[3, 0] == rows[4, 0] and all(0 <= s <= 1 for s in rows.values()) and rows[5, 15] == rows[1, 15]
    assert abs(rows[5, 3_200_000] - rows[1, 15]) < 0.3
    again = quality.fit(docs, labels)
    assert (again.z == model.z).all()
    nothing = quality.fit(docs.limit(0), labels)
    assert [r["score"] for r in quality.score(odd.limit(0), nothing).collect()] == [] and quality.score(odd, nothing).agg(F.min("score")).first()[0] == 0.5


# ---- hard negatives


def by_hand(rows, positives=5, negatives=5, least=80, most=100):
    fine = [(i, [math.floor(256 * float(x)) for x in v], lab) for i, v, lab in rows if lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    order = [(float("inf") if i is None else i) for i, _, _ in fine]
    out = []
    for a, (i, v, lab) in enumerate(fine):
        if i is None or i % 100:
            continue
        s = [sum(x * y for x, y in zip(v, w, strict=True)) if len(w) == len(v) else None for _, w, _ in fine]
        ranked = sorted((k for k in range(len(fine)) if k != a and s[k] is not None), key=lambda k: (-s[k], order[k]))
        for p in [k for k in ranked if fine[k][2] == lab][:positives]:
            found = [k for k in ranked if fine[k][2] != lab and least * s[p] <= 100 * s[k] <= most * s[p]][:negatives]
            out += [(i, fine[p][0], r + 1, fine[k][0], s[p], s[k]) for r, k in enumerate(found)]
    return Counter(out)


def mined(df, **more):
    return Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in hard_negatives.mine(df, F.col("id") % 100 == 0, **more).collect())


@pytest.mark.parametrize("spread", [False, True])
def test_hard_negatives_brute_force(spark, spread, monkeypatch):
    """Ties, copies, repeated and null keys, broken vectors, two lengths, huge components; one task or many blocks and tasks."""
    if spread:
        monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
        monkeypatch.setattr(hard_negatives, "ROWS", 40)
        monkeypatch.setattr(hard_negatives, "TILE", 2)
    r = random.Random(11)
    rows = [(i * 10, [r.choice([-1.0, -0.3, 0.0, 0.2, 0.5, 1.0]) for _ in range(10)], r.choice([0, 0, 0, 1, 2])) for i in range(160)]
    rows += [(100, rows[3][1], 0), (None, rows[10][1], 1), (None, rows[10][1], 1), (2000, [0.0] * 10, 0), (2100, rows[20][1], 9)]
    rows += [(3000 + i, rows[40][1], i % 2) for i in range(30)]
    rows += [(4000, None, 0), (4100, [None] + [1.0] * 9, 0), (4200, [float("nan")] * 10, 1), (4300, [1.0] * 10, None), (4400, [], 0), (4500, [float("inf")] * 10, 0)]
    rows += [(5000 + 100 * i, [float(i), 1.0, -1.0], i % 3) for i in range(8)]
    rows += [(6000, [2_000_000.0] * 10, 0), (6001, [1_500_000.5] * 10, 0), (6002, [1_750_000.25] * 10, 1), (6003, [1_400_000.0] * 10, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit(3), "rid": F.lit("x"), "lab": F.lit(0)})
    want = by_hand(rows)
    assert want and any(k[0] == 6000 for k in want) and mined(df) == want


def test_hard_negatives_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert not mined(df)
    one = spark.createDataFrame([(100, [1.0], 1), (1, [1e300], 1)], "vec_id long, embedding array<double>, label int")  # too large: takes no part
    assert not mined(one)


def test_bounds_hold():
    """No pair inside the interval is lost by the summaries, at any level."""
    g = np.random.default_rng(2)
    for scale in (3, 300, 2**26):
        a, b = (hard_negatives.Side(np.floor(g.normal(size=(n, 21)) * scale).astype(np.int64)) for n in (40, 60))
        exact = a.x @ b.x.T
        lo, hi = np.quantile(exact, 0.9, axis=1), np.quantile(exact, 0.97, axis=1)
        i, j, s = hard_negatives.survivors(a, np.arange(40), b, np.arange(60), lo, hi)
        want = {(p, r) for p, r in zip(*((exact >= lo[:, None]) & (exact <= hi[:, None])).nonzero(), strict=True)}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and (s == exact[i, j]).all()


# ---- spelling variants


def near_by_hand(words):
    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    return {(a, b) for a, b in itertools.permutations(words, 2) if one_edit(a, b)}


def variants_by_hand(counts, ratio=10):
    near = {w: [] for w in counts}
    for a, b in near_by_hand(list(counts)):
        near[a].append(b)
    best = {w: min(v, key=lambda x: (-counts[x], x.encode())) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if counts[b] >= ratio * counts[w]}
    out = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return out


def found(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_brute_force(spark):
    """Random words over few letters, accents and capitals outside A-Z, chains of forms, ties, words without a neighbour."""
    r = random.Random(4)
    counts = {"".join(r.choice("abéÉ") for _ in range(r.randint(1, 6))): r.choice([2, 2, 3, 30, 300, 4000]) for _ in range(500)}
    counts |= {"spelling": 10**6, "speling": 10**4, "spelin": 10**2, "splin": 5, "unrelated": 9, "a" * 300: 7, "a" * 301: 70, "a" * 150 + "b" + "a" * 149: 700, "×÷÷×": 3}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("len", F.lit("x"))
    want = variants_by_hand(counts)
    assert any(x[2] == "spelling" and x[0] == "spelin" for x in want) and found(spelling.variants(df)) == want


def test_variants_of_an_anagram_crowd(spark):
    """All orders of seven letters and what one edit makes of some: a very large group of equal multisets."""
    words = ["".join(p) for p in itertools.permutations("abcdefg")][:2500]
    words += [w[:3] + "z" + w[3:] for w in words[:400]] + [w[:2] + "y" + w[3:] for w in words[:400]]
    counts = {w: 2 + i % 50 for i, w in enumerate(dict.fromkeys(words))}
    by_rest = {}
    for w in counts:
        for i in range(len(w)):
            by_rest.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    near = {(a, b) for g in by_rest.values() for a, b in itertools.permutations(g, 2)}
    near |= {p for (_, rest), g in by_rest.items() if rest in counts for w in g for p in ((rest, w), (w, rest))}
    links = spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n long"))
    pairs = [(r["a"], r["b"]) for r in links.collect()]
    assert len(pairs) == len(set(pairs)) and {p for a, b in pairs for p in ((a, b), (b, a))} == near


def test_word_counts(spark):
    docs = [(1, "Spelling SPELLING spelling, Ünïcode ÜNÏCODE x" + "letters " * 40), (2, None), (3, ""), (None, "spelling spelling ÀÈÉÊËÌÍ"), (1, "Spelling"), (1, "Spelling")] + [(i, "commonword another" + "q" * (i % 3)) for i in range(10, 90)]
    want = Counter()
    for i, t in docs:
        word = ""
        for c in (t or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                word += c.lower() if c <= "Z" else c
                continue
            if word:
                h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
                w = word[: h % len(word)] + word[h % len(word) + 1 :] if h % 31 == 0 else word
                want[w] += 1
            word = ""
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit(1), "word": F.lit("w"), "n": F.lit(1)})
    assert {r["word"]: r["n"] for r in spelling.word_counts(df).collect()} == want and len(want) > 5
    assert spelling.variants(spelling.word_counts(df.limit(0))).count() == 0


def test_fold_is_unsigned_crc(spark):
    assert [r[0] for r in spark.range(50).select(fold(F.col("id"), 4)).collect()] == [zlib.crc32(str(i).encode()) % 4 for i in range(50)]
