"""Tokens, language, toxicity, chat formatting, and the pipeline."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter

import pytest

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from jobmill.llm import byte_bpe, chat_format, language, toxicity  # noqa: E402
from jobmill.llm import queries as q  # noqa: E402
from jobmill.llm.common import fold  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(PATH)


def test_perfect_hash(ranks):
    ph = byte_bpe.PerfectHash(list(ranks), list(ranks.values()))
    assert sorted(ph.values.tolist()) == sorted(ranks.values())
    assert ph.find(list(ranks)) == list(ranks.values())
    strangers = [k + b"\xff\xfe" for k in list(ranks)[:2000]]
    assert ph.find(strangers) == [-1] * 2000


def test_encode_as_tiktoken(spark, ranks):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab\n \t'sé世🙂0 9..  lltheing") for _ in range(rng.randrange(300))) for _ in range(200)]
    texts += ["", None, "a" * 20_000, " " * 3000, "<|endoftext|>", "don't 'S 12345   x"]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumn("ids", F.lit(1))
    want = {i: own.encode_ordinary(t or "") for i, t in enumerate(texts)}
    got = byte_bpe.encode(df, PATH, public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == want
    assert {r["doc_id"]: r["text"] for r in byte_bpe.decode(got, PATH).collect()} == {i: t or "" for i, t in enumerate(texts)}
    for r in byte_bpe.digests(df, PATH, public_tokenizers.PATTERN).collect():
        ids, t = want[r["doc_id"]], texts[r["doc_id"]] or ""
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert byte_bpe.digests(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_cache_starts_anew(ranks, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 5)
    monkeypatch.setattr(byte_bpe, "BLOCK", 10)
    c = byte_bpe.Codec(ranks, public_tokenizers.PATTERN, byte_bpe.PerfectHash(list(ranks)[:300], list(ranks.values())[:300]))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["hello there world", "one two three four five six seven", "hello again"]
    assert list(c.encode(texts)) == [" ".join(map(str, own.encode_ordinary(t))) for t in texts]


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = q.op9_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = out.filter("lang = lang_pred").count() / out.count()
    assert right > 0.95 and out.filter("score < 0 or score > 1").count() == 0
    model = language.fit(docs)
    odd = spark.createDataFrame([(None,), ("",), ("123 !?",), ("la " * 400_000,), ("x",)], "text string").withColumns({"lang_pred": F.lit(1), "p": F.lit(2), "d": F.lit(3)})
    rows = language.predict(odd, model).collect()
    assert [r["lang_pred"] for r in rows[:3]] == ["und"] * 3 and rows[0]["score"] == 0.0
    assert all(r["lang_pred"] in model.languages for r in rows[3:])
    empty = language.fit(docs.limit(0))
    assert language.predict(odd, empty).first()["lang_pred"] == "und" and language.predict(odd.limit(0), model).count() == 0


def test_language_scores_by_hand(spark):
    """The registered query against multinomial naive Bayes in plain Python, n-gram by n-gram."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    crc = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in rows}

    def buckets(t):
        t = language.letters(t)
        codes = language._codes(t)
        return [int(language.grams(codes[i : i + n], n)[0]) for n in language.LENGTHS for i in range(len(codes) - n + 1)]

    rows = [r for r in rows if r["text"] is not None and len(r["text"]) < 4000]
    short = docs.filter("length(text) < 4000")
    counts, n = {}, Counter()
    for r in rows:
        if crc[r["doc_id"]] != 2 and r["lang"] is not None and language.letters(r["text"]):
            counts.setdefault(r["lang"], Counter()).update(buckets(r["text"]))
            n[r["lang"]] += 1
    model = language.fit(short.filter(fold(F.col("doc_id"), 4) != 2))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(short, model).collect()}
    size = {g: sum(c.values()) for g, c in counts.items()}
    for r in rows[:60]:
        seen = Counter(buckets(r["text"]))
        if not seen:
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        s = {g: math.log(n[g] / sum(n.values())) + sum(k * math.log((counts[g][b] + 0.1) / (size[g] + 0.1 * language.BUCKETS)) for b, k in seen.items()) for g in counts}
        best = max(s, key=s.get)
        assert got[r["doc_id"]][0] == best and got[r["doc_id"]][1] == pytest.approx(1 / sum(math.exp(x - s[best]) for x in s.values()), abs=1e-6)


def test_unknown_schema_keywords_stop():
    chat_format.check_schema(chat_format.SCHEMAS["ask"])
    with pytest.raises(ValueError, match="pattern"):
        chat_format.check_schema({"properties": {"a": {"type": "string", "pattern": "x"}}})


def test_encode_whole_table_as_tiktoken(spark, ranks):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = own.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in q.op5_byte_bpe(spark, SF).collect()}
    assert got == want


def test_automaton_accepts_what_edit_distance_does():
    rng = random.Random(2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(3, 10))) for _ in range(12)}
    allowed = {w: rng.randrange(3) for w in words}
    lexicon = toxicity.Lexicon(allowed, set())
    for _ in range(3000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(12)))
        want = min(((d, t) for t, k in allowed.items() if (d := distance(w, t)) <= k), default=None) if w else None
        got = lexicon.match(w)
        assert (got and (got[1], got[0])) == want


def test_stems_and_quotes():
    lexicon = toxicity.Lexicon({"idiot": 1}, {"zork"})
    assert lexicon.match("zorkmaster") == ("zork*", 0) and lexicon.match("zor") is None and lexicon.match("idiott") == ("idiot", 1) and lexicon.match("idioxxt") is None
    model = toxicity.Model(lexicon, {("idiot", False): 3.0, ("idiot", True): 3.0, ("zork*", False): 3.0})
    assert model.hits('You IDIOT! zorks "an idiot" said') == [("idiot", False, False), ("zork*", False, False), ("idiot", False, True)]
    assert model.score("you idiot") > model.score('he said "idiot" once') and model.score(None) == model.score("") == model.score("fine words")


def test_toxicity(spark):
    rows = [(i, f"word{i % 7} some text here " + (("moron clown", "moron", "my clown")[i % 3] if i % 4 == 0 else "plain text"), i % 4 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(None, 1), (9999, None)], "doc_id long, toxic int")
    train = fold(F.col("doc_id"), 5) != 0
    model = toxicity.fit(docs.filter(train), labels.filter(train))
    odd = spark.createDataFrame([(1, "such a moron"), (2, "such a morron and clowns"), (3, None), (4, ""), (5, "plain " * 100_000)], "doc_id long, text string").withColumns({"score": F.lit(9), "y": F.lit(1)})
    got = {r["doc_id"]: (r["predicted"], r["score"]) for r in toxicity.score(odd, model).collect()}
    assert [got[i][0] for i in range(1, 6)] == [1, 1, 0, 0, 0] and all(0 <= s <= 1 for _, s in got.values())
    none = toxicity.fit(docs.limit(0), labels.limit(0))
    assert toxicity.score(odd, none).filter("predicted = 1").count() == 0 and toxicity.score(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_toxicity_misspelled_and_quoted(spark, sf):
    """Every term learned, with one letter doubled, left out or replaced, scores above clean text unless clean texts use that word; quoted, between plain and none."""
    at = SF.replace("0.001", sf)
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    held = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs.filter(~held), labels.filter(~held))
    clean = model.score("a fine day")
    assert len(model.lexicon.terms) >= 5
    tried = barred = 0
    for term, k in model.lexicon.terms.items():
        assert clean < model.score(f"you {term}")
        if k:
            for word in {w for i in range(len(term)) for w in (term[:i] + term[i] + term[i:], term[:i] + term[i + 1 :], term[:i] + "w" + term[i + 1 :])} - {term}:
                tried, barred = tried + 1, barred + (word in model.barred)
                assert word in model.barred or clean < model.score(f"you {word}"), word
        assert clean < model.score(f'once he said "{term}" aloud') < model.score(f"once you {term} aloud")
    assert tried >= 50 and barred < tried / 10
    got = toxicity.score(docs.join(labels, "doc_id").filter(held), model).groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n.get((0, 1), 0) <= 0.005 * n[0, 0] and n[1, 1] >= {"0.01": 4, "0.1": 91}[sf]


def test_toxicity_terms_of_copies(spark):
    """A word of one text that was copied forty times, now and then with a change, is no term; one of texts of their own is."""
    rng = random.Random(5)

    def prose(n):
        return [rng.choice("bcdfgklmnprst") + rng.choice("aeiou") + rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(n)]

    base = [*prose(30), "zugleich", *prose(30)]
    copies = [" ".join(w if w == "zugleich" or rng.random() > 0.02 else "xx" for w in base) for _ in range(40)]
    own = [" ".join([*prose(20), "moron", *prose(20)]) for _ in range(20)]
    texts = [(t, 1) for t in copies + own] + [(" ".join(prose(40)), 0) for _ in range(300)] + [(None, 0), ("", 1)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int"))
    assert "moron" in model.lexicon.terms and "zugleich" not in model.lexicon.terms


def test_toxicity_score_by_hand(spark):
    """The registered query against a plain reading of its model: nearest term by edit distance, window, logistic."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs.filter(fold(F.col("doc_id"), 5) != 0), spark.read.parquet(f"{SF}/labels.parquet").filter(fold(F.col("doc_id"), 5) != 0))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def nearest(word):
        if word in model.barred:
            return None
        found = [(0, word)] if word in model.lexicon.terms else []
        found = found or sorted((d, t) for t, k in model.lexicon.terms.items() if word and k and abs(len(t) - len(word)) <= k and (d := distance(word, t)) <= k)[:1]
        found = found or [(0, s + "*") for s in sorted(model.lexicon.stems, key=len) if word.startswith(s)][:1]
        return found[0] if found else None

    cache, got = {}, {r["doc_id"]: r["score"] for r in q.op1_toxicity(spark, SF).collect()}
    for r in docs.collect():
        words, sums = (r["text"] or "").split(), [0.0, 0.0]
        for i, w in enumerate(words):
            bare = w.lower().strip(toxicity.EDGES)
            if bare not in cache:
                cache[bare] = nearest(bare)
            if cache[bare]:
                sums[toxicity.is_quoted(words, i)] += model.weights.get(cache[bare][::-1], 0.0)
        b = model.coefficients
        z = b[0] + b[1] * math.log1p(sums[0]) + b[2] * math.log1p(sums[1])
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


CALLS = "conv_id long, turn int, call_id string, name string, arguments string, after array<string>"


def test_long_conversations(spark, monkeypatch):
    """Chains through many blocks, forwards and against the turns, random waits, a cycle across blocks: as one task orders them."""
    rng = random.Random(3)
    waits = {(1, f"a{i}"): [f"a{i - 1}", f"a{i - 2}"] for i in range(3000)} | {(2, f"a{i}"): [f"a{i + 1}"] for i in range(1200)}
    waits |= {(None, f"a{i}"): [f"a{rng.randrange(i + 1)}" for _ in range(3) if i > 5] for i in range(1500)}
    waits = {k: [w for w in ws if w != k[1]] for k, ws in waits.items()}
    waits |= {(3, f"a{i}"): [f"a{(i + 1) % 900}"] for i in range(900)} | {(3, "b"): ["a5"], (3, "c"): ["gone"], (4, "a0"): []}
    turns = [(c, int(i[1:] or 0), i, ws) for (c, i), ws in waits.items()]
    calls = spark.createDataFrame(turns, "conv_id long, turn int, call_id string, after array<string>").repartition(5)
    monkeypatch.setattr(chat_format, "LONG", 500)
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in chat_format.levels(calls, "conv_id", "call_id", "after", "turn").collect()}
    want = chat_format.call_levels({k: [(k[0], w) for w in ws] for k, ws in waits.items()})
    assert got == want and got[1, "a2999"] == 2999 and got[2, "a0"] == 1199 and (3, "b") not in got and got[3, "c"] == 0


@pytest.mark.parametrize("long_", [100_000, 0])
def test_tool_calls(spark, monkeypatch, long_):
    monkeypatch.setattr(chat_format, "LONG", long_)  # conversations of any length must come out the same
    schemas = {"add": {"required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "number"}}}, "additionalProperties": False}}
    calls = spark.createDataFrame([
        (1, 0, "x", "add", '{"b":[1,2.5],"a":1}', None), (1, 1, "y", "add", '{"a":"1"}', ["x", "gone"]), (1, 2, "z", "other", "{}", ["y", "x"]), (1, 3, "bad", "add", "{", ["x"]),
        (2, 0, "x", "add", '{"a":1,"c":2}', ["y"]), (2, 1, "y", "add", '{"a":NaN}', ["x"]), (2, 2, "w", "add", None, ["y"]), (1, 9, "x", "add", "{}", None), (1, 4, None, "add", "{}", None), (None, 0, "x", "add", '{"a":2}', []),
    ], CALLS).withColumns({"position": F.lit(1), "valid": F.lit(1)})
    results = spark.createDataFrame([(1, 1, "x", "é\n"), (1, 2, "x", "later"), (1, 5, "q", "orphan"), (2, 1, "y", None), (3, 0, None, "no id"), (None, 1, "x", "n")], "conv_id long, turn int, call_id string, content string")
    out = chat_format.link_tool_calls(calls, results, schemas)
    got = {(r["conv_id"], r["call_id"]): r for r in out.collect()}
    assert {k: (r["status"], r["level"], r["position"]) for k, r in got.items()} == {
        (1, "x"): ("linked", 0, 0), (1, "y"): ("unanswered", 1, 1), (1, "bad"): ("unanswered", 1, 2), (1, "z"): ("unanswered", 2, 3), (1, "q"): ("orphan", None, None),
        (2, "x"): ("cycle", None, None), (2, "y"): ("cycle", None, None), (2, "w"): ("cycle", None, None), (None, "x"): ("linked", 0, 0)}
    assert got[1, "x"]["record"] == '{"after":[],"arguments":{"a":1,"b":[1,2.5]},"id":"x","name":"add","result":"é\\n"}' and got[1, "x"]["valid"] and got[1, "x"]["n_calls"] == 2 and got[1, "x"]["n_results"] == 2
    assert got[1, "y"]["error"] == ".a: not of type integer" and got[1, "z"]["error"] == "name without a schema" and got[1, "bad"]["error"] == ".: not JSON"
    assert got[2, "x"]["error"] == ".c: unknown" and got[2, "y"]["error"] == ".: not JSON" and json.loads(got[2, "w"]["record"])["arguments"] is None
    assert chat_format.link_tool_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_pipeline(spark, ranks):
    import corpus_pipeline as P
    from tests.llm.test_native import norm
    from tests.llm.test_pairs import shingles

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(P.STAGES)
    a = stages["language"](spark, docs, SF)
    assert a.columns == docs.columns and a.count() >= 0.97 * docs.count()
    odd = docs.limit(3).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(1).withColumn("text", F.lit("12 34")))
    assert stages["language"](spark, odd, SF).count() == 3
    b = stages["exact_dedup"](spark, docs, SF)
    texts = {norm(r["text"]) for r in docs.collect()}
    assert b.count() == len(texts)
    c = stages["near_dedup"](spark, b, SF)
    rows, kept = b.collect(), {r["doc_id"] for r in c.collect()}
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in rows}
    links = [(i, j) for i in sets for j in sets if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    from tests.llm.test_pairs import union_find

    assert kept == set(union_find(sets, links).values())
    d = stages["mixing"](spark, c, SF)
    assert d.columns == docs.columns
    e = P.run(spark, SF)
    assert set(e.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and e.count() > 50


def test_small_batches(spark):
    """Each stage with Python hands it a few MB of texts at a time, however many rows those are; a lower bound stays."""
    import corpus_pipeline as P

    @F.pandas_udf("long")
    def together(texts):
        return texts.str.len() * 0 + texts.str.len().sum()

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for stage in (P.keep_recognised, P.drop_near_copies, P.encode_texts):
        session = spark.newSession()
        docs = session.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.format_string("%d words", "id").alias("text"), F.lit("en").alias("lang"))
        stage(session, docs, SF)
        long = docs.withColumn("text", F.repeat(F.format_string("%04d", "doc_id"), 1000))
        assert long.agg(F.max(together("text"))).first()[0] < 3 << 20  # of 12 MB
        session.conf.set(name, "1m")
        stage(session, docs, SF)
        assert session.conf.get(name) == "1m"


def test_near_copies_by_row(spark):
    """Ids that repeat or are null: one row of each group stays, and no other row goes with a copy."""
    import corpus_pipeline as P

    long = {x: " ".join(f"{x}{i}" for i in range(40)) for x in "abcdef"}
    near = {x: t + f" {x}end" for x, t in long.items()}
    kept = [(1, long["a"], "k"), (7, long["b"], "k"), (None, long["c"], "k"), (8, long["e"], "k"), (5, long["f"], "k"), (7, "", "k"), (None, None, "k"), (None, None, "k")]
    gone = [(7, near["a"], "g"), (None, near["a"], "g"), (5, long["f"], "z"), (9, near["e"], "g"), (None, long["f"] + " more", "g")]
    docs = spark.createDataFrame(kept + gone, "doc_id long, text string, source string").repartition(3)
    got = [tuple(r) for r in P.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(got, key=repr) == sorted(kept, key=repr)
    same = spark.createDataFrame([(3, long["a"], "x"), (3, near["a"], "x"), (None, long["b"], "x"), (None, near["b"], "x")], docs.schema)
    left = [(r["doc_id"], r["text"][0]) for r in P.drop_near_copies(spark, same, SF).collect()]
    assert sorted(left, key=repr) == [(3, "a"), (None, "b")]
