"""Toxicity scores: a lexicon trie walked by Levenshtein automata, weighed by context windows."""

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmill.llm.common import cut, few, free

#: Labelled documents from which the model is learned at most: an even sample by a hash of the id.
SAMPLE = 20_000
#: Terms that the model, which is broadcast, may have; more stop the job.
TERMS = 50_000
#: An edit leaves at most so much of a term's weight.
EDIT = 0.85
#: Misspelled uses of a term presumed for each exact one, until the sample shows more.
MISSPELLED = 0.2
#: How far from a word stand those by which copies of its surroundings are known.
REACH = 6
#: What a quoted hit weighs before the sample says otherwise, and at least, as a share of one that is not quoted.
QUOTED, LEAST_QUOTED = 0.5, 0.1
#: Beginnings of words that may be terms themselves, whatever follows them.
STEM_LENGTHS = range(4, 8)
#: Words on either side of a hit that decide whether it is quoted.
WINDOW = 4
#: Words a Python worker keeps at most with what they match; beyond it starts anew.
KEPT = 150_000

#: Quotation marks, and words that report what somebody else said.
QUOTES = frozenset("\"'“”„«»‘’‚‹›`")
REPORTING = frozenset("said says say wrote writes called calls word words term terms quote quoted quoting dit mot appelé sagte wort nannte zitat dijo palabra llamó".split())
EDGES = ".,;:!?()[]{}<>*#%&$@~^_=+|/\\-…" + "".join(sorted(QUOTES))


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Lexicon:
    """Terms in a trie, and the automaton that reads words along it.

    A state is a set of (trie node, edits so far): the union of the terms'
    Levenshtein automata, each confined to the trie. States are made as words
    need them and kept, so a word costs one dictionary look-up a letter.
    """

    def __init__(self, terms: dict[str, int], stems: set[str]):
        """terms: edits allowed for each whole word. stems: beginnings, met exactly."""
        self.terms, self.stems = terms, stems
        self.children: list[dict[str, int]] = [{}]
        self.most = [0]  # edits that some term below allows
        self.ends: list[str | None] = [None]
        self.is_stem = [False]
        for term, k in {**dict.fromkeys(stems, 0), **terms}.items():
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                    self.ends.append(None)
                    self.is_stem.append(False)
                self.most[node] = max(self.most[node], k)
                node = self.children[node][c]
            self.most[node] = max(self.most[node], k)
            if term in terms:
                self.ends[node] = term
            self.is_stem[node] = term in stems
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The state of the nodes reached with fewest edits, and of those that skipping letters of terms adds."""
        todo = list(reached.items())
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and reached.get(child, 99) > e + 1:
                    reached[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(reached.items()))
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}
        for node, e in self.sets[state]:
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= (self.most[child] if cost else 0) and reached.get(child, 99) > cost:
                    reached[child] = cost
            if e + 1 <= self.most[node] and reached.get(node, 99) > e + 1:
                reached[node] = e + 1  # a letter too many
        self.steps[state][c] = to = self._state(reached)
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The term nearest to the word and its edits, else a stem that begins it, or None."""
        state, stem = self.start, None
        for at, c in enumerate(word):
            state = self.steps[state].get(c, -1) if c in self.steps[state] else self._step(state, c)
            found = self.sets[state]
            if not found:
                break
            if at + 1 >= STEM_LENGTHS.start and stem is None:
                stem = next((word[: at + 1] for node, e in found if e == 0 and self.is_stem[node]), None)
        best = min(((e, t) for node, e in self.sets[state] if (t := self.ends[node]) is not None and e <= self.terms[t]), default=None) if len(word) else None
        return (best[1], best[0]) if best else (stem + "*", 0) if stem else None


def bare(word: str) -> str:
    return word.lower().strip(EDGES)


def features_of(text: str | None) -> set[str]:
    """Words of the text, and beginnings of words with a star."""
    words = {bare(w) for w in (text or "").split()} - {""}
    return words | {w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n}


@dataclass
class Model:
    lexicon: Lexicon
    weights: dict[tuple[str, int], float]  # by term and edits
    barred: frozenset[str] = frozenset()  # words near a term that clean texts use: never a misspelling
    coefficients: list[float] = field(default_factory=lambda: [-2.0, 1.0, 0.0])
    kept: dict[str, tuple[str, int] | None] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": {}}

    def hits(self, text: str | None) -> list[tuple[str, int, bool]]:
        """Term, edits, quoted, for each word that matches; of a learned model, for each that has a weight."""
        return [h[:3] for h in self.found(text)]

    def found(self, text: str | None) -> list[tuple[str, int, bool, str]]:
        """The hits, each with its word."""
        words = (text or "").split()
        kept, every = self.kept, set(words)
        new = [w for w in every if w not in kept]
        if len(kept) + len(new) > KEPT:
            kept.clear()
            new = list(every)
        for w in new:
            b = bare(w)
            m = None if b in self.barred else self.lexicon.match(b)
            kept[w] = m if not self.weights or m in self.weights else None
        if not any(map(kept.get, every)):
            return []
        out = []
        for i, w in enumerate(words):
            if m := kept[w]:
                out.append((*m, is_quoted(words, i), bare(w)))
        return out

    def inputs(self, hits: list[tuple[str, int, bool]]) -> tuple[float, float]:
        """Logarithms of the weight of hits that abuse and of hits that are quoted."""
        sums = [0.0, 0.0]
        for term, edits, quoted in hits:
            sums[quoted] += self.weights.get((term, edits), 0.0)
        return math.log1p(sums[0]), math.log1p(sums[1])

    def score(self, text: str | None) -> float:
        a, q = self.inputs(self.hits(text))
        b = self.coefficients
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, b[0] + b[1] * a + b[2] * q))))


def is_quoted(words: list[str], i: int) -> bool:
    """Whether the window around word i holds a quotation: marks on both sides, or a reporting word before it."""
    before, after = words[max(0, i - WINDOW) : i + 1], words[i : i + WINDOW + 1]
    opened = any(w[0] in QUOTES for w in before)
    closed = any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in after)
    return opened and closed or any(bare(w) in REPORTING for w in before[:-1])


#: Terms and misspellings of less weight, the logarithm of a ratio of rates, are none.
LEAST = math.log(5)


def _strength(t: float, n_t: int, c: int, n_c: int) -> float:
    return math.log(((t + 0.5) / (n_t + 1)) / ((c + 0.5) / (n_c + 1)))


def _telling(n_t: int, n_c: int) -> Column:
    """Whether a feature of ``a`` toxic and ``b`` clean documents is toxic: ten times as often, and by a likelihood ratio beyond chance."""
    a, b = F.col("a"), F.col("b")
    mean = (a + b) / max(1, n_t + n_c)
    evidence = 2 * (a * F.ln(a / (mean * n_t)) + F.when(b > 0, b * F.ln(b / (mean * n_c))).otherwise(0.0))
    return (((a + 0.5) / (n_t + 1)) / ((b + 0.5) / (n_c + 1)) >= 10) & (evidence >= 22)


def _counts(rows: DataFrame, wanted: frozenset | None) -> DataFrame:
    """Number of documents with each feature; of the wanted ones only, if given."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                f = features_of(t)
                n.update(f if wanted is None else f & wanted)
                if len(n) > 200_000:
                    yield pd.DataFrame({"feature": np.array(list(n), object), "n": np.array(list(n.values()), np.int64)})
                    n.clear()
        yield pd.DataFrame({"feature": np.array(list(n), object), "n": np.array(list(n.values()), np.int64)})

    return rows.select("text").mapInPandas(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _originals(rows: DataFrame, wanted: frozenset | None) -> DataFrame:
    """Number of documents with each feature that are no copies in part of one another; of the wanted features only, if given.

    A feature's contexts are the two words REACH before it and the two REACH
    after it, where the text goes so far; the whole text, where it goes so far on
    neither side. A document counts for a feature if it is the first, by a hash
    of its text, in each of its contexts: of copies, near copies and texts with
    shared passages, one does.
    """

    def occur(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t, doc in zip(b["text"], b["doc"], strict=True):
                words, out = [bare(w) for w in (t or "").split()], set()
                for i, w in enumerate(words):
                    fs = [f for f in (w, *(w[:n] + "*" for n in STEM_LENGTHS if len(w) > n)) if f and (wanted is None or f in wanted)]
                    if fs:
                        left = ["< " + " ".join(words[i - REACH : i - REACH + 2])] if i >= REACH else []
                        right = ["> " + " ".join(words[i + REACH - 1 : i + REACH + 1])] if i + REACH < len(words) else []
                        out.update((f, doc, c) for f in fs for c in left + right or [str(doc)])
                yield pd.DataFrame(list(out), columns=["feature", "doc", "context"]).astype({"doc": "int64"})

    seen = rows.select("text", F.xxhash64("text").alias("doc")).mapInPandas(occur, "feature string, doc long, context string")
    first = seen.withColumn("first", F.min("doc").over(Window.partitionBy("feature", "context")))
    return first.groupBy("feature", "doc").agg(F.bool_and(F.col("first") == F.col("doc")).alias("own")).groupBy("feature").agg(F.count_if("own").alias("originals"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton's method with bounded steps, ridge on all but the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    b, penalty = np.zeros(x.shape[1]), np.array([1e-3, *[ridge] * (x.shape[1] - 1)])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * b)
        step *= min(1.0, 1.0 / np.abs(step).max())
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: int = 4, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns lexicon, weights and scale from docs whose key has a label; rows to hold out are filtered by the caller.

    At most about ``sample`` labelled rows are used, whole texts, chosen by a
    hash of the key; a key that repeats in docs stands for all its rows. A term
    must occur in ``least`` toxic documents, ten times as often as in clean
    ones and beyond chance. All of this must hold again when toxic documents
    that share surroundings of it count once, and clean ones each, or the words
    of a copied text would be terms.
    Features are counted and tested by Spark, the driver gets those that pass.

    A word with k edits has at most EDIT ** k of its term's weight, less where
    clean texts hold words as far from the term. Such words, once seen, are
    barred themselves; how many words are in one document only, toxic or clean,
    tells what words the sample lacks are worth (Good and Turing's estimate). Words
    with more edits must besides be toxic by the count of all of them, barred ones too. A
    quoted hit has QUOTED of the weight, moved by the quoted hits of the sample.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("y"))
    total = known.count()
    if total > sample:
        known = known.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    # the sample is bounded, so it can be broadcast and no text moves
    rows = cut(docs.select(key, F.col(text).alias("text")).join(F.broadcast(known), key).select("text", "y"))
    sizes = {r["y"] > 0: r["n"] for r in rows.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    n_t, n_c = sizes.get(True, 0), sizes.get(False, 0)
    toxic = cut(_counts(rows.filter("y > 0"), None).filter(F.col("n") >= least))
    # a small set of features is sent to where documents are counted; a large one meets all their features in a join
    wanted = frozenset(r["feature"] for r in toxic.select("feature").collect()) if few(toxic) else None
    both = toxic.withColumnRenamed("n", "a").join(_counts(rows.filter("y <= 0"), wanted).withColumnRenamed("n", "b"), "feature", "left").fillna(0, "b")
    best = cut(both.filter(_telling(n_t, n_c)).select("feature", F.col("a").alias("n"), "b"))
    wanted = frozenset(r["feature"] for r in best.select("feature").collect()) if few(best) else None
    own = best.join(_originals(rows.filter("y > 0"), wanted).withColumnRenamed("originals", "a"), "feature").filter(F.col("a") >= least)
    t = {r["feature"]: r["n"] for r in own.filter(_telling(n_t, n_c)).select("feature", "n").limit(TERMS + 1).collect()}
    if len(t) > TERMS:
        raise ValueError(f"more than {TERMS} terms: no model to broadcast")
    stems = {f[:-1] for f in t if f.endswith("*")}
    stems = {s for s in stems if not any(s[:n] in stems for n in range(STEM_LENGTHS.start, len(s)))}
    words = {f for f in t if not f.endswith("*")}
    # a whole word explains its beginnings: keep a stem only if it says more than the words that begin with it
    stems = {s for s in stems if t[s + "*"] > 1.2 * max((t[w] for w in words if w.startswith(s) and w != s), default=0)}
    lexicon = Lexicon({w: edits_allowed(w) for w in words}, stems)
    probe = Model(lexicon, {})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [probe.found(x) for x in b["text"]]
            yield pd.DataFrame({"y": b["y"]} | {name: [[h[i] for h in f] for f in found] for i, name in enumerate(("term", "edits", "quoted", "form"))})

    hit = rows.select("text", F.col("y").cast("int").alias("y")).mapInPandas(find, "y int, term array<string>, edits array<int>, quoted array<boolean>, form array<string>").collect()
    free(rows, toxic, best)
    seen = [(r["y"] > 0, list(zip(r["term"], r["edits"], r["quoted"], r["form"], strict=True))) for r in hit]
    forms = {True: Counter(), False: Counter()}
    for y, hits in seen:
        forms[y].update({(term, k, form) for term, k, _, form in hits if k})
    barred = {key for key, b in forms[False].items() if _strength(forms[True][key], n_t, b, n_c) <= LEAST}
    once = {y: Counter(key[:2] for key, n in forms[y].items() if n == 1 and not forms[not y][key]) for y in forms}
    every, of = ({True: Counter(), False: Counter()} for _ in range(2))
    for y, hits in seen:
        every[y].update({h[:2] for h in hits})
    seen = [(y, [h[:3] for h in hits if (h[0], h[1], h[3]) not in barred]) for y, hits in seen]
    for y, hits in seen:
        of[y].update({h[:2] for h in hits})
    weights = {}
    for term in {*words, *(s + "*" for s in stems)}:
        exact = _strength(of[True][(term, 0)], n_t, of[False][(term, 0)], n_c)
        for k in range(lexicon.terms.get(term, 0) + 1):
            s = exact
            if k:
                s = min(exact * EDIT**k, _strength(max(once[True][(term, k)], MISSPELLED * of[True][(term, 0)]), n_t, once[False][(term, k)], n_c))
            if k > 1 and (b := every[False][(term, k)]):
                s = min(s, _strength(every[True][(term, k)], n_t, b, n_c))
            if s > LEAST:
                weights[(term, k)] = s
    model = Model(lexicon, weights, frozenset(form for _, _, form in barred))
    x = np.array([model.inputs(hits) for _, hits in seen]).reshape(-1, 2)
    y = np.array([float(y) for y, _ in seen])
    if 0 < y.sum() < len(y):
        # the second coefficient says how far quoted hits depart from their share; without any it is 0
        b = _logistic(np.column_stack([x[:, 0] + QUOTED * x[:, 1], x[:, 1]]), y)
        plain = max(0.0, float(b[1]))
        model.coefficients = [float(b[0]), plain, min(plain, max(LEAST_QUOTED * plain, QUOTED * plain + float(b[2])))]
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5, else 0), in place of columns of these names. Only the text is an input.

    Whole texts are read; a null or empty text has the score of a text without
    hits. The model is broadcast: TERMS terms at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype=float)

    scored = docs.withColumn("score", of(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
