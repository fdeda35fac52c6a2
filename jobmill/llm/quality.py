"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates."""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmill.llm.common import cut, free

#: Buckets of hashed n-grams, one more for the intercept; lengths of word n-grams and of n-grams of word shapes.
BUCKETS = 1 << 18
WORDS, SHAPES = (1, 2), (1, 2, 3)
#: Labelled documents from which the model is learned at most: an even sample by a hash of the key.
SAMPLE = 20_000
#: Documents that a task learns from in one pass, passes over the sample.
SHARD, PASSES = 2_500, 6
#: Step size, its damping, and the weights of both regularisers.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Characters of a text that are cut into words at once, and words remembered.
PIECE, MEMORY = 1 << 20, 1 << 18
PREDICTED = 0.7

_token = re.compile(r"\w+|[^\w\s]+")
_M = np.uint32(0x9E3779B1)


class _Hashes(dict):
    """Word to two hashes in one number: of its lower-case form, and of its shape (case of letters, digits, or the marks themselves)."""

    def __missing__(self, w: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        if w[0].isalnum() or w[0] == "_":
            shape = "9" if w.isdigit() else "A" if len(w) > 1 and w.isupper() else "Aa" if w[:1].isupper() else "a" if w.islower() else "?"
        else:
            shape = w[:8]
        h = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(b"\0" + shape.encode("utf-8", "surrogatepass"))
        self[w] = h
        return h


_hashes = _Hashes()


def _words(text: str) -> Iterator[list[str]]:
    if len(text) <= PIECE:
        yield _token.findall(text)
        return
    found = (m.group() for m in _token.finditer(text))
    while part := list(islice(found, PIECE // 4)):
        yield part


def _buckets(h: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams that end in one of the words, given two numbers a word; the first ones may lie before the piece."""
    word, shape = (h >> np.uint64(32)).astype(np.uint32), h.astype(np.uint32)
    again = np.zeros(len(h), np.uint32)
    again[1:] = word[1:] == word[:-1]
    shape = shape ^ (again * np.uint32(0x5BD1E995))  # a word that repeats the last one has a shape of its own
    out = []
    with np.errstate(over="ignore"):
        for salt, x, lengths in ((1, word, WORDS), (2, shape, SHAPES)):
            g = np.full(len(x), salt, np.uint32)
            for n in range(1, max(lengths) + 1):
                g = (g[: len(x) - n + 1] ^ x[n - 1 :]) * _M
                g ^= g >> np.uint32(15)
                if n in lengths:
                    out.append(((g * np.uint32(0x85EBCA77)) >> np.uint32(32 - 18)).astype(np.int64))
    return np.concatenate(out)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and the root of each one's share of all n-grams; then the intercept with 1.

    The whole text is read, long ones piece by piece. Null counts as empty.
    """
    total: dict | np.ndarray | None = None
    tail = np.zeros(0, np.uint64)
    reach = max(*WORDS, *SHAPES)  # words of the piece before that n-grams of this one reach, and one more for repetition
    at, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for words in _words(text or ""):
        h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
        b = np.bincount(_buckets(np.concatenate([tail, h])), minlength=BUCKETS) if total is not None or len(words) > BUCKETS else None
        if len(tail) and b is not None:
            b -= np.bincount(_buckets(tail), minlength=BUCKETS)  # counted with the piece before
        tail = np.concatenate([tail, h])[-reach:]
        if b is None:
            at, n = np.unique(_buckets(h), return_counts=True) if len(h) else (at, n)
            total = np.bincount(at, weights=n, minlength=BUCKETS).astype(np.int64) if len(text or "") > PIECE else None
        else:
            total = b if total is None else total + b
    if total is not None:
        at = np.flatnonzero(total)
        n = total[at]
    return np.append(at, BUCKETS), np.append(np.sqrt(n / max(1, n.sum())), 1.0)


def step(z: np.ndarray, n: np.ndarray, at: np.ndarray, x: np.ndarray, y: float) -> None:
    """One follow-the-regularised-leader update of the sums z and n for an example; the last bucket isn't regularised."""
    w = weights(z[at], n[at], at == BUCKETS)
    g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
    root = np.sqrt(n[at] + g * g)
    z[at] += g - (root - np.sqrt(n[at])) / ALPHA * w
    n[at] += g * g


def weights(z: np.ndarray, n: np.ndarray, free_: np.ndarray) -> np.ndarray:
    """The leader for the sums: 0 within L1, else what the regularised sum of gradients asks for."""
    l1, l2 = np.where(free_, 0.0, L1), np.where(free_, 0.0, L2)
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))


@dataclass
class Model:
    z: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + 1))

    def weights(self) -> np.ndarray:
        return weights(self.z, self.n, np.arange(BUCKETS + 1) == BUCKETS)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learns from docs whose key has a label; rows to hold out are filtered by the caller.

    At most about ``sample`` labelled keys are used, whole texts, chosen by a
    hash of the key; of several labels of a key the greatest counts. Features
    are written once. In each pass every SHARD documents, in order of a hash,
    go through one task that starts from the last pass's sums; the passes' sums are means over
    the shards, weighted by documents. The driver gets the model only: two
    numbers a bucket and shard. Without labelled texts the score is 0.5.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.max(label) > 0).cast("double").alias("y"))
    total = known.count()
    if total > sample:
        known = known.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * sample / total))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [features(t) for t in b["text"]]
            yield pd.DataFrame({"shard": b["shard"], "place": b["place"], "y": b["y"], "at": [a.astype("<i4").tobytes() for a, _ in found], "x": [x.astype("<f4").tobytes() for _, x in found]})

    shards = max(1, -(-min(total, sample) // SHARD))
    place = F.xxhash64(F.col(key), F.lit(1))
    # the sample is bounded, so it can be broadcast and no text moves
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(known), key).select(F.pmod(place, F.lit(shards)).cast("int").alias("shard"), place.alias("place"), "y", "text")
    table = cut(rows.mapInPandas(extract, "shard int, place long, y double, at binary, x binary"))
    model = Model()
    for _ in range(PASSES):
        model = _pass(table, model)
    free(table)
    return model


def _pass(table: DataFrame, model: Model) -> Model:
    shared = table.sparkSession.sparkContext.broadcast((model.z, model.n))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, seen, z, n = None, 0, None, None

        def result() -> list[pd.DataFrame]:
            if not seen:
                return []
            at = np.flatnonzero(n)
            return [pd.DataFrame({"seen": [seen], "at": [at.astype("<i4").tobytes()], "z": [z[at].tobytes()], "n": [n[at].tobytes()]})]

        for b in batches:
            for r in b.itertuples():
                if r.shard != shard:
                    yield from result()
                    shard, seen, (z, n) = r.shard, 0, (x.copy() for x in shared.value)
                step(z, n, np.frombuffer(r.at, "<i4"), np.frombuffer(r.x, "<f4").astype(float), r.y)
                seen += 1
        yield from result()

    parts = table.repartition("shard").sortWithinPartitions("shard", "place", "y", "at").mapInPandas(learn, "seen long, at binary, z binary, n binary").collect()
    total = sum(r["seen"] for r in parts)
    out = Model()
    for r in sorted(parts, key=lambda r: (r["seen"], bytes(r["z"]))):
        at = np.frombuffer(r["at"], "<i4")
        out.z[at] += r["seen"] / total * np.frombuffer(r["z"])
        out.n[at] += r["seen"] / total * np.frombuffer(r["n"])
    shared.unpersist()
    return out


def score(docs: DataFrame, model: Model, text: str = "text", least: float = PREDICTED) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= ``least``, else 0), in place of columns of these names. Only the text is an input.

    A score is the sparse dot product of weights and features. A null or empty
    text has the score of the intercept. The weights are broadcast: one a bucket.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.weights())

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        w = shared.value
        sums = [float(w[at] @ x) for at, x in map(features, texts)]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(sums, float), -35, 35))))

    scored = docs.withColumn("score", of(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
