"""Language identification: multinomial naive Bayes over hashed character n-grams."""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmill.llm.common import small_batches

#: Buckets of hashed n-grams, lengths of n-grams.
BUCKETS = 1 << 16
LENGTHS = (1, 2, 3)
#: Documents from which the model is learned at most: an even sample by a hash of the id.
SAMPLE = 20_000
#: Characters hashed at a time, so that very long texts need little memory.
SLICE = 1 << 18

UNKNOWN = "und"
_other = re.compile(r"[\W\d_]+")
_factors = (np.uint32(1), np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))


def letters(text: str | None) -> str:
    """Lower case with one space for each stretch of what is no letter; empty without a letter."""
    t = _other.sub(" ", (text or "").lower()).strip()
    return f" {t} " if t else ""


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each code point but the last n - 1."""
    m = max(0, len(codes) - n + 1)
    h = np.full(m, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ codes[k : k + m]) * _factors[1]
            h ^= h >> np.uint32(15)
        h *= _factors[2]
    return (h >> np.uint32(16)).astype(np.int64) % BUCKETS


def bucket_counts(t: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams and how often each occurs."""
    codes = _codes(t)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(codes), SLICE):
        for n in LENGTHS:
            total += np.bincount(grams(codes[at : at + SLICE + n - 1], n), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def _codes(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # buckets x languages
    log_prior: np.ndarray

    def _sums(self, texts: list[str]) -> np.ndarray:
        """Row of n-gram counts times log_p for each text: all n-grams of all texts are hashed at once and summed by text."""
        codes = _codes("".join(texts))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(size) - size
        row = np.repeat(np.arange(len(texts)), size)
        out = np.zeros((len(texts), len(self.languages)))
        for n in LENGTHS:
            s = self.log_p[grams(codes, n)]
            s[row[: len(s)] != row[n - 1 :]] = 0  # no n-gram reaches into the next text
            filled = begin < len(s)
            out[filled] += np.add.reduceat(s, begin[filled], axis=0)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The likeliest language of each text and its share of the likelihood."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        held, size = [], 0

        def settle(rows: list[int], sums: np.ndarray) -> None:
            s = sums + self.log_prior
            best = s.argmax(axis=1)
            share = 1 / np.exp(np.clip(s - s.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
            for i, k, p in zip(rows, best.tolist(), share.tolist(), strict=True):
                out[i] = self.languages[k], p

        for i, text in enumerate(texts if self.languages else []):
            t = letters(text)
            if len(t) > SLICE:  # alone, by its counts
                at, n = bucket_counts(t)
                settle([i], (n @ self.log_p[at])[None, :])
            elif t:
                held.append((i, t))
                size += len(t)
            if held and (size > SLICE or i == len(texts) - 1):
                settle([k for k, _ in held], self._sums([x for _, x in held]))
                held, size = [], 0
        return out


def fit(docs: DataFrame, sample: int = SAMPLE, smoothing: float = 0.1, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from rows with a language and a text; rows to hold out are filtered by the caller.

    At most about ``sample`` documents, chosen by a hash of the id, whole
    texts. Counts are summed per partition, then by Spark; the driver gets one
    row per language and bucket at most. Without rows, a model without
    languages.
    """
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    total = rows.select(key).count()
    part = min(1.0, sample / max(1, total))
    if part < 1:
        rows = rows.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(part * 1_000_000))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for b in batches:
            for t, g in zip(b[text], b[lang], strict=True):
                if t := letters(t):
                    at, k = bucket_counts(t)
                    sums.setdefault(g, np.zeros(BUCKETS, np.int64))[at] += k
                    n[g] = n.get(g, 0) + 1
        for g, x in sums.items():
            at = np.flatnonzero(x)
            yield pd.DataFrame({"lang": g, "bucket": np.append(at, -1).astype(np.int32), "n": np.append(x[at], n[g])})

    counts = rows.select(text, lang).mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    c = np.zeros((BUCKETS, len(languages)))
    prior = np.zeros(len(languages))
    where = counts["lang"].map({g: i for i, g in enumerate(languages)}).to_numpy(dtype=np.int64)
    real = (counts["bucket"] >= 0).to_numpy()
    c[counts["bucket"].to_numpy()[real], where[real]] = counts["n"].to_numpy()[real]
    prior[where[~real]] = counts["n"].to_numpy()[~real]
    log_p = np.log((c + smoothing) / (c.sum(axis=0) + smoothing * BUCKETS))
    return Model(languages, log_p, np.log(prior / max(1.0, prior.sum())) if len(languages) else prior)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1), in place of columns of these names. Only the text is an input.

    A null text, or one without a letter, is ``und`` with score 0. The matrix
    is broadcast: buckets x languages doubles, whatever the input's size.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.predict(list(texts)), columns=["lang_pred", "score"])

    found = docs.select(F.struct("*").alias("d"), of(F.col(text)).alias("p"))
    return found.select(*[F.col("d")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score")], "p.lang_pred", "p.score")


def accepted(lang_pred: Column, score: Column, least: float = 0.5) -> Column:
    """What a corpus keeps: a recognised language, more likely than all others together."""
    return (lang_pred != UNKNOWN) & (score >= least)
