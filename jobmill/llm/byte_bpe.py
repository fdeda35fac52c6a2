"""Byte-level BPE encoding and decoding with a given rank file.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that
is itself a vocabulary entry, for a whole batch of distinct pre-tokens at once.
Tier two: the rest is merged by a heap over a doubly linked list of its bytes.
Nothing is trained. The work is per row: no shuffle.
"""

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill.llm.common import small_batches

#: Pre-tokens with their ids that a task keeps: so many of late, and as many from before, of which those met again are kept on.
KEPT = 120_000
#: Characters of texts whose new pre-tokens are looked up together.
BLOCK = 1 << 19

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit keys over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hash_keys(keys: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, all at once. No key may be empty."""
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(keys), np.uint8).astype(np.uint64) + np.uint64(1)
    at = (np.arange(len(data)) - np.repeat(starts, lengths)).astype(np.uint64)
    with np.errstate(over="ignore"):
        return _mix(np.add.reduceat(_mix(data + at * _MULTIPLIER), starts) + lengths.astype(np.uint64))


class PerfectHash:
    """Minimal perfect hash by displacement: n keys fill slots 0 to n - 1.

    Keys fall into buckets; the largest buckets first, each gets the first
    displacement that sends all its keys to free slots. A look-up computes one
    slot and compares the stored key, so strangers are told apart.
    """

    def __init__(self, keys: list[bytes], values: list[int], load: int = 4):
        n = len(keys)
        h = hash_keys(keys)
        if len(np.unique(h)) != n:
            raise ValueError("two keys share a 64-bit hash")
        self.n, self.buckets = n, max(1, n // load)
        self.displacement = np.zeros(self.buckets, np.uint64)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        taken = np.zeros(n, bool)
        slot_of = np.zeros(n, np.int64)
        for b in sorted(range(self.buckets), key=lambda b: edges[b] - edges[b + 1]):
            members = order[edges[b] : edges[b + 1]]
            if not len(members):
                break
            own = h[members]
            d = 0
            while True:
                tries = self._slot(own[None, :], np.arange(d, d + 64, dtype=np.uint64)[:, None])
                free = ~taken[tries].any(axis=1)
                if len(members) > 1:
                    t = np.sort(tries, axis=1)
                    free &= (t[:, 1:] != t[:, :-1]).all(axis=1)
                if free.any():
                    k = int(np.argmax(free))
                    self.displacement[b] = d + k
                    taken[tries[k]] = True
                    slot_of[members] = tries[k]
                    break
                d += 64
        self.hashes = np.zeros(n, np.uint64)
        self.hashes[slot_of] = h
        self.keys: list[bytes] = [b""] * n
        self.values = np.zeros(n, np.int64)
        self.values[slot_of] = values
        for key, s in zip(keys, slot_of.tolist(), strict=True):
            self.keys[s] = key

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_mix(h + (d + np.uint64(1)) * _MULTIPLIER) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> list[int]:
        """The value of each key, -1 for strangers."""
        h = hash_keys(keys)
        slot = self._slot(h, self.displacement[(h % np.uint64(self.buckets)).astype(np.int64)])
        value = np.where(self.hashes[slot] == h, self.values[slot], -1).tolist()
        return [v if v < 0 or self.keys[s] == k else -1 for v, s, k in zip(value, slot.tolist(), keys, strict=True)]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank, leftmost first, merges until none is left."""
    n = len(piece)
    end = list(range(1, n + 1))  # part i is piece[i:end[i]]; the part that begins at end[i] follows; 0 for a part that is gone
    back = list(range(-1, n - 1))
    rank = ranks.get
    # an entry is rank, start and end of a pair in one number
    width = n.bit_length()
    mask = (1 << width) - 1
    heap = [(((r << width) | i) << width) | (i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        pair = pop(heap)
        i, stop = (pair >> width) & mask, pair & mask
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two has changed since
        end[i], end[j] = stop, 0
        if stop < n:
            back[stop] = i
            if (r := rank(piece[i : end[stop]])) is not None:
                push(heap, (((r << width) | i) << width) | end[stop])
        if (k := back[i]) >= 0 and (r := rank(piece[k:stop])) is not None:
            push(heap, (((r << width) | k) << width) | stop)
    return [ranks[piece[i : end[i]]] for i in range(n) if end[i]]


class Codec:
    """Encodes and decodes texts; one per partition, so that workers keep nothing for later stages."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, whole: PerfectHash):
        self.ranks, self.whole = ranks, whole
        self.split = regex.compile(pattern).findall
        self.seen: dict[str, str] = {}
        self.before: dict[str, str] = {}
        self.bytes_of = {str(rank): token for token, rank in ranks.items()}

    def learn(self, new: list[str]) -> None:
        """Ids of new pre-tokens, as decimal text with spaces between."""
        raw = [p.encode() for p in new]
        for p, b, v in zip(new, raw, self.whole.find(raw), strict=True):
            self.seen[p] = str(v) if v >= 0 else " ".join(map(str, merge_bytes(b, self.ranks)))

    def encode(self, texts: list[str]) -> Iterator[str]:
        """Decimal ids of each text, one space between. New pre-tokens are learned for some MB of text at a time."""
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and (not part or size < BLOCK):
                part.append(self.split(texts[at]))
                size += len(texts[at])
                at += 1
            if len(self.seen) > KEPT:
                self.before, self.seen = self.seen, {}
            seen, before = self.seen, self.before
            new = [p for p in set().union(*part) if p not in seen]
            seen.update((p, before[p]) for p in new if p in before)
            if new := [p for p in new if p not in seen]:
                self.learn(new)
            for pieces in part:
                yield " ".join(map(seen.__getitem__, pieces))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


def share(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """Reads the ranks, builds the perfect hash once on the driver and broadcasts both: their size is the file's. Texts then come in small batches."""
    small_batches(spark)
    ranks = load_ranks(path)
    return spark.sparkContext.broadcast((ranks, pattern, PerfectHash(list(ranks), list(ranks.values()))))


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, ids (array of int). Null texts count as empty and have no id."""
    shared = share(docs.sparkSession, path, pattern)

    @F.pandas_udf("array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = Codec(*shared.value)
        for texts in batches:
            yield pd.Series([np.array(s.split(" "), np.int32) if s else np.zeros(0, np.int32) for s in c.encode([t or "" for t in texts])], dtype=object)

    return docs.select(key, of(F.col(text)).alias("ids"))


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of encoded: key, text. Null ids count as none; bytes that are not UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in load_ranks(path).items()})

    @F.pandas_udf("string")
    def of(lists: pd.Series) -> pd.Series:
        token = shared.value
        return pd.Series([b"".join(token[i] for i in x).decode("utf-8", "replace") if x is not None else "" for x in lists], dtype=object)

    return encoded.select(key, of(F.col(ids)).alias("text"))


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_tokens, ids_sha256, decoded_sha256 (of the ids decoded again).

    The whole text is encoded, in one piece, as pre-tokens may be of any
    length. Null texts count as empty. Repeated rows are encoded each.
    """
    shared = share(docs.sparkSession, path, pattern)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = Codec(*shared.value)
        for texts in batches:
            n, of_ids, of_text = [], [], []
            for ids in c.encode([t or "" for t in texts]):
                n.append(ids.count(" ") + 1 if ids else 0)
                of_ids.append(hashlib.sha256(ids.encode()).hexdigest())
                of_text.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pd.DataFrame({"n_tokens": np.array(n, np.int64), "ids_sha256": np.array(of_ids, object), "decoded_sha256": np.array(of_text, object)})

    return docs.select(key, of(F.col(text)).alias("d")).select(key, "d.*")
