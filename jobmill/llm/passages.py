"""Texts that share a passage of so many words with another text."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmill.llm.bytes64 import BLOCK, Ranges, utf8
from jobmill.llm.common import cut, free, only
from jobmill.llm.jaccard_join import text_words

#: Words whose hash chooses the anchor of a window.
GRAM = 8


def anchored(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Ranges]:
    """Windows of ``length`` words in runs that share an anchor: first window, last window, hash of the anchor's words.

    The anchor of a window is its leftmost gram with the smallest hash, so
    equal windows have equal anchors.
    """
    h = Ranges(words)
    at = np.arange(len(words) - GRAM + 1)
    gram = h.of(at, at + GRAM)
    packed = (gram >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    wide = np.lib.stride_tricks.sliding_window_view(packed, length - GRAM + 1)
    anchor = (wide.min(axis=1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], len(anchor)) - 1
    return first, last, gram[anchor[first]].view(np.int64), h


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """docs(row, t) to row, key (of the anchor), span (hash of all words of the run)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keys, spans = [], [], []
            for i, w in enumerate(text_words(*utf8(b.column("t")))):
                if len(w) >= length:
                    first, last, key, h = anchored(w, length)
                    rows.append(np.full(len(key), i))
                    keys.append(key)
                    spans.append(h.of(first, last + length).view(np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(keys)), pa.array(np.concatenate(spans))], names=["row", "key", "span"])

    return docs.mapInArrow(of, "row long, key long, span long")


def _windows(docs: DataFrame, length: int) -> DataFrame:
    """docs(row, t, keys) to row, window: hash of each window whose anchor is among the keys."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, rows, found, size = b.column("keys"), [], [], 0
            for i, w in enumerate(text_words(*utf8(b.column("t")))):
                first, last, key, h = anchored(w, length)
                wanted = np.isin(key, lists[i].values.to_numpy(zero_copy_only=False))
                count = (last - first + 1)[wanted]
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[wanted], count)
                rows.append(np.full(len(at), i))
                found.append(h.of(at, at + length).view(np.int64))
                size += len(at)
                if size > BLOCK or i == len(lists) - 1:
                    yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(found))], names=["row", "window"])
                    rows, found, size = [], [], 0

    return docs.mapInArrow(of, "row long, window long")


def _in_two(rows: DataFrame, by: list[str]) -> DataFrame:
    """The groups that two different rows are in."""
    return rows.groupBy(*by).agg(F.min("row").alias("_a"), F.max("row").alias("_b")).filter("_a <> _b").select(*by)


def shared_passages(docs: DataFrame, length: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (doc, h): key and xxhash64 of the texts that hold ``length`` words in a row which another text holds too.

    Words are stretches without white space, A to Z in lower case; another text
    is one with another key or other bytes. Texts of fewer words, empty and
    null ones are absent. Windows meet by their anchor, a few words chosen by
    their hash: runs of windows that agree as a whole settle most; of the rest,
    windows are compared one by one. Words and windows stand by 64-bit hashes.
    """
    h = F.xxhash64(text)
    rows = docs.select(F.xxhash64(F.col(key), h).alias("row"), F.col(text).alias("t"))
    runs = cut(_runs(rows, length).distinct())
    met = cut(runs.join(cut(_in_two(runs, ["key"])), "key"))
    free(runs)
    whole = met.join(_in_two(met, ["key", "span"]), ["key", "span"], "left_semi")
    found = cut(whole.select("row").distinct())
    # a run that is the only one of its bytes may share windows with the others of its anchor
    kinds = met.groupBy("key", "span").agg(F.min("row").alias("row"))
    open_ = met.join(found, "row", "left_anti").select("key").distinct()
    doubt = cut(kinds.join(open_, "key", "left_semi").groupBy("row").agg(F.collect_set("key").alias("keys")))
    texts = only(rows, doubt, ["row"]).dropDuplicates(["row"])
    windows = _windows(texts.join(doubt, "row").select("row", "t", "keys"), length)
    windows = cut(windows.distinct())
    # all rows of a run share what its first row shares
    more = windows.join(_in_two(windows, ["window"]), "window", "left_semi").select("row").distinct()
    every = cut(found.unionByName(more).distinct())
    free(met, found, doubt, windows)
    ids = docs.select(F.col(key).alias("doc"), h.alias("h")).withColumn("row", F.xxhash64("doc", "h"))
    return ids.join(every, "row", "left_semi").select("doc", "h").distinct()
