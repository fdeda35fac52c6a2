"""Removal of long repeated byte strings by longest previous factors in suffix order.

One suffix array over a corpus would be one task. So each window of the given
length goes to an anchor inside it that its own bytes choose; equal windows
have equal anchors. Hashes around anchors settle what is unique and what is
repeated as a whole; only stretches where repetition begins or ends are left,
and their suffixes are sorted, some MB of whole anchor groups at a time.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmill.llm.bytes64 import GramRanges, groups, utf8
from jobmill.llm.common import cut, free, only, small_batches

#: Bytes whose hash chooses anchors.
GRAM = 16
#: Bytes of suffixes sorted together, bytes of one anchor's stretches beyond which it is divided first.
SORTED = 1 << 19
LARGE = 1 << 18
#: Stretches handed on at a time.
SLICED = 5_000
#: A slice of a very long text, which slices overlap so that no window is lost.
LONG = 1 << 19


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values: of the rest of one block and the start of the next."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    head = np.minimum.accumulate(y, axis=1).ravel()
    tail = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray] | None:
    """Windows of ``length`` bytes of the texts in data, in runs that share an anchor.

    The anchor of a window is the leftmost position among its first half with
    the smallest hash of GRAM bytes. For each run: row of its text, first and
    last window, anchor (positions in the text), hash of the half window at the
    anchor, hash of all bytes of the run.
    """
    half = length // 2
    if len(data) < length:
        return None
    h = GramRanges(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = h.of(at, at + GRAM)
    packed = ((gram >> np.uint64(32)) << np.uint64(32)) | at.astype(np.uint64)
    anchor = (sliding_min(packed, half + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)[: len(data) - length + 1]
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - length + 1))
    if not len(row):
        return None
    count = np.maximum(0, sizes - length + 1)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + offsets[row]
    a = anchor[start]
    new = np.ones(len(row), bool)
    new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    lo, hi, a, row = start[first], start[last], a[first], row[first]
    base = offsets[row]
    return {"row": row, "lo": lo - base, "hi": hi - base, "anchor": a - base, "key": h.of(a, a + half).view(np.int64), "span": h.of(lo, hi + length).view(np.int64)}


def slices(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Texts in groups of about a block, very long ones alone in overlapping slices: bytes, offsets, first row, position of the slice."""
    for i, j in groups(offsets):
        if j == i + 1 and offsets[j] - offsets[i] > LONG:
            for at in range(0, int(offsets[j] - offsets[i]) - length + 1, LONG - length + 1):
                part = data[offsets[i] + at : min(offsets[j], offsets[i] + at + LONG)]
                yield part, np.array([0, len(part)]), i, at
        else:
            yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, 0


def repeated_starts(data: np.ndarray, starts: np.ndarray, order: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start, whether its window of ``length`` bytes has an earlier and a later equal by ``order``.

    Starts are sorted as suffixes; blocks of bytes compare by their 64-bit
    hashes instead of letter by letter, first the block at the start, then the
    one that ends the window, then ``order`` itself: no more of the suffixes is
    asked for. The longest previous factor of a start is its longest agreement
    with the previous or next smaller ``order`` in that sequence. Where
    suffixes agree on the window they stand together and in order, so the
    previous smaller one is the left neighbour, the next smaller one agrees on
    less, and the factor, counted up to ``length``, is ``length`` or less. All
    agreement is checked on the bytes.
    """
    h = GramRanges(data)
    block = length - length // 3
    a, b = h.of(starts, starts + block), h.of(starts + length - block, starts + length)
    while True:
        suffix = np.lexsort((order, b, a))
        x, y = a[suffix], b[suffix]
        agrees = np.zeros(len(starts), bool)  # with the previous smaller
        agrees[1:] = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
        at = np.flatnonzero(agrees)
        false = at[~same_bytes(data, starts[suffix[at - 1]], starts[suffix[at]], length)]
        if not len(false):
            break
        # hashes that agree by chance: their windows are told apart by their bytes
        raw, names = data.tobytes(), {}
        for k in np.flatnonzero(np.isin(a, x[false]) & np.isin(b, y[false])).tolist():
            b[k] ^= np.uint64(names.setdefault(raw[starts[k] : starts[k] + length], len(names)) << 32 | 1)
    earlier, later = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    earlier[suffix[at]] = True
    later[suffix[at - 1]] = True
    return earlier, later


def same_bytes(data: np.ndarray, p: np.ndarray, q: np.ndarray, length: int) -> np.ndarray:
    """Whether the windows at p and q hold the same bytes. A pair one byte behind another pair needs a look at the last byte only."""
    order = np.lexsort((p, q - p))
    p, q = p[order], q[order]
    follows = np.zeros(len(p), bool)
    follows[1:] = (p[1:] == p[:-1] + 1) & (q[1:] == q[:-1] + 1)
    good = data[p + length - 1] == data[q + length - 1]
    whole = np.flatnonzero(~follows)
    for i in range(0, len(whole), 1024):
        k = whole[i : i + 1024]
        span = np.arange(length)
        good[k] = (data[p[k][:, None] + span] == data[q[k][:, None] + span]).all(axis=1)
    # a pair holds if its run of followers holds so far
    run = np.cumsum(~follows) - 1
    broken = np.cumsum(~good)
    before = broken[whole] - ~good[whole]
    out = np.zeros(len(p), bool)
    out[order] = broken - before[run] == 0 if len(p) else False
    return out


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def anchors(docs: DataFrame, length: int, key: str, text: str) -> DataFrame:
    """Runs of windows of every text: doc, h, key, span, lo, hi, anchor."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("t"))
            for part, off, first, at in slices(data, offsets, length):
                if (r := anchor_runs(part, off, length)) is not None:
                    take = pa.array(r["row"] + first)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc").take(take), b.column("h").take(take), *(pa.array(r[c]) for c in ("key", "span")), *(pa.array((r[c] + at).astype(np.int32)) for c in ("lo", "hi", "anchor"))],
                        names=["doc", "h", "key", "span", "lo", "hi", "anchor"],
                    )

    return rows.mapInArrow(find, f"doc {kind}, h long, key long, span long, lo int, hi int, anchor int")


def settle(runs: DataFrame, keep_first: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """runs(doc, h, key, span, lo, hi, n, ...) to (repeated runs, runs left in doubt, the written table that both read).

    Runs of equal (key, span) hold the same bytes: with two or more of them
    (n counts) all windows are repeated. A key with one run in all holds no
    repeated window. Keys with several spans stay in doubt.
    """
    # written before the join, so that Spark can split what a frequent key brings
    keys = cut(runs.groupBy("key").agg(F.sum("n").alias("_total")).filter("_total > 1").select("key"))
    many = cut(runs.join(keys, "key"))
    first = F.min(F.struct(*[F.struct(F.col(c).isNull(), F.col(c)).alias(c) for c in ("doc", "h", "lo")]))
    spans = many.groupBy("key", "span").agg(F.sum("n").alias("_n"), first.alias("_first"))
    per_key = spans.groupBy("key").agg(F.count("*").alias("_spans"))
    spans = cut(spans.join(per_key, "key").filter("_n > 1 or _spans > 1"))
    joined = cut(many.join(spans, ["key", "span"]).withColumn(
        "_is_first", F.struct(*[F.struct(F.col(c).isNull(), F.col(c)).alias(c) for c in ("doc", "h", "lo")]) == F.col("_first")))
    free(keys, many, spans)
    repeated = joined.filter("_n > 1")
    if keep_first:
        repeated = repeated.filter("not _is_first")
    doubt = joined.filter("_spans > 1 and _is_first")
    return repeated.select("doc", "h", "lo", "hi"), doubt.withColumn("n", F.col("_n")).drop("_n", "_first", "_spans", "_is_first"), joined


def repeated_ranges(docs: DataFrame, length: int = 400, keep_first: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stretches of repeated bytes: doc, h (xxhash64 of the text), start, stop. They may overlap.

    A window of ``length`` bytes is repeated when an equal one starts anywhere
    else, in the same or another text, repeated rows included; with
    ``keep_first``, when an equal one starts earlier, by key, text hash and
    position.
    """
    found, used = _ranges(docs, length, keep_first, key, text)
    out = cut(found)
    free(*used)
    return out


def _ranges(docs: DataFrame, length: int, keep_first: bool, key: str, text: str) -> tuple[DataFrame, list[DataFrame]]:
    """The plan of repeated_ranges, and the written tables that it reads."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    runs = cut(anchors(docs, length, key, text).withColumn("n", F.lit(1).cast("long")))
    repeated, doubt, table = settle(runs, keep_first)
    free(runs)
    used = [table]

    wanted = doubt.groupBy("doc", "h").agg(F.collect_list(F.struct("key", "lo", "hi", "anchor", "n")).alias("runs"))
    wanted = cut(wanted)
    texts = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    texts = only(texts, wanted, ["doc", "h"]).dropDuplicates(["doc", "h"])

    def slice_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for doc, h, t, rs in zip(b["doc"].array, b["h"].array, b["t"], b["runs"], strict=True):
                raw = (t or "").encode()
                for r in rs:
                    rows.append((doc, h, r["key"], r["lo"], r["hi"], r["anchor"], r["n"], raw[r["lo"] : r["hi"] + length]))
                    if len(rows) == SLICED:
                        yield pd.DataFrame(rows, columns=["doc", "h", "key", "lo", "hi", "anchor", "n", "bytes"])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["doc", "h", "key", "lo", "hi", "anchor", "n", "bytes"])

    shape = f"doc {kind}, h long, key long, lo int, hi int, anchor int, n long, bytes binary"
    left = wanted.join(texts.select(F.col("doc").alias("_d"), F.col("h").alias("_h"), "t"), wanted["doc"].eqNullSafe(F.col("_d")) & (wanted["h"] == F.col("_h")))
    stretch = cut(left.select("doc", "h", "t", "runs").mapInPandas(slice_out, shape))
    free(wanted)
    used.append(stretch)
    found = [repeated]

    # an anchor with very many different stretches: windows part by where they start relative to it, on a finer grid each round
    width = 1 << (length // 2).bit_length()
    ready = []
    while True:
        large = cut(stretch.groupBy("key").agg(F.sum(F.octet_length("bytes")).alias("_size")).filter(F.col("_size") > LARGE).select("key")) if width > 1 else None
        if large is None or large.isEmpty():
            ready.append(stretch)
            break
        ready.append(stretch.join(large, "key", "left_anti"))
        width //= 2
        cells = cut(stretch.join(large, "key").mapInPandas(divide(length, width), shape + ", span long"))
        more, doubt, table = settle(cells, keep_first)
        found.append(more)
        stretch = cut(doubt.select(*stretch.columns))
        free(cells)
        used += [large, table, stretch]
    stretch = ready[0]
    for r in ready[1:]:
        stretch = stretch.unionByName(r)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole key groups, SORTED bytes or so at a time; batches arrive sorted by key."""
        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            sizes = b["bytes"].map(len).to_numpy().cumsum()
            cuts = np.searchsorted(sizes, np.arange(SORTED, sizes[-1] + SORTED, SORTED), "left") + 1 if len(b) else []
            at = 0
            for c in cuts:
                part = b.iloc[at : int(c)]
                at = int(c)
                if not len(part):
                    continue
                held.append(part)
                size += int(part["bytes"].map(len).sum())
                if size >= SORTED:
                    g = pd.concat(held, ignore_index=True)
                    end = g["key"].iloc[-1]
                    yield from ranges(g[g["key"] != end])
                    held = [g[g["key"] == end]]
                    size = int(held[0]["bytes"].map(len).sum())
        if held:
            yield from ranges(pd.concat(held, ignore_index=True))

    def ranges(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(g):
            return
        # earlier means smaller key, text hash, position
        g = g.sort_values(["doc", "h", "lo"], na_position="last", ignore_index=True)
        data = np.frombuffer(b"".join(g["bytes"]), np.uint8)
        sizes = g["bytes"].map(len).to_numpy()
        count = sizes - length + 1
        base = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(g)), count)
        starts = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + base[row]
        earlier, later = repeated_starts(data, starts, np.arange(len(starts)), length)
        many = g["n"].to_numpy()[row] > 1  # repeated as a whole, found before
        flags = earlier if keep_first else (earlier | later) & ~many
        first, last = runs_of(flags)
        # runs must not cross from one stretch into the next
        pieces = []
        for f, z in zip(first.tolist(), last.tolist(), strict=True):
            while row[f] != row[z]:
                e = int(np.searchsorted(row, row[f], "right")) - 1
                pieces.append((f, e))
                f = e + 1
            pieces.append((f, z))
        if pieces:
            p = np.array(pieces)
            r = row[p[:, 0]]
            lo = g["lo"].to_numpy()[r]
            yield pd.DataFrame({"doc": g["doc"].to_numpy()[r], "h": g["h"].to_numpy()[r], "lo": lo + starts[p[:, 0]] - base[r], "hi": lo + starts[p[:, 1]] - base[r]})

    last = stretch.repartition("key").sortWithinPartitions("key").select("doc", "h", "key", "lo", "hi", "n", "bytes")
    found.append(last.mapInPandas(compare, f"doc {kind}, h long, lo int, hi int"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("doc", "h", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop")), used


def divide(length: int, width: int):
    """Parts the windows of stretches by the cell, ``width`` wide, of their start relative to the anchor.

    Windows of one cell share a core, from the cell's last start to the end of
    its first window; its hash is the new key, so windows that differ there
    part. In a cell of width 1 the core is the window itself.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                raw, at, end = r.bytes, r.lo, r.hi
                h = GramRanges(np.frombuffer(raw, np.uint8))
                while at <= end:
                    cell = (at - r.anchor) // width
                    stop = min(end, r.anchor + (cell + 1) * width - 1)
                    core = r.anchor + (cell + 1) * width - 1 - r.lo, r.anchor + cell * width + length - r.lo
                    k, s = h.of(np.array([core[0], at - r.lo]), np.array([core[1], stop + length - r.lo])).view(np.int64).tolist()
                    rows.append((r.doc, r.h, k ^ (cell * 0x5851F42D4C957F2D & 0x7FFFFFFFFFFFFFFF), at, stop, r.anchor, r.n, raw[at - r.lo : stop + length - r.lo], s))
                    at = stop + 1
            yield pd.DataFrame(rows, columns=["doc", "h", "key", "lo", "hi", "anchor", "n", "bytes", "span"]).astype({"doc": b["doc"].dtype} if b["doc"].dtype != object else {})

    return of


def cut_out(raw: bytes, ranges: list) -> tuple[bytes, int, int]:
    """What is left of raw, bytes removed, maximal removed runs."""
    kept, at, spans = [], 0, 0
    end = -1
    for start, stop in sorted((r["start"], r["stop"]) for r in ranges):
        if start > end:
            kept.append(raw[max(at, 0) : start])
            spans += 1
        end = max(end, stop)
        at = end
    kept.append(raw[max(at, 0) :])
    left = b"".join(kept)
    return left, len(raw) - len(left), spans


def covered(ranges: list) -> tuple[int, int]:
    """Bytes that the ranges cover, bytes of their longest maximal run."""
    total, longest, begin, end = 0, 0, 0, 0
    for start, stop in sorted((r["start"], r["stop"]) for r in ranges):
        if start > end:
            total += end - begin
            begin = start
        end = max(end, stop)
        longest = max(longest, end - begin)
    return total + end - begin, longest


def _listed(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("doc", "h").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))


def _reported(docs: DataFrame, length: int, key: str, text: str) -> DataFrame:
    """Texts with a repeated string of so many bytes: doc, h, n_repeated (bytes that such strings cover), longest (of their maximal runs)."""
    kind = docs.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [covered(r) for r in b["ranges"]]
            yield pd.DataFrame({"doc": b["doc"], "h": b["h"], "n_repeated": [d[0] for d in done], "longest": [d[1] for d in done]})

    ranges, used = _ranges(docs, length, False, key, text)
    out = cut(_listed(ranges).mapInPandas(measure, f"doc {kind}, h long, n_repeated long, longest long"))
    free(*used)
    return out


def remove_repeats(docs: DataFrame, length: int = 400, keep_first: bool = False, key: str = "doc_id", text: str = "text", report: int | None = None) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_removed, n_spans, kept_sha256; with ``report`` also n_repeated.

    Each byte that a repeated window of ``length`` bytes covers is removed (see
    repeated_ranges). Null texts count as empty; texts shorter than the window
    lose nothing; repeated rows repeat each other. Texts without a repeat are
    not moved at all.

    ``report``, a length of at most ``length``, removes nothing more:
    n_repeated counts the bytes that repeated windows of that many bytes cover,
    first ones included. A longer repeat lies within a run of shorter ones, so
    only texts with such a run of ``length`` bytes are searched for it.
    """
    kind = docs.schema[key].dataType.simpleString()
    searched, at, short = docs, (key, text), None
    if report is not None:
        if not 2 * GRAM <= report <= length:
            raise ValueError(f"report must be from {2 * GRAM} to length")
        short = _reported(docs, report, key, text)
        long = cut(short.filter(F.col("longest") >= length).select("doc", "h"))
        whole_rows = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
        searched, at = only(whole_rows, long, ["doc", "h"]), ("doc", "t")
    ranges, used = _ranges(searched, length, keep_first, *at)
    listed = cut(_listed(ranges))
    free(*used)
    texts = docs.select(F.col(key).alias("_d"), F.xxhash64(text).alias("_h"), F.col(text).alias("t"))
    texts = only(texts.select(F.col("_d").alias("doc"), F.col("_h").alias("h"), "t"), listed, ["doc", "h"]).dropDuplicates(["doc", "h"])
    texts = texts.select(F.col("doc").alias("_d"), F.col("h").alias("_h"), "t")
    joined = listed.join(texts, listed["doc"].eqNullSafe(texts["_d"]) & (listed["h"] == texts["_h"])).select("doc", "h", "t", "ranges")

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [cut_out((t or "").encode(), r) for t, r in zip(b["t"], b["ranges"], strict=True)]
            yield pd.DataFrame({"doc": b["doc"], "h": b["h"], "n_removed": [d[1] for d in done], "n_spans": [d[2] for d in done], "kept": [hashlib.sha256(d[0]).hexdigest() for d in done]})

    done = joined.mapInPandas(rewrite, f"doc {kind}, h long, n_removed long, n_spans long, kept string")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), F.xxhash64(text).alias("_h"), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole.cast("binary"), 256).alias("_sha"))
    out = rows.join(done, rows[key].eqNullSafe(done["doc"]) & (rows["_h"] == done["h"]), "left")
    zero = F.lit(0).cast("long")
    more = []
    if short is not None:
        short = short.select(F.col("doc").alias("_sd"), F.col("h").alias("_sh"), "n_repeated")
        out = out.join(short, out[key].eqNullSafe(short["_sd"]) & (out["_h"] == short["_sh"]), "left")
        more = [F.coalesce("n_repeated", zero).alias("n_repeated")]
    return out.select(key, "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "_sha").alias("kept_sha256"), *more)
