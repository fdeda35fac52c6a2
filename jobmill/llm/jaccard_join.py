"""Exact Jaccard near-duplicate join in a metric space of shingle sets.

The metric is the size of the symmetric difference. Sets of one shingle are
the first pivots: a document is nearest to the shingles it holds, ties going to
the rarest, and that is its home region. A document must also enter each other
region that may be home to a set near enough; by the triangle inequality these
are the regions of its rarest few shingles (the window). Within a region,
documents become pivots in turn. A pivot takes in all members near it at once,
so a group of near copies costs as many comparisons as it has members; members
left over form a smaller region that joins again. A parity sketch of each set,
which grows with the set, bounds each distance from below before any set is
read: two sketches differ in at most as many bits as the sets do in members.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmill.llm.bytes64 import BLOCK, Ranges, groups, mix, utf8
from jobmill.llm.common import cut, drop_rows, free, only, small_batches
from jobmill.llm.components import components

#: Buckets in which shingles are counted to tell rare from frequent, in pieces of so many.
BUCKETS, PIECE = 1 << 20, 1 << 12
#: Bits of a set's sketch: twice its size, rounded up to a power of two within these bounds.
BITS = 256, 1 << 16
#: Open members up to which a region takes no further pivot; members up to which it is joined as it is; members of a tile beyond.
SMALL, TINY, TILE = 256, 16, 512
#: A distance beyond all.
FAR = 1 << 62

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of each word of a byte array, A to Z in lower case."""
    data = _LOWER[data]
    space = np.concatenate([[True], _SPACE[data], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, stop = edge[::2], edge[1::2]
    return Ranges(data).of(start, stop), start


def text_words(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the words of each text, in order."""
    for i, j in groups(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo > 2 * BLOCK and j == i + 1:
            yield _long_words(data[lo:hi])
            continue
        # a space between texts, so that no word crosses
        spaced = np.insert(data[lo:hi], (offsets[i + 1 : j] - lo).astype(np.int64), 32)
        words, at = word_hashes(spaced)
        first = 0
        for last in np.searchsorted(at, offsets[i + 1 : j + 1] - lo + np.arange(j - i)).tolist():
            yield words[first:last]
            first = last


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer than n words has one shingle of all of them."""
    for words in text_words(data, offsets):
        yield _shingles(words, n)


def _long_words(data: np.ndarray) -> np.ndarray:
    """Words of a very long text, a block at a time, cut at white space."""
    parts, at = [], 0
    gaps = np.flatnonzero(_SPACE[data])
    while at < len(data):
        k = np.searchsorted(gaps, at + BLOCK)
        end = int(gaps[k]) + 1 if k < len(gaps) else len(data)
        parts.append(word_hashes(data[at:end])[0])
        at = end
    return np.concatenate(parts)


def _shingles(w: np.ndarray, n: int) -> np.ndarray:
    if not len(w):
        return np.zeros(0, np.uint64)
    m = min(n, len(w))
    h = np.full(len(w) - m + 1, m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(m):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - m + 1 + k])
    return np.unique(h)


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any set at the similarity."""
    return -(-percent * n // 100)


def bucket_counts(docs: DataFrame, n: int, text: str) -> np.ndarray:
    """How many shingles of all documents fall into each bucket. The driver gets one number a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            data, offsets = utf8(b.column(0))
            held, size = [], 0
            for s in shingle_sets(data, offsets, n):
                held.append(s)
                size += len(s)
                if size > BLOCK:
                    total += np.bincount((np.concatenate(held) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                    held, size = [], 0
            if held:
                total += np.bincount((np.concatenate(held) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        yield from _pieces({i: p for i, p in enumerate(total.reshape(-1, PIECE)) if p.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                p = np.frombuffer(x.as_buffer(), np.int64)
                total[i] = total[i] + p if i in total else p
        yield from _pieces(total)

    shape = "piece int, counts binary"
    parts = docs.select(text).mapInArrow(count, shape).repartition("piece").mapInArrow(add, shape)
    out = np.zeros((BUCKETS // PIECE, PIECE), np.int64)
    for r in parts.toLocalIterator():
        out[r["piece"]] += np.frombuffer(r["counts"], np.int64)
    return np.minimum(out.ravel(), 2**31 - 1).astype(np.int32)


def _pieces(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.int64).tobytes() for x in total.values()], pa.binary())], names=["piece", "counts"])


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of shingles that fall on each bit."""
    bits = BITS[0]
    while bits < min(2 * len(s), BITS[1]):
        bits *= 2
    at = (s >> np.uint64(32)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def digest(s: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        a, b = mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64), mix(s + np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return np.array([a, b], np.uint64).tobytes()


def summaries(docs: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    """One row per row of docs: doc, n (set size), node (digest; null for an empty set), profile (sketch), window.

    window: the rarest shingles, so many that any two sets at the similarity
    share one of them; empty for sets so small that no larger set is near, when
    no smaller one is either.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, n, text))
    kind = docs.schema[key].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in batches:
            data, offsets = utf8(b.column("t"))
            size, node, prof, window = [], [], [], []
            for s in shingle_sets(data, offsets, n):
                size.append(len(s))
                node.append(digest(s) if len(s) else None)
                prof.append(sketch(s) if len(s) else None)
                if 100 * len(s) // percent > len(s):
                    spare = len(s) - least_overlap(len(s), percent)
                    rarity = counts[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]
                    window.append(s[np.lexsort((s, rarity))[: spare + 1]].view(np.int64))
                else:
                    window.append(np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(w) for w in window])]).astype(np.int32)), pa.array(np.concatenate([*window, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(size, pa.int64()), pa.array(node, pa.binary()), pa.array(prof, pa.binary()), lists], names=["doc", "n", "node", "profile", "window"])

    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("t"))
    return rows.mapInArrow(of, f"doc {kind}, n long, node binary, profile binary, window array<long>")


def set_ids(docs: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """One row per row of docs: doc, n, node, as in summaries. Computing them again costs less than keeping a second table of windows."""
    kind = docs.schema[key].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, node = [], []
            for s in shingle_sets(*utf8(b.column("t")), n):
                size.append(len(s))
                node.append(digest(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(size, pa.int64()), pa.array(node, pa.binary())], names=["doc", "n", "node"])

    return docs.select(F.col(key).alias("doc"), F.col(text).alias("t")).mapInArrow(of, f"doc {kind}, n long, node binary")


def sets_of(docs: DataFrame, nodes: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """The sets of the given nodes(node, doc): node, shingles (sorted, 8 bytes each), read from each node's document."""
    ids = nodes.select("doc").distinct()
    kind = docs.schema[key].dataType.simpleString()
    rows = only(docs.select(F.col(key).alias("doc"), F.col(text).alias("t")), ids, ["doc"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("t"))
            sets = list(shingle_sets(data, offsets, n))
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "node", "shingles"])

    found = rows.mapInArrow(of, f"doc {kind}, node binary, shingles binary")
    # rows that repeat a key hold other texts too: only the node's own set counts, once
    return found.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]).select("node", "shingles")


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """Sketches, one a row, as they would be with fewer bits."""
    while x.shape[-1] > words:
        x = x[..., : x.shape[-1] // 2] ^ x[..., x.shape[-1] // 2 :]
    return x


def may_link(total: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of so many members together, at this distance at least, may be at the similarity."""
    # shared = (total - distance) / 2 and joint = (total + distance) / 2
    return 100 * (total - apart) >= percent * (total + apart)


def by_length(sketches: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length of sketch, and their sketches as 64-bit words."""
    sizes = np.fromiter(map(len, sketches), np.int64, len(sketches))
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        yield rows, np.frombuffer(b"".join(sketches[rows]), np.uint64).reshape(len(rows), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which each sketch in a differs from the one beside it in b; of different lengths, the longer is folded."""
    out = np.zeros(len(a), np.int64)
    for i, x in by_length(a):
        for j, y in by_length(b[i]):
            words = min(x.shape[1], y.shape[1])
            step = max(1, BLOCK // words)
            for k in range(0, len(j), step):
                part = j[k : k + step]
                out[i[part]] = np.bitwise_count(folded(x[part], words) ^ folded(y[k : k + step], words)).sum(axis=1)
    return out


def possible(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) that sizes and sketches allow. info(node, n, profile)."""

    def keep(na: pd.Series, nb: pd.Series, pa_: pd.Series, pb: pd.Series) -> pd.Series:
        if not len(na):
            return pd.Series([], dtype=bool)
        return pd.Series(may_link(na.to_numpy() + nb.to_numpy(), distances(pa_.to_numpy(object), pb.to_numpy(object)), percent))

    keep_udf = F.pandas_udf(keep, "boolean")
    a = info.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("profile").alias("pa"))
    b = info.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("profile").alias("pb"))
    sized = pairs.join(a, "a").join(b, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sized.filter(keep_udf("na", "nb", "pa", "pb")).select("a", "b")


def between(star: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Rows of star(region, node, n, pivot, pivot_n, ...) from which a set near the pivot may be near: sets further off are near no such set.

    A set near both is at most 100 / percent times the smaller one; by the
    triangle inequality the distance to the pivot is at most the sum of the two
    that nearness allows.
    """

    def keep(n: pd.Series, pivot_n: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        if not len(n):
            return pd.Series([], dtype=bool)
        a, b = n.to_numpy(), pivot_n.to_numpy()
        x = 100 * np.minimum(a, b) // percent
        return pd.Series((100 + percent) * distances(p.to_numpy(object), q.to_numpy(object)) <= (100 - percent) * (a + b + 2 * x))

    keep_udf = F.pandas_udf(keep, "boolean")
    sized = star.filter(10_000 * F.least("n", "pivot_n") >= percent * percent * F.greatest("n", "pivot_n"))
    a = info.select("node", F.col("profile").alias("pa"))
    b = info.select(F.col("node").alias("pivot"), F.col("profile").alias("pb"))
    return sized.join(a, "node").join(b, "pivot").filter(keep_udf("n", "pivot_n", "pa", "pb")).select(*star.columns)


def tiled_pairs(rows: DataFrame, info: DataFrame, percent: int, crossing: bool = False, nearest: bool = False) -> DataFrame:
    """Pairs (a, b) of large regions that sizes and sketches allow, at least one of them open.

    rows(region, node, open, all). A region is cut into tiles of about TILE by
    TILE members; a task holds one tile at a time, whatever the region's size,
    and gives only what passes. ``crossing``: pairs of one open and one closed
    member only. ``nearest``: of these, for each open member the one with the
    nearest sketch in each tile, with region, open (the member) and apart.
    """
    parts = F.ceil(F.col("all") / TILE).cast("int")
    own = F.pmod(F.xxhash64("node"), parts.cast("long")).cast("int")
    r = rows.join(info, "node").select("region", "node", "n", "profile", "open", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    r = r.select("region", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "profile", "open")

    def of(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        i, j = g["i"].iloc[0], g["j"].iloc[0]
        x, y = g[g["own"] == i], g[g["own"] == j]
        if not len(x) or not len(y):
            return
        nx, ny, ox, oy, kx, ky = (z[c].to_numpy() for c in ("n", "open", "node") for z in (x, y))
        for s, p in by_length(x["profile"].to_numpy(object)):
            for t, q in by_length(y["profile"].to_numpy(object)):
                words = min(p.shape[1], q.shape[1])
                u, v = folded(p, words), folded(q, words)
                step = max(1, BLOCK // (words * len(t)))
                for at in range(0, len(s), step):
                    rows = s[at : at + step]
                    apart = np.bitwise_count(u[at : at + step, None, :] ^ v[None, :, :]).sum(axis=-1, dtype=np.int64)
                    ok = may_link(nx[rows, None] + ny[None, t], apart, percent) & (ox[rows, None] ^ oy[None, t] if crossing or nearest else ox[rows, None] | oy[None, t])
                    ok &= 100 * np.minimum(nx[rows, None], ny[None, t]) >= percent * np.maximum(nx[rows, None], ny[None, t])
                    ok &= kx[rows, None] != ky[None, t] if i != j else rows[:, None] < t[None, :]
                    if nearest:
                        apart[~ok] = FAR
                        for mine, away, far, own_, other in ((ox[rows], ~oy[t], apart, kx[rows], ky[t]), (oy[t], ~ox[rows], apart.T, ky[t], kx[rows])):
                            if mine.any() and away.any():
                                k = far[mine].argmin(axis=1)
                                least = far[mine][np.arange(len(k)), k]
                                hit = least < FAR
                                yield pd.DataFrame({"a": own_[mine][hit], "b": other[k[hit]], "region": g["region"].iloc[0], "open": own_[mine][hit], "apart": least[hit]})
                        continue
                    a, b = np.nonzero(ok)
                    if len(a):
                        yield pd.DataFrame({"a": kx[rows[a]], "b": ky[t[b]]})

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            groups_ = [g for _, g in b.groupby(["region", "i", "j"], sort=False)]
            rest = groups_.pop() if groups_ else None
            for g in groups_:
                yield from of(g)
        if rest is not None and len(rest):
            yield from of(rest)

    shape = "a binary, b binary" + (f", region {rows.schema['region'].dataType.simpleString()}, open binary, apart long" if nearest else "")
    found = r.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j").mapInPandas(tiles, shape)
    return found.select(*ordered(F.col("a"), F.col("b")), *found.columns[2:])


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) whose sets are at the similarity, in full."""

    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            s, t = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(100 * both >= percent * (len(s) + len(t) - both))
        return pd.Series(out, dtype=bool)

    near_udf = F.pandas_udf(near, "boolean")
    a, b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").filter(near_udf("sa", "sb")).select("a", "b")


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_links(docs: DataFrame, nodes: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    """Links (a, b) among nodes(node, n, doc, profile, window) that join all nodes within the similarity.

    Not every pair within it is listed: members that one pivot takes in are not
    compared with each other, as they are connected by it. Members that
    different pivots take in are, as far as the triangle inequality allows them
    to be near; there, one link joins a member with all that a pivot took in.
    """
    entries = nodes.select(F.explode("window").alias("region"), "node")
    crowd = entries.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1").select("region")
    met = cut(entries.join(crowd, "region"))
    # regions of the same members are one
    kinds = met.groupBy("region").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    kinds = cut(kinds.groupBy("size", "x", "y").agg(F.min("region").alias("region")).select("region"))
    members = cut(met.join(kinds, "region"))
    free(met, kinds)
    # how often a node meets others tells how central it is: what was changed in a copy is its own alone
    shared = members.groupBy("node").agg(F.count("*").alias("shared"))
    info = nodes.select("node", "n", "profile")
    first = members
    members = start = cut(first.join(shared, "node").join(info.select("node", "n"), "node"))
    free(first)

    def alike(a: str, b: str) -> Column:
        """Sizes that allow the similarity: the triangle inequality with the empty set as pivot."""
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    links: list[DataFrame] = []
    done: dict[str, DataFrame] = {}

    def compare(pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs not compared before, cut."""
        fresh = pairs.select("a", "b").distinct()
        fresh = cut(fresh.join(done["pairs"], ["a", "b"], "left_anti") if "pairs" in done else fresh)
        named = fresh.select(F.col("a").alias("node")).union(fresh.select("b")).distinct()
        missing = cut((named.join(done["sets"], "node", "left_anti") if "sets" in done else named).join(nodes.select("node", "doc"), "node"))
        more = cut(sets_of(docs, missing, n, key, text))
        done["sets"] = done["sets"].unionByName(more) if "sets" in done else more
        done["pairs"] = done["pairs"].unionByName(fresh) if "pairs" in done else fresh
        links.append(cut(linked(fresh, done["sets"], percent)))
        free(missing)
        return links[-1]

    finish: list[DataFrame] = []
    while not members.isEmpty():
        pivots = members.groupBy("region").agg(F.max_by(F.struct("node", "n"), F.struct("shared", "node")).alias("p"))
        pivots = pivots.select("region", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"))
        star = members.join(pivots, "region").filter("node <> pivot")
        got = compare(possible(star.filter(alike("n", "pivot_n")).select(*ordered(F.col("node"), F.col("pivot"))).distinct(), info, percent))
        both = got.union(got.select("b", "a")).select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.lit(True).alias("taken"))
        rest = star.join(both, ["node", "pivot"], "left").withColumn("open", F.col("taken").isNull()).drop("taken")
        sums = rest.groupBy("region").agg(F.count_if("open").alias("left"), F.count_if(~F.col("open")).alias("went"), F.count("*").alias("all"))
        # a pivot that took in little says that the region is loose: its members are near few others
        ready = (F.col("left") <= SMALL) | (8 * F.col("went") < F.col("left"))
        rest = cut(rest.join(sums.filter("left > 0 and all > 1").withColumn("ready", ready), "region"))
        free(start)
        finish.append(rest.filter("ready").select("region", "node", "n", "open", "all"))
        # what the pivot took in leaves the region, once it has met what stays
        members = cut(rest.filter("open and not ready").select("region", "node", "n", "shared"))
        if members.isEmpty():
            break
        closed = rest.filter("not open and not ready").select("region", "node", "open")
        near = between(rest.filter("open and not ready").select("region", "node", "n", "pivot", "pivot_n", "open"), info, percent).select("region", "node", "open")
        met = cut(closed.unionByName(near))

        def sides(rows: DataFrame) -> DataFrame:
            """rows of the regions that have an open one, with their number."""
            return rows.join(rows.groupBy("region").agg(F.count("*").alias("all"), F.count_if("open").alias("_n")).filter("_n > 0").drop("_n"), "region")

        # the nearest by sketch first: with a link to one member of what the pivot took in, the others add none
        close = cut(tiled_pairs(sides(met), info, percent, nearest=True))
        tried = compare(close.groupBy("region", "open").agg(F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b"))
        joined = close.join(tried, ["a", "b"]).select("region", F.col("open").alias("node")).distinct()
        asked = cut(close.select("region", F.col("open").alias("node")).distinct().join(joined, ["region", "node"], "left_anti"))
        if not asked.isEmpty():
            rest_met = met.filter("not open").unionByName(asked.withColumn("open", F.lit(True)))
            compare(tiled_pairs(sides(rest_met), info, percent, crossing=True))
        free(met, close, asked)
    if not finish:
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    last = finish[0]
    for r in finish[1:]:
        last = last.unionByName(r)
    tiny = last.filter(F.col("all") <= TINY)
    x = tiny.filter("open").select("region", F.col("node").alias("x"), F.col("n").alias("nx"))
    y = tiny.select(F.col("region").alias("r"), F.col("node").alias("y"), F.col("n").alias("ny"))
    close = possible(x.join(y, (F.col("region") == F.col("r")) & (F.col("x") != F.col("y")) & alike("nx", "ny")).select(*ordered(F.col("x"), F.col("y"))).distinct(), info, percent)
    compare(close.unionByName(tiled_pairs(last.filter(F.col("all") > TINY).select("region", "node", "open", "all"), info, percent)))
    out = links[0]
    for r in links[1:]:
        out = out.unionByName(r)
    return out


def placed_nodes(docs: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    """One row per distinct set that is not empty: node, doc (its smallest key), root (the same for all sets that links join)."""
    nodes = cut(summaries(docs, n, percent, key, text).filter("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.min("doc").alias("doc"), F.first("profile").alias("profile"), F.first("window").alias("window")))
    roots = components(near_links(docs, nodes, n, percent, key, text))
    return nodes.select("node", "doc").join(roots, "node", "left").select("node", "doc", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id.

    Words are stretches without white space, A to Z in lower case; a set holds
    the distinct shingles of n words. Two documents are linked when shared *
    100 >= percent * joint. component_id: smallest key that links reach, itself
    included. Texts without a word, null or empty, have size 0 and are linked
    with nothing. Equal sets are one node, so any number of copies is compared
    once; a key that repeats with several texts is one node for each. Null keys
    never are a component's smallest.

    Shingles stand by 64-bit hashes and sets by 128 bits.
    """
    small_batches(docs.sparkSession)
    rows = set_ids(docs, n, key, text)
    placed = placed_nodes(docs, n, percent, key, text)
    lows = cut(placed.groupBy("root").agg(F.min("doc").alias("component_id")))  # so that Spark can split a large component
    placed = placed.join(lows, "root").select("node", "component_id")
    out = rows.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), "node").join(placed, "node", "left")
    return out.select(key, "n_shingles", F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns: one of each group that links join, and all without a word.

    The row kept has the smallest key (null keys last), then the smallest digest
    of its text, then the smallest other columns. Rows are told apart by key and
    text, so a key that repeats takes no other row with it.
    """
    small_batches(docs.sparkSession)
    mark = F.unhex(F.md5(F.col(text).cast("binary"))).alias("mark")
    rows = set_ids(docs.select(F.struct(F.col(key).alias("k"), mark).alias("row"), text), n, "row", text)
    rows = cut(rows.filter("node is not null").select("doc.k", "doc.mark", "node"))
    firsts = rows.groupBy("node").agg(F.min(F.struct(F.col("k").isNull().alias("nul"), "k", "mark")).alias("first"))
    placed = cut(placed_nodes(docs, n, percent, key, text).select("node", "root").join(firsts, "node"))
    leads = cut(placed.groupBy("root").agg(F.min("first").alias("lead")))  # so that Spark can split a large group
    leads = placed.join(leads, "root").select("node", "lead")
    gone = rows.join(leads, "node").filter(~(F.col("k").eqNullSafe(F.col("lead.k")) & (F.col("mark") == F.col("lead.mark"))))
    gone = cut(gone.select("k", F.col("mark").alias("h")).distinct())
    tied = cut(rows.groupBy("k", "mark").agg(F.count("*").alias("n_rows")).filter("n_rows > 1").select("k", F.col("mark").alias("h")))
    free(placed)
    return drop_rows(docs, key, mark, gone, tied)
