"""Hard-negative mining: exact inner products, bounded first by summaries of the vectors' segments."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmill.llm.common import cut, free

#: Lengths of a segment, coarse to fine; summaries of the first are stored with the vectors.
LEVELS = (8, 4, 2)
#: Anchors that a task holds at a time, and of those, how many are scored at once.
ANCHORS, TILE = 8192, 256
#: Vectors that one group of anchors meets in a task at least, and in how many tasks at most it meets all.
ROWS, SPREAD = 16_384, 64
#: Stands for a null key: the last one of equal scores.
LAST = np.iinfo(np.int64).max
NONE = np.iinfo(np.int64).min


def summary(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean (times the root of the length) and deviation (the length of what is left) of each segment of each row.

    The last segment is filled up with zeros, which changes no inner product.
    """
    if rest := -x.shape[1] % length:
        x = np.pad(x, ((0, 0), (0, rest)))
    s = x.reshape(len(x), x.shape[1] // length, length)
    mean = s.mean(axis=2)
    return mean * np.sqrt(length), np.sqrt(((s - mean[:, :, None]) ** 2).sum(axis=2))


class Side:
    """Vectors of one length, integers as int64, with their summaries level by level."""

    def __init__(self, x: np.ndarray, stored: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.x = x
        self.size = np.abs(x).max(initial=0)
        self.f = x.astype(float)
        self.norm = np.sqrt((self.f**2).sum(axis=1))
        self.levels = {LEVELS[0]: stored} if stored else {}

    def level(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        if length not in self.levels:
            self.levels[length] = summary(self.f, length)
        return self.levels[length]


def survivors(a: Side, i: np.ndarray, b: Side, j: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, score) of all pairs of the rows i of a and j of b whose score lies in [lo, hi] of the row of a.

    Of each segment, the product of the means plus or minus the product of the
    deviations bounds what it adds to the score. Pairs whose bounds miss the
    interval go; those left are refined with shorter segments and scored last.
    """
    slack = 1 + 1e-6 * a.norm[i].max(initial=0) * b.norm[j].max(initial=0)  # more than all rounding
    p = q = None
    for length in LEVELS:
        (am, ad), (bm, bd) = a.level(length), b.level(length)
        if p is None:
            centre, radius = am[i] @ bm[j].T, ad[i] @ bd[j].T + slack
            near = (centre + radius >= lo[:, None]) & (centre - radius <= hi[:, None])
            rows, cols = near.any(axis=1), near.any(axis=0)
            i, lo, hi, j, near = i[rows], lo[rows], hi[rows], j[cols], near[rows][:, cols]
            if near.sum() * 8 < near.size:  # few pairs left: from here on pair by pair
                p, q = near.nonzero()
        if p is not None and length != LEVELS[0]:
            s = np.einsum("ij,ij->i", am[i[p]], bm[j[q]])
            r = np.einsum("ij,ij->i", ad[i[p]], bd[j[q]]) + slack
            keep = (s + r >= lo[p]) & (s - r <= hi[p])
            p, q = p[keep], q[keep]
    exact = float(a.size) * float(b.size) * a.x.shape[1] < 2**53  # doubles hold all sums
    if p is None:
        s = (a.f[i] @ b.f[j].T).astype(np.int64) if exact else a.x[i] @ b.x[j].T
        p, q = ((s >= lo[:, None]) & (s <= hi[:, None])).nonzero()
        return i[p], j[q], s[p, q]
    left, right = (a.f, b.f) if exact else (a.x, b.x)
    s = np.einsum("ij,ij->i", left[i[p]], right[j[q]]).astype(np.int64)
    keep = (s >= lo[p]) & (s <= hi[p])
    return i[p][keep], j[q][keep], s[keep]


class Best:
    """The k greatest scores of each slot, ties by smaller key. Keys must come in order, so that a later tie never enters a full slot."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.slot, self.score, self.key = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(slots, NONE)  # least score that can still enter

    def add(self, slot: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        fits = score >= self.floor[slot]
        if not fits.any():
            return
        slot, score, key = (np.concatenate([old, new[fits]]) for old, new in ((self.slot, slot), (self.score, score), (self.key, key)))
        order = np.lexsort((key, -score, slot))
        slot, score, key = slot[order], score[order], key[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = rank < self.k
        self.slot, self.score, self.key = slot[kept], score[kept], key[kept]
        full = rank == self.k - 1
        self.floor[slot[full]] = score[full] + 1


def stored(vectors: DataFrame, key: str, vector: str, label: str, scale: float) -> DataFrame:
    """id, lab, dim, width (bytes of a component), x (floor(scale * component) as integers), means and devs of the coarse segments.

    Vectors without a label, null or empty ones, and ones with a null or
    non-finite component are left out, and so are those with components so large
    that a score might not fit a long: from the root of 2 ** 62 / length on.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, g in b.groupby(b["v"].map(len)):
                x = np.floor(scale * np.array(g["v"].tolist(), float))
                size = np.abs(x).max(axis=1)
                fits = size < np.sqrt(2.0**62 / dim)
                g, x, size = g[fits], x[fits], size[fits]
                if not len(g):
                    continue
                width = np.where(size < 2**15, 2, np.where(size < 2**31, 4, 8))
                mean, dev = summary(x, LEVELS[0])
                yield pd.DataFrame({
                    "id": g["id"], "lab": g["lab"], "dim": dim, "width": width, "x": [r.astype(f"<i{w}").tobytes() for r, w in zip(x, width, strict=True)],
                    "means": [r.tobytes() for r in mean.astype("<f4")], "devs": [r.tobytes() for r in dev.astype("<f4")]})

    v = F.col(vector)
    fine = F.col(label).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.filter(F.coalesce(fine, F.lit(False))).select(F.coalesce(F.col(key).cast("long"), F.lit(int(LAST))).alias("id"), F.col(label).cast("string").alias("lab"), v.alias("v"))
    return rows.mapInPandas(of, "id long, lab string, dim int, width int, x binary, means binary, devs binary")


def _side(rows: pd.DataFrame, dim: int) -> Side:
    x = np.empty((len(rows), dim), np.int64)
    width = rows["width"].to_numpy()
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        x[at] = np.frombuffer(b"".join(rows["x"].iloc[at]), f"<i{w}").reshape(-1, dim)
    mean, dev = (np.frombuffer(b"".join(rows[c]), "<f4").reshape(len(rows), -1).astype(float) for c in ("means", "devs"))
    return Side(x, (mean, dev))


def _best_of_groups(rows: DataFrame, k: int, slots: int, least: int | None, most: int | None) -> DataFrame:
    """rows of anchors (flag 0) and vectors (flag 1), a group (ab, salt) after the other, to (ab, n, slot, id, score): the best of each group.

    Without ``least`` vectors of the anchor's label count, other than itself;
    with it those of other labels whose score lies between ``least`` and
    ``most`` percent of the slot's score in ``given``.
    """

    def update(anchors: list, best: Best, v: pd.DataFrame) -> None:
        for dim, part in v.groupby("dim", sort=False):
            if dim not in anchors[0]:
                continue
            side, frame = anchors[0][dim]
            other, ids, rid = _side(part, dim), part["id"].to_numpy(), part["rid"].to_numpy()
            a_lab, b_lab, a_rid, n = frame["lab"].to_numpy(), part["lab"].to_numpy(), frame["rid"].to_numpy(), frame["n"].to_numpy()
            given = anchors[1].get(dim)
            for lab in np.unique(a_lab):
                mine, theirs = np.flatnonzero(a_lab == lab), np.flatnonzero((b_lab == lab) == (least is None))
                for at in range(0, len(mine), TILE):
                    i = mine[at : at + TILE]
                    floor = best.floor[(n[i] * slots)[:, None] + np.arange(slots)]
                    if least is None:
                        lo, hi = floor[:, 0].astype(float), np.full(len(i), np.inf)
                    else:
                        # per slot: at least the given share, and what its entries leave open
                        open_ = given[i] != NONE
                        lo = np.where(open_, np.maximum(np.ceil(given[i] * (least / 100) - 1e-6 * np.abs(given[i]) - 1), floor), np.inf).min(axis=1)
                        hi = np.where(open_, given[i] * (most / 100) + 1e-6 * np.abs(given[i]) + 1, -np.inf).max(axis=1)
                    p, q, s = survivors(side, i, other, theirs, lo, hi)
                    if least is None:
                        keep = a_rid[p] != rid[q]
                        best.add(n[p[keep]], s[keep], ids[q[keep]])
                        continue
                    for slot in range(slots):
                        g = given[p, slot]
                        keep = (g != NONE) & _between(s, g, least, most)
                        best.add(n[p[keep]] * slots + slot, s[keep], ids[q[keep]])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, waiting, anchors, best = None, [], None, None

        def result() -> list[pd.DataFrame]:
            if best is None or not len(best.slot):
                return []
            return [pd.DataFrame({"ab": group[0], "n": best.slot // slots, "slot": best.slot % slots, "id": best.key, "score": best.score})]

        for b in batches:
            for g, part in b.groupby(["ab", "salt"], sort=False):
                if g != group:
                    yield from result()
                    group, waiting, anchors, best = g, [], None, None
                flag = part["flag"].to_numpy()
                if (flag == 0).any():
                    waiting.append(part[flag == 0])
                v = part[flag == 1]
                if len(v) and waiting:
                    frame = pd.concat(waiting).astype({"n": int})  # it came with nulls of vectors
                    by = {dim: f for dim, f in frame.groupby("dim")}
                    sizes = {dim: np.array([list(x) + [NONE] * (slots - len(x)) for x in f["given"]], np.int64).reshape(len(f), slots) for dim, f in by.items()} if least is not None else {}
                    anchors, best, waiting = ({dim: (_side(f, dim), f) for dim, f in by.items()}, sizes), Best((frame["n"].max() + 1) * slots, k), []
                if len(v) and anchors:
                    update(anchors, best, v)
        yield from result()

    return rows.mapInPandas(scan, "ab int, n int, slot int, id long, score long")


def _between(s: np.ndarray, g: np.ndarray, least: int, most: int) -> np.ndarray:
    """least * g <= 100 * s <= most * g; products that might leave int64 are taken in Python's integers."""
    if max(np.abs(s).max(initial=0), np.abs(g).max(initial=0)) < 2**53:
        return (least * g <= 100 * s) & (100 * s <= most * g)
    s, g = s.astype(object), g.astype(object)
    return ((least * g <= 100 * s) & (100 * s <= most * g)).astype(bool)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: float = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Each component x counts as floor(scale * x), a score is the inner product of
    such integers. Anchors are the rows whose key satisfies ``anchor``, a
    condition over a column ``id``. Positives of an anchor: the
    first ``positives`` other rows of its label, greater score first, then smaller
    key. For each, the first ``negatives`` rows of other labels whose score is
    ``least`` to ``most`` percent of the positive's. Only vectors of one length
    are compared; see ``stored`` for rows that take no part. Rows may repeat a key:
    each stands for itself. A null key comes last among equal scores and is no anchor.

    All anchors meet all vectors: anchors in blocks of ANCHORS, each with the
    vectors in up to SPREAD tasks. A task streams its vectors in order of their
    keys past its block, keeps the best of each anchor, and by the worst of these skips
    pairs whose bounds can't enter. Shuffled: the vectors, as small integers, once a
    block of anchors and pass.
    """
    table = cut(stored(vectors, key, vector, label, scale).withColumn("rid", F.monotonically_increasing_id()))
    chosen = cut(table.filter(F.coalesce(anchor, F.lit(False)) & (F.col("id") != int(LAST))).select("rid", "id"))
    # dense numbers of anchors: an offset per partition of the written table, few rows, and the place within it
    placed = chosen.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    placed = cut(placed)
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    total, before, offsets = 0, [], []
    for p in sorted(sizes):
        before.append(p)
        offsets.append(total)
        total += sizes[p]
    blocks = max(1, -(-total // ANCHORS))
    salts = max(1, min(SPREAD, -(-table.count() // ROWS)))
    starts = table.sparkSession.createDataFrame(list(zip(before, offsets, strict=True)), "part int, start long")
    number = placed.join(F.broadcast(starts), "part").select("rid", ((F.col("place") + F.col("start")) % blocks).cast("int").alias("ab"), F.floor((F.col("place") + F.col("start")) / blocks).cast("int").alias("n"))
    anchors = cut(table.join(number, "rid"))

    def passes(given: DataFrame | None, k: int, slots: int, lo: int | None, hi: int | None) -> DataFrame:
        extra = F.lit(None).cast("array<long>").alias("given")
        a = anchors.withColumn("given", extra) if given is None else anchors.join(given, ["ab", "n"])
        a = a.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("flag", F.lit(0))
        v = table.withColumns({"ab": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "n": F.lit(None).cast("int"), "given": F.lit(None).cast("array<long>"), "salt": F.pmod(F.xxhash64("rid"), F.lit(salts)).cast("int"), "flag": F.lit(1)})
        rows = a.unionByName(v).repartition("ab", "salt").sortWithinPartitions("ab", "salt", "flag", "id")
        found = _best_of_groups(rows, k, slots, lo, hi)
        # the best of each task's best: at most k rows a slot and task
        top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k)
        return found.groupBy("ab", "n", "slot").agg(top.alias("best"))

    first = passes(None, positives, 1, None, None).select("ab", "n", F.posexplode("best").alias("slot", "p"))
    first = cut(first.select("ab", "n", "slot", F.col("p.id").alias("positive_id"), (-F.col("p.s")).alias("positive_score")))
    given = first.groupBy("ab", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("given"))
    second = passes(given, negatives, positives, least, most).select("ab", "n", "slot", F.posexplode("best").alias("rank", "q"))
    out = cut(second.join(first, ["ab", "n", "slot"]).join(anchors.select("ab", "n", F.col("id").alias("anchor_id")), ["ab", "n"]))
    free(table, chosen, placed, anchors, first)

    def known(c: Column) -> Column:
        return F.when(c != int(LAST), c)

    return out.select("anchor_id", known(F.col("positive_id")).alias("positive_id"), (F.col("rank") + 1).cast("int").alias("rank"), known(F.col("q.id")).alias("negative_id"), "positive_score", (-F.col("q.s")).alias("negative_score"))
