"""Embedding near-dedup by an epsilon grid order join."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmill.llm.common import cut
from jobmill.llm.components import components

#: Vectors from which the principal directions are learned at most. They order the work and never change the result.
SAMPLE = 5_000
#: Leading directions that make the grid, vectors of a block, of a leaf.
DIRECTIONS, BLOCK, LEAF = 8, 512, 128


def principal(sample: np.ndarray) -> np.ndarray:
    """Orthonormal leading directions, one per column."""
    if len(sample) < 2:
        return np.eye(sample.shape[1])[:, :DIRECTIONS]
    _, v = np.linalg.eigh(np.cov(sample.T))
    return v[:, ::-1][:, :DIRECTIONS]


def box_gap(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> float:
    """Least distance between two boxes."""
    return float(np.sqrt((np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a)) ** 2).sum()))


def interval_pairs(p: np.ndarray, q: np.ndarray, eps: float, same: bool) -> Iterator[tuple[slice, slice]]:
    """Leaf pairs of two sequences of projected vectors that may hold points within eps; halves intervals recursively."""
    todo = [(0, len(p), 0, len(q))]
    while todo:
        a, b, c, d = todo.pop()
        if box_gap(p[a:b].min(0), p[a:b].max(0), q[c:d].min(0), q[c:d].max(0)) > eps:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            yield slice(a, b), slice(c, d)
        elif same and (a, b) == (c, d):
            m = (a + b) // 2
            todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]


def link_leaf(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest joint index that rows and columns of a link matrix reach; columns follow the rows in the index."""
    n, m = near.shape
    row, col = np.arange(n), np.arange(n, n + m)
    while True:
        new_col = np.minimum(col, np.where(near, row[:, None], n + m).min(axis=0))
        new_row = np.minimum(row, np.where(near, new_col[None, :], n + m).min(axis=1))
        if (new_row == row).all() and (new_col == col).all():
            return row, col
        row, col = new_row, new_col


def near_vectors(vectors: DataFrame, cosine: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of vectors: key, n_links, component_id, kept.

    Vectors of one label and length are linked when their cosine, in double
    precision, is at least ``cosine``. Vectors that are null, empty, zero or
    hold null or non-finite parts, and those without a label, link with
    nothing. Equal vectors are one node with a multiplicity, so a vector with
    very many copies is compared once.

    Nodes are sorted by the cells of a grid of width eps (the distance of unit
    vectors at that cosine) on the leading principal directions and cut into
    blocks. Projection shortens distances, so blocks whose boxes are more than
    eps apart hold no link: partitions are paired first, then their blocks,
    then intervals within blocks, down to leaves that are compared in full.
    component_id: smallest key that links reach. kept: key equals component_id.
    A null key never is a component's smallest.
    """
    eps = math.sqrt(2 - 2 * cosine) + 1e-7
    v = F.col(vector)
    fine = (
        v.isNotNull() & F.col(label).isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    node = F.md5(F.concat_ws("|", F.col(label).cast("string"), v.cast("string")).cast("binary"))
    rows = vectors.select(F.col(key), F.when(fine, node).alias("node"), F.col(label).alias("label"), v.alias("v"))
    nodes = cut(
        rows.filter("node is not null").groupBy("node")
        .agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("m"), F.min(key).alias("low"))
        .withColumn("dim", F.size("v"))
    )
    spark = vectors.sparkSession
    common = nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    turn = None
    if common:
        sample = nodes.filter(F.col("dim") == common[0]["dim"]).orderBy("node").limit(SAMPLE).select("v").collect()
        x = np.array([r["v"] for r in sample], float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        turn = principal(x / np.linalg.norm(x, axis=1, keepdims=True))
    shared = spark.sparkContext.broadcast(turn)

    def unit(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def project(u: np.ndarray) -> np.ndarray:
        t = shared.value
        return u @ t if t is not None and len(t) == u.shape[1] else np.zeros((len(u), 1))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, g in b.groupby("dim"):
                u = unit(np.array(g["v"].tolist(), float))
                c = np.floor(project(u) / eps).astype(np.int64)
                yield pd.DataFrame({"node": g["node"], "label": g["label"].astype(str), "dim": g["dim"], "m": g["m"], "cell": list(c), "u": [x.tobytes() for x in u]})

    placed = nodes.select("node", "label", "dim", "m", "v").mapInPandas(cells, "node string, label string, dim int, m long, cell array<long>, u binary")
    order = ["label", "dim", "cell", "node"]

    def blocks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of at most BLOCK consecutive nodes of one label and length."""
        rest: pd.DataFrame | None = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            parts = [g.iloc[i : i + BLOCK] for _, g in b.groupby(["label", "dim"], sort=False) for i in range(0, len(g), BLOCK)]
            rest = parts.pop() if parts else None
            if parts:
                yield pd.DataFrame([block(g) for g in parts])
        if rest is not None and len(rest):
            yield pd.DataFrame([block(rest)])

    def block(g: pd.DataFrame) -> dict:
        u = np.frombuffer(b"".join(g["u"]), float).reshape(len(g), -1)
        p = project(u)
        return {"block": g["node"].iloc[0], "label": g["label"].iloc[0], "dim": g["dim"].iloc[0], "lo": p.min(0), "hi": p.max(0), "nodes": g["node"].tolist(), "m": g["m"].to_numpy(), "u": u.tobytes()}

    blocks = cut(
        placed.repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInPandas(blocks_of, "block string, label string, dim int, lo array<double>, hi array<double>, nodes array<string>, m array<long>, u binary")
        .withColumn("part", F.spark_partition_id())
    )

    def gap(a: str, b: str) -> F.Column:
        """Square of the least distance between two boxes."""
        sides = F.zip_with(
            F.zip_with(f"{a}lo", f"{b}hi", lambda x, y: x - y), F.zip_with(f"{b}lo", f"{a}hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))
        )
        return F.aggregate(sides, F.lit(0.0), lambda s, x: s + x * x)

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])

    boxes = blocks.select("block", "label", "dim", "part", "lo", "hi")
    corner = [F.array(*[f(F.element_at(c, i + 1)) for i in range(DIRECTIONS)]) for f, c in ((F.min, "lo"), (F.max, "hi"))]
    corners = [F.filter(x, lambda y: y.isNotNull()) for x in corner]
    boxes8 = boxes.withColumns({c: F.concat(c, F.array_repeat(F.lit(0.0), DIRECTIONS)) for c in ("lo", "hi")})
    parts = boxes8.groupBy("label", "dim", "part").agg(corners[0].alias("lo"), corners[1].alias("hi"))
    pa, pb = named(parts, "a_"), named(parts, "b_")
    near_parts = pa.join(pb, (pa["a_label"] == pb["b_label"]) & (pa["a_dim"] == pb["b_dim"]) & (pa["a_part"] <= pb["b_part"])).filter(gap("a_", "b_") <= eps * eps)
    near_parts = near_parts.select(F.col("a_label").alias("label"), F.col("a_dim").alias("dim"), "a_part", "b_part")
    ba, bb = named(boxes.drop("label", "dim"), "a_"), named(boxes.drop("label", "dim"), "b_")
    ba, bb = ba.join(boxes.select(F.col("block").alias("a_block"), "label", "dim"), "a_block"), bb.join(boxes.select(F.col("block").alias("b_block"), F.col("label").alias("l2"), F.col("dim").alias("d2")), "b_block")
    pairs = near_parts.join(ba, ["label", "dim", "a_part"]).join(bb, (F.col("label") == F.col("l2")) & (F.col("dim") == F.col("d2")) & (near_parts["b_part"] == bb["b_part"]))
    pairs = pairs.filter((F.col("a_part") < bb["b_part"]) | (F.col("a_block") <= F.col("b_block"))).filter(gap("a_", "b_") <= eps * eps).select("a_block", "b_block")
    data = blocks.select("block", "nodes", "m", "u")
    work = pairs.join(named(data, "a_"), "a_block").join(named(data, "b_"), "b_block")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each node, links counted here and the first node that it reaches here."""
        for batch in batches:
            for r in batch.itertuples():
                same = r.a_block == r.b_block
                a = np.frombuffer(r.a_u, float).reshape(len(r.a_nodes), -1)
                b = np.frombuffer(r.b_u, float).reshape(len(r.b_nodes), -1)
                na, nb = np.array(r.a_nodes, object), np.array(r.b_nodes, object)
                for i, j in interval_pairs(project(a), project(b), eps, same):
                    near = a[i] @ b[j].T >= cosine
                    whole = same and i == j
                    if whole:
                        np.fill_diagonal(near, False)
                    if not near.any():
                        continue
                    # rows and columns of a whole block are the same nodes
                    row, col = link_leaf(near | np.eye(len(near), dtype=bool) if whole else near)
                    names = np.concatenate([na[i], nb[j]])
                    yield pd.DataFrame({"node": na[i], "n": near @ r.b_m[j], "root": names[row]})[near.any(axis=1)]
                    if not whole:
                        yield pd.DataFrame({"node": nb[j], "n": near.T @ r.a_m[i], "root": names[col]})[near.any(axis=0)]

    found = cut(work.mapInPandas(compare, "node string, n long, root string"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.select("node", "m", "low").join(counts, "node", "left").join(roots, "node", "left").select("node", "low", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    lows = cut(known.groupBy("root").agg(F.min("low").alias("component_id")))  # so that Spark can split a large component
    known = known.join(lows, "root").select("node", "n_links", "component_id")
    out = rows.select(key, "node").join(known, "node", "left")
    out = out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
