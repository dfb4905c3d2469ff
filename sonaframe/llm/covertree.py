"""Exact top-k inner products by dual-tree search over cover trees.

Candidates and queries are dealt by hash into blocks of a bounded size, and a
task builds a cover tree of each block: a node covers its points within a
radius, its children's radius is smaller by a fixed base, and centres of
siblings lie more than the children's radius apart.  A query block then meets each candidate block:
a pair of nodes with centres q and r and radii a and b holds no inner product
above ``q.r + a |r| + b |q| + a b``; the pair is dropped when this is below
the worst k-th score of the query node's queries, else the wider node is
opened, most promising pairs first.  k-th scores start from a bounded sample
of the candidates, which only makes them larger, never wrong: every row is
searched and the result is exact.

Scores are integers: components are floor(scale * x).  Products below 2 ** 53
are exact as doubles; blocks that could exceed this use 64-bit integers.

Edge cases: vectors that are null or hold null, NaN or infinite components
take no part, nor do rows with a null id; vectors of different lengths do not
meet; rows that repeat an id are rows of their own (a query skips only its
own row); ties go to the smaller id; with fewer than k candidates all are
returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

LEAF = 256
#: A child's radius is its parent's over this.
BASE = 1.3
_EXACT = float(1 << 53)


@dataclass
class CoverTree:
    """Nodes in arrays; a leaf holds the points order[start:end], an inner node the nodes child[start:end]."""
    rows: np.ndarray       # row numbers, in order
    ids: np.ndarray
    x: np.ndarray          # points, in order
    centre: np.ndarray     # node centres
    norm: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    children: list[list[int]]

    @property
    def exact(self) -> bool:
        return len(self.x) == 0 or float((self.x.astype(np.float64) ** 2).sum(1).max()) < _EXACT / 4


def build_tree(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> CoverTree:
    f = x.astype(np.float64)
    order: list[int] = []
    centre, radius, start, end, children = [], [], [], [], []

    def far(at: np.ndarray, p: int) -> np.ndarray:
        d = f[at] - f[p]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    # (points, centre, their distances to it, parent)
    todo = [(np.arange(len(x)), 0, far(np.arange(len(x)), 0), -1)] if len(x) else []
    while todo:
        at, p, dist, parent = todo.pop()
        node = len(centre)
        r = float(dist.max())
        centre.append(p)
        radius.append(r * (1 + 1e-9) + 1e-6)
        start.append(len(order))
        children.append([])
        if parent >= 0:
            children[parent].append(node)
        if len(at) <= leaf or r == 0.0:
            order.extend(at.tolist())
            end.append(len(order))
            continue
        end.append(-1)
        # centres more than r / BASE apart, until every point lies within r / BASE of one
        chosen, near, owner = [p], dist.copy(), np.zeros(len(at), np.int64)
        while near.max() > r / BASE:
            q = int(at[near.argmax()])
            d = far(at, q)
            closer = d < near
            owner[closer] = len(chosen)
            near = np.where(closer, d, near)
            chosen.append(q)
        for c, q in enumerate(chosen):
            mine = owner == c
            todo.append((at[mine], q, near[mine], node))
    o = np.array(order, np.int64)
    c = f[np.array(centre, np.int64)] if centre else np.zeros((0, x.shape[1]))
    return CoverTree(rows[o], ids[o], x[o], c, np.sqrt((c * c).sum(1)), np.array(radius), np.array(start), np.array(end), children)


def _leaf_of(tree: CoverTree, node: int) -> bool:
    return not tree.children[node]


def dual_search(q: CoverTree, r: CoverTree, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the positions in ``r``, scores and validity of its best k (of at least ``floor``)."""
    nq = len(q.x)
    exact = q.exact and r.exact
    qx, rx = (q.x.astype(np.float64), r.x.astype(np.float64)) if exact else (q.x, r.x)
    low = np.iinfo(np.int64).min
    best = np.full((nq, k), low, np.int64)
    where = np.full((nq, k), -1, np.int64)
    big = np.iinfo(np.int64).max
    worst = floor.astype(np.float64)  # no candidate below it can count
    rank = np.argsort(np.argsort(r.ids, kind="stable"))  # ties: smaller id first
    leaves: dict[int, np.ndarray] = {}

    def queries(node: int) -> np.ndarray:
        got = leaves.get(node)
        if got is None:
            got = np.arange(q.start[node], q.end[node]) if _leaf_of(q, node) else np.concatenate([queries(c) for c in q.children[node]])
            leaves[node] = got
        return got

    def bound(a: int, b: int) -> float:
        v = float(q.centre[a] @ r.centre[b]) + q.radius[a] * r.norm[b] + r.radius[b] * q.norm[a] + q.radius[a] * r.radius[b]
        return v * (1 + 1e-9) + 1e-6 if v > 0 else v * (1 - 1e-9) + 1e-6

    heap = [(-bound(0, 0), 0, 0)] if nq and len(rx) else []
    while heap:
        minus, a, b = heapq.heappop(heap)
        at = queries(a)
        if -minus < worst[at].min():
            continue
        la, lb = _leaf_of(q, a), _leaf_of(r, b)
        if la and lb:
            span = np.arange(r.start[b], r.end[b])
            s = (qx[at] @ rx[span].T).astype(np.int64)
            s[q.rows[at][:, None] == r.rows[span][None, :]] = low  # the query's own row
            for lo in range(0, len(span), 512):
                part, ps = span[lo: lo + 512], s[:, lo: lo + 512]
                some = (ps >= worst[at][:, None]).any(axis=1)
                if not some.any():
                    continue
                rows = at[some]
                allw = np.concatenate([where[rows], np.tile(part, (len(rows), 1))], axis=1)
                alls = np.concatenate([best[rows], ps[some]], axis=1)
                ties = np.where(allw >= 0, rank[allw], big)
                first = np.argsort(ties, axis=1, kind="stable")
                alls, allw = np.take_along_axis(alls, first, 1), np.take_along_axis(allw, first, 1)
                top = np.argsort(-np.maximum(alls, low + 1), axis=1, kind="stable")[:, :k]
                best[rows], where[rows] = np.take_along_axis(alls, top, 1), np.take_along_axis(allw, top, 1)
                kth = best[rows, k - 1]
                worst[rows] = np.where(kth > low, np.maximum(worst[rows], kth.astype(np.float64)), worst[rows])
            continue
        if lb or not la and q.radius[a] >= r.radius[b]:
            pairs = [(c, b) for c in q.children[a]]
        else:
            pairs = [(a, c) for c in r.children[b]]
        for c, d in pairs:
            v = bound(c, d)
            if v >= worst[queries(c)].min():
                heapq.heappush(heap, (-v, c, d))
    return where, best, (best > low) & (best >= floor[:, None])


def _integer_vectors(vectors: DataFrame, id_col: str, column: str, scale: int) -> DataFrame:
    x = F.transform(F.col(column), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    fine = F.forall(F.col(column), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(column).isNotNull()).where(fine).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), x.alias("x"), F.size(column).alias("dim"))


def _matrix(lists: pa.ChunkedArray, n: int, dim: int) -> np.ndarray:
    flat = lists.combine_chunks().flatten() if isinstance(lists, pa.ChunkedArray) else lists.flatten()
    return np.asarray(flat, np.int64).reshape(n, dim)


def _trees(points: DataFrame, per_block: int, keys: list[str]) -> DataFrame:
    """One row (keys, tree) a block."""
    def build(batch: pa.Table) -> pa.Table:
        n, dim = batch.num_rows, batch.column("dim")[0].as_py()
        ids = np.asarray(batch.column("id").combine_chunks(), np.int64)
        order = np.lexsort((np.asarray(batch.column("row").combine_chunks(), np.int64), ids))
        tree = build_tree(np.asarray(batch.column("row").combine_chunks(), np.int64)[order], ids[order], _matrix(batch.column("x"), n, dim)[order])
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([batch.column("block")[0].as_py()], pa.int64()),
                         "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return points.groupBy(*keys).applyInArrow(build, "dim int, block long, tree binary")


def top_inner_products(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", column: str = "embedding",
                       block_rows: int = 4096, query_rows: int = 1024, sample_rows: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner products of each row that ``queries`` names.

    ``queries`` is a condition on ``id``.  ``sample_rows`` bounds the sample
    that starts the k-th scores.
    """
    points = cut(_integer_vectors(vectors, id_col, column, scale))
    sizes = {r["dim"]: r["n"] for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # lengths of vectors: few
    blocks = max(1, -(-max(sizes.values(), default=0) // block_rows))
    asked = points.where(queries)
    groups = max(1, -(-asked.count() // query_rows))
    deal = lambda df, n: df.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)).cast("long"))
    sample = points.orderBy(F.xxhash64("row"), "row").limit(sample_rows).select("row", "x", "dim").collect()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {r["dim"] for r in sample}:
        own = [r for r in sample if r["dim"] == d]
        by_dim[d] = (np.array([r["row"] for r in own], np.int64), np.array([r["x"] for r in own], np.int64).reshape(len(own), d))
    candidates = _trees(deal(points, blocks), block_rows, ["dim", "block"])
    asked = _trees(deal(asked, groups), query_rows, ["dim", "block"]).select("dim", F.col("tree").alias("asked"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    both = asked.join(candidates, ["dim", "block"]).select("asked", "tree")

    def search(batches):
        for b in batches:
            for qa, ra in zip(b.column(0), b.column(1)):
                q, r = pickle.loads(qa.as_py()), pickle.loads(ra.as_py())
                floor = np.full(len(q.x), np.iinfo(np.int64).min + 1, np.int64)
                rows, x = by_dim.get(q.x.shape[1], (np.zeros(0, np.int64), np.zeros((0, q.x.shape[1]), np.int64)))
                if len(rows) > k:
                    s = (q.x.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if q.exact else q.x @ x.T
                    s[q.rows[:, None] == rows[None, :]] = np.iinfo(np.int64).min + 1
                    floor = np.partition(s, len(rows) - k, axis=1)[:, len(rows) - k]
                where, score, real = dual_search(q, r, k, floor)
                i, j = np.nonzero(real)
                at = where[i, j]
                yield pa.RecordBatch.from_arrays([pa.array(q.rows[i]), pa.array(q.ids[i]), pa.array(r.ids[at]), pa.array(score[i, j])],
                                                 names=["row", "query_id", "vec_id", "score"])

    found = both.mapInArrow(search, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
