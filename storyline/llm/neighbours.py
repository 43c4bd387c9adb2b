"""Approximate nearest neighbours by few stable projections, a kd-tree over them, and a chi-square stopping test.

Vectors of length one are projected on a few random directions. A projected squared distance over the true one follows
a chi-square law with as many degrees of freedom as directions. A search takes the leaves of the kd-tree in the order of
their projected distance from the query and of their vectors those that pass the test are verified by true cosine; a vector
fails it, and the search ends at the first leaf that does, when a vector nearer than the worst of the best found would lie
that far out in projection only with a small probability (``risk``).

Rows are dealt to blocks by a hash of the id, queries to chunks; each block answers each chunk, and the best of all
blocks are ranked. Nothing is fitted on the data. Vectors that are null, zero, or hold null or non-finite components
take no part; vectors of different length are never compared. Equal scores go by the smaller id. Repeated ids are rows
of their own, though never candidates of a query of the same id. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS, LEAF, SEED = 16, 48, 7
BLOCK_ROWS, LEAST_ROWS, USUAL_BLOCKS, CHUNK_ROWS = 16_384, 1024, 12, 8192
LEAVES_AT_ONCE = 6


def chi_square_limit(risk: float, m: int = DIRECTIONS) -> float:
    """x with P(chi-square of m degrees >= x) = risk; m is even."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    lo, hi = 0.0, 400.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > risk else (lo, mid)
    return hi


class Tree:
    """Leaves of a kd-tree: row order, offsets and boxes."""

    def __init__(self, points: np.ndarray):
        self.order, ends, todo = np.arange(len(points)), [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF:
                ends.append((a, b))
                continue
            rows = self.order[a:b]
            axis = int(np.argmax(np.ptp(points[rows], axis=0)))
            half = (b - a) // 2
            self.order[a:b] = rows[np.argpartition(points[rows, axis], half)]
            todo += [(a, a + half), (a + half, b)]
        self.ends = np.array(sorted(ends)).reshape(-1, 2)
        sorted_points = points[self.order]
        self.low = np.minimum.reduceat(sorted_points, self.ends[:, 0])
        self.high = np.maximum.reduceat(sorted_points, self.ends[:, 0])

    def distances(self, q: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (gap * gap).sum(1)


def _dots(columns: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products of the columns with q, summed from the first component to the last as SQL does it: the same to the bit."""
    each = np.ascontiguousarray(columns) * q.reshape(len(q), -1)
    # A lone column would be summed in pairs.
    return np.add.reduce(each, axis=0) if each.shape[1] > 1 else np.add.accumulate(each, axis=0)[-1]


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, limit: float, verified: list[int] | None = None) -> tuple[list[int], list[int], list[float]]:
    """The k nearest found of one block for each query: query ids, ids and cosines. verified: gets the number of vectors whose cosine
    was taken for each query."""
    across = np.ascontiguousarray(vectors.T)
    norm = np.sqrt(_dots(across, across))
    unit = vectors / norm[:, None]
    basis = np.random.default_rng(SEED).standard_normal((vectors.shape[1], DIRECTIONS))
    points = unit @ basis
    tree = Tree(points)
    points = points[tree.order]
    ids, across, norm = ids[tree.order], across.take(tree.order, 1), norm[tree.order]
    out: tuple[list[int], list[int], list[float]] = ([], [], [])
    for qid, q in zip(query_ids, queries, strict=True):
        length = math.sqrt(float(_dots(q[:, None], q)[0]))
        at_q = (q / length) @ basis
        far = tree.distances(at_q)
        leaves = np.argsort(far, kind="stable")
        best_s, best_r, n = np.empty(0), np.empty(0, np.int64), 0
        for at in range(0, len(leaves), LEAVES_AT_ONCE):
            if len(best_s) == k and far[leaves[at]] > limit * max(2 - 2 * best_s[-1], 1e-12):
                break
            rows = np.concatenate([np.arange(a, b) for a, b in tree.ends[leaves[at : at + LEAVES_AT_ONCE]]])
            rows = rows[ids[rows] != qid]
            if len(best_s) == k:
                gap = points[rows] - at_q
                rows = rows[np.einsum("ij,ij->i", gap, gap) <= limit * max(2 - 2 * best_s[-1], 1e-12)]
                if not len(rows):
                    continue
            n += len(rows)
            s = np.concatenate([best_s, _dots(across.take(rows, 1), q) / (norm[rows] * length)])
            r = np.concatenate([best_r, rows])
            top = np.lexsort((ids[r], -s))[:k]
            best_s, best_r = s[top], r[top]
        if verified is not None:
            verified.append(n)
        out[0].extend([qid] * len(best_r))
        out[1].extend(ids[best_r].tolist())
        out[2].extend(best_s.tolist())
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, risk: float = 0.002) -> DataFrame:
    """query_id, rank, vec_id and score. rows and queries: vec_id and embedding."""
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    vectors = lambda df: df.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)
    rows, queries = vectors(rows), vectors(queries)
    n, nq = rows.count(), queries.count()
    blocks = max(1, math.ceil(n / BLOCK_ROWS), min(USUAL_BLOCKS, math.ceil(n / LEAST_ROWS)))
    chunks = max(1, math.ceil(nq / CHUNK_ROWS))
    dealt = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = queries.select(F.size("v").alias("dim"), dealt(2, chunks).alias("chunk"), each(blocks).alias("block"), "vec_id", "v")
    right = rows.select(F.size("v").alias("dim"), dealt(1, blocks).alias("block"), each(chunks).alias("chunk"), "vec_id", "v")
    limit = chi_square_limit(risk)

    def block(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        held, asked = held.sort_values("vec_id", kind="stable"), asked.sort_values("vec_id", kind="stable")
        found = search(held["vec_id"].to_numpy(), np.stack(held["v"].to_numpy()), asked["vec_id"].to_numpy(), np.stack(asked["v"].to_numpy()), k, limit)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    keys = ["dim", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
