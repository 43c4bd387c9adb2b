"""Clusters of embeddings by density: mutual reachability, a minimum spanning forest, and a condensed tree of clusters.

Two rows are as far apart as their vectors are, or as either is from its ``core``-th neighbour, whichever is most; pairs
farther than ``reach`` are no links. Whatever holds together up to some distance is a component; those of at least ``least``
rows are clusters, a tree of them as the distance grows. A cluster's stability is the sum over its rows of 1 / distance at
which they leave it less that at which it ends, and of the tree those clusters are taken that are more stable than what is
below them. A label is the smallest id of its cluster; rows in none are noise.

Rows are put into cells by nearest pivot (of ``PIVOTS`` rows chosen by hash) and near cells into blocks; a row meets only the cells that
can hold something near enough by the triangle inequality. Each row keeps its ``KEEP`` nearest. The forest grows by Borůvka
rounds: the least link out of each component is a grouped minimum over the links known so far, and rows whose list
cannot vouch for it search again, up to the least link known. The tree is built from below over ranges of at most ``EDGES``
links: within a range components are independent, so each is a group of its own. No step takes all rows to one task.

Rows that are no more than a block are one task's matrix. Distances are squared and rounded to nine places; links as far as one another join at once, so ties need no rule. Null
vectors, zeros, and vectors with a component that is null or not finite take no part and are noise.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.operators.graph import components
from storyline.shared import materialize

BLOCK, PIVOTS, KEEP, EDGES = 2048, 128, 16, 50_000
#: Blocks of a table and the most rows of one; tasks of a search; rows of the matrices in a task.
BLOCKS, SIDE, TASKS, AT_ONCE = 32, 131_072, 32, 1024
NEAREST = 1e-6


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.float64) if len(rows) else np.empty((0, 0))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors."""
    return np.round(np.maximum(2 - 2 * (a @ b.T), 0), 9)


def _packed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """A row for each key, with each of the other columns (long, double or array<double>) as the bytes of its values in order."""
    names = [c for c in rows.columns if c not in by]
    keys = [rows.schema[c] for c in by]

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in order])
        held = {c: t.column(c).combine_chunks() for c in names}
        flat = {c: (x.flatten() if pa.types.is_list(x.type) else x).to_numpy(zero_copy_only=False).tobytes() for c, x in held.items()}
        return pa.table({c: pa.array([k.as_py()], pa.int64()) for c, k in zip(by, key, strict=True)} | {c: pa.array([x], pa.binary()) for c, x in flat.items()})

    kind = T.StructType([*keys, *(T.StructField(c, T.BinaryType()) for c in names)])
    return rows.groupBy(*by).applyInArrow(lambda key, t: pack(key, t), kind)


def _row_by_row(a: np.ndarray) -> list[int]:
    """The rows of a small matrix from nearest to nearest, so that neighbours in the list are near."""
    left, way = set(range(1, len(a))), [0] if len(a) else []
    while left:
        near = list(left)
        way.append(near[int(np.argmax(a[near] @ a[way[-1]]))])
        left.discard(way[-1])
    return way


class _Space:
    """The rows in blocks of near cells, and which blocks a row has to meet. There are about ``BLOCKS`` blocks, each of at most ``SIDE``
    rows, so what is sent when all meet all grows with the rows, up to BLOCKS * SIDE of them."""

    def __init__(self, faces: DataFrame, key: str, embedding: str):
        spark = faces.sparkSession
        x = F.transform(embedding, lambda v: v.cast("double"))
        length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v))
        fit = F.col(embedding).isNotNull() & F.forall(x, lambda v: F.coalesce((v == v) & (F.abs(v) < float("inf")), F.lit(False)))
        rows = faces.filter(fit).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda v: v / length).alias("u"), length.alias("_l")).filter("_l > 0").drop("_l")
        pivots = np.array([r.u for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()], np.float64)
        way = _row_by_row(pivots)
        self.pivots = held = spark.sparkContext.broadcast(pivots[way])

        def home(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                d = np.sqrt(_apart(_matrix(p["u"]), held.value)) if len(p) else np.empty((0, 1))
                yield p.assign(cell=d.argmin(1) if len(p) else [], far=d.min(1) if len(p) else [])

        placed = materialize(rows.mapInPandas(home, "id long, u array<double>, cell long, far double"), "placed")
        cells = sorted((r.cell, r.n, r.far) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect())
        self.size = sum(n for _, n, _ in cells)
        self.side = max(BLOCK, min(SIDE, -(-self.size // BLOCKS)))
        # A cell's rows stand in any order from ``start`` on; blocks are pieces of the way through all cells.
        self.cells, start, starts, counts = {}, 0, [0] * (PIVOTS + 1), [1] * (PIVOTS + 1)
        for cell, n, far in cells:
            self.cells[cell] = (far, start // self.side, (start + n - 1) // self.side)
            starts[cell], counts[cell] = start, n
            start += n
        self.blocks = max(1, -(-self.size // self.side))
        of = lambda x: F.get(F.lit(x).cast("array<long>"), F.col("cell").cast("int"))
        at = of(starts) + F.pmod(F.xxhash64("id"), of(counts))
        self.rows = placed.select("id", "u", "cell", F.floor(at / self.side).alias("block"))
        self._held: DataFrame | None = None

    def search(self, asking: DataFrame, n: int, more: DataFrame | None, find: Callable[[dict, np.ndarray], _Found], schema: str) -> DataFrame:
        """What find() gathers for the n rows asking (id, u, cell, block, bound and others; bound is a squared distance) from all blocks
        that may hold rows within the bound of some, with the columns of more (by id; rows without are left out). A block of asking
        rows meets the others one by one in a task; what several tasks tell of a row is left to the caller to merge."""
        pivots, cells, spark = self.pivots, self.cells, asking.sparkSession
        if self._held is None:
            self._held = materialize(_packed(self.rows, ["block"], ["cell", "id"]), "held")
        asks = max(1, -(-n // self.side))
        strips = min(self.blocks, -(-TASKS // asks))
        one = materialize(_packed(asking.withColumn("ask", F.floor(F.col("block") * asks / self.blocks)).drop("block"), ["ask"], ["cell", "id"]), "asking")
        floats = {f.name for f in asking.schema if f.dataType.simpleString() in ("double", "array<double>")}

        def decoded(batch: pa.RecordBatch, k: int, names: dict[str, str], doubles: set[str]) -> dict[str, np.ndarray]:
            out = {to: np.frombuffer(batch.column(c)[k].as_buffer(), np.float64 if to in doubles else np.int64) for c, to in names.items()}
            if "u" in out:
                out["u"] = out["u"].reshape(len(out["id"]), -1)
            return out

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    q = decoded(batch, k, {c: c for c in ("id", "u", "bound")}, floats)
                    bound, met = np.sqrt(q["bound"]) + 1e-4, set()
                    for i in range(0, len(bound), AT_ONCE):
                        d = np.sqrt(_apart(q["u"][i : i + AT_ONCE], pivots.value))
                        for cell, (far, first, last) in cells.items():
                            if (d[:, cell] - far <= bound[i : i + AT_ONCE]).any():
                                met.update(range(first, last + 1))
                    there = np.array(sorted(met), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), batch.column("ask")[k].as_py(), np.int64)), pa.array(there)], ["ask", "block"])

        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
        pairs = one.select("ask", "id", "u", "bound").mapInArrow(visits, "ask long, block long")
        held, extra = self._held, []
        if more is not None:
            extra = [c for c in more.columns if c != "id"]
            known = self.rows.select("id", "cell", "block").join(more, "id", "left")
            known = known.select("block", "cell", "id", *(F.coalesce(c, F.lit(float("inf") if more.schema[c].dataType.simpleString() == "double" else -1)).alias(c) for c in extra))
            held = held.join(_packed(known, ["block"], ["cell", "id"]).select("block", *extra), "block")
        other = {c: f"_{c}" for c in ("id", "u", "cell", *extra)}
        doubles = floats | {f.name for f in (more.schema if more is not None else []) if f.dataType.simpleString() == "double"}
        held = held.select("block", *(F.col(c).alias(to) for c, to in other.items())).join(F.broadcast(pairs), "block").withColumn("strip", F.col("block") % strips).drop("block")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * asks * strips)
        mine = one.withColumn("strip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(strips - 1).cast("long"))))
        met = held.repartition(parts, "ask", "strip").join(mine.repartition(parts, "ask", "strip").hint("shuffle_hash"), ["ask", "strip"])
        own = {c: c for c in one.columns if c != "ask"}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple, _Found] = {}
            for batch in batches:
                for k in range(batch.num_rows):
                    name = (batch.column("ask")[k].as_py(), batch.column("strip")[k].as_py())
                    if name not in found:
                        q = {c: x.copy() for c, x in decoded(batch, k, own, floats).items()}
                        found[name] = find(q, np.sqrt(_apart(q["u"], pivots.value)))
                    found[name].meet_block(decoded(batch, k, {to: c for c, to in other.items()}, doubles), cells)
            for x in found.values():
                yield from x.told()

        return met.mapInArrow(run, schema)


class _Found:
    """A block of asking rows and what was found for them so far; bounds get less as more is found."""

    def __init__(self, q: dict[str, np.ndarray], far: np.ndarray):
        self.q, self.far, self.bound = q, far, q["bound"]

    def meet_block(self, m: dict[str, np.ndarray], cells: dict[int, tuple]) -> None:
        edges = [*np.flatnonzero(np.diff(m["cell"], prepend=-1)), len(m["cell"])]
        for low, high in zip(edges, edges[1:], strict=False):
            cell = int(m["cell"][low])
            for i in range(0, len(self.bound), AT_ONCE):
                piece = slice(i, i + AT_ONCE)
                for j in range(low, high, 4 * AT_ONCE):
                    near = i + np.flatnonzero(self.far[piece, cell] - cells[cell][0] <= np.sqrt(self.bound[piece]) + 1e-4)
                    if len(near):
                        self.meet(near, {c: x[j : min(j + 4 * AT_ONCE, high)] for c, x in m.items()})

    def meet(self, rows: np.ndarray, m: dict[str, np.ndarray]) -> None:
        """Takes what these rows of the cell (in order of id) are to the asking rows named by number."""
        raise NotImplementedError

    def told(self) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class _Nearest(_Found):
    """The ``keep`` nearest other rows within the bound, the smaller id among those as near."""

    def __init__(self, q: dict[str, np.ndarray], far: np.ndarray, keep: int):
        super().__init__(q, far)
        self.d, self.other = np.full((len(q["id"]), keep), np.inf), np.full((len(q["id"]), keep), -1, np.int64)

    def meet(self, rows: np.ndarray, m: dict[str, np.ndarray]) -> None:
        s = self.q["u"][rows] @ m["u"].T
        r, c = np.nonzero(s >= (1 - self.bound[rows] / 2 - 1e-8)[:, None])
        d, r, other = np.round(np.maximum(2 - 2 * s[r, c], 0), 9), rows[r], m["id"][c]
        fit = (d <= self.bound[r]) & (other != self.q["id"][r])
        d, r, other = d[fit], r[fit], other[fit]
        if not len(r):
            return
        met, keep = np.unique(r), self.d.shape[1]
        d, r, other = np.concatenate([d, self.d[met].ravel()]), np.concatenate([r, np.repeat(met, keep)]), np.concatenate([other, self.other[met].ravel()])
        order = np.lexsort((other, d, r))
        d, r, other = d[order], r[order], other[order]
        place = np.arange(len(r)) - np.searchsorted(r, r, side="left")
        first = place < keep
        self.d[r[first], place[first]], self.other[r[first], place[first]] = d[first], other[first]
        self.bound[met] = np.minimum(self.bound[met], self.d[met, -1])

    def told(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.d), 16 * AT_ONCE):
            r, k = np.nonzero(np.isfinite(self.d[i : i + 16 * AT_ONCE]))
            r += i
            yield pa.RecordBatch.from_arrays([pa.array(self.q["id"][r]), pa.array(self.other[r, k]), pa.array(self.d[r, k])], ["id", "other", "d"])


class _LeastOut(_Found):
    """The least link to a row of another component, within the bound; among equal ones the least ends."""

    def __init__(self, q: dict[str, np.ndarray], far: np.ndarray):
        super().__init__(q, far)
        self.w, self.other = np.full(len(q["id"]), np.inf), np.full(len(q["id"]), np.iinfo(np.int64).max)

    def meet(self, rows: np.ndarray, m: dict[str, np.ndarray]) -> None:
        w = np.maximum(_apart(self.q["u"][rows], m["u"]), self.q["core"][rows][:, None])
        w = np.maximum(w, m["core"][None, :])
        w[self.q["comp"][rows][:, None] == m["comp"][None, :]] = np.inf
        at = w.argmin(1)
        w, other = w[np.arange(len(rows)), at], m["id"][at]
        better = np.isfinite(w) & (w <= self.bound[rows]) & ((w < self.w[rows]) | ((w == self.w[rows]) & (other < self.other[rows])))
        rows, w = rows[better], w[better]
        self.w[rows], self.other[rows], self.bound[rows] = w, other[better], w

    def told(self) -> Iterator[pa.RecordBatch]:
        fit = np.isfinite(self.w)
        ids, other = self.q["id"][fit], self.other[fit]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, self.w[fit], np.minimum(ids, other), np.maximum(ids, other))], ["id", "w", "a", "b"])


def _neighbours(space: _Space, keep: int, reach: float) -> DataFrame:
    """id, other, d, n: the nearest other rows within reach, nearest first."""
    found = space.search(space.rows.withColumn("bound", F.lit(reach)), space.size, None, lambda q, far: _Nearest(q, far, keep), "id long, other long, d double")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))
    return materialize(found.withColumn("n", nth).filter(F.col("n") <= keep), "neighbours")


def _forest_of_a_block(space: _Space, core: int, reach: float) -> tuple[DataFrame, DataFrame]:
    """spanning_forest() of rows that are no more than a block: one task's matrix, grown from row to row."""

    def grow(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id", kind="stable")
        ids, d = p["id"].to_numpy(), _apart(_matrix(p["u"]), _matrix(p["u"]))
        np.fill_diagonal(d, np.inf)
        cores = np.partition(d, core - 1, axis=1)[:, core - 1] if len(ids) > core else np.full(len(ids), np.inf)
        fit = cores <= reach
        ids, cores, w = ids[fit], cores[fit], d[fit][:, fit]
        w = np.maximum(np.maximum(w, cores[:, None]), cores[None, :])
        w[w > reach] = np.inf
        left, to, open_, out = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64), np.ones(len(ids), bool), []
        while open_.any():
            k = int(np.argmin(np.where(open_, left, np.inf)))
            if not open_[k] or not np.isfinite(left[k]):
                k = int(np.argmax(open_))
                out.append((ids[k], -1.0, ids[k]))
            else:
                out.append((ids[k], left[k], ids[to[k]]))
            open_[k] = False
            nearer = w[k] < left
            left, to = np.where(nearer, w[k], left), np.where(nearer, k, to)
        return pd.DataFrame(out, columns=["id", "w", "other"])

    grown = materialize(space.rows.select("id", "u", F.lit(0).alias("block")).groupBy("block").applyInPandas(lambda p: grow(p), "id long, w double, other long"), "forest")
    return grown.filter("w >= 0").select("w", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")), grown.select("id")


def spanning_forest(space: _Space, core: int, reach: float, keep: int = KEEP) -> tuple[DataFrame, DataFrame]:
    """Links (w, a, b) of the minimum spanning forest, and the ids that have ``core`` neighbours within reach."""
    if space.size <= BLOCK:
        return _forest_of_a_block(space, core, reach)
    keep = max(keep, core)
    lists = _neighbours(space, keep, reach)
    cores = materialize(lists.filter(F.col("n") == core).select("id", F.col("d").alias("core")), "cores")
    last = lists.filter(F.col("n") == keep).select("id", F.col("d").alias("last"))
    two = lists.join(cores, "id").join(cores.select(F.col("id").alias("other"), F.col("core").alias("core2")), "other")
    known = two.select(F.greatest("d", "core", "core2").alias("w"), F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    known = materialize(known, "links")
    # No link that is not known and leads to a row is shorter than its ``least``.
    endless = F.lit(float("inf"))
    at = cores.join(last, "id", "left").select("id", "core", F.col("id").alias("comp"), F.coalesce(F.greatest("last", "core"), endless).alias("least"))
    forest: DataFrame | None = None

    def crossing(links: DataFrame, at: DataFrame) -> DataFrame:
        ends = at.select("id", "comp")
        return links.select("w", "a", "b").join(ends.toDF("a", "ca"), "a").join(ends.toDF("b", "cb"), "b").filter("ca <> cb").select("w", "a", "b", "ca", "cb")

    def least_of(links: DataFrame) -> DataFrame:
        both = links.select(F.explode(F.array("ca", "cb")).alias("comp"), F.struct("w", "a", "b", "ca", "cb").alias("x"))
        return materialize(both.groupBy("comp").agg(F.min("x").alias("best")), "best")

    while True:
        at = materialize(at, "components")
        # Links within a component are of no use from here on.
        known = materialize(crossing(known, at), "links")
        best = least_of(known)
        asking = at.join(best.select("comp", F.col("best.w").alias("w")), "comp", "left").withColumn("bound", F.coalesce("w", F.lit(reach))).filter(F.col("least") <= F.col("bound"))
        asking = materialize(asking.select("id", "core", "comp", "bound"), "asking")
        if n := asking.count():
            told = space.search(space.rows.join(asking, "id"), n, at.select("id", "core", "comp"), _LeastOut, "id long, w double, a long, b long")
            told = materialize(told.groupBy("id").agg(F.min(F.struct("w", "a", "b")).alias("x")).select("id", "x.*"), "told")
            known = materialize(known.unionByName(crossing(told, at)).distinct(), "links")
            # A row that found nothing within reach has no link out; one that found nothing nearer than its bound may have one there.
            heard = asking.join(told.select("id", "w"), "id", "left").select("id", F.coalesce("w", F.when(F.col("bound") >= reach, endless), "bound").alias("heard"))
            at = materialize(at.join(heard, "id", "left").withColumn("least", F.coalesce("heard", "least")).drop("heard"), "components")
            best = least_of(known)
        if best.isEmpty():
            break
        taken = materialize(best.select("best.*").distinct(), "taken")
        forest = taken.select("w", "a", "b") if forest is None else forest.unionByName(taken.select("w", "a", "b"))
        roots = components(taken.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        at = at.join(roots.toDF("comp", "root"), "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
    return (known.select("w", "a", "b").limit(0) if forest is None else forest), cores.select("id")


NODE = "kind string, node long, size long, cluster string, parent string, sums double, below double"


def _joined(nodes: pd.DataFrame, links: pd.DataFrame, least: int) -> pd.DataFrame:
    """The links of one range in one component, shortest first: what becomes of its nodes (node, size, cluster if it is one, sums
    of 1 / distance, value of the clusters below). Gives the one node left, the clusters that ended, and the cluster that the rows
    of each node came to first."""
    out: list[tuple] = []
    state = {n.node: [n.size, n.cluster if isinstance(n.cluster, str) else None, n.sums, n.below] for n in nodes.itertuples()}
    new = {n: [n] if s[1] is None else [] for n, s in state.items()}  # nodes whose rows are in no cluster yet
    up = {n: n for n in state}

    def top(n: int) -> int:
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for w, level in links.sort_values("w", kind="stable").groupby("w", sort=True):
        near, met = 1 / max(math.sqrt(w), NEAREST), {}
        for a, b in zip(level["a"], level["b"], strict=True):
            x, y = sorted((top(a), top(b)))
            if x != y:
                up[y] = x
                met[x] = met.pop(x, [x]) + met.pop(y, [y])
        for x, parts in met.items():
            size, big = sum(state[p][0] for p in parts), [p for p in parts if state[p][1] is not None]
            fresh = [n for p in parts for n in new.pop(p)]
            if len(big) == 1:
                n, name, sums, below = state[big[0]]
                state[x] = [size, name, sums + (size - n) * near, below]
            elif big or size >= least:
                name, below = f"{float(w)!r}:{x}", 0.0
                for p in big:
                    n, child, sums, under = state[p]
                    stability = sums - n * near
                    below += max(stability, under)
                    out.append(("cluster", None, n, child, name, stability, under))
                state[x] = [size, name, size * near, below]
            else:
                state[x] = [size, None, 0.0, 0.0]
            name = state[x][1]
            new[x] = [] if name is not None else fresh
            if name is not None:
                out += [("home", n, None, name, None, None, None) for n in fresh]
    for x in {top(n) for n in state}:
        size, name, sums, below = state[x]
        out.append(("node", x, size, name, None, sums, below))
    return pd.DataFrame(out, columns=[c.split()[0] for c in NODE.split(", ")])


def condensed_tree(forest: DataFrame, ids: DataFrame, least: int, reach: float, at_once: int = EDGES) -> tuple[DataFrame, DataFrame]:
    """Clusters (cluster, parent, size, stability, below: what those below are worth) and each id's first cluster (id, cluster)."""
    forest = materialize(forest, "forest")
    ranges = max(1, math.ceil(forest.count() / at_once))
    cuts = sorted(set(forest.agg(F.percentile_approx("w", [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0])) if ranges > 1 else []
    rows = ids.select("id", F.col("id").alias("node"), F.lit(None).cast("string").alias("home"))
    nodes = ids.select(F.col("id").alias("node"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("string").alias("cluster"), F.lit(0.0).alias("sums"), F.lit(0.0).alias("below"))
    ended: DataFrame | None = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        held = forest if low is None else forest.filter(F.col("w") > low)
        held = held if high is None else held.filter(F.col("w") <= high)
        place = rows.select("id", "node")
        held = held.join(place.toDF("a", "na"), "a").join(place.toDF("b", "nb"), "b").select("w", F.col("na").alias("a"), F.col("nb").alias("b"))
        held = materialize(held, "range")
        roots = components(held.select("a", "b")).toDF("node", "root")
        linked = held.join(roots.toDF("a", "root"), "a")
        touched = nodes.join(roots, "node")
        done = linked.groupBy("root").cogroup(touched.groupBy("root")).applyInPandas(lambda e, n: _joined(n, e, least), NODE)
        done = materialize(done, "joined")
        over = done.filter("kind = 'cluster'").select("cluster", "parent", "size", F.col("sums").alias("stability"), "below")
        ended = over if ended is None else ended.unionByName(over)
        nodes = nodes.join(roots, "node", "left_anti").unionByName(done.filter("kind = 'node'").select(*nodes.columns))
        homes = done.filter("kind = 'home'").select("node", F.col("cluster").alias("now"))
        rows = rows.join(homes, "node", "left").join(roots, "node", "left")
        rows = materialize(rows.select("id", F.coalesce("root", "node").alias("node"), F.coalesce("home", "now").alias("home")), "rows")
        nodes = materialize(nodes, "nodes")
    last = nodes.filter("cluster is not null").select("cluster", F.lit(None).cast("string").alias("parent"), "size", (F.col("sums") - F.col("size") / max(math.sqrt(reach), NEAREST)).alias("stability"), "below")
    return materialize(ended.unionByName(last), "clusters"), rows.select("id", F.col("home").alias("cluster"))


def chosen(clusters: DataFrame) -> DataFrame:
    """cluster and pick: the highest cluster on the way up from it that is worth no less than those below it, itself included. Ways
    are doubled, so a tree of depth d takes log d rounds."""
    best = F.when(F.col("stability") >= F.col("below"), F.col("cluster"))
    now = materialize(clusters.select("cluster", F.col("parent").alias("up"), best.alias("pick")), "ways")
    while not now.filter("up is not null").isEmpty():
        above = now.select(F.col("cluster").alias("up"), F.col("up").alias("up2"), F.col("pick").alias("pick2"))
        now = materialize(now.join(above, "up", "left").select("cluster", F.col("up2").alias("up"), F.coalesce("pick2", "pick").alias("pick")), "ways")
    return now.select("cluster", "pick")


def density_clusters(faces: DataFrame, key: str, embedding: str, least: int = 5, core: int = 3, reach: float = 1.0) -> DataFrame:
    """id, label (null for noise) and size of each row's cluster. reach: the largest distance of unit vectors that links."""
    space = _Space(faces, key, embedding)
    forest, ids = spanning_forest(space, core, round(reach * reach, 9))
    clusters, first = condensed_tree(forest, ids, least, round(reach * reach, 9))
    held = first.join(chosen(clusters), "cluster").filter("pick is not null").select("id", "pick")
    labels = held.groupBy("pick").agg(F.min("id").alias("label"), F.count("*").alias("size"))
    return faces.select(F.col(key).cast("long").alias("id")).join(held.join(labels, "pick").drop("pick"), "id", "left")
