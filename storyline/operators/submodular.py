"""Selection of K photos that are good, spread over months, events, persons and kinds, and not alike.

The value of a selection is the sum of its scores, plus for each month, event, person and kind a weight times the square root
of its photos in it, less twice what pairs of embeddings are alike beyond 0.8. Each further photo adds less than it would
have before, so the greedy choice is near the best, and a photo's gain of earlier is a bound of its gain now: the lazy greedy
looks at a photo again only when its bound is on top.

The rows are dealt at random (by hash) to parts of at most ``at_once`` rows; each part picks K, the picks are dealt again until
one part holds them, and that one picks K. The better of this and of the best part is improved by swaps until none gains. Without
the penalty, where the value never falls, two such rounds reach in expectation at least (1 - 1/e) / 2 of the best value
(Barbosa et al., 2015), whatever the number of parts; with it no bound is known, and a test measures it. No part holds more
than ``at_once`` rows, however many there are.

rows: id, score, month, event, importance (of the event), persons (array of struct person, weight), kind, embedding. Nulls: a null
score or importance is 0, a null month, event or kind is a group of its own, a photo without persons or embedding has none.
Equal gains go to the smallest id. Fewer than K rows are all taken.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.shared import materialize

# Weight of each term, and the likeness from which on a pair costs.
MONTH, EVENT, PERSON, KIND, ALIKE, FREE = 0.6, 0.8, 1.0, 0.4, 2.0, 0.8
POOL = {
    "id": "long", "score": "double", "month": "string", "event": "string", "importance": "double", "persons": "array<struct<person:long,weight:double>>", "kind": "string",
    "embedding": "array<double>",
}


class Pool:
    """Rows of one part as arrays, sorted by id."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("id", kind="stable").reset_index(drop=True)
        self.rows, self.n = rows, len(rows)
        self.id = rows["id"].to_numpy(np.int64)
        self.score = rows["score"].fillna(0.0).to_numpy(np.float64)
        code = lambda c: pd.factorize(rows[c], use_na_sentinel=False)[0]
        self.groups = [(code("month"), np.full(self.n, MONTH)), (code("event"), EVENT * rows["importance"].fillna(0.0).to_numpy(np.float64)), (code("kind"), np.full(self.n, KIND))]
        held = [[] if p is None else p for p in rows["persons"]]
        names: dict[int, int] = {}
        for x in held:
            for p in x:
                names.setdefault(p["person"], len(names))
        self.person = np.zeros((self.n, len(names)))
        for i, x in enumerate(held):
            for p in x:
                self.person[i, names[p["person"]]] = p["weight"] or 0.0
        size = max((len(e) for e in rows["embedding"] if e is not None), default=1)
        self.unit = np.zeros((self.n, size))
        for i, e in enumerate(rows["embedding"]):
            if e is not None and len(e) == size and (length := math.sqrt(float(np.dot(e, e)))) > 0:
                self.unit[i] = np.asarray(e, np.float64) / length

    def alike(self, i: int) -> np.ndarray:
        """What each row costs beside row i."""
        return ALIKE * np.maximum(self.unit @ self.unit[i] - FREE, 0.0)


class Chosen:
    """A selection, with what is needed to tell the gain of any row."""

    def __init__(self, pool: Pool):
        self.p, self.members = pool, []
        self.counts = [np.zeros(int(c.max(initial=-1)) + 1) for c, _ in pool.groups]
        self.shown = np.zeros(pool.person.shape[1])
        self.cost = np.zeros(pool.n)
        self.value = 0.0

    def gains(self, i: int | slice = slice(None)) -> np.ndarray:
        p, out = self.p, self.p.score[i] - self.cost[i]
        for (code, weight), n in zip(p.groups, self.counts, strict=True):
            held = n[code[i]]
            out = out + weight[i] * (np.sqrt(held + 1) - np.sqrt(held))
        return np.round(out + p.person[i] @ (np.sqrt(self.shown + 1) - np.sqrt(self.shown)), 9)

    def put(self, i: int, sign: int = 1) -> None:
        if sign < 0:
            self.members.remove(i)
        alike = self.p.alike(i)
        alike[i] = 0.0
        self.cost += sign * alike
        for (code, _), n in zip(self.p.groups, self.counts, strict=True):
            n[code[i]] += sign
        self.shown += sign * (self.p.person[i] > 0)
        if sign > 0:
            self.members.append(i)

    def worth(self) -> float:
        """The value of the selection: what its rows gain one after the other."""
        fresh, total = Chosen(self.p), 0.0
        for i in self.members:
            total += float(fresh.gains(i))
            fresh.put(i)
        return total


def lazy_greedy(pool: Pool, k: int) -> Chosen:
    chosen = Chosen(pool)
    bounds = [(-g, i) for i, g in enumerate(chosen.gains())]
    heapq.heapify(bounds)
    while bounds and len(chosen.members) < k:
        _, i = heapq.heappop(bounds)
        now = (-float(chosen.gains(i)), i)
        if not bounds or now <= bounds[0]:
            chosen.put(i)
        else:
            heapq.heappush(bounds, now)
    return chosen


def swapped(chosen: Chosen) -> Chosen:
    """The best swap of one chosen row for one that is not, until none gains."""
    while True:
        best = (1e-6, 0, 0)
        for i in list(chosen.members):
            chosen.put(i, -1)
            gains = chosen.gains()
            gains[chosen.members] = -np.inf
            j = int(np.argmax(gains))
            better = float(gains[j] - gains[i])
            if better > best[0]:
                best = (better, i, j)
            chosen.put(i)
        if best[0] <= 1e-6:
            return chosen
        chosen.put(best[1], -1)
        chosen.put(best[2])


def select_spread(rows: DataFrame, k: int, at_once: int = 20_000, swaps: bool = True) -> DataFrame:
    """id, place (order of choice, from 0) and value (of the whole selection)."""
    if at_once < 4 * k:
        raise ValueError("a part holds at least four times as many rows as are chosen, or the parts would not get fewer")
    names = list(POOL)
    rows = pool = rows.select(*(F.col(c).cast(t).alias(c) for c, t in POOL.items()))
    size, best = pool.count(), None

    def pick(last: bool):  # noqa: ANN202
        def run(part: pd.DataFrame) -> pd.DataFrame:
            held = Pool(part.drop(columns=["part", "from_part"], errors="ignore"))
            chosen = lazy_greedy(held, k)
            if last and "from_part" in part.columns and part["from_part"].notna().any():
                # The best selection of a part is here whole: it may be better than what was picked from all.
                firm = Chosen(held)
                for i in np.flatnonzero(part.sort_values("id", kind="stable")["from_part"].fillna(False).to_numpy(bool)):
                    firm.put(int(i))
                chosen = max(chosen, firm, key=lambda c: c.worth())
            if last and swaps:
                chosen = swapped(chosen)
            out = held.rows.iloc[chosen.members].assign(place=range(len(chosen.members)), value=chosen.worth())
            return out[[*names, "place", "value"]]

        return run

    schema = ", ".join(f"{c} {t}" for c, t in POOL.items()) + ", place long, value double"
    while size > at_once:
        parts = 2 * math.ceil(size / at_once)  # half full on average, as a hash deals unevenly
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("id", F.lit(size)), F.lit(parts)))
        picked = materialize(dealt.groupBy("part").applyInPandas(pick(False), schema), "picked")
        top = picked.agg(F.max("value")).first()[0]
        here = picked.filter(F.col("value") == top)
        if best is None or top > best[0]:
            best = (top, here.select("id", F.lit(True).alias("from_part")))
        pool = picked.drop("place", "value")
        size = pool.count()
    if best is not None:
        firm = rows.join(best[1], "id").select(*names)
        pool = pool.unionByName(firm).dropDuplicates(["id"]).join(best[1], "id", "left")
    return pool.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(pick(True), schema).select("id", "place", "value")
