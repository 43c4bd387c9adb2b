"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the text alone are standardised and sent through cosines of random projections, whose inner products
approximate a Gaussian kernel. Each partition of the training rows sums its part of the normal equations; their sums
are solved with a ridge, and the scores of training rows set aside are made probabilities by isotonic regression.

The training rows are a bounded sample of the labelled rows: ``most`` rows, chosen by a hash of the id when there are
more. Null texts count as empty; labels that are null, or tie for one document, are left out. Without any labelled row each
score is 0.5. Rows are scored one by one, so repeated rows get equal scores. Columns other than doc_id and text are not
looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.llm.common import in_arrow, in_slices, materialize, unused

MOST_ROWS, FOURIER, RIDGE, SEED = 200_000, 384, 1e-3, 20240607
SIGNS = b"!#$%&*|.,;:?-\"'()<>{}[]=/\\_@+"
STATISTICS = 24 + len(SIGNS)


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # statistics x features
    shift: np.ndarray
    ridge: np.ndarray
    at: np.ndarray  # calibration: raw scores and their probabilities
    says: np.ndarray


def statistics(text: str) -> list[float]:
    raw = text.encode()
    n = max(len(raw), 1)
    data = np.frombuffer(raw, np.uint8)
    by = np.bincount(data, minlength=256)
    words = raw.lower().split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(len(words), 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen = np.fromiter(Counter(words).values(), np.int64) if words else np.zeros(1, np.int64)
    blank = np.concatenate([[True], (data == 32) | ((data >= 9) & (data <= 13)), [True]])
    first, last = data[blank[:-2] & ~blank[1:-1]], data[~blank[1:-1] & blank[2:]]
    letter = lambda x: ((x >= 97) & (x <= 122)) | ((x >= 65) & (x <= 90)) | (x > 127)
    upper, small, digit = int(by[65:91].sum()), int(by[97:123].sum()), int(by[48:58].sum())
    share = by[by > 0] / n
    values = [
        math.log1p(len(raw)), math.log1p(len(words)), math.log1p(len(lines)), float(size.mean()), float(size.std()), math.log1p(int(size.max())),
        upper / n, small / n, digit / n, int(by[128:].sum()) / n, int(by[9:33].sum()) / n, upper / max(upper + small, 1),
        len(seen) / m, len(seen) / math.sqrt(m), int(seen.max()) / m, int((seen == 1).sum()) / m, len(set(lines)) / max(len(lines), 1), math.log1p(n / max(len(lines), 1)),
        float(-(share * np.log2(share)).sum()), int(letter(first).sum()) / m, int(letter(last).sum()) / m, int(((first >= 65) & (first <= 90)).sum()) / m, int(((first >= 48) & (first <= 57)).sum()) / m,
        float(((seen / m) ** 2).sum()),
    ]
    return values + [math.sqrt(int(by[s]) / n) for s in SIGNS]


def _table(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for part in in_slices([batch], text):
        yield part, np.array([statistics(x or "") for x in part.column(text).to_pylist()], np.float64).reshape(-1, STATISTICS)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, y and the statistics of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _table(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "stats"])

    return in_arrow(docs.select("doc_id", "y", "text"), run, "doc_id long, y double, stats array<double>")


def held_out(doc_id: Column, of: int = 3) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % of == 1, F.lit(False))


def _features(x: np.ndarray, m: Model) -> np.ndarray:
    z = np.clip((x - m.mean) / m.scale, -8, 8)
    return np.hstack([np.ones((len(x), 1)), math.sqrt(2 / m.weights.shape[1]) * np.cos(z @ m.weights + m.shift), z])


def _isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean score and mean label of each pool, both rising."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, y in zip(score[order], label[order], strict=True):
        pools.append([s, y, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            s2, y2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + s2, pools[-1][1] + y2, pools[-1][2] + n2]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], (p[:, 1] + 0.5 * p[:, 1].sum() / p[:, 2].sum()) / (p[:, 2] + 0.5)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Model | None:
    """Learn from the labelled rows of docs that are not held out."""
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.avg("quality").alias("y")).filter("y = 0 or y = 1")
    known = known.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    total = known.count()
    if total > most:
        known = known.filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < int(most / total * (1 << 30)))
    # Ids and labels of about ``most`` rows, under 4 MB: the texts need not move.
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))
    rows = materialize(rows.withColumn("aside", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0), "quality-train").coalesce(16)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(STATISTICS), np.zeros(STATISTICS)
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("stats").to_pylist())
                n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pa.RecordBatch.from_pydict({"n": [n], "s": [s.tolist()], "q": [q.tolist()]})

    parts = in_arrow(rows.select("stats"), moments, "n long, s array<double>, q array<double>").collect()
    if not (n := sum(p["n"] for p in parts)):
        return None
    mean = np.sum([p["s"] for p in parts], 0) / n
    scale = np.sqrt(np.maximum(np.sum([p["q"] for p in parts], 0) / n - mean**2, 0)) + 1e-6
    rng = np.random.default_rng(SEED)
    weights = rng.standard_normal((STATISTICS, FOURIER)) / math.sqrt(2 * STATISTICS)
    model = Model(mean, scale, weights, rng.uniform(0, 2 * math.pi, FOURIER), np.zeros(0), np.zeros(0), np.zeros(0))
    width = 1 + FOURIER + STATISTICS

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, v = np.zeros((width, width)), np.zeros(width)
        for b in batches:
            if b.num_rows:
                z = _features(np.array(b.column("stats").to_pylist()), model)
                a += z.T @ z
                v += z.T @ np.array(b.column("y").to_pylist())
        yield pa.RecordBatch.from_pydict({"a": [a.tobytes()], "v": [v.tobytes()]})

    parts = in_arrow(rows.filter("not aside").select("stats", "y"), normal, "a binary, v binary").collect()
    a = np.sum([np.frombuffer(p["a"]).reshape(width, width) for p in parts], 0)
    v = np.sum([np.frombuffer(p["v"]) for p in parts], 0)
    m = max(a[0, 0], 1.0)
    model = model._replace(ridge=np.linalg.solve(a / m + RIDGE * np.eye(width), v / m))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict({"s": _features(np.array(b.column("stats").to_pylist()), model) @ model.ridge, "y": b.column("y")})

    aside = in_arrow(rows.filter("aside").select("stats", "y"), raw, "s double, y double").collect()  # a quarter of ``most``
    if not aside:
        return model._replace(at=np.array([0.0, 1.0]), says=np.array([0.0, 1.0]))
    at, says = _isotonic(np.array([r["s"] for r in aside]), np.array([r["y"] for r in aside]))
    return model._replace(at=at, says=says)


def _score(x: np.ndarray, model: Model | None) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    raw = _features(x, model) @ model.ridge
    # Between the pools the line; a slight part of the raw score keeps the order within a pool.
    return np.clip(0.998 * np.interp(raw, model.at, model.says) + 0.002 * np.clip(raw, 0, 1), 0, 1)


def score(docs: DataFrame, model: Model | None, out: str = "score") -> DataFrame:
    """docs with the score of each text; a column of that name is replaced."""
    kept = [c for c in docs.columns if c != out]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _table(batch, "text"):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(_score(x, held.value))], [*kept, out])

    return in_arrow(docs, run, T.StructType([docs.schema[c] for c in kept] + [T.StructField(out, T.DoubleType())]))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of each row of docs, by a model fitted on them and their labels."""
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", "score")


def keep(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is at least ``least``."""
    own = unused(docs, "_score")
    return score(docs, fit(docs, labels), own).filter(F.col(own) >= least).drop(own)
