"""Filter interaction audit: what five filters remove from each part in every order they can be applied in.

Exact copies are found by one range-sort. Rows are dealt to ranges of (text fingerprint, doc_id) and sorted there by
fingerprint, full text and doc_id, so that a row's predecessor tells whether a smaller id has its text. Only rows with the
first fingerprint of a range can have copies before it. They are counted by range and text digest, and each range also says
which text it starts and ends with and the smallest id it saw; comparing these few rows settles the counts. No group of
copies meets in one task: equal rows are dealt by id, and rows of one id by their place in the input.

A row's failures are a mask of five bits. Counters of (part, mask, labels) add up, and all orders follow from 32 counters a
part: a document leaves at the first filter of the order that its mask holds, so each filter removes a share 1/|mask| of the
orders' removals.

Null texts count as empty, a null part as the empty string. A null id is neither smaller nor larger than another, so such a
row fails no filter E and makes none fail. A repeated id is not smaller than itself; each of its rows counts. Labels that
repeat an id count as 1 if any row says 1; documents without labels count as neither good nor toxic. Columns other than
doc_id, text, source, quality and toxic are not looked at. Empty documents give no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import in_arrow, materialize, texts

#: In the order of the bits of a mask.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SIGNS, CAPITALS = b"#$%&*|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPY = 16
FOUND = "doc_id long, part string, fp long, mask int, digest string, least long, edge boolean"


def own_failures(text: str) -> int:
    """The mask of filters A to D, which look at one text only."""
    raw = text.encode()
    words = raw.split()  # bytes are split at space and \x09-\x0D, no others
    distinct = len(set(words))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * distinct < LEAST_DISTINCT * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MOST_CAPITALS * len(text)) << 2
        | (len(raw.translate(None, SIGNS)) < len(raw)) << 3
    )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order: each with its mask, and at the end a row for each text at an edge of the range."""
    first = fp = digest = None
    last_text = text_mask = least = None
    edges: dict[tuple[int, str], int | None] = {}  # smallest id of each text with the first or the last fingerprint
    ends: dict[str, int | None] = {}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("fp", pa.int64()), ("mask", pa.int32()), ("digest", pa.string()), ("least", pa.int64()), ("edge", pa.bool_())])
    for b in batches:
        out: list[tuple] = []
        for doc_id, text, part, f in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "part", "fp")), strict=True):
            if f != fp or text != last_text:
                if f != fp:
                    if first is None:
                        first = f
                    elif fp == first:
                        edges = {(fp, sha(t)): i for t, i in ends.items()}
                    fp, ends = f, {}
                last_text, text_mask, least = text, own_failures(text), None
                digest = sha(text) if f == first else None
            if least is None:
                least = doc_id  # nulls come first, so this is null or the smallest id
                ends[text] = least
            copy = doc_id is not None and least is not None and doc_id > least
            out.append((doc_id, part, f, text_mask | copy * COPY, digest, least if f == first else None, False))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)
    if fp is not None:
        edges |= {(fp, sha(t)): i for t, i in ends.items()}
        rows = [(None, None, f, None, d, i, True) for (f, d), i in edges.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def failures(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, part, mask of what it fails within its range. Rows with a digest stand at the start of
    a range and may have copies in ranges before; rows with ``edge`` are no documents but the ends of ranges."""
    rows = texts(docs, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "part", F.xxhash64("text").alias("fp"), F.monotonically_increasing_id().alias("place"))
    # The keys that are sampled for the ranges are three numbers each, however long the texts are.
    ranged = rows.repartitionByRange("fp", "doc_id", "place").sortWithinPartitions("fp", "text", "doc_id")
    return materialize(in_arrow(ranged.drop("place"), _compared, FOUND), "audit")


def _marked(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Counters: part, mask, good, toxic, digest, fp, least, n."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # Null ids find no label; they are dealt by fingerprint, not all to one task.
    known = known.filter("doc_id is not null").withColumn("salt", F.lit(0).cast("long"))
    rows = found.filter("not edge").withColumn("salt", F.when(F.col("doc_id").isNull(), F.col("fp")).otherwise(0))
    keys = ["part", "mask", "good", "toxic", "digest", "fp", "least"]
    rows = rows.join(known, ["doc_id", "salt"], "left").withColumn("fp", F.when(F.col("digest").isNotNull(), F.col("fp")))
    return rows.select("part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")), "digest", "fp", "least").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Additive counters: part, mask, good, toxic, n."""
    found = failures(docs)
    # A text at an edge of some ranges: the smallest id of all of them. Two rows for each range, if no fingerprints collide.
    least = found.filter("edge").groupBy("fp", "digest").agg(F.min("least").alias("first"))
    settled = _marked(found, labels).join(least, ["fp", "digest"], "left")
    # Where an earlier range has a smaller id, all rows here are copies but those without an id, which have a range's least of null.
    settled = settled.withColumn("mask", F.when(F.col("first") < F.col("least"), F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask")))
    return settled.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step."""
    masks, bits = 1 << len(FILTERS), [1 << k for k in range(len(FILTERS))]
    cells = [{"before": before, "bit": bit} for before in range(masks) for bit in bits if not before & bit]
    at = {(c["before"], c["bit"]): i for i, c in enumerate(cells)}
    orders = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        for step, k in enumerate(order):
            orders.append({"filter_order": name, "step": step + 1, "cell": at[sum(bits[j] for j in order[:step]), bits[k]]})
    n_orders = len(orders) // len(FILTERS)

    def literal(rows: list[dict], schema: str) -> Column:
        return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")

    n = lambda where: F.array(*(F.coalesce(F.sum(F.when(where & (F.col("mask") == m), F.col("n"))), F.lit(0)) for m in range(masks)))
    parts = histogram(docs, labels).groupBy("part").agg(n(F.lit(True)).alias("all"), n(F.col("good")).alias("good"), n(F.col("toxic")).alias("toxic"))

    def summed(column: str, holds: Callable[[Column], Column], weight: Callable[[Column], Column] | None = None) -> Column:
        """The counters of the masks that hold."""
        term = lambda m: F.get(F.col(column), m) * (weight(m) if weight else 1)
        return F.aggregate(F.sequence(F.lit(0), F.lit(masks - 1)), F.lit(0).cast("long"), lambda acc, m: acc + F.when(holds(m), term(m)).otherwise(0))

    def cell(c: Column) -> Column:
        before, bit = c["before"], c["bit"]
        clear = lambda m, b: m.bitwiseAND(b) == 0
        removed = lambda m: ~clear(m, bit) & clear(m, before)
        return F.struct(
            summed("all", lambda m: clear(m, before.bitwiseOR(bit))).alias("kept"),
            summed("all", removed).alias("removed"),
            summed("all", lambda m: ~clear(m, bit) & ~clear(m, before)).alias("redundant"),
            F.get(F.col("all"), bit).alias("unique_fails"),
            summed("good", removed).alias("good_lost"),
            summed("toxic", removed).alias("toxic_lost"),
            # A document is removed by the first of its failures, each of them in the same share of the orders.
            summed("all", lambda m: ~clear(m, bit), lambda m: (F.lit(n_orders) / F.bit_count(m)).cast("long")).alias("shapley"),
        )

    worked_out = parts.select("part", F.transform(literal(cells, "before:int,bit:int"), cell).alias("cells"))
    each = worked_out.select("part", "cells", F.explode(literal(orders, "filter_order:string,step:int,cell:int")).alias("o"))
    return each.select("part", "o.filter_order", "o.step", F.get("cells", F.col("o.cell")).alias("c")).select("part", "filter_order", "step", "c.*")
