"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns virtual nodes at hashed places of a ring; a key belongs to the first virtual node clockwise. A shard
takes no more than its share: sizes of shards differ by one row at most. A shard first takes keys of its own arcs, in
ring order; keys that find it full go on clockwise to the next virtual node whose shard has room. Only the number of
rows of each arc meets on the driver, as many numbers as there are virtual nodes; where each row of an arc goes then
follows from its rank in the arc.

A null text has no bytes and the checksum of the empty text. Null ids are keys like others. Equal rows (id, size and
checksum) are counted before the shuffle and dealt out as so many ranks, in pieces of ``STEP``; rows of one id with different
texts are ranked in ranges of checksum and size. So a key that holds a third of all rows is no burden to one task. Ties in
ring place go by id, checksum and size. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.llm.common import literal_rows, materialize

RING_BITS, CELL_BITS = 60, 12
#: Ranks that one row is dealt out as at once.
STEP = 65_536


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """Place and shard of each virtual node, clockwise."""
    place = lambda s, k: int(hashlib.sha256(f"shard {s} node {k}".encode()).hexdigest()[:15], 16)
    return sorted((place(s, k), s) for s in range(shards) for k in range(nodes))


def arcs(places: list[tuple[int, int]]) -> list[dict]:
    """The arcs cut at the borders of a grid of cells, as an equi-join key: lo <= place < hi belongs to the arc."""
    cell, out, lo = 1 << (RING_BITS - CELL_BITS), [], 0
    for k, end in enumerate([p for p, _ in places] + [1 << RING_BITS]):
        while lo < end + 1 and lo < 1 << RING_BITS:
            hi = min(end + 1, (lo // cell + 1) * cell)
            out.append({"cell": lo // cell, "lo": lo, "hi": hi, "arc": k % len(places)})
            lo = hi
    return out


def fill(owner: list[int], rows: dict[int, int], shards: int) -> list[dict]:
    """Which ranks of each arc go to which shard, and from which slot on."""
    total = sum(rows.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, out = [0] * shards, []

    def put(arc: int, lo: int, n: int, shard: int) -> None:
        out.append({"arc": arc, "lo": lo, "hi": lo + n, "shard": shard, "slot": used[shard]})
        used[shard] += n

    over = {}
    for arc in sorted(rows):
        own = min(rows[arc], room[owner[arc]] - used[owner[arc]])
        if own:
            put(arc, 0, own, owner[arc])
        over[arc] = own
    for arc in sorted(rows):
        at, k = over[arc], arc
        while at < rows[arc]:
            k = (k + 1) % len(owner)
            if (n := min(rows[arc] - at, room[owner[k]] - used[owner[k]])) > 0:
                put(arc, at, n, owner[k])
                at += n
    return out


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << RING_BITS))


def _ranked(rows: DataFrame, step: int) -> DataFrame:
    """A row for each of the n ranks from first on. Rows of many ranks are first cut in pieces, and the pieces dealt anew, so that no
    row holds more than ``step`` ranks at once and no task all of one key's."""
    each = lambda df, n: df.withColumn("rank", F.explode(F.sequence(F.col("first"), F.col("first") + n - 1))).drop("first", "n")
    pieces = rows.filter(F.col("n") > step).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step))))
    pieces = pieces.withColumns({"first": F.col("first") + F.col("piece") * step, "n": F.least(F.lit(step), F.col("n") - F.col("piece") * step)}).drop("piece")
    return each(rows.filter(F.col("n") <= step), F.col("n")).unionByName(each(pieces.repartition("arc", "first"), F.col("n")))


def assign(docs: DataFrame, shards: int = 8, nodes: int = 256, step: int = STEP) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")).withColumn("place", _place(F.col("doc_id")))
    places = ring(shards, nodes)
    pieces = literal_rows(spark, arcs(places), "cell bigint, lo bigint, hi bigint, arc int")
    # As many rows as cells and virtual nodes, whatever the data.
    at = rows.withColumn("cell", F.shiftright("place", RING_BITS - CELL_BITS)).join(F.broadcast(pieces), "cell").filter("lo <= place and place < hi")
    order = ["place", "doc_id", "text_crc32", "size"]
    # In ranges of the whole order: rows of one id with different texts are dealt to many of them too.
    at = at.select("doc_id", "size", "text_crc32", "n", "place", "arc").repartitionByRange("arc", *order).withColumn("part", F.spark_partition_id())
    at = materialize(at, "shards")
    held = materialize(at.groupBy("arc", "part").agg(F.sum("n").alias("n")), "arcs")
    counted = {r["arc"]: r["n"] for r in held.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    plan = literal_rows(spark, fill([s for _, s in places], counted, shards), "arc int, lo bigint, hi bigint, shard int, slot bigint")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # As many rows as ranges and arcs.
    offsets = held.withColumn("offset", before(Window.partitionBy("arc").orderBy("part"))).drop("n")
    ranked = at.withColumn("first", before(Window.partitionBy("arc", "part").orderBy(*order))).join(F.broadcast(offsets), ["arc", "part"])
    ranked = _ranked(ranked.withColumn("first", F.col("first") + F.col("offset")).drop("offset", "part", "place"), step)
    dealt = ranked.join(F.broadcast(plan), "arc").filter("lo <= rank and rank < hi")
    return dealt.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("rank") - F.col("lo")).alias("slot"))
