"""The nearest named place of each photo: places lie in blocks, and a photo is sent to the blocks that may hold its nearest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.functions.scalar import haversine_km
from storyline.shared import materialize, spread

#: Places of a leaf of a block and of a block, leaves that all tasks know, photos that look for leaves together, photos of a block that a task holds.
MOST, BLOCK, KNOWN, GROUP, PACK = 16, 16_384, 8_192, 32, 131_072
#: Chords (of the unit sphere) closer than this, twice a millionth of a km, may be the same distance when rounded.
CLOSE = 2e-6 / 6371


def nearest_place(photos: DataFrame, key: str, places: DataFrame, most: int = MOST, looked: list[int] | None = None) -> DataFrame:
    """key, place and km (six places) of the nearest of all places, the smallest id among equals; null without coordinates or places.

    Places are cut along a curve into blocks of about BLOCK, and these into leaves, of which all tasks know the bounds. A photo is as
    near to a place as to the nearest known one of a leaf at most, and is sent to the blocks of the leaves that are no farther: where places
    and photos mix, one or two. There it meets the leaves of at most ``most`` places that are no farther. Places at the same point are
    one, with the smallest id. A key is one row. places: id, lat, lon. looked: gets the number of pairs of photos and places."""
    spark = photos.sparkSession
    fit = lambda a, b: f"abs({a}) <= 90 and abs({b}) <= 180"
    spots = places.filter(fit("lat", "lon")).select("id", F.col("lat").cast("double").alias("plat"), F.col("lon").cast("double").alias("plon"))
    spots = materialize(spots.groupBy("plat", "plon").agg(F.min("id").alias("place")).mapInArrow(_on_curve, T.StructType([
        T.StructField("place", places.schema["id"].dataType), T.StructField("plat", T.DoubleType()), T.StructField("plon", T.DoubleType()), T.StructField("curve", T.LongType())])), "places")
    n = spots.count()
    best = T.StructType([T.StructField("km", T.DoubleType()), T.StructField("place", places.schema["id"].dataType)])
    held = photos.select(key, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).withColumn("_fit", F.coalesce(F.expr(fit("lat", "lon")), F.lit(False)) & F.lit(n > 0))
    rows = held.filter(~F.col("_fit")).select(key, F.lit(None).cast(best).alias("b"))
    if n:
        blocks = spots.repartitionByRange(-(-n // BLOCK), "curve", "plat", "plon").select(F.spark_partition_id().alias("block"), "place", "plat", "plon")
        blocks = materialize(blocks, "blocks")
        known = spark.sparkContext.broadcast(_known(blocks, max(most, -(-n // KNOWN))))
        kind = T.StructType([T.StructField("block", T.IntegerType()), photos.schema[key], *(T.StructField(c, T.DoubleType()) for c in ("lat", "lon", "upto"))])
        asked = materialize(spread(held.filter("_fit").select(key, "lat", "lon")).mapInArrow(_sent(known), kind), "asked")
        # A block that many photos ask is read by several tasks.
        shares = F.broadcast(asked.groupBy("block").agg(F.ceil(F.count("*") / PACK).alias("_n")))
        one = asked.join(shares, "block").withColumn("part", F.pmod(F.xxhash64(key, "lat", "lon"), F.col("_n"))).drop("_n")
        two = blocks.join(shares, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        one, two = (x.repartition(parts, "block", "part").groupBy("block", "part") for x in (one, two))
        kind = T.StructType([photos.schema[key], T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), *spots.drop("curve").schema, T.StructField("n", T.LongType())])
        found = one.cogroup(two).applyInArrow(_met(key, most, looked is not None), kind)
        if looked is not None:
            found = materialize(found, "nearest")
            looked.append(found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        km = F.round(haversine_km(*map(F.col, ("lat", "lon", "plat", "plon"))), 6)
        rows = rows.unionByName(found.filter("n is null").select(key, F.struct(km.alias("km"), "place").alias("b")))
    return rows.groupBy(key).agg(F.min("b").alias("b")).select(key, "b.place", "b.km")


def _curve(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Places on a curve that visits each quarter of a cell before the next: 24 bits of both numbers in turn."""
    out = np.zeros(len(lat), np.int64)
    for shift, x in ((0, (lon + 180) / 360), (1, (lat + 90) / 180)):
        x = np.minimum(x * 2**24, 2**24 - 1).astype(np.int64)
        for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = (x | (x << by)) & mask
        out |= x << shift
    return out


def _on_curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lat, lon = (b.column(c).to_numpy() for c in ("plat", "plon"))
        yield pa.RecordBatch.from_arrays([b.column("place"), b.column("plat"), b.column("plon"), pa.array(_curve(lat, lon))], ["place", "plat", "plon", "curve"])


def _points(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """On the unit sphere: three rows."""
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])


class _Leaves:
    """Bounds of slices of ``size`` points, and a point of each."""

    def __init__(self, points: np.ndarray, size: int):
        starts = np.arange(0, points.shape[1], size)
        self.low, self.high = np.minimum.reduceat(points, starts, 1), np.maximum.reduceat(points, starts, 1)
        self.one = points[:, np.minimum(starts + size // 2, points.shape[1] - 1)]

    def near(self, p: np.ndarray, upto: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a point of p and a leaf that may hold its nearest one, and how far that is at most. p lie close together."""
        middle = (p.min(1) + p.max(1))[:, None] / 2
        wide = _far(p, middle).max()
        some = np.flatnonzero(_apart(middle, self.low, self.high) <= _far(self.one, middle).min() + 2 * wide + CLOSE)
        least = _far(p[:, :, None], self.one[:, None, some]).min(1)
        upto = least if upto is None else np.minimum(upto, least)
        i, leaf = np.nonzero(_apart(p[:, :, None], self.low[:, None, some], self.high[:, None, some]) <= upto[:, None] + CLOSE)
        return i, some[leaf], upto


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _length(x - y for x, y in zip(a, b, strict=True))


def _apart(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """From points to boxes."""
    return _length(np.maximum(np.maximum(x - y, y - z), 0) for x, y, z in zip(low, p, high, strict=True))


def _length(parts: Iterator[np.ndarray]) -> np.ndarray:
    return np.sqrt(sum(x * x for x in parts))


def _groups(lat: np.ndarray, lon: np.ndarray) -> Iterator[np.ndarray]:
    order = np.argsort(_curve(lat, lon))
    for k in range(0, len(order), GROUP):
        yield order[k : k + GROUP]


def _known(blocks: DataFrame, size: int) -> tuple[np.ndarray, _Leaves]:
    """The leaves of all blocks, and their blocks."""
    names = [f"{k}{i}" for k in ("low", "high", "one") for i in range(3)]

    def cut(rows: pa.Table) -> pa.Table:
        lat, lon = (rows[c].to_numpy() for c in ("plat", "plon"))
        leaves = _Leaves(_points(lat, lon)[:, np.argsort(_curve(lat, lon))], size)
        values = np.concatenate([leaves.low, leaves.high, leaves.one])
        return pa.table([pa.array(np.full(values.shape[1], rows["block"][0].as_py(), np.int32)), *map(pa.array, values)], ["block", *names])

    kind = T.StructType([T.StructField("block", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in names)])
    told = blocks.groupBy("block").applyInArrow(cut, kind).toArrow()
    leaves = _Leaves.__new__(_Leaves)
    leaves.low, leaves.high, leaves.one = (np.stack([told[f"{k}{i}"].to_numpy() for i in range(3)]) for k in ("low", "high", "one"))
    return told["block"].to_numpy(), leaves


def _sent(known) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Photos with each block that may hold their nearest place, and the chord that it is away at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, leaves = known.value
        most = int(block.max()) + 1
        for batch in batches:
            lat, lon = (batch.column(c).to_numpy() for c in ("lat", "lon"))
            p = _points(lat, lon)
            for group in _groups(lat, lon):
                i, leaf, upto = leaves.near(p[:, group])
                once = np.unique(i * most + block[leaf])
                i = once // most
                rows = batch.take(pa.array(group[i]))
                yield pa.RecordBatch.from_arrays([pa.array((once % most).astype(np.int32)), *rows.columns, pa.array(upto[i])], ["block", *rows.schema.names, "upto"])

    return run


def _met(key: str, most: int, count: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The nearest place of a block for each photo, and those that another engine's rounding may put before it. count: a row with n, the pairs."""

    def run(asked: pa.Table, places: pa.Table) -> pa.Table:
        lat, lon, plat, plon = (t[c].to_numpy() for t, c in ((asked, "lat"), (asked, "lon"), (places, "plat"), (places, "plon")))
        order = np.argsort(_curve(plat, plon))
        p, q, upto = _points(lat, lon), _points(plat, plon)[:, order], asked["upto"].to_numpy()
        rank = np.empty(len(plat), np.int64)
        rank[pc.sort_indices(places["place"]).to_numpy()] = np.arange(len(plat))
        leaves, met, photo, place = _Leaves(q, most) if len(plat) else None, 0, [], []
        for group in _groups(lat, lon) if len(plat) else ():
            i, leaf, least = leaves.near(p[:, group], upto[group])
            size = np.minimum(most, len(plat) - leaf * most)
            j = np.repeat(leaf * most - np.cumsum(size) + size, size) + np.arange(size.sum())
            i = np.repeat(i, size)
            met += len(i)
            chord = _far(p[:, group[i]], q[:, j])
            np.minimum.at(least, i, chord)
            close = chord <= least[i] + CLOSE
            i, j, chord = group[i[close]], order[j[close]], chord[close]
            # Engines differ in the last bits, the more the nearer to the opposite point.
            flat = np.sqrt(np.maximum(1 - chord**2 / 4, 1e-16))
            km = 12742e6 * np.arcsin(np.minimum(chord / 2, 1))
            whole = np.floor(km + 0.5)
            unsure = np.abs(km + 0.5 - np.round(km + 0.5)) <= 1e-4 / flat
            first = np.lexsort((rank[j], whole, i, unsure))
            first = first[: np.count_nonzero(~unsure)]
            first = first[np.concatenate(([True], i[first][1:] != i[first][:-1]))[: len(first)]]
            keep = np.concatenate((first, np.flatnonzero(unsure)))
            photo.append(i[keep]), place.append(j[keep])
        photo, place = (pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (photo, place))
        out = pa.table([*(asked[c].take(photo) for c in (key, "lat", "lon")), *(places[c].take(place) for c in ("place", "plat", "plon")), pa.nulls(len(photo), pa.int64())], [key, "lat", "lon", "place", "plat", "plon", "n"])
        total = pa.table([*(pa.nulls(1, f.type) for f in out.schema if f.name != "n"), pa.array([met])], out.schema.names)
        return pa.concat_tables([out, total]) if count else out

    return run
