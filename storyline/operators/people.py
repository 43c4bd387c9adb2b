"""Faces and persons: centroids, grouping of embeddings under user constraints, box carry-over, suppression."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.functions.scalar import normalised
from storyline.shared import materialize

THRESHOLD, FIRST_NEW, IOU_SAME, IOU_DROP = 0.363, 1_000_000, 0.4, 0.3
CENTRES_AT_ONCE = 4096
#: Groups whose cosines to all others are one matrix, and by how much such a cosine may differ from that of two vectors.
GROUPS_AT_ONCE, SLACK = 512, 1e-9


def centroids(rows: DataFrame, by: list[str], embedding: str) -> DataFrame:
    """Unit vector of the sum of each group's embeddings, summed by dimension before the shuffle."""
    parts = rows.select(*by, F.posexplode(embedding).alias("dim", "x")).groupBy(*by, "dim").agg(F.sum(F.col("x").cast("double")).alias("x"))
    whole = parts.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("v"))
    return whole.select(*by, normalised("v").alias("centroid"))


def nearest_centroid(rows: DataFrame, key: str, embedding: str, centres: DataFrame, label: str, at_once: int = CENTRES_AT_ONCE) -> DataFrame:
    """the centroid of largest cosine for each row, the smallest label among equals. Centres are few (one for each
    person of a library): they are written down once, counted, and go to the tasks as matrices of about at_once; every sixteen
    matrices the best so far are written down, so that the memory they take has a bound, however many there are."""
    spark = rows.sparkSession
    centres = materialize(centres.select(label, "centroid"), "centres")
    slices = max(1, math.ceil(centres.count() / at_once))
    kind = T.StructType([rows.schema[key], T.StructField("u", T.ArrayType(T.DoubleType())), T.StructField("label", centres.schema[label].dataType), T.StructField("cosine", T.DoubleType())])
    both = rows.select(key, normalised(embedding).alias("u"), F.lit(None).cast(kind["label"].dataType).alias("label"), F.lit(None).cast("double").alias("cosine"))
    for k in range(slices):
        held = centres.filter(F.pmod(F.xxhash64(label), F.lit(slices)) == k).orderBy(label).collect()
        if held:
            told = spark.sparkContext.broadcast((pd.Series([r[label] for r in held]), np.array([r["centroid"] for r in held], np.float64)))
            both = both.mapInPandas(lambda parts, told=told: _nearer(parts, told.value), kind)
        if k % 16 == 15:
            both = materialize(both, "nearest")
    return both.select(key, "label", "cosine")


def _nearer(parts: Iterator[pd.DataFrame], told: tuple[pd.Series, np.ndarray]) -> Iterator[pd.DataFrame]:
    """The rows with the nearest of these centres where it is nearer than what they have."""
    labels, matrix = told
    for part in parts:
        fit = part["u"].map(lambda u: u is not None and len(u) == matrix.shape[1]).to_numpy(bool)
        if fit.any():
            near = np.round(np.stack(part["u"][fit].to_numpy()) @ matrix.T, 9)
            at = near.argmax(1)
            cosine, label = near[np.arange(len(at)), at], labels.to_numpy()[at]
            old, old_label = part["cosine"].to_numpy()[fit], part["label"].to_numpy()[fit]
            better = np.isnan(old) | (cosine > old)
            for i in np.flatnonzero(cosine == old):
                better[i] = label[i] < old_label[i]
            rows = np.flatnonzero(fit)[better]
            part = part.astype({"label": object})
            part.iloc[rows, part.columns.get_loc("cosine")] = cosine[better]
            part.iloc[rows, part.columns.get_loc("label")] = label[better]
        yield part


LEAST_PIXELS = 36


def large_enough(faces: DataFrame, pixels: str = "pixels", fixed: str = "fixed") -> DataFrame:
    """The faces to be grouped: those the user placed, and those at least 36 pixels high; of smaller ones too little is known."""
    return faces.filter(F.col(fixed).isNotNull() | (F.col(pixels) >= LEAST_PIXELS))


def group_faces(faces: DataFrame, by: list[str], threshold: float = THRESHOLD, first_new: int = FIRST_NEW) -> DataFrame:
    """Faces (id, photo, quality, fixed, embedding) to persons. Faces the user placed come first and stay; the others, best
    first, join the nearest group that has no face of the same photo, or found one. Then the likest groups merge, in
    rounds. Each step depends on those before, so a library is one fold; a library's faces are a family's, not a table. The
    cosines of a face to all groups, and of groups to all others, are matrices; only what is near enough is looked at one by one."""

    def fold(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["quality", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        vectors = np.stack(held["embedding"].to_numpy()).astype(np.float64)
        photo, fixed = held["photo"].tolist(), held["fixed"]
        ids, firm, members, photos = [], [], [], []
        # Sums and unit vectors of the groups, with room for more, and the groups that have a face of each photo.
        sums, units = np.zeros((64, vectors.shape[1])), np.zeros((64, vectors.shape[1]))
        of_photo: dict[object, list[int]] = {}
        numbers: dict[int, int] = {}

        def put(i: int, k: int) -> None:
            sums[k] += vectors[i]
            units[k] = unit(sums[k])
            if photo[i] not in photos[k]:
                photos[k].add(photo[i])
                of_photo.setdefault(photo[i], []).append(k)
            members[k].append(i)

        def found(i: int, name: int, is_firm: bool) -> None:
            nonlocal sums, units
            if len(ids) == len(sums):
                sums, units = (np.concatenate([x, np.zeros_like(x)]) for x in (sums, units))
            numbers[name] = len(ids)
            ids.append(name)
            firm.append(is_firm)
            members.append([])
            photos.append(set())
            put(i, len(ids) - 1)

        unit = lambda v: v / n if (n := np.linalg.norm(v)) > 0 else v
        for i in np.flatnonzero(fixed.notna()):
            name = int(fixed[i])
            put(i, numbers[name]) if name in numbers else found(i, name, True)
        fresh = max([first_new, *(x + 1 for x in ids)])
        for i in np.flatnonzero(fixed.isna()):
            near = units[: len(ids)] @ vectors[i]
            near[of_photo.get(photo[i], [])] = -np.inf
            # The product of a matrix may differ in its last bits from that of two vectors, which decides.
            top = near.max(initial=-np.inf)
            best = max(((float(units[k] @ vectors[i]), -k) for k in np.flatnonzero(near >= top - SLACK)), default=(-2.0, 0)) if top >= threshold - SLACK else (-2.0, 0)
            if best[0] >= threshold:
                put(i, -best[1])
            else:
                found(i, fresh, False)
                fresh += 1
        while True:
            u, close = units[: len(ids)], []
            for k in range(0, len(ids), GROUPS_AT_ONCE):
                for a, b in zip(*np.nonzero(u[k : k + GROUPS_AT_ONCE] @ u.T >= threshold - SLACK), strict=True):
                    a += k
                    if a < b and not (firm[a] and firm[b]) and photos[a].isdisjoint(photos[b]) and (cosine := float(u[a] @ u[b])) >= threshold:
                        close.append((-cosine, a, b))
            used: set[int] = set()
            gone = set()
            for _, a, b in sorted(close):
                if a in used or b in used:
                    continue
                used |= {a, b}
                keep, drop = (b, a) if firm[b] else (a, b)
                sums[keep] += sums[drop]
                units[keep] = unit(sums[keep])
                photos[keep] |= photos[drop]
                members[keep] += members[drop]
                gone.add(drop)
            if not gone:
                break
            left = [k for k in range(len(ids)) if k not in gone]
            sums, units = sums[left], units[left]
            ids, firm, members, photos = ([x[k] for k in left] for x in (ids, firm, members, photos))
        label = np.full(len(held), -1, np.int64)
        for name, rows in zip(ids, members, strict=True):
            label[rows] = name
        return held[[*by, "id"]].assign(grp=label)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in faces.select(*by, "id").schema)
    # A count that is named is not merged by the planner, to which libraries of few bytes look like little work.
    parts = int(faces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return faces.repartition(parts, *by).groupBy(*by).applyInPandas(fold, f"{schema}, grp long")


def carry_over(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Which old box each new box of a photo goes on, one to one, the largest overlap first. old, new: id and box."""
    from storyline.functions.scalar import iou

    pairs = new.select(*by, F.col("id").alias("new_id"), F.col("box").alias("n")).join(old.select(*by, F.col("id").alias("old_id"), F.col("box").alias("o")), by)
    pairs = pairs.withColumn("iou", iou(F.col("n"), F.col("o"))).filter(F.col("iou") >= IOU_SAME).select(*by, "new_id", "old_id", "iou")
    # A pair is taken when it is the best of both its ends among the pairs left; a photo's few boxes are one array.
    sorted_ = pairs.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col("iou")).alias("far"), "new_id", "old_id"))).alias("p"))
    zero = F.array().cast("array<struct<new_id:bigint,old_id:bigint>>")
    clash = lambda acc, p: F.exists(acc, lambda x: (x["new_id"] == p["new_id"]) | (x["old_id"] == p["old_id"]))
    take = lambda acc, p: F.when(clash(acc, p), acc).otherwise(F.concat(acc, F.array(F.struct(p["new_id"].cast("bigint").alias("new_id"), p["old_id"].cast("bigint").alias("old_id")))))
    return sorted_.select(*by, F.inline(F.aggregate("p", zero, take)))


def suppress(detections: DataFrame, by: list[str], limit: float = IOU_DROP) -> DataFrame:
    """Of boxes that overlap, the one with the best score; a fold over the sorted boxes of an image. detections: id, score, box."""
    from storyline.functions.scalar import iou

    kind = detections.schema["box"].dataType.simpleString()
    sorted_ = detections.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("worse"), "id", "box"))).alias("d"))
    zero = F.array().cast(f"array<struct<id:bigint,box:{kind}>>")
    near = lambda acc, d: F.exists(acc, lambda k: iou(k["box"], d["box"]) > limit)
    take = lambda acc, d: F.when(near(acc, d), acc).otherwise(F.concat(acc, F.array(F.struct(d["id"].cast("bigint").alias("id"), d["box"].alias("box")))))
    return sorted_.select(*by, F.inline(F.aggregate("d", zero, take)))


def coverage_deficit(shown: DataFrame, persons: DataFrame) -> DataFrame:
    """How many more photos each named person needs by role. shown: library_id, person_id, one row for each included photo."""
    want = F.when(F.col("role").isin("barn", "kjernefamilie"), 6).when(F.col("role") == "besteforeldre", 2).otherwise(1)
    have = shown.groupBy("library_id", "person_id").agg(F.count("*").alias("have"))
    both = persons.select("library_id", F.col("id").alias("person_id"), want.alias("want")).join(have, ["library_id", "person_id"], "left")
    return both.withColumn("missing", F.greatest(F.col("want") - F.coalesce("have", F.lit(0)), F.lit(0)))


def portraits(rows: DataFrame, by: list[str], most: int = 9) -> DataFrame:
    """K9: one photo for each person, those with most photos first: the best face, less if not alone; no photo twice.
    rows: photo, person, score, alone. The few persons and photos of an event are one array, folded."""
    counted = rows.withColumn("n", F.count("*").over(Window.partitionBy(*by, "person")))
    each = counted.groupBy(*by, "person", "n").agg(F.sort_array(F.collect_list(F.struct((-F.col("score") * F.when(F.col("alone"), 1.0).otherwise(0.6)).alias("worse"), "photo"))).alias("p"))
    people = each.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("few"), "person", "p"))).alias("all"))
    zero = F.array().cast("array<struct<person:bigint,photo:bigint>>")

    def take(acc, x):  # noqa: ANN001, ANN202
        free = F.get(F.filter(x["p"], lambda p: ~F.exists(acc, lambda a: a["photo"] == p["photo"])), 0)
        more = F.concat(acc, F.array(F.struct(x["person"].cast("bigint").alias("person"), free["photo"].cast("bigint").alias("photo"))))
        return F.when((F.size(acc) < most) & free.isNotNull(), more).otherwise(acc)

    return people.select(*by, F.inline(F.aggregate("all", zero, take)))


SMALL_FACE, MANY_FACES, ONE_PASS = 0.06, 8, 640 * 1.2


def wants_tiles(photos: DataFrame, detections: DataFrame, key: list[str]) -> DataFrame:
    """Photos to be searched in tiles: larger than one pass sees, with many faces or a small one. photos: width, height; detections: h in pixels."""
    held = photos.select(*key, "width", "height").join(detections.select(*key, "h"), key, "left")
    seen = held.groupBy(*key, "width", "height").agg(F.count("h").alias("faces"), F.coalesce(F.bool_or(F.col("h") < F.col("height") * SMALL_FACE), F.lit(False)).alias("has_small"))
    return seen.withColumn("wants_tiles", (F.greatest("width", "height") > ONE_PASS) & ((F.col("faces") >= MANY_FACES) | F.col("has_small")))


def put_faces(faces: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """M5: the faces of photos seen anew replace the old ones; what the user decided of an old box goes to the new box in its
    place (J14). faces: by, id, box, grp, person_id, confirmed, ignored; new: by, id and box."""
    decided = faces.filter("confirmed or ignored")
    pairs = carry_over(decided, new, by).join(decided.select(*by, F.col("id").alias("old_id"), "grp", "person_id", "confirmed", "ignored"), [*by, "old_id"])
    marks = pairs.select(*by, F.col("new_id").alias("id"), "grp", "person_id", "confirmed", "ignored")
    fresh = new.join(marks, [*by, "id"], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False))).withColumn("ignored", F.coalesce("ignored", F.lit(False)))
    kept = faces.join(new.select(*by).distinct(), by, "left_anti")
    return kept.unionByName(fresh.select(*faces.columns))


def person_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Photos of each person in a pool, and the person's place, most photos first. rows: persons (array)."""
    n = rows.select(*by, F.explode("persons").alias("person")).groupBy(*by, "person").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "person")))
