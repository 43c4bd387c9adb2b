"""A selection held against a reference set."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyline.functions.scalar import hamming
from storyline.operators.hashes import two_nearest_of_all
from storyline.shared import materialize

SAME_MOMENT, SAME_BITS = 20, 10
SURE, MAYBE = 8, 14
PARTS = 4
#: An image looks hashes up by parts where these are at most 1 / FEW of its shape, and at most FEW.
FEW = 64


def covered(items: DataFrame, others: DataFrame, bits: int = 64) -> DataFrame:
    """Ids of items near some other: the same id, at most 20 seconds apart, or at most 10 bits apart. Each way is an
    equi-join: on the id, on time slots of 20 seconds with their neighbours, on parts of the hash. Columns: id, t, h."""
    same = items.join(others.select("id").distinct(), "id", "left_semi").select("id")
    slot = lambda c: F.floor(F.col(c) / SAME_MOMENT)
    theirs = others.filter("t is not null").select(F.col("t").alias("t2")).distinct().withColumn("slot", F.explode(F.array(*(slot("t2") + k for k in (-1, 0, 1)))))
    timed = items.filter("t is not null").withColumn("slot", slot("t")).join(theirs, "slot").filter(F.abs(F.col("t") - F.col("t2")) <= SAME_MOMENT).select("id")
    shaped = lambda df: df.select(F.lit(0).alias("shape"), "id", "h")
    near = two_nearest(shaped(items), shaped(others), bits, SAME_BITS).filter((F.col("n") == 1) & (F.col("d") <= SAME_BITS))
    alike = items.join(near.select(F.col("q").alias("h")), "h", "left_semi").select("id")
    return same.unionByName(timed).unionByName(alike).distinct()


def selection_metrics(gold: DataFrame, selection: DataFrame, bits: int = 64) -> DataFrame:
    """Share of the selection that is near the reference set, share of that set near the selection, harmonic mean."""
    part = lambda a, b, name: a.select("id").distinct().join(covered(a, b, bits).withColumn("hit", F.lit(1)), "id", "left").agg(F.count("hit").alias(f"{name}_hit"), F.count("*").alias(f"{name}_n"))
    p = part(selection, gold, "p").withColumn("one", F.lit(1))
    r = part(gold, selection, "r").withColumn("one", F.lit(1))
    share = lambda x: F.when(F.col(f"{x}_n") > 0, F.col(f"{x}_hit") / F.col(f"{x}_n")).otherwise(0.0)
    both = p.join(r, "one").select(share("p").alias("precision"), share("r").alias("recall"))
    total = F.col("precision") + F.col("recall")
    return both.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def event_coverage(library: DataFrame, gold: DataFrame, selection: DataFrame, least: int = 3) -> DataFrame:
    """Shares of the events of at least three rows that each set touches, and of the reference's events and months that
    the selection finds again. library: id, event, month."""
    big = library.groupBy("event").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("event")
    mark = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    held = library.join(mark(gold, "g"), "id", "left").join(mark(selection, "s"), "id", "left")
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    events = held.join(big, "event", "left_semi").groupBy("event").agg(has("g"), has("s"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    of_events = events.agg(ratio(F.count_if("s"), F.count("*")).alias("event_coverage"), ratio(F.count_if("g"), F.count("*")).alias("gold_event_coverage"), ratio(F.count_if(F.col("g") & F.col("s")), F.count_if("g")).alias("events_found")).withColumn("one", F.lit(1))
    months = held.groupBy("month").agg(has("g"), has("s")).agg(ratio(F.count_if(F.col("g") & F.col("s")), F.count_if("g")).alias("months_found")).withColumn("one", F.lit(1))
    return of_events.join(months, "one").drop("one")


def redundancy(selection: DataFrame, by: list[str], bits: int = 64) -> DataFrame:
    """Mean over the selected of their greatest likeness 1 - d / 64 to another one of the library's; none for a lone one. The nearest
    other is among the two nearest, itself the first of them or one of equals."""
    rows = selection.select(F.struct(*by).alias("shape"), "id", F.col("h").cast("long").alias("q"))
    near = two_nearest(rows.withColumnRenamed("q", "h"), rows.withColumnRenamed("q", "h"), bits).drop("n")
    other = F.min(F.when(F.col("lib_id") != F.col("id"), F.col("d")))
    most = rows.join(near, ["shape", "q"], "left").groupBy("shape", "id").agg(F.greatest(F.lit(0.0), 1 - other / F.lit(float(bits))).alias("m"))
    return most.groupBy("shape").agg(F.avg("m").alias("redundancy"), F.count("*").alias("n")).filter("n > 1").select("shape.*", "redundancy")


def _top_two(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of rows (lib_id, d) the two nearest different items, each at its least distance."""
    order = Window.partitionBy(*by).orderBy("d", "lib_id")
    return rows.groupBy(*by, "lib_id").agg(F.min("d").alias("d")).withColumn("n", F.row_number().over(order)).filter("n <= 2")


def two_nearest(album: DataFrame, library: DataFrame, bits: int = 64, limit: int | None = None, looked: list[int] | None = None) -> DataFrame:
    """The two nearest library items of each distinct (shape, h) of album images: shape, q, lib_id, d, n; exact.

    Hashes are cut into ``PARTS`` parts. An image whose parts few hashes share meets those; if its second item lies within PARTS - 1
    bits, all others are farther. All other images meet their whole shape, in blocks whose bits are counted in tasks: with hashes as
    long as these a larger radius looks up more parts than that costs. Equal hashes count once, with their two smallest ids. With a
    limit only items within so many bits are certain. looked: gets the number of pairs that each way compared."""
    width = math.ceil(bits / PARTS)
    cut = lambda c: F.array(*(F.struct(F.lit(k).alias("part"), F.shiftright(c, k * width).bitwiseAND(F.lit((1 << min(width, bits - k * width)) - 1)).alias("v")) for k in range(PARTS)))
    first = Window.partitionBy("shape", "h").orderBy("lib_id")
    items = library.filter("h is not null").select("shape", F.col("h").cast("long").alias("h"), F.col("id").alias("lib_id")).distinct()
    items = materialize(items.withColumn("_n", F.row_number().over(first)).filter("_n <= 2").drop("_n"), "items")
    hashes = items.select("shape", "h").distinct()
    parts = materialize(hashes.select("shape", "h", F.inline(cut(F.col("h")))), "parts")
    open_ = album.filter("h is not null").select("shape", F.col("h").cast("long").alias("q")).distinct()
    open_ = materialize(open_.join(hashes.groupBy("shape").agg(F.count("*").alias("size")), "shape"), "open")
    asked = open_.filter(F.col("size") > PARTS * FEW).select("shape", "q", "size", F.inline(cut(F.col("q"))))
    shared = parts.groupBy("shape", "part", "v").agg(F.count("*").alias("_m"))
    rare = asked.join(shared, ["shape", "part", "v"]).groupBy("shape", "q", "size").agg(F.sum("_m").alias("_m")).filter(F.col("_m") * FEW <= F.least("size", F.lit(FEW * FEW)))
    met = asked.join(rare.select("shape", "q"), ["shape", "q"], "left_semi").join(parts, ["shape", "part", "v"]).select("shape", "q", "h")
    met = materialize(met.withColumn("d", hamming("q", "h")), "met")
    near = materialize(_top_two(met.join(items, ["shape", "h"]), ["shape", "q"]), "best")
    done = near.filter((F.col("n") == 2) & (F.col("d") <= PARTS - 1)).select("shape", "q")
    open_ = materialize(open_.join(done, ["shape", "q"], "left_anti"), "open")
    if looked is not None:
        looked.extend((met.count(), open_.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]))
    rest = _top_two(two_nearest_of_all(open_.select("shape", "q"), items, "shape", limit), ["shape", "q"])
    return near.join(done, ["shape", "q"], "left_semi").unionByName(materialize(rest, "best"))


def album_match(album: DataFrame, library: DataFrame, bits: int = 64) -> DataFrame:
    """Best and second library item of each album image within its shape class; sure up to 8 bits, maybe up to 14. Several
    crops of an item count by their best. album: id, shape, h; library: id, shape, h."""
    near = two_nearest(album, library, bits).drop("n")
    two = _top_two(album.select("id", "shape", F.col("h").cast("long").alias("q")).join(near, ["shape", "q"]), ["id"])
    pick = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    best = two.groupBy("id").agg(pick(1, "lib_id").alias("best"), pick(1, "d").alias("distance"), pick(2, "lib_id").alias("runner_up"), pick(2, "d").alias("runner_up_distance"))
    both = album.select("id").distinct().join(best, "id", "left")
    status = F.when(F.col("distance") <= SURE, "sure").when(F.col("distance") <= MAYBE, "unsure").otherwise("unmatched")
    return both.withColumn("status", status)


def gold_from_matches(matches: DataFrame) -> DataFrame:
    """U8: library items that album images surely show, each once, in album order."""
    first = matches.filter(F.col("status") == "sure").groupBy("best").agg(F.min("id").alias("first_image"))
    return first.withColumnRenamed("best", "id")


def match_rate(matches: DataFrame) -> DataFrame:
    """A18, S27"""
    n = F.count("*")
    return matches.agg(n.alias("images"), F.when(n > 0, F.count_if(F.col("status") == "sure") / n).otherwise(0.0).alias("match_rate"))


def report_row(metrics: DataFrame, name: str) -> DataFrame:
    """A Markdown table row of the metrics."""
    cells = [F.format_string("%.2f", c) for c in metrics.columns]
    return metrics.select(F.concat(F.lit(f"| {name} | "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row"))


def decorations(uses: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """Images used on more than three different pages are decoration, not photos. uses: image, page."""
    return uses.groupBy(*by, "image").agg(F.count_distinct("page").alias("pages")).filter(F.col("pages") > most)


def gold_listing(gold: DataFrame) -> DataFrame:
    """Name, year, images and match rate of each stored set."""
    n = F.count("*")
    return gold.groupBy("library_id", "name", "year").agg(n.alias("images"), (F.count_if(F.col("status") == "sure") / n).alias("match_rate"))


GOLD_JSON = "array<struct<content_hash:string,page:int,idx:int,distance:int,status:string>>"


def gold_to_json(gold: DataFrame) -> DataFrame:
    """One JSON text for each set, its images in album order."""
    row = F.struct("page", "idx", F.struct(F.lower(F.hex("content_hash")).alias("content_hash"), "page", "idx", "distance", "status").alias("x"))
    return gold.groupBy("library_id", "name", "year").agg(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["x"])).alias("json"))


def gold_from_json(stored: DataFrame) -> DataFrame:
    """The rows of stored sets."""
    rows = stored.select("library_id", "name", "year", F.inline(F.from_json("json", GOLD_JSON)))
    return rows.withColumn("content_hash", F.unhex("content_hash"))
