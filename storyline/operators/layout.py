"""Pages of a story, spreads and page checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.functions.scalar import grid_columns

SINGLE_SHARE, FULL_QUALITY = 0.4, 0.45


def paginate(chosen: DataFrame, by: list[str], t: str, key: str) -> DataFrame:
    """L1: page, place on the page and kind of page of each chosen photo of an event.

    About 40 % of the pages hold one photo: those that must, then the best. The rest is dealt out evenly in time order to grids.
    Pages go by their first photo; a story of three pages or more opens with a single one. Singles alternate between full
    bleed and air, and weak ones never fill the page. Windows do all but the alternation, which is a running count.
    chosen: quality, single (free, must or never), pages."""
    part = Window.partitionBy(*by)
    rows = chosen.withColumn("i", F.row_number().over(part.orderBy(t, key)) - 1).withColumn("n", F.count("*").over(part))
    rows = rows.withColumn("must", F.count_if(F.col("single") == "must").over(part)).withColumn("can", F.count_if(F.col("single") != "never").over(part))
    p = F.least(F.greatest(F.col("pages"), F.col("must") + (F.col("n") > F.col("must")).cast("int"), F.lit(1)), F.col("n"))
    rows = rows.withColumn("p", p)
    some = F.least(F.greatest(F.round(F.col("p").cast("double") * SINGLE_SHARE), 2 * F.col("p") - F.col("n"), F.lit(1)), F.col("p") - 1)
    want = F.greatest(F.when(F.col("p") == F.col("n"), F.col("n")).otherwise(some), F.col("must"))
    rows = rows.withColumn("want", F.when(F.col("p") == 1, 0).otherwise(want))
    best = part.orderBy(F.desc(F.col("single") == "must"), F.col("single") == "never", F.desc("quality"), "i")
    rows = rows.withColumn("alone", (F.row_number().over(best) <= F.least(F.col("want"), F.col("can"))))
    rows = rows.withColumn("singles", F.count_if("alone").over(part))
    in_rest = F.row_number().over(Window.partitionBy(*by, "alone").orderBy("i")) - 1
    rest = F.col("n") - F.col("singles")
    grids = F.greatest(F.col("p") - F.col("singles"), F.lit(1))
    # Grid g holds the places from g * rest // grids on.
    rows = rows.withColumn("grid", F.when(~F.col("alone"), F.floor(((in_rest + 1) * grids - 1) / rest)))
    page_key = F.when(F.col("alone"), F.col("i")).otherwise(F.min("i").over(Window.partitionBy(*by, "alone", "grid")))
    rows = rows.withColumn("first_i", page_key).withColumn("size", F.count("*").over(Window.partitionBy(*by, "first_i")))
    opening = F.min(F.when(F.col("size") == 1, F.col("first_i"))).over(part)
    rows = rows.withColumn("rank", F.when((F.col("p") >= 3) & (F.col("first_i") == opening), -1).otherwise(F.col("first_i")))
    rows = rows.withColumn("page", (F.dense_rank().over(part.orderBy("rank")) - 1).cast("long"))
    good = (F.col("size") == 1) & (F.col("quality") >= FULL_QUALITY)
    before = F.coalesce(F.count_if(good).over(part.orderBy("page", "i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    single_kind = F.when((F.col("p") > 1) & good & (before % 2 == 0), "full_bleed").otherwise("air")
    kind = F.when(F.col("size") == 1, single_kind).otherwise("grid")
    place = (F.row_number().over(Window.partitionBy(*by, "page").orderBy("i")) - 1).cast("long")
    columns = F.when(F.col("size") > 1, grid_columns(F.col("size")))
    lone = F.when((F.col("n") == 1), "air").otherwise(kind)
    return rows.select(*by, key, "page", place.alias("place"), lone.alias("kind"), columns.alias("columns"))


def spreads(pages: DataFrame, by: list[str], order: list[str], page: str) -> DataFrame:
    """Pages in pairs; the first stands alone on the right."""
    rows = pages.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    side = lambda k: F.max(F.when(F.col("_n") % 2 == k, F.col(page)))
    return rows.groupBy(*by, F.floor(F.col("_n") / 2).cast("long").alias("spread")).agg(side(0).alias("left"), side(1).alias("right"))


def drawn_size(photo_ratio: Column, frame_w: Column, frame_h: Column, zoom: Column, cover: Column) -> Column:
    """Width and height of the whole photo as drawn in its frame, in the frame's unit; zoom is 100 to 400 percent."""
    frame_ratio = frame_w / frame_h
    wide = F.when(cover, photo_ratio > frame_ratio).otherwise(photo_ratio < frame_ratio)
    height = F.when(wide, frame_h).otherwise(frame_w / photo_ratio)
    times = F.greatest(F.lit(100), F.least(F.lit(400), F.coalesce(zoom, F.lit(100)))) / 100.0
    return F.struct((height * photo_ratio * times).alias("w"), (height * times).alias("h"))


def print_checks(placed: DataFrame, files: DataFrame, blurry: DataFrame) -> DataFrame:
    """One row for each fault: a photo without a file, a low resolution, or a blurry photo shown large that has no other fault.
    placed: content_hash, page, ppi, share (of the page)."""
    key = ["library_id", "content_hash"]
    missing = placed.join(files.select(*key), key, "left_anti").select(*key, "page", F.lit("missing_file").alias("issue"))
    low = placed.join(files.select(*key).distinct(), key, "left_semi").filter("ppi < 150").select(*key, "page", F.lit("low_resolution").alias("issue"))
    found = missing.unionByName(low)
    large = placed.filter("share >= 0.5").join(blurry.select(*key).distinct(), key, "left_semi").join(found.select(*key), key, "left_anti")
    return found.unionByName(large.select(*key, "page", F.lit("blurry_and_large").alias("issue")))


def print_report(placed: DataFrame, issues: DataFrame) -> DataFrame:
    """A23"""
    faults = issues.groupBy("library_id").agg(F.count_if(F.col("issue") == "missing_file").alias("missing"), F.count_if(F.col("issue") == "low_resolution").alias("low_resolution"))
    all_ = placed.groupBy("library_id").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("photos"))
    return all_.join(faults, "library_id", "left").fillna(0, ["missing", "low_resolution"])


def local_recount(photos: DataFrame, by: list[str]) -> DataFrame:
    """Included photos of each event and their pages: four to a page, none without photos."""
    n = F.count_if("included")
    return photos.groupBy(*by).agg(n.alias("included"), F.when(n > 0, F.ceil(n / 4)).otherwise(0).cast("long").alias("pages"))


def assemble_pages(locked: DataFrame, made: DataFrame, by: list[str]) -> DataFrame:
    """L3: the pages of an event in order: locked ones and new ones by their first photo, locked before new where both begin alike;
    photos that a locked page has leave the new ones. locked, made: page, pos, photo."""
    free = made.join(locked.select(*by, "photo"), [*by, "photo"], "left_anti")
    both = locked.select(*by, F.lit(0).alias("kind"), "page", "pos", "photo").unionByName(free.select(*by, F.lit(1).alias("kind"), "page", "pos", "photo"))
    first = both.groupBy(*by, "kind", "page").agg(F.min("photo").alias("_first"))
    number = F.row_number().over(Window.partitionBy(*by).orderBy("_first", "kind", "page"))
    pages = first.withColumn("number", number).drop("_first")
    return both.join(pages, [*by, "kind", "page"]).select(*by, "number", (F.col("kind") == 0).alias("locked"), "pos", "photo")


def portrait_page(chosen: DataFrame, portraits: DataFrame, by: list[str], most: int = 9, least: int = 3) -> DataFrame:
    """L2: the page of faces that an adult trip of two pages or more begins with: the persons' portraits if there are two, else
    the most skin among photos with people if there are three. chosen: photo, skin, people; portraits: photo."""
    faces = portraits.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).filter("_n >= 2").select(*by, "photo")
    skin = Window.partitionBy(*by).orderBy(F.desc("skin"), "photo")
    close = chosen.filter("people").join(faces.select(*by).distinct(), by, "left_anti").withColumn("_p", F.row_number().over(skin)).filter(F.col("_p") <= most)
    close = close.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).filter(F.col("_n") >= least).select(*by, "photo")
    return faces.unionByName(close).withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("photo")) - 1)


def page_policy(size: Column, decision: Column, mood: Column, exceptional: Column, people: Column) -> Column:
    """L2: whether a photo must have, may have or never has a page of its own: the user's size, then the decision (a highlighted
    one must, a toned-down one never; more of a kind says nothing of its page), then what it shows."""
    out = F.when(size >= 3, "must").when(size.isNotNull(), "never").when(decision == "fremhev", "must").when(decision == "demp", "never")
    return out.when(mood & exceptional, "free").when(people == False, "never").otherwise("free")  # noqa: E712
