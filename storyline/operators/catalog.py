"""The relational layer of the catalog: snapshots, upserts, anti joins, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(previous: DataFrame, scanned: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """M1: state of each key between two snapshots: unchanged if all compared columns are equal (nulls too), else changed;
    added and removed where one side has none."""
    a = previous.select(*keys, F.struct(*compared).alias("old"), F.lit(True).alias("_a"))
    b = scanned.select(*keys, F.struct(*compared).alias("new"), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full")
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return both.select(*keys, state.alias("state"), "old", "new")


def files_to_read(reconciled: DataFrame, hashed: DataFrame, keys: list[str]) -> DataFrame:
    """M1: new and changed keys, and unchanged ones that were never hashed, if they are local."""
    local = reconciled.filter((F.col("state") != "removed") & (F.coalesce(F.col("new.status"), F.lit("local")) == "local"))
    seen = hashed.filter(F.col("content_hash").isNotNull()).select(*keys, F.lit(True).alias("_seen"))
    both = local.join(seen, keys, "left")
    return both.filter((F.col("state") != "unchanged") | F.col("_seen").isNull()).select(*keys, "state")


def sync_report(reconciled: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each state."""
    states = ("added", "changed", "removed", "unchanged")
    return reconciled.groupBy(*by).agg(*(F.count_if(F.col("state") == s).alias(s) for s in states))


def latest_wins(log: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(*keys).orderBy(*(F.desc(o) if isinstance(o, str) else o for o in order))
    return log.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """M2: rows of changes in place of those of the table with the same key."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def relation_upsert(table: DataFrame, changes: DataFrame, keys: list[str], status: str = "status", firm: str = "confirmed") -> DataFrame:
    """M2: as upsert, but a confirmed relation is not downgraded."""
    held = table.filter(F.col(status) == firm).select(*keys)
    down = changes.filter(F.col(status) != firm).join(held, keys, "left_semi")
    return upsert(table, changes.join(down.select(*keys), keys, "left_anti").unionByName(changes.limit(0)), keys)


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet, one of each key."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def without_source(files: DataFrame, source: Column) -> DataFrame:
    """Files less those of a source; prune_orphans() does the rest."""
    return files.filter(~source)


def orphans(photos: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Photos that no file has."""
    return photos.join(files.select(*keys), keys, "left_anti")


def prune_orphans(photos: DataFrame, files: DataFrame) -> DataFrame:
    """M4: photos with a file; marks that point at a photo that is gone are cleared."""
    kept = photos.join(files.select("library_id", "content_hash").distinct(), ["library_id", "content_hash"], "left_semi")
    alive = kept.select("library_id", F.col("content_hash").alias("duplicate_of"), F.lit(True).alias("_alive"))
    marked = kept.join(alive, ["library_id", "duplicate_of"], "left")
    return marked.withColumn("duplicate_of", F.when(F.col("_alive"), F.col("duplicate_of"))).select(*photos.columns)


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first in a total order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each key and their places; Spark limits each task's share before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def sources_per_content(files: DataFrame, content: Column, kind: str) -> DataFrame:
    """The kinds of source of each content, sorted; copies count for their original."""
    return files.groupBy(content.alias("content")).agg(F.sort_array(F.collect_set(kind)).alias("kinds"), F.count("*").alias("files"))


def catalog_summary(rows: DataFrame, content: str, checks: dict[str, Column]) -> DataFrame:
    """A1: counts in one pass; exact duplicates are rows with content less different contents."""
    return rows.agg(
        F.count("*").alias("files"),
        F.count_distinct(content).alias("contents"),
        (F.count(content) - F.count_distinct(content)).alias("exact_duplicates"),
        *(F.count_if(c).alias(name) for name, c in checks.items()),
    )


def feedback_with_photos(feedback: DataFrame, photos: DataFrame) -> DataFrame:
    """The photo taken in and the one taken out of each log row: a swap has both, an exclusion only the second."""
    a = photos.select("library_id", F.col("content_hash"), F.struct("q_sharp", "q_exposure", "q_color").alias("photo"))
    b = a.select("library_id", F.col("content_hash").alias("other_hash"), F.col("photo").alias("other"))
    both = feedback.join(a, ["library_id", "content_hash"], "left").join(b, ["library_id", "other_hash"], "left")
    out = F.col("action").isin("ta_bort", "fjern_dag")
    return both.withColumn("added", F.when(~out, F.col("photo"))).withColumn("removed", F.when(out, F.col("photo")).otherwise(F.col("other"))).drop("photo", "other")


def canonical_year(photos: DataFrame, year: int) -> DataFrame:
    """Photos of a year that are no copies, as a range filter that reaches the scan."""
    first, after = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in (year, year + 1))
    return photos.filter(F.col("duplicate_of").isNull() & (F.col("taken_at") >= first) & (F.col("taken_at") < after))


def photo_projection(photos: DataFrame) -> DataFrame:
    """Quality only if all four measures are there, technical measures only if all three are."""
    whole = lambda *cs: F.when(F.greatest(*(F.col(c).isNull().cast("int") for c in cs)) == 0, F.struct(*cs))
    return photos.withColumn("quality", whole("q_sharp", "q_exposure", "q_color", "q_skin")).withColumn("tech", whole("q_motion", "q_noise", "q_cast"))


def missing_faces(photos: DataFrame, model: str) -> DataFrame:
    """Photos with a thumbnail that this model has not seen."""
    seen = F.col("faces_done") & F.col("faces_model").eqNullSafe(F.lit(model))
    return photos.filter(F.col("has_thumbnail") & F.col("duplicate_of").isNull() & ~F.coalesce(seen, F.lit(False)))


def missing_quality(photos: DataFrame) -> DataFrame:
    """P5"""
    return photos.filter(F.col("has_thumbnail") & (F.col("q_sharp").isNull() | F.col("q_motion").isNull()))


def face_groups(faces: DataFrame, least: int, ignored: int = 999_999, unnamed: int = 1_000_000) -> DataFrame:
    """A4: faces and photos of each group; small groups only if a face in them was confirmed."""
    groups = faces.filter(F.col("grp") != ignored).groupBy("library_id", "grp").agg(
        F.count("*").alias("faces"), F.count_distinct("content_hash").alias("photos"), F.bool_or("confirmed").alias("confirmed")
    )
    groups = groups.filter((F.col("faces") >= least) | F.col("confirmed"))
    return groups.withColumn("person_id", F.when(F.col("grp") < unnamed, F.col("grp")))


def faces_of_photos(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """Scanned photos with their faces by id, maybe none; photos that were not scanned are absent."""
    held = faces.groupBy("library_id", "content_hash").agg(F.sort_array(F.collect_list(F.struct("id", "h", "sharpness", "person_id", "grp", "ignored"))).alias("faces"))
    both = photos.filter("faces_done").select("library_id", "content_hash").join(held, ["library_id", "content_hash"], "left")
    return both.withColumn("faces", F.coalesce("faces", F.array().cast(held.schema["faces"].dataType)))


def set_groups(faces: DataFrame, groups: DataFrame, ignored: int = 999_999, unnamed: int = 1_000_000) -> DataFrame:
    """M6: new groups by face id; the person follows the group unless the face was confirmed."""
    new = groups.select("library_id", "id", F.col("grp").alias("_grp"))
    both = faces.join(new, ["library_id", "id"], "left")
    grp = F.coalesce("_grp", "grp")
    person = F.when(F.col("_grp").isNull() | F.col("confirmed"), F.col("person_id")).otherwise(F.when((grp < unnamed) & (grp != ignored), grp))
    return both.withColumn("person_id", person).withColumn("grp", grp).select(*faces.columns)


def name_group(faces: DataFrame, group: int, person: int) -> DataFrame:
    """M7: all faces of a group belong to a person."""
    hit = F.col("grp") == group
    return faces.withColumn("person_id", F.when(hit, F.lit(person)).otherwise(F.col("person_id"))).withColumn("confirmed", F.col("confirmed") | hit).withColumn("grp", F.when(hit, F.lit(person)).otherwise(F.col("grp")))


def ignore_group(faces: DataFrame, group: int, ignored: int = 999_999) -> DataFrame:
    """M7: all faces of a group are left out from now on."""
    hit = F.col("grp") == group
    return faces.withColumn("ignored", F.col("ignored") | hit).withColumn("person_id", F.when(~hit, F.col("person_id"))).withColumn("grp", F.when(hit, F.lit(ignored)).otherwise(F.col("grp")))


def cloud_years(files: DataFrame, year_guess: Column) -> DataFrame:
    """A3: files that are not on this machine, by guessed year."""
    return files.filter(F.col("status") == "cloud_only").groupBy(year_guess.alias("year")).agg(F.count("*").alias("n")).filter("year is not null")


def default_year(years: DataFrame, last: int) -> DataFrame:
    """Last year if it is there, else the year with most photos, the earliest of equals. years: year and n."""
    return years.orderBy(F.desc(F.col("year") == last), F.desc("n"), "year").limit(1)


def undo_steps(log: DataFrame, most: int = 100) -> DataFrame:
    """The last steps of each year that can be undone, the newest first."""
    return top_per_key(log, ["library_id", "album_year"], [F.desc("id")], most)


def prefix_names(documents: DataFrame, prefix: str) -> DataFrame:
    """Names that start with a prefix, letters in either case."""
    return documents.filter(F.lower("name").startswith(prefix.lower())).select("name").orderBy("name")


def list_sources(sources: DataFrame) -> DataFrame:
    """Sources by id."""
    return sources.orderBy("library_id", "id")


def files_of_sources(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files with the kind and the root of their source."""
    held = sources.select("library_id", F.col("id").alias("source_id"), "kind", F.col("path").alias("root"))
    return files.join(held, ["library_id", "source_id"])


def cloud_files(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files that are not on this machine, with their full path."""
    from storyline.sources.files import full_path

    held = files_of_sources(files.filter(F.col("status") == "cloud_only"), sources)
    return held.select("library_id", "id", full_path(F.col("root"), F.col("rel_path")).alias("path"), "size")


def faces_in_year(faces: DataFrame, photos: DataFrame, year: int) -> DataFrame:
    """Faces of the year's photos; the year filter reaches the scan of the photos."""
    first, after = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in (year, year + 1))
    held = photos.filter((F.col("taken_at") >= first) & (F.col("taken_at") < after)).select("library_id", "content_hash", "taken_at")
    return faces.join(held, ["library_id", "content_hash"])


def with_names(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """Faces with the name of their person, null for unknown ones."""
    return faces.join(persons.select("library_id", F.col("id").alias("person_id"), "name"), ["library_id", "person_id"], "left")


def enriched(draft: DataFrame, summary: DataFrame, looks: DataFrame) -> DataFrame:
    """Draft photos with size and thumbnail, and with the user's rotation and zoom, where there are none the usual ones."""
    key = ["library_id", "content_hash"]
    both = draft.join(summary.select(*key, "width", "height", "has_thumbnail"), key, "left").join(looks.select(*key, "rotation", "zoom"), key, "left")
    return both.withColumn("rotation", F.coalesce("rotation", F.lit(0))).withColumn("zoom", F.coalesce("zoom", F.lit(100)))


def ingest_report(reconciled: DataFrame, read: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """Added, changed and removed files, files read, photos that are new by content, and files that could not be read.
    read: by, content_hash (null if unreadable); known: by, content_hash of the photos before."""
    states = reconciled.groupBy(*by).agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("added", "changed", "removed")))
    new = read.filter("content_hash is not null").select(*by, "content_hash").distinct().join(known, [*by, "content_hash"], "left_anti")
    seen = read.groupBy(*by).agg(F.count("content_hash").alias("read"), F.count_if(F.col("content_hash").isNull()).alias("unreadable"))
    out = states.join(seen, by, "full").join(new.groupBy(*by).agg(F.count("*").alias("new_photos")), by, "left")
    return out.fillna(0, ["added", "changed", "removed", "read", "unreadable", "new_photos"])


def split_group(faces: DataFrame, group: int, split: DataFrame, ignored: int = 999_999, unnamed: int = 1_000_000) -> DataFrame:
    """M7: the marked faces of a group become a new group; the others of the group are locked to it. split: library_id, id."""
    new = F.greatest(F.lit(unnamed), F.coalesce(F.max(F.when(F.col("grp") != ignored, F.col("grp"))) + 1, F.lit(0)))
    nexts = faces.groupBy("library_id").agg(new.alias("_next"))
    # A library has one number: the table is small, and the join by library is left to the planner.
    both = faces.join(nexts, "library_id").join(split.select("library_id", "id", F.lit(True).alias("_split")), ["library_id", "id"], "left")
    here = F.col("grp") == group
    gone = here & F.coalesce("_split", F.lit(False))
    both = both.withColumn("confirmed", F.col("confirmed") | gone | (here & ~F.col("ignored"))).withColumn("ignored", F.col("ignored") & ~gone)
    both = both.withColumn("person_id", F.when(~gone, F.col("person_id")))
    return both.withColumn("grp", F.when(gone, F.col("_next")).otherwise(F.col("grp"))).select(*faces.columns)


def move_face(faces: DataFrame, moves: DataFrame, ignored: int = 999_999) -> DataFrame:
    """M7: single faces go to a person, or are left out where the person is null. moves: library_id, id, to_person."""
    both = faces.join(moves.select("library_id", "id", "to_person", F.lit(True).alias("_moved")), ["library_id", "id"], "left")
    hit = F.coalesce("_moved", F.lit(False))
    out = both.withColumn("person_id", F.when(hit, F.col("to_person")).otherwise(F.col("person_id"))).withColumn("confirmed", F.col("confirmed") | hit)
    out = out.withColumn("ignored", F.when(hit, F.col("to_person").isNull()).otherwise(F.col("ignored")))
    return out.withColumn("grp", F.when(hit, F.coalesce("to_person", F.lit(ignored))).otherwise(F.col("grp"))).select(*faces.columns)
