"""Events changed by the user's hints, and local changes of a draft. All relabel rows with joins; none moves rows one by one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.operators.graph import components


def renumber(rows: DataFrame, by: list[str], label: str, t: str, key: str) -> DataFrame:
    """Groups numbered from 0 by their first row; groups without rows are gone."""
    first = F.min(F.struct(t, key)).over(Window.partitionBy(*by, label))
    rows = rows.withColumn("_first", first)
    return rows.withColumn("grp", (F.dense_rank().over(Window.partitionBy(*by).orderBy("_first")) - 1).cast("long")).drop("_first")


def merge_groups(rows: DataFrame, sets: DataFrame, by: list[str], t: str, key: str) -> DataFrame:
    """The groups that a set touches become one, in the place of the first; it is no everyday group any more.
    rows: grp, everyday; sets: set_id and key."""
    name = F.concat_ws(":", *by, F.lpad(F.col("grp").cast("string"), 12, "0"))
    touched = rows.join(sets, [*by, key]).select(*by, "set_id", name.alias("node")).distinct()
    first = touched.groupBy(*by, "set_id").agg(F.min("node").alias("a"))
    roots = components(touched.join(first, [*by, "set_id"]).select("a", F.col("node").alias("b")))
    held = rows.withColumn("node", name).join(roots, "node", "left")
    held = held.withColumn("everyday", F.col("everyday") & F.col("root").isNull()).withColumn("_label", F.coalesce("root", "node"))
    return renumber(held.drop("node", "root"), by, "_label", t, key).drop("_label")


def own_stories(rows: DataFrame, sets: DataFrame, by: list[str], t: str, key: str) -> DataFrame:
    """The rows of a set leave their groups and are a story of their own; the last set that names a row has it."""
    own = sets.groupBy(*by, key).agg(F.max("set_id").alias("_set"))
    held = rows.join(own, [*by, key], "left")
    label = F.when(F.col("_set").isNotNull(), F.concat(F.lit("s"), F.col("_set").cast("string"))).otherwise(F.concat(F.lit("g"), F.col("grp").cast("string")))
    held = held.withColumn("_label", label).withColumn("everyday", F.col("everyday") & F.col("_set").isNull())
    return renumber(held, by, "_label", t, key).drop("_label", "_set")


def gather_locked(rows: DataFrame, locked: DataFrame, by: list[str], t: str, key: str) -> DataFrame:
    """The rows of a locked page go to the group of its first row. locked: page_id, pos and key."""
    known = locked.join(rows.select(*by, key, "grp"), [*by, key])
    home = known.groupBy(*by, "page_id").agg(F.min_by("grp", "pos").alias("_home"))
    moved = locked.join(home, [*by, "page_id"]).groupBy(*by, key).agg(F.max_by("_home", "page_id").alias("_home"))
    held = rows.join(moved, [*by, key], "left").withColumn("_label", F.coalesce("_home", "grp"))
    return renumber(held, by, "_label", t, key).drop("_label", "_home")


def flags_of_hints(rows: DataFrame, hints: DataFrame, by: list[str], key: str) -> DataFrame:
    """Hints of each group, true if any of its rows is named. hints: kind and key."""
    kinds = ("merged", "own_story", "trip_yes", "trip_no")
    both = rows.join(hints, [*by, key], "left")
    return both.groupBy(*by, "grp").agg(*(F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)).alias(k) for k in kinds))


def trip_guess(rows: DataFrame, by: list[str], children: DataFrame, away: DataFrame) -> DataFrame:
    """trips without children: not everyday nor nature, over a day long, five rows with persons at least, none of them a
    child, away from home, and the children are known. rows: grp, t, everyday, nature, persons; children: person; away: grp, away."""
    known = children.groupBy(*by).agg(F.collect_set("person").alias("children"))
    both = rows.join(known, by, "left")
    child = F.arrays_overlap("persons", F.coalesce("children", F.array().cast("array<bigint>")))
    out = both.groupBy(*by, "grp", "everyday", "nature").agg(
        F.floor((F.max("t") - F.min("t")) / 86_400).alias("days"), F.count_if(F.size("persons") > 0).alias("with_persons"),
        F.coalesce(F.bool_or(child), F.lit(False)).alias("child"), F.bool_or(F.size("children") > 0).alias("known"),
    )
    guess = ~F.col("everyday") & ~F.col("nature") & (F.col("days") >= 1) & (F.col("with_persons") >= 5) & ~F.col("child") & F.coalesce("known", F.lit(False))
    return out.join(away, [*by, "grp"], "left").select(*by, "grp", (guess & F.coalesce("away", F.lit(True))).alias("adult_trip"))


def coverage_repair(rows: DataFrame, wants: DataFrame, by: list[str], key: str) -> DataFrame:
    """Photos added so that each named person reaches their count: first from groups where the person is not shown, then by
    face, quality and place. A photo added for one person counts for the next, so a library is one fold over its persons.
    rows: grp, t, quality, usable, included, persons (array of person and score); wants: person and want."""

    def fold(key_: tuple, held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["t", key]).reset_index(drop=True)
        included, added = held["included"].to_list(), [False] * len(held)
        grp, usable, quality = (held[c].to_list() for c in ("grp", "usable", "quality"))
        faces: dict[int, dict[int, float]] = {}
        for i, ps in enumerate(held["persons"]):
            for p in ps:
                faces.setdefault(p["person"], {})[i] = p["score"]
        for person, want in wanted.sort_values("person")[["person", "want"]].itertuples(index=False):
            own = faces.get(person, {})
            shown = [grp[i] for i in own if included[i]]
            free = [i for i in own if not included[i] and usable[i]]
            while len(shown) < want and free:
                best = max(free, key=lambda i: (grp[i] not in shown, own[i], quality[i], -i))
                included[best] = added[best] = True
                shown.append(grp[best])
                free.remove(best)
        return held.assign(added=added).loc[lambda d: d["added"], [*by, key]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by, key).schema)
    # A photo that shows nobody, or is neither in nor usable, changes nothing, so it is not sent.
    shows = rows.filter((F.size("persons") > 0) & (F.col("included") | F.col("usable"))).select(*dict.fromkeys([*by, key, "t", "grp", "quality", "usable", "included", "persons"]))
    # As many parts as shuffles have, whatever their bytes: the work is the folds.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shows.repartition(parts, *by).groupBy(*by).cogroup(wants.repartition(parts, *by).groupBy(*by)).applyInPandas(fold, schema)


def apply_choices(draft: DataFrame, patches: DataFrame, by: list[str], key: str) -> DataFrame:
    """A draft with the user's latest choices: taken in or out, with the reason that says so. patches: key and included."""
    new = patches.select(*by, key, F.col("included").alias("_new"))
    both = draft.join(new, [*by, key], "left")
    reason = F.when(F.col("_new"), "chosen_by_you").when(~F.col("_new"), "excluded_by_you").otherwise(F.col("reason"))
    return both.withColumn("reason", reason).withColumn("included", F.coalesce("_new", "included")).drop("_new")


def move_photo(photos: Column, moved: Column, before: Column) -> Column:
    """A page's array of photos with one moved in front of another, or to the end."""
    rest = F.filter(photos, lambda x: x != moved)
    at = F.coalesce(F.array_position(rest, before), F.lit(0)).cast("int")
    head = F.when(at > 0, F.slice(rest, 1, F.greatest(at - 1, F.lit(0)))).otherwise(rest)
    tail = F.when(at > 0, F.slice(rest, F.greatest(at, F.lit(1)), F.size(rest))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(head, F.array(moved), tail)


def fill_frame(pages: DataFrame, by: list[str], page: Column, photos: Column) -> DataFrame:
    """A page gets its photos, the other pages lose those; empty pages are gone. pages: page and photos."""
    left = F.when(F.col("page") == page, photos).otherwise(F.array_except("photos", photos))
    return pages.withColumn("photos", left).filter(F.size("photos") > 0)


def counters(draft: DataFrame, by: list[str]) -> DataFrame:
    """Included photos, events with content, and photos whose page has a warning."""
    return draft.groupBy(*by).agg(
        F.count_if("included").alias("included"), F.count_distinct(F.when(F.col("included"), F.col("grp"))).alias("events"), F.count_if(F.col("included") & F.col("warning")).alias("warnings")
    )


def notices(report: DataFrame, kinds: list[str]) -> DataFrame:
    """One notice for each counter above 0, in fixed order."""
    said = F.array(*(F.when(F.col(k) > 0, F.concat(F.lit(f"{k}: "), F.col(k).cast("string"))) for k in kinds))
    return report.withColumn("notices", F.filter(said, lambda x: x.isNotNull()))


def months(rows: DataFrame, t: Column) -> DataFrame:
    """Rows of each month; the same as grouping neighbours, for the list is sorted by time."""
    return rows.groupBy(F.date_format(t, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def album_text(albums: DataFrame, persons: DataFrame, by: list[str]) -> DataFrame:
    """The stored title and names, else the year and the family in the order they were named. albums: year, title, names."""
    from storyline.functions.scalar import name_line

    family = persons.filter(F.col("role").isin("barn", "kjernefamilie")).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]).alias("family"))
    both = albums.join(family, by, "left")
    return both.withColumn("title", F.coalesce("title", F.col("year").cast("string"))).withColumn("names", F.coalesce("names", name_line(F.col("family")), F.lit(""))).drop("family")


def distinct_persons(rows: DataFrame, by: list[str], unnamed: int = 1_000_000) -> DataFrame:
    """U4: the named persons of each group of rows, sorted, each once. rows: persons (array)."""
    named = rows.select(*by, F.explode("persons").alias("p")).filter(F.col("p") < unnamed).groupBy(*by).agg(F.sort_array(F.collect_set("p")).alias("persons"))
    return rows.select(*by).distinct().join(named, by, "left").withColumn("persons", F.coalesce("persons", F.array().cast("array<bigint>")))


def hints_of_choices(choices: DataFrame) -> DataFrame:
    """Hints from stored choices: photo names that are no hash are dropped, and locked pages that have none left.
    choices: library_id, kind, page and photos (array of hex names)."""
    valid = F.filter("photos", lambda h: h.rlike("^[0-9a-fA-F]{64}$"))
    held = choices.withColumn("photos", F.transform(valid, F.lower))
    return held.filter((F.col("kind") != "locked") | (F.size("photos") > 0))


def frame_candidates(rows: DataFrame, by: list[str], page: Column, key: str) -> DataFrame:
    """Photos to choose from for a frame: the page's own first, then the story's, those not included last. rows: page, included."""
    order = [F.desc(F.col("page").eqNullSafe(page)), F.desc("included"), key]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
