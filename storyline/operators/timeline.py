"""Events, bursts and groups along a timeline. ``by`` names the columns of one timeline, the unit of parallelism; ``t`` is
a column of whole seconds; ``key`` breaks ties of time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.functions.scalar import civil, haversine_km

EVENT_GAP, BURST_GAP, EVENT_LEAST = 3 * 3600, 20, 3
TRIP_GAP, TRIP_KM = 36 * 3600, 30.0
NATURE_SHARE = 0.25


def gap_groups(rows: DataFrame, by: list[str], t: str, key: str, gap: int, out: str) -> DataFrame:
    """Number of the run within the timeline, from 0; a new run starts where more than ``gap`` seconds passed.
    Rows without a time get no run."""
    order = Window.partitionBy(*by, F.col(t).isNull()).orderBy(t, key)
    first = F.when(F.col(t) - F.lag(t).over(order) > gap, 1).otherwise(0)
    run = F.sum(first).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(out, F.when(F.col(t).isNotNull(), run).cast("long"))


def assign_events(rows: DataFrame, by: list[str], t: str, key: str, gap: int = EVENT_GAP) -> DataFrame:
    return gap_groups(rows, by, t, key, gap, "event")


def assign_bursts(rows: DataFrame, by: list[str], t: str, key: str, gap: int = BURST_GAP) -> DataFrame:
    """Burst number and burst size."""
    out = gap_groups(rows, by, t, key, gap, "burst")
    return out.withColumn("burst_size", F.count("*").over(Window.partitionBy(*by, "burst")))


def neighbourhood_events(rows: DataFrame, by: list[str], t: str, key: str, lat: str, lon: str, around: int = 10, gap: int = EVENT_GAP, km: float = TRIP_KM) -> DataFrame:
    """Events whose border is a gap longer than ``gap`` seconds and than twice the median gap of its neighbourhood (``around`` gaps on
    either side of it and itself), or a place more than ``km`` from the last known one. The gaps of a neighbourhood are one
    sorted array of at most 2 * around + 1. A row without a place makes no border by place; one without a time gets no event."""
    order = Window.partitionBy(*by, F.col(t).isNull()).orderBy(t, key)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon")))
    rows = rows.withColumn("_gap", F.col(t) - F.lag(t).over(order)).withColumn("_was", F.last(known, ignorenulls=True).over(earlier))
    near = F.array_sort(F.collect_list("_gap").over(order.rowsBetween(-around, around)))
    rows = rows.withColumn("_near", near)
    half = lambda k: F.get("_near", F.floor((F.size("_near") - k) / 2).cast("int"))
    median = (half(1) + half(0)) / 2
    moved = haversine_km(F.col("_was.lat"), F.col("_was.lon"), F.col(lat), F.col(lon)) > km
    border = (F.col("_gap") > F.greatest(F.lit(gap), 2 * median)) | F.coalesce(moved, F.lit(False))
    run = F.sum(F.when(border, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("event", F.when(F.col(t).isNotNull(), run).cast("long")).drop("_gap", "_was", "_near")


def best_of_burst(rows: DataFrame, by: list[str], score: str, key: str) -> DataFrame:
    """The row of each burst with the highest score, the smallest key among equals."""
    order = Window.partitionBy(*by, "burst").orderBy(F.desc(score), key)
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def mark_best(rows: DataFrame, by: list[str], score: str, key: str, out: str = "best") -> DataFrame:
    """Whether a row is the one that best_of_burst() keeps."""
    order = Window.partitionBy(*by, "burst").orderBy(F.desc(score), key)
    return rows.withColumn(out, F.row_number().over(order) == 1)


def event_stats(rows: DataFrame, by: list[str], t: str, included: Column | None = None) -> DataFrame:
    """Size, included rows, first and last second, days covered and calendar days between, of each event."""
    day = lambda c: F.to_date(civil(c))
    got = rows.filter(F.col("event").isNotNull()).groupBy(*by, "event").agg(
        F.count("*").alias("n"), F.count_if(F.lit(True) if included is None else included).alias("included"), F.min(t).alias("first_t"), F.max(t).alias("last_t")
    )
    span = F.floor((F.col("last_t") - F.col("first_t")) / 86_400) + 1
    return got.withColumn("span_days", span.cast("long")).withColumn("day_diff", F.datediff(day("last_t"), day("first_t")).cast("long"))


def everyday_groups(rows: DataFrame, by: list[str], t: str, key: str, least: int = EVENT_LEAST) -> DataFrame:
    """Events with few rows are gathered by month; groups are numbered by their first row."""
    size = Window.partitionBy(*by, "event")
    month = F.date_format(civil(F.min(t).over(size)), "yyyy-MM")
    few = F.count("*").over(size) < least
    rows = rows.filter(F.col("event").isNotNull()).withColumn("everyday", few).withColumn("_m", F.when(few, month))
    rows = rows.withColumn("_g", F.when(few, F.col("_m")).otherwise(F.col("event").cast("string")))
    whole = Window.partitionBy(*by, "everyday", "_g").orderBy(t, key)
    first = rows.withColumn("_first", F.struct(F.first(t).over(whole), F.first(key).over(whole)))
    return first.withColumn("grp", (F.dense_rank().over(Window.partitionBy(*by).orderBy("_first")) - 1).cast("long")).drop("_m", "_g", "_first")


def relative_rank(rows: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """Share of rows with a strictly smaller value, over n - 1; 0.5 for a lone row, null where the value is."""
    part = Window.partitionBy(*by, F.col(value).isNull())
    rank = F.when(F.count("*").over(part) <= 1, 0.5).otherwise(F.percent_rank().over(part.orderBy(value)))
    return rows.withColumn(out, F.when(F.col(value).isNotNull(), rank))


def _places(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The distinct values that are there, the first place of each and the one after its last in sorted order, and the number of
    rows. Equal values are counted before the shuffle, so what is sorted are distinct values, not rows."""
    part = Window.partitionBy(*by)
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_to", F.sum("_c").over(part.orderBy(value))).withColumn("_n", F.sum("_c").over(part))
    return counts.withColumn("_from", F.col("_to") - F.col("_c"))


def _holds(place: Column) -> Column:
    return (F.col("_from") <= place) & (place < F.col("_to"))


def quantile_cuts(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each share the value at place round((n - 1) * share) of the sorted values."""
    at = lambda s: F.max(F.when(_holds(F.round((F.col("_n") - 1) * s)), F.col(value)))
    return _places(rows, by, value).groupBy(*by).agg(*(at(s).alias(name) for name, s in shares.items()))


def upper_median(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """For each column on its own, the value at place n // 2 of the sorted values that are there."""
    out = None
    for v in values:
        one = _places(rows, by, v).filter(_holds(F.floor(F.col("_n") / 2))).select(*by, v)
        out = one if out is None else out.join(one, by, "full")
    return out


def home_cell(rows: DataFrame, by: list[str], lat: str, lon: str) -> DataFrame:
    """Centre of the cell of a tenth of a degree with most rows, the smallest cell among equals."""
    cell = lambda c: F.floor(F.col(c) * 10).cast("long")
    counts = rows.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(*by, cell(lat).alias("c1"), cell(lon).alias("c2")).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.min(F.struct(-F.col("n"), "c1", "c2")).alias("b"))
    return best.select(*by, ((F.col("b.c1") + 0.5) / 10).alias("home_lat"), ((F.col("b.c2") + 0.5) / 10).alias("home_lon"))


def nature_flag(rows: DataFrame, by: list[str], people: str, share: float = NATURE_SHARE) -> DataFrame:
    """A10: fewer than a quarter of the rows that tell have people; false where none tells."""
    return rows.groupBy(*by).agg((F.count_if(F.col(people)) < F.count(people) * share).alias("nature"))


def nearest_in_time(rows: DataFrame, others: DataFrame, by: list[str], t: str, key: str) -> DataFrame:
    """For each row the nearest of the others of its timeline, the earlier and then smaller key among equals. Both sides
    go through one sort: the last other before and the first one from each row on are the only candidates."""
    a = rows.select(*by, t, key, F.lit(1).alias("side"))
    b = others.select(*by, t, key, F.lit(0).alias("side"))
    other = F.when(F.col("side") == 0, F.struct(F.col(t).alias("t"), F.col(key).alias("key")))
    first_of = Window.partitionBy(*by, "side", t).orderBy(key)
    both = a.unionByName(b).withColumn("_other", F.when(F.row_number().over(first_of) == 1, other))
    up = Window.partitionBy(*by).orderBy(t, "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*by).orderBy(F.desc(t), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_before", F.last("_other", True).over(up)).withColumn("_after", F.last("_other", True).over(down)).filter("side = 1")
    far = lambda c: F.abs(F.col(f"{c}.t") - F.col(t))
    later = F.col("_before").isNull() | (far("_after") < far("_before"))
    pick = F.when(later, F.col("_after")).otherwise(F.col("_before"))
    return both.select(*by, key, t, pick["key"].alias("near_key"), F.abs(pick["t"] - F.col(t)).alias("near_seconds"))


def trip_merge(events: DataFrame, by: list[str], homes: DataFrame, gap: int = TRIP_GAP, km: float = TRIP_KM) -> DataFrame:
    """Events (event, first_t, last_t, lats, lons: the sorted coordinates of their rows) merged to trips. The place of a
    growing trip is the median of all its rows, so this is a fold over the events of a timeline, which are few."""
    import numpy as np

    def far(p: tuple[float, float], q: tuple[float, float]) -> float:
        a1, o1, a2, o2 = map(np.radians, (*p, *q))
        return 12742.0 * np.arcsin(np.sqrt(np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin((o2 - o1) / 2) ** 2))

    def fold(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("event")
        middle = lambda lats, lons: (sorted(lats)[len(lats) // 2], sorted(lons)[len(lons) // 2]) if len(lats) else None
        trips, open_ = [], None
        for r in held.itertuples():
            home = None if pd.isna(r.home_lat) else (r.home_lat, r.home_lon)
            here = middle(list(r.lats), list(r.lons))
            if open_ is not None and home and here:
                there = middle(open_["lats"], open_["lons"])
                if there and r.first_t - open_["last"] <= gap and far(there, here) <= km and far(there, home) > km and far(here, home) > km:
                    open_["last"] = r.last_t
                    open_["lats"] += list(r.lats)
                    open_["lons"] += list(r.lons)
                    trips.append(open_["trip"])
                    continue
            open_ = {"trip": r.event, "last": r.last_t, "lats": list(r.lats), "lons": list(r.lons)}
            trips.append(r.event)
        return held[[*by, "event"]].assign(trip=trips)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.select(*by, "event").schema)
    return events.join(homes, by, "left").groupBy(*by).applyInPandas(fold, f"{schema}, trip long")


def merge_suggestions(events: DataFrame, by: list[str], most_pages: int = 3) -> DataFrame:
    """Runs of two to four short events in a row: at most two days from one to the next and three in all. A fold over the
    sorted events of a timeline with higher-order functions. events: event, everyday, pages, first_day, last_day."""
    sorted_ = events.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("event", "everyday", "pages", "first_day", "last_day"))).alias("e"))
    run = "array<bigint>"
    zero = F.struct(F.array().cast(run).alias("run"), F.lit(None).cast("date").alias("since"), F.lit(None).cast("date").alias("until"), F.array().cast(f"array<{run}>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        fits = ~e["everyday"] & e["pages"].between(1, most_pages)
        goes = fits & (F.size(acc["run"]) > 0) & (F.size(acc["run"]) < 4) & (F.datediff(e["first_day"], acc["until"]) <= 2) & (F.datediff(e["last_day"], acc["since"]) <= 3)
        goes = F.coalesce(goes, F.lit(False))
        done = F.when(~goes & (F.size(acc["run"]) >= 2), F.concat(acc["out"], F.array(acc["run"]))).otherwise(acc["out"])
        now = F.when(goes, F.concat(acc["run"], F.array(e["event"]))).when(fits, F.array(e["event"])).otherwise(F.array().cast(run))
        return F.struct(now.alias("run"), F.when(goes, acc["since"]).otherwise(e["first_day"]).alias("since"), e["last_day"].alias("until"), done.alias("out"))

    end = lambda acc: F.when(F.size(acc["run"]) >= 2, F.concat(acc["out"], F.array(acc["run"]))).otherwise(acc["out"])
    return sorted_.select(*by, F.posexplode(F.aggregate("e", zero, step, end)).alias("suggestion", "events"))


def distance_from_home(rows: DataFrame, homes: DataFrame, by: list[str], lat: str, lon: str) -> DataFrame:
    """km from home and whether that counts as away."""
    both = rows.join(homes, by, "left").withColumn("km", haversine_km(F.col(lat), F.col(lon), F.col("home_lat"), F.col("home_lon")))
    return both.withColumn("away", F.coalesce(F.col("km") > TRIP_KM, F.lit(True)))
