"""Simple selections: covers, monthly quotas, the baseline, and the scale of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.functions.scalar import target_pages

SPACING, LEAST_PER_MONTH = 30 * 60, 3


def cover_candidates(rows: DataFrame, by: list[str], score: str, people: str, day: str, key: str, n_people: int = 2, n_overview: int = 4) -> DataFrame:
    """K3: the best rows with and without people, at most one for each day. The best of each day comes first, so taking the
    best days is the same as the greedy scan."""
    order = [F.desc(score), key]
    daily = rows.withColumn("_d", F.row_number().over(Window.partitionBy(*by, people, day).orderBy(*order))).filter("_d = 1")
    placed = daily.withColumn("place", F.row_number().over(Window.partitionBy(*by, people).orderBy(*order)))
    return placed.filter(F.col("place") <= F.when(F.col(people), n_people).otherwise(n_overview)).drop("_d")


def cover_pair(candidates: DataFrame, by: list[str], choices: DataFrame, people: str, key: str) -> DataFrame:
    """K4: front: the user's choice, else the first with people, else the first without; back: the first that is not the front."""
    seen = candidates.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(~F.col(people), F.col("place"), F.col(key).alias("key")))), lambda x: x["key"]).alias("people_first"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(people), F.col("place"), F.col(key).alias("key")))), lambda x: x["key"]).alias("overview_first"),
    )
    both = seen.join(choices, by, "left").withColumn("front", F.coalesce("front", F.get("people_first", 0)))
    other = F.get(F.filter("overview_first", lambda k: k != F.col("front")), 0)
    return both.select(*by, "front", F.coalesce("back", other).alias("back"))


def month_quotas(months: DataFrame, by: list[str], k: int, n: str = "n") -> DataFrame:
    """Rows of a month in proportion to the root of its size, at least 3 (or all), at most all."""
    total = F.sum(F.sqrt(n)).over(Window.partitionBy(*by))
    share = F.round(k * F.sqrt(n) / total)
    return months.withColumn("quota", F.least(F.greatest(share, F.least(F.lit(LEAST_PER_MONTH), F.col(n))), F.col(n)).cast("long"))


def page_scale(events: DataFrame, by: list[str], wanted: int) -> DataFrame:
    """Of the scales 0.20 to 3.00 in steps of 0.05 the first with the total of pages nearest to the wanted one.
    events: natural (F18), a row for each event; each gets as many rows as there are scales."""
    each = events.select(*by, "natural", F.explode(F.sequence(F.lit(4), F.lit(60))).alias("step"))
    pages = each.withColumn("pages", target_pages(F.col("natural"), F.col("step") * 0.05)).groupBy(*by, "step").agg(F.sum("pages").alias("pages"))
    best = pages.groupBy(*by).agg(F.min(F.struct(F.abs(F.col("pages") - wanted).alias("off"), "step", "pages")).alias("b"))
    return best.select(*by, F.round(F.col("b.step") * 0.05, 2).alias("scale"), F.col("b.pages").alias("pages"))


def baseline(rows: DataFrame, by: list[str], t: str, month: str, score: str, key: str, best: str, k: int) -> DataFrame:
    """K5: k rows of each timeline. Each month takes its quota of the best rows that lie half an hour apart, then fills up;
    the whole is filled or cut to exactly k. best: whether the row is the best of its burst. The spacing in a month looks at what
    was taken before: a fold over the sorted rows of a month, which holds no more than its quota of taken rows."""
    one = F.struct(F.col(score).isNull().alias("unscored"), (-F.col(score)).alias("down"), F.col(key).alias("key"), F.col(t).alias("t"), F.col(score).alias("score"), F.coalesce(F.col(best), F.lit(False)).alias("best"))
    held = rows.groupBy(*by, month).agg(F.sort_array(F.collect_list(one)).alias("sorted")).withColumn("n", F.size("sorted").cast("long"))
    held = month_quotas(held, by, k).withColumn("all", F.transform("sorted", lambda x, i: x.withField("i", i))).withColumn("ranked", F.filter("all", lambda x: x["best"]))

    def step(taken: Column, x: Column) -> Column:
        near = F.coalesce(F.exists(taken, lambda y: F.abs(y["t"] - x["t"]) <= SPACING), F.lit(False))
        return F.when((F.size(taken) < F.col("quota")) & ~near, F.concat(taken, F.array(x))).otherwise(taken)

    spaced = held.withColumn("spaced", F.aggregate("ranked", F.slice("ranked", 1, 0), step)["i"])
    rest = F.filter("ranked", lambda x: ~F.array_contains("spaced", x["i"]))["i"]
    filled = spaced.withColumn("taken", F.concat("spaced", F.slice(rest, F.lit(1), F.greatest(F.col("quota").cast("int") - F.size("spaced"), F.lit(0)))))
    out = F.transform("all", lambda x: F.struct(x["t"].alias(t), x["score"].alias(score), x["key"].alias(key), x["best"].alias(best), F.array_contains("taken", x["i"]).alias("taken")))
    marked = filled.select(*by, month, F.inline(out))
    # Taken rows first, the best first among both; for those not taken the best of a burst comes before the others.
    order = [F.desc("taken"), F.desc(F.col("taken") | F.col(best)), F.desc(score), key]
    return marked.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k).drop("place")
