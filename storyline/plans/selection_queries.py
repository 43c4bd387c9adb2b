"""Queries of the larger algorithms: borders by neighbourhood, series, nearest places, density clusters, spread selection, album choices.

Events stand for photos, customers for places, embeddings for faces and for what photos show.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.functions.scalar import normalised
from storyline.operators import choices, density, places, series, submodular, timeline
from storyline.plans.queries import query
from storyline.shared import shared_dir, spread
from storyline.sources import tables as src
from storyline.streaming.events import run_to_end

PLACE = "CASE WHEN event_id % 11 > 0 THEN 59 + (event_id // 400 % 5) * 0.5 + (event_id % 97) * 0.001 END AS lat, 10 + (event_id % 89) * 0.001 AS lon"
KM = "12742 * asin(sqrt(pow(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin((radians({d}) - radians({c})) / 2), 2)))"


@query(f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS t, {PLACE} FROM events),
g AS (SELECT *, t - lag(t) OVER o AS gap, last_value(CASE WHEN lat IS NOT NULL THEN lat END IGNORE NULLS) OVER p AS plat, last_value(CASE WHEN lat IS NOT NULL THEN lon END IGNORE NULLS) OVER p AS plon
  FROM e WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id), p AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, median(gap) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS med FROM g)
SELECT user_id, event_id, sum((coalesce(gap > greatest(10800, 2 * med), false) OR coalesce({KM.format(a="plat", b="lat", c="plon", d="lon")} > 30, false))::INT)
  OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS event FROM m""")
def event_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    lat = F.when(k % 11 > 0, 59 + (F.floor(k / 400) % 5) * 0.5 + (k % 97) * 0.001)
    rows = src.timeline(spark, sf_dir).select("user_id", "event_id", "t", lat.alias("lat"), (10 + (k % 89) * 0.001).alias("lon"))
    return timeline.neighbourhood_events(rows, ["user_id"], "t", "event_id", "lat", "lon").select("user_id", "event_id", "event")


@query(f"""WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 59.9 + (c_custkey % 1000) * 0.00001 ELSE 55 + (c_custkey * 7919 % 150000) * 0.0001 END AS plat,
  CASE WHEN c_custkey % 3 = 0 THEN 10.7 + (c_custkey // 3 % 1000) * 0.00001 ELSE -170 + (c_custkey * 104729 % 340000) * 0.001 END AS plon FROM customer),
e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 59.9 + (event_id % 991) * 0.00001 ELSE 50 + (event_id * 6151 % 300000) * 0.0001 END AS lat,
  CASE WHEN event_id % 4 = 0 THEN 10.7 + (event_id % 983) * 0.00001 ELSE -180 + (event_id * 7001 % 360000) * 0.001 END AS lon FROM events),
d AS (SELECT event_id, id, round({KM.format(a="lat", b="plat", c="lon", d="plon")}, 6) AS km FROM e, p)
SELECT event_id, (min({{'km': km, 'id': id}})).id AS place, min(km) AS km FROM d GROUP BY event_id""")
def nearest_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("c_custkey"), F.col("event_id")
    towns = src.table(spark, sf_dir, "customer").select(
        c.alias("id"), F.when(c % 3 == 0, 59.9 + (c % 1000) * 0.00001).otherwise(55 + (c * 7919 % 150000) * 0.0001).alias("lat"),
        F.when(c % 3 == 0, 10.7 + (F.floor(c / 3) % 1000) * 0.00001).otherwise(-170 + (c * 104729 % 340000) * 0.001).alias("lon"),
    )
    photos = src.table(spark, sf_dir, "events").select(
        "event_id", F.when(k % 4 == 0, 59.9 + (k % 991) * 0.00001).otherwise(50 + (k * 6151 % 300000) * 0.0001).alias("lat"),
        F.when(k % 4 == 0, 10.7 + (k % 983) * 0.00001).otherwise(-180 + (k * 7001 % 360000) * 0.001).alias("lon"),
    )
    return places.nearest_place(photos, "event_id", towns)


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the unit vector of what they show."""
    vectors = src.table(spark, sf_dir, "embeddings").select("vec_id", normalised("embedding").alias("unit"))
    e = spread(src.timeline(spark, sf_dir)).withColumn("vec_id", F.col("event_id") % F.lit(vectors.count()))
    return e.join(vectors, "vec_id", "left")


SERIES = """WITH RECURSIVE v AS (SELECT vec_id, [x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) FOR x IN embedding::DOUBLE[]] AS unit FROM embeddings),
e AS MATERIALIZED (SELECT event_type, event_id, epoch_us(ts) // 1000000 AS t, value, unit FROM events LEFT JOIN v ON vec_id = event_id % (SELECT count(*) FROM embeddings)),
l AS MATERIALIZED (SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.event_type = b.event_type AND a.event_id <> b.event_id AND abs(a.t - b.t) <= 3600 WHERE round(list_dot_product(a.unit, b.unit), 6) >= 0.3),
r AS (SELECT event_id, event_id AS o FROM e UNION SELECT r.event_id, l.b FROM r JOIN l ON r.o = l.a),
s AS MATERIALIZED (SELECT event_id, min(o) AS series FROM r GROUP BY event_id)"""


def _series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events with their series and vec_id, and the vectors."""
    vectors = src.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    e = spread(src.timeline(spark, sf_dir).select("event_type", "event_id", "t", "value")).withColumn("vec_id", F.col("event_id") % F.lit(vectors.count()))
    return series.like_series(e, ["event_type"], "event_id", "t", "vec_id", 3600, 0.3, vectors), vectors


@query(f"{SERIES} SELECT event_id, series FROM s")
def photo_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir)[0].select("event_id", "series")


@query(f"""{SERIES},
x AS MATERIALIZED (SELECT s.series, e.event_id, value, unit FROM s JOIN e USING (event_id)),
p0 AS (SELECT series, event_id, unit FROM x QUALIFY row_number() OVER (PARTITION BY series ORDER BY value DESC, event_id) = 1),
f1 AS MATERIALIZED (SELECT x.*, round(1 - list_dot_product(x.unit, p0.unit), 6) AS far FROM x JOIN p0 USING (series) WHERE x.event_id <> p0.event_id),
p1 AS (SELECT series, event_id, unit FROM f1 WHERE far > 0 QUALIFY row_number() OVER (PARTITION BY series ORDER BY far DESC, event_id) = 1),
f2 AS (SELECT f1.series, f1.event_id, least(far, round(1 - list_dot_product(f1.unit, p1.unit), 6)) AS far FROM f1 JOIN p1 USING (series) WHERE f1.event_id <> p1.event_id),
p2 AS (SELECT series, event_id FROM f2 WHERE far > 0 QUALIFY row_number() OVER (PARTITION BY series ORDER BY far DESC, event_id) = 1)
SELECT series, event_id, 0 AS pick FROM p0 UNION ALL SELECT series, event_id, 1 FROM p1 UNION ALL SELECT series, event_id, 2 FROM p2""")
def series_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos, vectors = _series(spark, sf_dir)
    return series.spread_picks(photos, ["series"], "event_id", "value", "vec_id", vectors=vectors).select("series", "event_id", "pick")


@query()
def density_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of cosine 0.3 and more link. SQL has no words for the tree; a test holds the whole table against a plain implementation."""
    return density.density_clusters(src.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", least=5, core=3, reach=1.4**0.5)


@query()
def spread_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty events. Greedy choice has no SQL; a test holds its value against the plain greedy one on the whole table."""
    k = F.col("event_id")
    photos = _shown(spark, sf_dir).select(
        k.alias("id"), (F.col("value") / 100).alias("score"), F.floor(F.col("t") / (2 * 86_400)).alias("month"), F.col("user_id").alias("event"), ((F.col("user_id") % 10) / 10).alias("importance"),
        F.when(k % 3 > 0, F.array(F.struct((k * 7 % 23).alias("person"), F.lit(0.8).alias("weight")))).alias("persons"), F.col("event_type").alias("kind"), F.col("unit").alias("embedding"),
    )
    return submodular.select_spread(photos, 60)


#: Types of choice commands, in the order of event_id % 13.
TYPES = ("pleased", "trip", "merge", "split", "pages", "front", "back", "rotate", "size", "crop", "gather", "own_story", "put_back")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commands: a user is a library of eleven photos."""
    k = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (k % 13 + 1).cast("int"))
    photo = k * 7 % 11
    n = F.when(k % 5 > 0, (k % 9 - 1) * F.when(k % 13 == 9, 60).otherwise(1))
    return src.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("library"), F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), k.alias("id"), kind.alias("type"),
        F.when((k % 17 > 0) | ~kind.isin("front", "back"), photo).alias("photo"), F.array_distinct(F.array(photo, (photo + 1 + k % 3) % 11, (photo + 5) % 11)).alias("photos"), (k % 2 == 0).alias("on"),
        n.alias("n"), F.when(k % 4 > 0, k % 130).alias("x"), F.when(k % 4 > 0, k % 101).alias("y"), (k % 8 == 0).alias("whole"),
    )


LOOKS = """WITH c AS (SELECT user_id AS library, event_id AS id, event_id % 13 AS k, event_id * 7 % 11 AS photo, CASE WHEN event_id % 5 > 0 THEN (event_id % 9 - 1) * CASE WHEN event_id % 13 = 9 THEN 60 ELSE 1 END END AS n,
  event_id % 2 = 0 AS turned_on, CASE WHEN event_id % 4 > 0 THEN least(event_id % 130, 100) END AS x, CASE WHEN event_id % 4 > 0 THEN event_id % 101 END AS y, event_id % 8 = 0 AS whole, epoch_ms(ts) AS t FROM events),
l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY library, photo, k ORDER BY t DESC, id DESC) = 1)
SELECT library, CASE WHEN turned_on THEN 'adult_trip' ELSE 'family_trip' END AS what, photo, NULL::BIGINT AS value, NULL::BIGINT AS value2 FROM l WHERE k = 1
UNION ALL SELECT library, 'pages', photo, greatest(n, 1), NULL FROM l WHERE k = 4 AND n IS NOT NULL
UNION ALL SELECT library, 'rotation', photo, count(*) * 90 % 360, NULL FROM c WHERE k = 7 GROUP BY library, photo HAVING count(*) % 4 > 0
UNION ALL SELECT library, 'size', photo, least(greatest(n, -1), 4), NULL FROM l WHERE k = 8 AND n IS NOT NULL
UNION ALL SELECT library, 'focus', photo, x, y FROM l WHERE k = 9 AND x IS NOT NULL
UNION ALL SELECT library, 'whole', photo, 1, NULL FROM l WHERE k = 9 AND whole
UNION ALL SELECT library, 'zoom', photo, least(n, 400), NULL FROM l WHERE k = 9 AND n > 100 AND NOT whole"""


def _looks(rows: DataFrame) -> DataFrame:
    """The rows that rest on the last command of a photo alone, which SQL can tell too."""
    return rows.filter(F.col("what").isin("adult_trip", "family_trip", "pages", "rotation", "size", "focus", "whole", "zoom")).select("library", "what", "photo", "value", "value2")


@query(LOOKS)
def choice_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looks(choices.fold_choices(_log(spark, sf_dir), ["library"]))


@query()
def album_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirteen commands; pages, stories and covers rest on the order of the whole log, so a test holds them against a plain fold."""
    return choices.fold_choices(_log(spark, sf_dir), ["library"])


@query(LOOKS)
def choice_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looks(streamed_choices(spark, _log(spark, sf_dir)))


def streamed_choices(spark: SparkSession, log: DataFrame, files: int = 8, late: str = "40 days") -> DataFrame:
    """The log as a stream of files in no order of time, and the album of each library at its end. A row of the far future ends it."""
    folder = f"{shared_dir(spark)}/choices-{uuid.uuid4().hex}"
    log.repartition(files).write.parquet(f"{folder}/in")
    end = spark.range(1).select(F.lit(-1).cast("long").alias("library"), F.lit("2199-01-01").cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("id"), F.lit("end").alias("type"))
    log.limit(0).unionByName(end, allowMissingColumns=True).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    # State is kept in as many parts as the stream starts with; more than cores do no good to one run to its end.
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(parts), spark.sparkContext.defaultParallelism)))
    try:
        run_to_end(choices.choice_stream(stream, "library", late), f"{folder}/out", f"{folder}/state")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    return choices.latest_choices(spark.read.parquet(f"{folder}/out")).filter("library >= 0")
