"""Queries over the driver's tables, one for each operator or a few of them, and SQL that gives the same rows.

Times go out as whole numbers and fractions are rounded, so that both engines print the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.functions import scalar as f
from storyline.operators import catalog, dedup, draft, evaluate, graph, groups, layout, learn, people, select, timeline
from storyline.shared import materialize
from storyline.sources import tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(q: Query) -> Query:
        QUERIES[name or q.__name__] = q
        if sql:
            ORACLE[name or q.__name__] = sql
        return q

    return put


T = "epoch_us(ts) // 1000000"
EVENTS = f"e AS (SELECT user_id, event_id, {T} AS t, event_type, value FROM events)"
GAPPED = f"""{EVENTS}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 10800 THEN 1 ELSE 0 END AS n FROM e),
s AS (SELECT * EXCLUDE (n), sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS event FROM g)"""
BURSTS = GAPPED.replace("10800", "20").replace("AS event FROM", "AS burst FROM")
DOCS = "d AS (SELECT doc_id, trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)) AS w, text, source, n_chars, lang FROM documents)"
_BITS = ", ".join(f"sum(((h >> {i}) & 1) * 2 - 1) AS b{i}" for i in range(60))
_SUM = " + ".join(f"(CASE WHEN b{i} > 0 THEN {1 << i}::BIGINT ELSE 0::BIGINT END)" for i in range(60))
SIMHASH = f"""w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(trim(text)), '\\s+')) AS w FROM documents),
h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 15))::BIGINT AS h FROM w WHERE w <> ''),
x AS (SELECT doc_id, {_BITS} FROM h GROUP BY doc_id), sh AS (SELECT doc_id, {_SUM} AS simhash FROM x)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.assign_events(src.timeline(spark, sf_dir), ["user_id"], "t", "event_id")


# Timeline


@query(f"""WITH {GAPPED} SELECT user_id, event, count(*) AS n, min(t) AS first_t, max(t) AS last_t, max(value) AS best_value
FROM s GROUP BY user_id, event HAVING count(*) >= 3""")
def gap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("user_id", "event").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.max("value").alias("best_value"))
    return rows.filter("n >= 3")


@query(f"WITH {BURSTS} SELECT user_id, event_id, burst, count(*) OVER (PARTITION BY user_id, burst) AS burst_size FROM s")
def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.assign_bursts(src.timeline(spark, sf_dir), ["user_id"], "t", "event_id").select("user_id", "event_id", "burst", "burst_size")


@query(f"""WITH {BURSTS} SELECT user_id, burst, event_id, value FROM s
QUALIFY row_number() OVER (PARTITION BY user_id, burst ORDER BY value DESC, event_id) = 1""")
def best_of_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline.assign_bursts(src.timeline(spark, sf_dir), ["user_id"], "t", "event_id")
    return timeline.best_of_burst(rows, ["user_id"], "value", "event_id").select("user_id", "burst", "event_id", "value")


@query(f"""WITH {GAPPED} SELECT user_id, event, count(*) AS n, count(*) FILTER (value >= 50) AS included, min(t) AS first_t, max(t) AS last_t,
(max(t) - min(t)) // 86400 + 1 AS span_days, datediff('day', make_timestamp(min(t) * 1000000), make_timestamp(max(t) * 1000000)) AS day_diff FROM s GROUP BY user_id, event""")
def event_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.event_stats(_events(spark, sf_dir), ["user_id"], "t", F.col("value") >= 50)


@query(f"""WITH {GAPPED}, k AS (SELECT *, count(*) OVER (PARTITION BY user_id, event) < 3 AS everyday,
strftime(make_timestamp(min(t) OVER (PARTITION BY user_id, event) * 1000000), '%Y-%m') AS m FROM s),
l AS (SELECT *, CASE WHEN everyday THEN m ELSE event::VARCHAR END AS g FROM k),
f AS (SELECT *, first_value(t) OVER o AS ft, first_value(event_id) OVER o AS fk FROM l WINDOW o AS (PARTITION BY user_id, everyday, g ORDER BY t, event_id)),
r AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY ft, fk) - 1 AS grp FROM f)
SELECT user_id, grp, everyday, count(*) AS n, min(t) AS first_t FROM r GROUP BY user_id, grp, everyday""")
def everyday_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline.everyday_groups(_events(spark, sf_dir), ["user_id"], "t", "event_id")
    return rows.groupBy("user_id", "grp", "everyday").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


@query(f"WITH {GAPPED} SELECT user_id, event, count(*) FILTER (value >= 80) < count(*) * 0.25 AS nature FROM s GROUP BY user_id, event")
def nature_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.nature_flag(_events(spark, sf_dir).withColumn("people", F.col("value") >= 80), ["user_id", "event"], "people")


@query(f"""WITH {EVENTS} SELECT user_id, event_id, round(CASE WHEN count(*) OVER (PARTITION BY user_id) <= 1 THEN 0.5
ELSE percent_rank() OVER (PARTITION BY user_id ORDER BY value) END, 6) AS rank FROM e WHERE value IS NOT NULL""")
def relative_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline.relative_rank(src.timeline(spark, sf_dir), ["user_id"], "value").filter("value is not null")
    return rows.select("user_id", "event_id", F.round("rank", 6).alias("rank"))


@query(f"""WITH {EVENTS}, p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM e WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (i = round((n - 1) * 0.9)) AS mood, max(value) FILTER (i = round((n - 1) * 0.5)) AS middle, max(value) FILTER (i = round((n - 1) * 0.97)) AS top FROM p GROUP BY event_type""")
def quantile_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.quantile_cuts(src.timeline(spark, sf_dir), ["event_type"], "value", {"mood": 0.9, "middle": 0.5, "top": 0.97})


@query("""WITH p AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, l_quantity AS median_quantity FROM p WHERE i = n // 2""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline.upper_median(src.table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_quantity"])
    return rows.withColumnRenamed("l_quantity", "median_quantity")


PLACES = "c AS (SELECT c_nationkey, c_custkey, 50 + (c_custkey * 7 % 400) / 100.0 AS lat, 5 + (c_custkey * 13 % 900) / 100.0 AS lon FROM customer)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return src.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (50 + (key * 7 % 400) / 100.0).alias("lat"), (5 + (key * 13 % 900) / 100.0).alias("lon"))


HOMES = """n AS (SELECT c_nationkey, floor(lat * 10)::BIGINT AS c1, floor(lon * 10)::BIGINT AS c2, count(*) AS n FROM c GROUP BY ALL),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c1, c2) = 1),
h AS (SELECT c_nationkey, (c1 + 0.5) / 10 AS home_lat, (c2 + 0.5) / 10 AS home_lon FROM b)"""


@query(f"WITH {PLACES}, {HOMES} SELECT c_nationkey, round(home_lat, 4)::DOUBLE AS home_lat, round(home_lon, 4)::DOUBLE AS home_lon FROM h")
def home_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline.home_cell(_places(spark, sf_dir), ["c_nationkey"], "lat", "lon")
    return rows.select("c_nationkey", *(F.round(c, 4).cast("double").alias(c) for c in ("home_lat", "home_lon")))


@query(f"""WITH {PLACES}, {HOMES}, d AS (SELECT c_custkey, 12742.0 * asin(sqrt(pow(sin((radians(home_lat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(home_lat)) * pow(sin((radians(home_lon) - radians(lon)) / 2), 2))) AS km
FROM c LEFT JOIN h USING (c_nationkey)) SELECT c_custkey, round(km, 3)::DOUBLE AS km, coalesce(km > 30, true) AS away FROM d""")
def distance_from_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _places(spark, sf_dir)
    out = timeline.distance_from_home(rows, timeline.home_cell(rows, ["c_nationkey"], "lat", "lon"), ["c_nationkey"], "lat", "lon")
    return out.select("c_custkey", F.round("km", 3).cast("double").alias("km"), "away")


@query(f"""WITH {EVENTS}, a AS (SELECT * FROM e WHERE event_type = 'purchase'), b AS (SELECT * FROM e WHERE event_type = 'view'),
j AS (SELECT a.user_id, a.event_id, b.event_id AS near_key, abs(a.t - b.t) AS near_seconds, b.t AS bt FROM a LEFT JOIN b USING (user_id))
SELECT user_id, event_id, near_key, near_seconds FROM j QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY near_seconds, bt, near_key) = 1""")
def nearest_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.timeline(spark, sf_dir)
    out = timeline.nearest_in_time(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), ["user_id"], "t", "event_id")
    return out.select("user_id", "event_id", "near_key", "near_seconds")


# Selection

MONTHS = f"WITH {EVENTS}, m AS (SELECT strftime(make_timestamp(t * 1000000), '%Y-%m') AS month, event_type, count(*) AS n FROM e GROUP BY ALL)"


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.timeline(spark, sf_dir).groupBy(F.date_format(f.civil("t"), "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("n"))


@query(f"""{MONTHS} SELECT event_type, month, n, least(greatest(round(60 * sqrt(n) / sum(sqrt(n)) OVER (PARTITION BY event_type)), least(3, n)), n)::BIGINT AS quota FROM m""")
def month_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.month_quotas(_months(spark, sf_dir), ["event_type"], 60).select("event_type", "month", "n", "quota")


PAGES = f"""WITH {GAPPED}, p AS (SELECT user_id, event, count(*) AS n, count(*) < 3 AS everyday FROM s GROUP BY user_id, event),
q AS (SELECT *, CASE WHEN everyday THEN ceil(1.5 * sqrt(n) / 4.0) ELSE greatest(1.0, least(16.0, round(0.6 * sqrt(n)))) END::DOUBLE AS natural FROM p)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _events(spark, sf_dir).groupBy("user_id", "event").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("everyday", F.col("n") < 3)
    return sizes.withColumn("natural", f.natural_pages(F.col("n"), F.col("everyday"), F.lit(False), F.lit(None).cast("int")))


@query(f"""{PAGES} SELECT user_id, event, n, "natural", greatest(round(least(greatest(floor("natural" * 0.8), 1) * 4.0, greatest(ceil(n * 0.5), 1))), 1)::BIGINT AS quota FROM q""")
def natural_pages_and_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir)
    pages = f.target_pages(F.col("natural"), F.lit(0.8))
    return rows.select("user_id", "event", "n", "natural", f.quota(F.col("n"), pages, F.lit(0.8), F.lit(1.0)).alias("quota"))


@query(f"""{PAGES}, k AS (SELECT user_id, step, sum(greatest(CASE WHEN step * 0.05::DOUBLE > 1 THEN round("natural" * (step * 0.05::DOUBLE)) ELSE floor("natural" * (step * 0.05::DOUBLE)) END, 1))::BIGINT AS pages
FROM q, range(4, 61) AS r(step) GROUP BY user_id, step)
SELECT user_id, round(step * 0.05, 2)::DOUBLE AS scale, pages FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(pages - 40), step) = 1""")
def page_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.page_scale(_pages(spark, sf_dir), ["user_id"], 40).select("user_id", F.col("scale").cast("double").alias("scale"), "pages")


@query(f"""WITH {EVENTS}, k AS (SELECT user_id, event_id, value, event_type = 'purchase' AS people, t // 86400 AS day FROM e),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY user_id, people, day ORDER BY value DESC, event_id) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, people ORDER BY value DESC, event_id) AS place FROM b)
SELECT user_id, people, place, event_id FROM p WHERE place <= CASE WHEN people THEN 2 ELSE 4 END""")
def cover_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.timeline(spark, sf_dir).withColumn("people", F.col("event_type") == "purchase").withColumn("day", F.floor(F.col("t") / 86_400))
    out = select.cover_candidates(rows, ["user_id"], "value", "people", "day", "event_id")
    return out.select("user_id", "people", F.col("place").cast("long").alias("place"), "event_id")


# The spacing of the taken rows of a month: row after row of its best of bursts, the list of taken ones carried on.
@query(f"""WITH RECURSIVE {BURSTS},
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, burst ORDER BY value DESC, event_id) = 1 AS best, strftime(make_timestamp(t * 1000000), '%Y-%m') AS month FROM s),
m AS (SELECT user_id, month, count(*) AS n FROM b GROUP BY ALL),
q AS (SELECT user_id, month, least(greatest(round(20 * sqrt(n) / sum(sqrt(n)) OVER (PARTITION BY user_id)), least(3, n)), n)::BIGINT AS quota FROM m),
k AS (SELECT b.*, quota, row_number() OVER (PARTITION BY user_id, month ORDER BY value DESC, event_id) AS i FROM b JOIN q USING (user_id, month) WHERE best),
r(user_id, month, i, ts, ids) AS (SELECT user_id, month, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM q
  UNION ALL SELECT user_id, month, i, CASE WHEN goes THEN list_append(ts, t) ELSE ts END, CASE WHEN goes THEN list_append(ids, event_id) ELSE ids END
  FROM (SELECT k.user_id, k.month, k.i, k.t, k.event_id, r.ts, r.ids, len(r.ts) < k.quota AND len(list_filter(r.ts, lambda x : abs(x - k.t) <= 1800)) = 0 AS goes
    FROM r JOIN k ON r.user_id = k.user_id AND r.month = k.month AND r.i + 1 = k.i)),
z AS (SELECT user_id, month, ids FROM r QUALIFY row_number() OVER (PARTITION BY user_id, month ORDER BY i DESC) = 1),
w AS (SELECT k.user_id, k.event_id, row_number() OVER (PARTITION BY k.user_id, k.month ORDER BY k.i) <= k.quota - len(z.ids) AS taken FROM k JOIN z USING (user_id, month) WHERE NOT list_contains(z.ids, k.event_id)),
a AS (SELECT event_id FROM w WHERE taken UNION ALL SELECT unnest(ids) FROM z)
SELECT user_id, month, t, event_id FROM b LEFT JOIN (SELECT event_id, true AS taken FROM a) USING (event_id)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY coalesce(taken, false) DESC, coalesce(taken, best) DESC, value DESC, event_id) <= 20""")
def baseline_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline.mark_best(timeline.assign_bursts(src.timeline(spark, sf_dir), ["user_id"], "t", "event_id"), ["user_id"], "value", "event_id")
    rows = rows.withColumn("month", F.date_format(f.civil("t"), "yyyy-MM"))
    return select.baseline(rows, ["user_id"], "t", "month", "value", "event_id", "best", 20).select("user_id", "month", "t", "event_id")


# Duplicates


@query("""SELECT count(*) AS files, count(DISTINCT text) AS contents, count(text) - count(DISTINCT text) AS exact_duplicates,
count(*) FILTER (lang = 'en') AS english, count(*) FILTER (n_chars < 500) AS short FROM documents""")
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog_summary(src.table(spark, sf_dir, "documents"), "text", {"english": F.col("lang") == "en", "short": F.col("n_chars") < 500})


@query("SELECT sha256(text) AS content, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = src.table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("content")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query(f"WITH {SIMHASH} SELECT doc_id, simhash FROM sh")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.simhashes(spark, sf_dir)


NEAR = f"""WITH RECURSIVE {SIMHASH}, m AS (SELECT min(doc_id) AS doc_id, simhash FROM sh GROUP BY simhash),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, bit_count(xor(a.simhash, b.simhash))::INT AS d FROM m a JOIN m b ON a.doc_id < b.doc_id AND bit_count(xor(a.simhash, b.simhash)) <= 6)"""


def _distinct_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.simhashes(spark, sf_dir).groupBy("simhash").agg(F.min("doc_id").alias("doc_id"))


@query(f"{NEAR} SELECT a, b, d FROM p")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.hamming_pairs(_distinct_hashes(spark, sf_dir), "doc_id", "simhash", 6, 60)


#: All pairs of documents, those of equal hashes too.
NEAR_ALL = f"""WITH RECURSIVE {SIMHASH}, p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.doc_id < b.doc_id AND bit_count(xor(a.simhash, b.simhash)) <= 6)"""
COMPONENTS = f"""{NEAR_ALL}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node), c AS (SELECT node, min(root) AS root FROM r GROUP BY node)"""


@query(f"{COMPONENTS} SELECT node, root FROM c")
def near_dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = materialize(src.simhashes(spark, sf_dir), "simhashes")
    firsts = held.groupBy("simhash").agg(F.min("doc_id").alias("a"))
    near = dedup.hamming_pairs(firsts, "a", "simhash", 6, 60).select("a", "b")
    # A document is linked to the first of its hash, which links it to all that are near: edges grow with the documents and not with the pairs of copies.
    same = held.join(firsts, "simhash").select("a", F.col("doc_id").alias("b")).filter("a < b")
    return graph.components(near.unionByName(same))


@query(f"{COMPONENTS} SELECT root, node AS best, n_chars FROM c JOIN documents ON node = doc_id QUALIFY row_number() OVER (PARTITION BY root ORDER BY n_chars DESC, node) = 1")
def best_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = near_dup_components(spark, sf_dir).join(src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), "n_chars"), "node")
    held = members.select("root", F.col("node").alias("id"), F.col("n_chars").alias("width"), F.lit(1).alias("height"), *(F.lit(None).cast("string").alias(c) for c in ("date_source", "camera_make", "gps_lat")))
    return dedup.best_copy(held, ["root"]).select("root", F.col("id").alias("best"), F.col("width").alias("n_chars"))


# Catalog


@query("SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1")
def rows_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphans_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = src.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return catalog.orphans(orders, src.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def has_photo_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = src.table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return src.table(spark, sf_dir, "customer").select("c_custkey").join(large, "c_custkey", "left_semi")


LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query(f"SELECT {LINE}, o_orderstatus FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1) JOIN orders ON l_orderkey = o_orderkey")
def first_file_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = LINE.split(", ")
    lines = src.table(spark, sf_dir, "lineitem").select(*cols)
    first = catalog.first_per_key(lines, ["l_orderkey"], cols[1:])
    orders = src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return first.join(orders, "l_orderkey")


@query("SELECT md5(text) AS content, array_to_string(list_sort(list(DISTINCT source)), ',') AS kinds, count(*) AS files FROM documents GROUP BY 1")
def sources_per_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = src.table(spark, sf_dir, "documents")
    return catalog.sources_per_content(docs, F.md5("text"), "source").withColumn("kinds", F.array_join("kinds", ","))


SNAPSHOTS = """a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0),
b AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 0),
r AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed'
WHEN a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus AND a.o_totalprice IS NOT DISTINCT FROM b.o_totalprice THEN 'unchanged' ELSE 'changed' END AS state
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)"""


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = src.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    price = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return catalog.reconcile(orders.filter("o_orderkey % 7 <> 0"), orders.filter("o_orderkey % 11 <> 0").withColumn("o_totalprice", price), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query(f"WITH {SNAPSHOTS} SELECT o_orderkey, state FROM r")
def reconcile_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir).select("o_orderkey", "state")


@query(f"WITH {SNAPSHOTS} SELECT count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'removed') AS removed, count(*) FILTER (state = 'unchanged') AS unchanged FROM r")
def sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.sync_report(_reconciled(spark, sf_dir), [])


@query(f"WITH {EVENTS} SELECT user_id, event_type, event_id, value FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY t DESC, event_id DESC) = 1")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest_wins(src.timeline(spark, sf_dir), ["user_id", "event_type"], ["t", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT e.event_id, a.value AS added, b.value AS removed FROM (SELECT event_id, event_type, event_id + 1 AS next_id, event_id + 3 AS other_id FROM events) e
LEFT JOIN events a ON a.event_id = e.next_id AND e.event_type <> 'view' LEFT JOIN events b ON b.event_id = e.other_id""")
def double_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    log = e.select("event_id", "event_type", (F.col("event_id") + 1).alias("next_id"), (F.col("event_id") + 3).alias("other_id"))
    a = e.select(F.col("event_id").alias("next_id"), F.col("value").alias("a"))
    b = e.select(F.col("event_id").alias("other_id"), F.col("value").alias("removed"))
    both = log.join(a, "next_id", "left").join(b, "other_id", "left")
    return both.select("event_id", F.when(F.col("event_type") != "view", F.col("a")).alias("added"), "removed")


@query("SELECT user_id, count(*) AS faces, count(DISTINCT event_type) AS photos, bool_or(value > 99) AS confirmed FROM events GROUP BY user_id HAVING count(*) >= 70 OR bool_or(value > 99)")
def group_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "events")
    faces = e.select(F.lit("L1").alias("library_id"), F.col("user_id").alias("grp"), F.col("event_type").alias("content_hash"), (F.col("value") > 99).alias("confirmed"))
    return catalog.face_groups(faces, 70).select(F.col("grp").alias("user_id"), "faces", "photos", "confirmed")


@query("SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events QUALIFY place <= 5")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.top_per_key(src.table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), "event_id"], 5)
    return rows.withColumn("place", F.col("place").cast("long"))


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id) WHERE l.quality IS DISTINCT FROM 1")
def null_safe_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = src.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    both = src.table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return both.filter(~F.col("quality").eqNullSafe(F.lit(1)))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), lower('Part 1')) OR starts_with(lower(p_name), 'b')")
def prefix_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower("p_name")
    return src.table(spark, sf_dir, "part").filter(name.startswith("part 1") | name.startswith("b")).select("p_partkey", "p_name")


@query(f"""WITH y AS (SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1) SELECT year, n FROM y ORDER BY (year = 2030) DESC, n DESC, year LIMIT 1""")
def default_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.default_year(rows_per_year(spark, sf_dir), 2030)


# Evaluation

GOLD_SETS = f"""WITH {SIMHASH}, gold AS (SELECT DISTINCT doc_id AS id FROM labels WHERE quality = 1), sel AS (SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0),
i AS (SELECT d.doc_id AS id, d.doc_id * 37 AS t, s.simhash AS h FROM documents d LEFT JOIN sh s USING (doc_id)),
near AS (SELECT a.id AS a, b.id AS b FROM i a JOIN i b ON a.id = b.id OR abs(a.t - b.t) <= 20 OR bit_count(xor(a.h, b.h)) <= 10)"""


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hashes = src.simhashes(spark, sf_dir)
    docs = src.table(spark, sf_dir, "documents").select("doc_id").join(hashes, "doc_id", "left")
    items = materialize(docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") * 37).alias("t"), F.col("simhash").alias("h")), "items")
    gold = src.table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    return items.join(gold, "id", "left_semi"), items.filter("id % 3 = 0")


@query(f"""{GOLD_SETS}, p AS (SELECT count(*) FILTER (id IN (SELECT a FROM near WHERE b IN (SELECT id FROM gold))) / count(*) AS precision FROM sel),
r AS (SELECT count(*) FILTER (id IN (SELECT a FROM near WHERE b IN (SELECT id FROM sel))) / count(*) AS recall FROM gold WHERE id IN (SELECT id FROM i))
SELECT round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(2 * precision * recall / (precision + recall), 6)::DOUBLE AS f1 FROM p, r""")
def selection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, chosen = _items(spark, sf_dir)
    out = evaluate.selection_metrics(gold, chosen, 60)
    return out.select(*(F.round(c, 6).cast("double").alias(c) for c in out.columns))


COVERED = f"""WITH {GAPPED}, l AS (SELECT event_id AS id, user_id * 100000 + event AS event, t // 604800 AS month, event_id % 4 = 0 AS g, event_id % 5 = 0 AS s FROM s),
b AS (SELECT event FROM l GROUP BY event HAVING count(*) >= 3), v AS (SELECT event, bool_or(g) AS g, bool_or(s) AS s FROM l WHERE event IN (SELECT event FROM b) GROUP BY event),
m AS (SELECT month, bool_or(g) AS g, bool_or(s) AS s FROM l GROUP BY month)"""


@query(f"""{COVERED}, x AS (SELECT count(*) FILTER (s) / count(*) AS event_coverage, count(*) FILTER (g) / count(*) AS gold_event_coverage, count(*) FILTER (g AND s) / count(*) FILTER (g) AS events_found FROM v),
y AS (SELECT count(*) FILTER (g AND s) / count(*) FILTER (g) AS months_found FROM m)
SELECT round(event_coverage, 6)::DOUBLE AS event_coverage, round(gold_event_coverage, 6)::DOUBLE AS gold_event_coverage, round(events_found, 6)::DOUBLE AS events_found, round(months_found, 6)::DOUBLE AS months_found FROM x, y""")
def event_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("user_id") * 100_000 + F.col("event")).alias("event"), F.floor(F.col("t") / 604_800).alias("month"))
    out = evaluate.event_coverage(rows, rows.filter("id % 4 = 0").select("id"), rows.filter("id % 5 = 0").select("id"))
    return out.select(*(F.round(c, 6).cast("double").alias(c) for c in out.columns))


@query(f"""WITH {SIMHASH}, s AS (SELECT doc_id, source, simhash FROM documents JOIN sh USING (doc_id)),
m AS (SELECT a.source, a.doc_id, max(greatest(0.0, 1 - bit_count(xor(a.simhash, b.simhash)) / 60.0)) AS m FROM s a JOIN s b ON a.source = b.source AND a.doc_id <> b.doc_id GROUP BY ALL)
SELECT source, round(avg(m), 6)::DOUBLE AS redundancy FROM m GROUP BY source""")
def redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = src.table(spark, sf_dir, "documents").select("doc_id", "source").join(src.simhashes(spark, sf_dir), "doc_id")
    docs = materialize(docs, "hashes")
    out = evaluate.redundancy(docs.select("source", F.col("doc_id").alias("id"), F.col("simhash").alias("h")), ["source"], 60)
    return out.select("source", F.round("redundancy", 6).cast("double").alias("redundancy"))


MATCHED = f"""WITH {SIMHASH}, k AS (SELECT doc_id, (n_chars // 400)::INT AS shape, lang = 'en' AS album, simhash FROM documents JOIN sh USING (doc_id)),
d AS (SELECT a.doc_id AS id, b.doc_id AS lib_id, bit_count(xor(a.simhash, b.simhash))::INT AS d FROM k a JOIN k b ON a.shape = b.shape WHERE a.album AND NOT b.album),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, lib_id) AS n FROM d),
xx AS (SELECT id, max(lib_id) FILTER (n = 1) AS best, max(d) FILTER (n = 1) AS distance, max(lib_id) FILTER (n = 2) AS runner_up, max(d) FILTER (n = 2) AS runner_up_distance FROM n WHERE n <= 2 GROUP BY id),
y AS (SELECT k.doc_id AS id, best, distance, runner_up, runner_up_distance, CASE WHEN distance <= 8 THEN 'sure' WHEN distance <= 14 THEN 'unsure' ELSE 'unmatched' END AS status FROM k LEFT JOIN xx ON k.doc_id = xx.id WHERE k.album)"""


@query(f"{MATCHED} SELECT * FROM y")
def album_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = src.table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 400).cast("int").alias("shape"), (F.col("lang") == "en").alias("album")).join(src.simhashes(spark, sf_dir), "doc_id")
    held = materialize(docs.select(F.col("doc_id").alias("id"), "shape", "album", F.col("simhash").alias("h")), "hashes")
    return evaluate.album_match(held.filter("album"), held.filter("not album"))


@query(f"{MATCHED} SELECT count(*) AS images, round(count(*) FILTER (status = 'sure') / count(*), 6)::DOUBLE AS match_rate FROM y")
def match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.match_rate(album_match(spark, sf_dir))
    return out.withColumn("match_rate", F.round("match_rate", 6).cast("double"))


# People

CENTRES = """x AS (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT label, dim, sum(x) AS x FROM x GROUP BY ALL), l AS (SELECT label, sqrt(sum(x * x)) AS len FROM s GROUP BY label)"""


@query(f"WITH {CENTRES} SELECT label, dim::INT AS dim, round(x / len, 4)::DOUBLE AS x FROM s JOIN l USING (label)")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = people.centroids(src.table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return c.select("label", F.posexplode("centroid").alias("dim", "x")).select("label", (F.col("dim") + 1).alias("dim"), F.round("x", 4).cast("double").alias("x"))


@query(f"""WITH {CENTRES}, c AS (SELECT label, list(x / len ORDER BY dim) AS c FROM s JOIN l USING (label) GROUP BY label),
d AS (SELECT vec_id, c.label, list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS s FROM embeddings, c)
SELECT vec_id, label, round(s, 4)::DOUBLE AS cosine FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, label) = 1""")
def cosine_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.table(spark, sf_dir, "embeddings")
    out = people.nearest_centroid(rows, "vec_id", "embedding", people.centroids(rows, ["label"], "embedding"), "label")
    return out.select("vec_id", "label", F.round("cosine", 4).cast("double").alias("cosine"))


@query()
def leader_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "embeddings")
    faces = e.select(F.col("label").cast("string").alias("library_id"), F.col("vec_id").alias("id"), (F.col("vec_id") % 97).alias("photo"), (F.col("vec_id") * 31 % 101).cast("double").alias("quality"), F.when(F.col("vec_id") % 50 == 0, F.col("vec_id")).alias("fixed"), "embedding")
    return people.group_faces(faces, ["library_id"])


# Learning

STEPS = {"view": "for_mange_herfra", "click": "mangler_herfra", "purchase": "uskarpt"}
FOLD = f"""WITH {EVENTS}, l AS (SELECT user_id, list(struct_pack(event_type := event_type, value := value) ORDER BY event_id) AS log FROM e GROUP BY user_id),
p AS (SELECT user_id, list_reduce(list_concat([struct_pack(event_type := 1.0::DOUBLE, value := 0.5::DOUBLE)], list_transform(log, lambda x : struct_pack(event_type := CASE x.event_type WHEN 'view' THEN 0.0 WHEN 'click' THEN 1.0 WHEN 'purchase' THEN 2.0 ELSE 3.0 END::DOUBLE, value := x.value))),
lambda a, x : struct_pack(event_type := greatest(0.6::DOUBLE, least(1.6::DOUBLE, a.event_type + CASE x.event_type WHEN 0.0 THEN -0.04::DOUBLE WHEN 1.0 THEN 0.04::DOUBLE WHEN 3.0 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END)),
value := greatest(0.3::DOUBLE, least(0.8::DOUBLE, a.value + CASE WHEN x.event_type = 2.0 THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END)))) AS w FROM l)"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.timeline(spark, sf_dir)
    reason = F.create_map(*(F.lit(x) for kv in STEPS.items() for x in kv))[F.col("event_type")]
    log = e.select("user_id", F.col("event_id").alias("id"), F.lit("ta_med").alias("action"), reason.alias("reason"), *(F.lit(None).cast("double").alias(c) for c in ("added_sharp", "removed_sharp")))
    return learn.learn(log, ["user_id"])


@query(f"{FOLD} SELECT user_id, round(w.event_type, 6)::DOUBLE AS event_density, round(w.value, 6)::DOUBLE AS w_sharp FROM p")
def clamped_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).select("user_id", *(F.round(c, 6).cast("double").alias(c) for c in ("event_density", "w_sharp")))


@query(f"""{FOLD}, m AS (SELECT user_id, w.event_type AS d, w.value AS s FROM p) SELECT user_id, concat_ws(',', CASE WHEN s - 0.5 >= 0.05 - 1e-9 THEN 'sharpness_counts_more' END,
CASE WHEN q >= 0.05 - 1e-9 THEN 'quality_before_moment' END, CASE WHEN d - 1 >= 0.05 - 1e-9 THEN 'more_of_each_event' END, CASE WHEN 1 - d >= 0.05 - 1e-9 THEN 'fewer_of_each_event' END) AS lessons
FROM (SELECT m.*, least(0.95, 0.75 + 0.02 * n) - 0.75 AS q FROM m JOIN (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY user_id) USING (user_id))""")
def lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.lessons(_weights(spark, sf_dir), ["user_id"]).withColumn("lessons", F.array_join("lessons", ","))


@query("SELECT user_id, count(*) AS choices, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS answers FROM events GROUP BY user_id")
def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "events").withColumn("reason", F.when(F.col("event_type") == "purchase", "uskarpt"))
    return learn.feedback_summary(e, ["user_id"])


# Scalar functions

NAMES = """n AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'IMG_' || strftime(ts, '%Y%m%d_%H%M%S') || '.jpg' WHEN 1 THEN strftime(ts, '%Y-%m-%d %H.%M.%S') || '.png'
WHEN 2 THEN 'IMG-' || strftime(ts, '%Y%m%d') || '-WA0001.jpg' ELSE 'DSC0' || (event_id % 10000) || '.JPG' END AS name, epoch_us(date_trunc('second', ts)) // 1000000 AS t, epoch_us(date_trunc('day', ts)) // 1000000 AS d FROM events)"""


@query(f"WITH {NAMES} SELECT event_id, CASE event_id % 4 WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN d END AS t, CASE WHEN lower(name) LIKE '%.png' THEN 'png' ELSE 'jpeg' END AS format FROM n")
def filename_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "events").select("event_id", "ts")
    say = lambda p: F.date_format("ts", p)
    k = F.col("event_id") % 4
    name = (
        F.when(k == 0, F.concat(F.lit("IMG_"), say("yyyyMMdd_HHmmss"), F.lit(".jpg"))).when(k == 1, F.concat(say("yyyy-MM-dd HH.mm.ss"), F.lit(".png")))
        .when(k == 2, F.concat(F.lit("IMG-"), say("yyyyMMdd"), F.lit("-WA0001.jpg"))).otherwise(F.concat(F.lit("DSC0"), F.col("event_id") % 10_000, F.lit(".JPG")))
    )
    rows = e.select("event_id", name.alias("name")).withColumn("at", f.filename_time("name"))
    return rows.select("event_id", f.local_seconds("at").alias("t"), f.format_of("name").alias("format"))


BOXES = "b AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 / 100.0 AS x, l_suppkey % 40 / 100.0 AS y, l_quantity / 100 AS w, (l_linenumber + 1) / 10.0 AS h FROM lineitem)"


@query(f"""WITH {BOXES}, p AS (SELECT a.l_orderkey, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS "by", b.w AS bw, b.h AS bh FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber),
i AS (SELECT *, greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0) * greatest(least(ay + ah, "by" + bh) - greatest(ay, "by"), 0) AS i FROM p)
SELECT l_orderkey, count(*) AS pairs, round(max(i / (aw * ah + bw * bh - i)), 6)::DOUBLE AS most FROM i GROUP BY l_orderkey""")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.table(spark, sf_dir, "lineitem")
    box = F.struct((F.col("l_partkey") % 50 / 100.0).alias("x"), (F.col("l_suppkey") % 40 / 100.0).alias("y"), (F.col("l_quantity") / 100).alias("w"), ((F.col("l_linenumber") + 1) / 10.0).alias("h"))
    a = rows.select("l_orderkey", F.col("l_linenumber").alias("n1"), box.alias("a"))
    both = a.join(rows.select("l_orderkey", F.col("l_linenumber").alias("n2"), box.alias("b")), "l_orderkey").filter("n1 < n2")
    return both.groupBy("l_orderkey").agg(F.count("*").alias("pairs"), F.round(F.max(f.iou(F.col("a"), F.col("b"))), 6).cast("double").alias("most"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(1e-7 + l_extendedprice / (l_quantity * 10 / 25.4), 6)::DOUBLE AS ppi, l_extendedprice / (l_quantity * 10 / 25.4) < 150 AS low FROM lineitem WHERE l_quantity > 0")
def ppi_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    ppi = f.ppi(F.col("l_extendedprice"), F.col("l_quantity") * 10)
    return src.table(spark, sf_dir, "lineitem").filter("l_quantity > 0").select("l_orderkey", "l_linenumber", "l_partkey", F.round(1e-7 + ppi, 6).cast("double").alias("ppi"), f.low_resolution(ppi).alias("low"))


@query("SELECT p_partkey, greatest(50, ceil(p_size / 50.0) * 50)::BIGINT AS tier, (300 + greatest(50, ceil(p_size / 50.0) * 50) * 4)::BIGINT AS price FROM (SELECT p_partkey, p_size * 5 AS p_size FROM part)")
def price_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.col("p_size") * 5
    return src.table(spark, sf_dir, "part").select("p_partkey", f.price_tier(pages).alias("tier"), f.price(pages).alias("price"))


@query("SELECT event_id, props->>'$.device' AS device, length(props)::INT AS size FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.device").alias("device"), F.length("props").alias("size"))


@query("SELECT conv_id, turn, (turn < 3) AND (n <= 3 OR n % 3 = 0) AS ask FROM (SELECT conv_id, turn, length(coalesce(text, '')) % 10 AS n FROM conversations)")
def ask_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit(""))) % 10
    return src.table(spark, sf_dir, "conversations").select("conv_id", "turn", f.ask_why(n, F.col("turn")).alias("ask"))


# Layout and draft


@query(f"""WITH {EVENTS}, p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS page, event_id FROM e)
SELECT user_id, (page // 2)::BIGINT AS spread, max(event_id) FILTER (page % 2 = 0) AS "left", max(event_id) FILTER (page % 2 = 1) AS "right" FROM p GROUP BY ALL""")
def spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.spreads(src.timeline(spark, sf_dir), ["user_id"], ["t", "event_id"], "event_id")


@query(f"""{PAGES}, a AS (SELECT user_id, event, event_id, value / 100 AS quality, "natural"::INT AS pages, q.n, row_number() OVER (PARTITION BY user_id, event ORDER BY t, event_id) - 1 AS i FROM s JOIN q USING (user_id, event)),
b AS (SELECT *, least(greatest(pages, 1), n) AS p, row_number() OVER (PARTITION BY user_id, event ORDER BY quality DESC, i) AS best FROM a),
c AS (SELECT *, best <= CASE WHEN p = 1 THEN 0 WHEN p = n THEN n ELSE least(greatest(round(p * 0.4), 2 * p - n, 1), p - 1) END AS alone FROM b),
d AS (SELECT *, count(*) FILTER (alone) OVER (PARTITION BY user_id, event) AS singles, row_number() OVER (PARTITION BY user_id, event, alone ORDER BY i) AS nth FROM c),
g1 AS (SELECT *, CASE WHEN NOT alone THEN (nth * greatest(p - singles, 1) - 1) // (n - singles) END AS grid FROM d),
h AS (SELECT *, CASE WHEN alone THEN i ELSE min(i) OVER (PARTITION BY user_id, event, alone, grid) END AS first_i FROM g1),
k AS (SELECT *, count(*) OVER (PARTITION BY user_id, event, first_i) AS size FROM h),
l AS (SELECT *, min(first_i) FILTER (size = 1) OVER (PARTITION BY user_id, event) AS opening FROM k),
m AS (SELECT *, dense_rank() OVER (PARTITION BY user_id, event ORDER BY CASE WHEN p >= 3 AND first_i = opening THEN -1 ELSE first_i END) - 1 AS page, size = 1 AND quality >= 0.45 AS good FROM l),
o AS (SELECT *, count(*) FILTER (good) OVER (PARTITION BY user_id, event ORDER BY page, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fine FROM m)
SELECT user_id, event, event_id, page, row_number() OVER (PARTITION BY user_id, event, page ORDER BY i) - 1 AS place,
CASE WHEN size > 1 THEN 'grid' WHEN p > 1 AND good AND fine % 2 = 0 THEN 'full_bleed' ELSE 'air' END AS kind,
CASE WHEN size > 1 THEN CASE WHEN size = 2 OR size = 4 THEN 2 WHEN size <= 9 THEN 3 ELSE 4 END END::INT AS "columns" FROM o""")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    pages = _pages(spark, sf_dir).select("user_id", "event", F.col("natural").cast("int").alias("pages"))
    held = rows.join(pages, ["user_id", "event"]).select("user_id", "event", "event_id", "t", (F.col("value") / 100).alias("quality"), F.lit("free").alias("single"), "pages")
    return layout.paginate(held, ["user_id", "event"], "t", "event_id")


def _km_sql(p: tuple[str, str], q: tuple[str, str]) -> str:
    (a1, o1), (a2, o2) = p, q
    return f"12742.0 * asin(sqrt(pow(sin((radians({a2}) - radians({a1})) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * pow(sin((radians({o2}) - radians({o1})) / 2), 2)))"


_HERE, _THERE, _HOME = ("lat", "lon"), ("there_lat", "there_lon"), ("home_lat", "home_lon")


@query(f"""WITH RECURSIVE {GAPPED}, l AS (SELECT user_id, event, t, 50 + (event % 7) / 1.5::DOUBLE AS lat, 5 + (event % 3) / 2.0::DOUBLE AS lon FROM s),
n AS (SELECT user_id, floor(lat * 10)::BIGINT AS c1, floor(lon * 10)::BIGINT AS c2, count(*) AS n FROM l GROUP BY ALL),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, c1, c2) = 1),
k AS (SELECT user_id, event, first_t, last_t, lats, lons, lats[len(lats) // 2 + 1] AS lat, lons[len(lons) // 2 + 1] AS lon, (c1 + 0.5::DOUBLE) / 10 AS home_lat, (c2 + 0.5::DOUBLE) / 10 AS home_lon, row_number() OVER (PARTITION BY user_id ORDER BY event) AS i
  FROM (SELECT user_id, event, min(t) AS first_t, max(t) AS last_t, list(lat ORDER BY lat) AS lats, list(lon ORDER BY lon) AS lons FROM l GROUP BY ALL) JOIN b USING (user_id)),
r(user_id, event, i, trip, last_t, lats, lons) AS (SELECT user_id, event, i, event, last_t, lats, lons FROM k WHERE i = 1
  UNION ALL SELECT user_id, event, i, CASE WHEN goes THEN trip ELSE event END, last_t, CASE WHEN goes THEN list_sort(list_concat(old_lats, lats)) ELSE lats END, CASE WHEN goes THEN list_sort(list_concat(old_lons, lons)) ELSE lons END
  FROM (SELECT *, first_t - old_t <= 129600 AND {_km_sql(_THERE, _HERE)} <= 30 AND {_km_sql(_THERE, _HOME)} > 30 AND {_km_sql(_HERE, _HOME)} > 30 AS goes
    FROM (SELECT k.*, r.trip, r.last_t AS old_t, r.lats AS old_lats, r.lons AS old_lons, r.lats[len(r.lats) // 2 + 1] AS there_lat, r.lons[len(r.lons) // 2 + 1] AS there_lon FROM r JOIN k ON r.user_id = k.user_id AND r.i + 1 = k.i)))
SELECT user_id, event, trip FROM r""")
def trip_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("lat", 50 + F.col("event") % 7 / 1.5).withColumn("lon", 5 + F.col("event") % 3 / 2.0)
    events = rows.groupBy("user_id", "event").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sort_array(F.collect_list("lat")).alias("lats"), F.sort_array(F.collect_list("lon")).alias("lons"))
    return timeline.trip_merge(events, ["user_id"], timeline.home_cell(rows, ["user_id"], "lat", "lon"))


@query(f"""{PAGES.replace("WITH", "WITH RECURSIVE", 1)}, d AS (SELECT user_id, event, make_timestamp(min(t) * 1000000)::DATE AS first_day, make_timestamp(max(t) * 1000000)::DATE AS last_day FROM s GROUP BY user_id, event),
k AS (SELECT d.*, NOT everyday AND "natural" BETWEEN 1 AND 3 AS fits, row_number() OVER (PARTITION BY user_id ORDER BY event) AS i FROM d JOIN q USING (user_id, event)),
r(user_id, i, run, since, until, done) AS (SELECT user_id, i, CASE WHEN fits THEN [event] ELSE []::BIGINT[] END, first_day, last_day, []::BIGINT[] FROM k WHERE i = 1
  UNION ALL SELECT user_id, i, CASE WHEN goes THEN list_append(run, event) WHEN fits THEN [event] ELSE []::BIGINT[] END, CASE WHEN goes THEN since ELSE first_day END, last_day, CASE WHEN NOT goes AND len(run) >= 2 THEN run ELSE []::BIGINT[] END
  FROM (SELECT k.*, r.run, r.since, fits AND len(r.run) BETWEEN 1 AND 3 AND k.first_day - r.until <= 2 AND k.last_day - r.since <= 3 AS goes FROM r JOIN k ON r.user_id = k.user_id AND r.i + 1 = k.i)),
o AS (SELECT user_id, i, done AS events FROM r WHERE len(done) > 0
  UNION ALL SELECT user_id, i + 1, run FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1) WHERE len(run) >= 2)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY i) - 1)::INT AS suggestion, array_to_string(events, ',') AS events FROM o""")
def merge_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = timeline.event_stats(_events(spark, sf_dir), ["user_id"], "t").join(_pages(spark, sf_dir).select("user_id", "event", "everyday", "natural"), ["user_id", "event"])
    held = days.select("user_id", "event", "everyday", F.col("natural").cast("int").alias("pages"), F.to_date(f.civil("first_t")).alias("first_day"), F.to_date(f.civil("last_t")).alias("last_day"))
    return timeline.merge_suggestions(held, ["user_id"]).withColumn("events", F.array_join("events", ","))


@query()
def album_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = src.photos(spark, sf_dir)
    key = F.col("content_hash")
    faces = photos.filter("faces_done and content_hash % 3 = 0").select("library_id", "content_hash", key.alias("id"), (key % 30 / 100.0).alias("h"), (key % 10 / 10.0).alias("sharpness"), (key % 5).alias("person_id"), F.lit(None).cast("long").alias("grp"), F.lit(False).alias("ignored"))
    decisions = photos.filter("content_hash % 29 = 0").select("library_id", "content_hash", F.when(key % 2 == 0, "med").otherwise("ikke_med").alias("decision"))
    prefs = photos.select("library_id").distinct().select("library_id", *(F.lit(s).alias(n) for n, (s, _, _) in learn.WEIGHTS.items()))
    return draft.make_draft(photos, faces, decisions, prefs)


@query("""WITH p AS (SELECT user_id AS person_id, CASE user_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 2 ELSE 1 END AS want FROM (SELECT DISTINCT user_id FROM events)),
h AS (SELECT user_id AS person_id, count(*) AS have FROM events WHERE value > 97 GROUP BY user_id) SELECT person_id, greatest(want - coalesce(have, 0), 0)::BIGINT AS missing FROM p LEFT JOIN h USING (person_id)""")
def coverage_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "events")
    role = F.when(F.col("id") % 3 == 0, "barn").when(F.col("id") % 3 == 1, "besteforeldre").otherwise("annen")
    persons = e.select(F.lit("L1").alias("library_id"), F.col("user_id").alias("id")).distinct().withColumn("role", role)
    shown = e.filter("value > 97").select(F.lit("L1").alias("library_id"), F.col("user_id").alias("person_id"))
    return people.coverage_deficit(shown, persons).select("person_id", F.col("missing").cast("long").alias("missing"))


# Hints, patches and work lists

EVERYDAY = f"""WITH RECURSIVE {GAPPED}, k AS (SELECT user_id, event_id, t, event AS grp, count(*) OVER (PARTITION BY user_id, event) < 3 AS everyday FROM s)"""
RENUMBERED = "n AS (SELECT *, min(struct_pack(t := t, k := event_id)) OVER (PARTITION BY user_id, label) AS f FROM l), r AS (SELECT user_id, event_id, everyday, dense_rank() OVER (PARTITION BY user_id ORDER BY f) - 1 AS grp FROM n)"


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    size = rows.groupBy("user_id", "event").agg((F.count("*") < 3).alias("everyday"))
    return rows.join(size, ["user_id", "event"]).select("user_id", "event_id", "t", F.col("event").alias("grp"), "everyday")


@query(f"""{EVERYDAY}, h AS (SELECT user_id, event_id % 17 AS set_id, grp FROM k WHERE event_id % 17 < 2),
ed AS (SELECT DISTINCT a.user_id, a.grp AS a, b.grp AS b FROM h a JOIN h b ON a.user_id = b.user_id AND a.set_id = b.set_id),
c(user_id, grp, root) AS (SELECT user_id, a, a FROM ed UNION SELECT ed.user_id, ed.b, c.root FROM c JOIN ed ON ed.user_id = c.user_id AND ed.a = c.grp),
m AS (SELECT user_id, grp, min(root) AS root FROM c GROUP BY ALL),
l AS (SELECT k.user_id, event_id, t, everyday AND root IS NULL AS everyday, coalesce(root, k.grp) AS label FROM k LEFT JOIN (SELECT * FROM m WHERE (user_id, root) IN (SELECT user_id, root FROM m GROUP BY ALL HAVING count(*) > 1)) m ON m.user_id = k.user_id AND m.grp = k.grp),
{RENUMBERED} SELECT user_id, event_id, everyday, grp FROM r""")
def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grouped(spark, sf_dir)
    sets = rows.filter("event_id % 17 < 2").select("user_id", (F.col("event_id") % 17).alias("set_id"), "event_id")
    return groups.merge_groups(rows, sets, ["user_id"], "t", "event_id").select("user_id", "event_id", "everyday", "grp")


@query(f"""{EVERYDAY}, l AS (SELECT user_id, event_id, t, everyday AND event_id % 23 <> 0 AS everyday, CASE WHEN event_id % 23 = 0 THEN 's' || (event_id % 2) ELSE 'g' || grp END AS label FROM k),
{RENUMBERED} SELECT user_id, event_id, everyday, grp FROM r""")
def own_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grouped(spark, sf_dir)
    sets = rows.filter("event_id % 23 = 0").select("user_id", (F.col("event_id") % 2).alias("set_id"), "event_id")
    return groups.own_stories(rows, sets, ["user_id"], "t", "event_id").select("user_id", "event_id", "everyday", "grp")


@query(f"""{EVERYDAY}, p AS (SELECT user_id, event_id, event_id % 3 AS page_id, event_id AS pos, grp FROM k WHERE event_id % 31 = 0),
h AS (SELECT user_id, page_id, arg_min(grp, pos) AS home FROM p GROUP BY ALL),
l AS (SELECT k.user_id, k.event_id, t, everyday, coalesce(home, k.grp) AS label FROM k LEFT JOIN p ON p.event_id = k.event_id LEFT JOIN h ON h.user_id = p.user_id AND h.page_id = p.page_id),
{RENUMBERED} SELECT user_id, event_id, grp FROM r""")
def gathered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grouped(spark, sf_dir)
    locked = rows.filter("event_id % 31 = 0").select("user_id", (F.col("event_id") % 3).alias("page_id"), F.col("event_id").alias("pos"), "event_id")
    return groups.gather_locked(rows, locked, ["user_id"], "t", "event_id").select("user_id", "event_id", "grp")


@query(f"""{EVERYDAY}, c AS (SELECT user_id, grp, everyday, count(*) FILTER (event_id % 3 > 0) AS n, bool_or(event_id % 3 > 0 AND event_id % 40 = 0) AS child, (max(t) - min(t)) // 86400 AS days FROM k GROUP BY ALL)
SELECT user_id, grp, NOT everyday AND days >= 1 AND n >= 5 AND NOT child AND grp % 5 <> 0 AS adult_trip FROM c""")
def trip_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    rows = _grouped(spark, sf_dir).withColumn("nature", F.lit(False)).withColumn("persons", F.when(key % 3 > 0, F.array(key % 40)).otherwise(F.array().cast("array<bigint>")))
    children = rows.select("user_id", F.lit(0).cast("long").alias("person")).distinct()
    away = rows.select("user_id", "grp", (F.col("grp") % 5 != 0).alias("away")).distinct()
    return groups.trip_guess(rows, ["user_id"], children, away)


@query()
def coverage_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    rows = _grouped(spark, sf_dir).withColumn("quality", key % 100 / 100.0).withColumn("usable", key % 7 > 0).withColumn("included", key % 11 == 0)
    rows = rows.withColumn("persons", F.when(key % 4 == 0, F.array(F.struct((key % 13).alias("person"), (key % 9 / 9.0).alias("score")))))
    wants = src.table(spark, sf_dir, "events").select("user_id").distinct().withColumn("person", F.explode(F.sequence(F.lit(0), F.lit(12)))).withColumn("want", F.lit(2))
    return groups.coverage_repair(rows, wants, ["user_id"], "event_id")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_id % 2 = 0 ELSE value > 50 END AS included,
CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'chosen_by_you' ELSE 'excluded_by_you' END ELSE event_type END AS reason FROM events""")
def choice_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "events").select("event_id", (F.col("value") > 50).alias("included"), F.col("event_type").alias("reason"))
    patches = e.filter("event_id % 5 = 0").select("event_id", (F.col("event_id") % 2 == 0).alias("included"))
    return groups.apply_choices(e, patches, [], "event_id")


@query("""WITH p AS (SELECT user_id, list(event_id ORDER BY event_id) AS x FROM events GROUP BY user_id), q AS (SELECT user_id, x[len(x)] AS m, x[1] AS b, list_filter(x, lambda i : i <> x[len(x)]) AS rest FROM p WHERE len(x) > 1)
SELECT user_id, array_to_string(list_concat([m], rest), ',') AS photos FROM q""")
def moved_photo(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = src.table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("x")).filter(F.size("x") > 1)
    moved = groups.move_photo(F.col("x"), F.element_at("x", -1), F.get("x", 0))
    return pages.select("user_id", F.array_join(moved, ",").alias("photos"))


@query("""WITH c AS (SELECT user_id, count(*) FILTER (value > 99) AS great, count(*) FILTER (value < 1) AS poor FROM events GROUP BY user_id)
SELECT user_id, concat_ws(';', CASE WHEN great > 0 THEN 'great: ' || great END, CASE WHEN poor > 0 THEN 'poor: ' || poor END) AS notices FROM c""")
def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = src.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 99).alias("great"), F.count_if(F.col("value") < 1).alias("poor"))
    return groups.notices(c, ["great", "poor"]).select("user_id", F.array_join("notices", ";").alias("notices"))


@query(f"{EVERYDAY} SELECT user_id, count(*) FILTER (event_id % 3 = 0) AS included, count(DISTINCT grp) FILTER (event_id % 3 = 0) AS events, count(*) FILTER (event_id % 3 = 0 AND everyday) AS warnings FROM k GROUP BY user_id")
def album_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grouped(spark, sf_dir).withColumn("included", F.col("event_id") % 3 == 0).withColumn("warning", F.col("everyday"))
    return groups.counters(rows, ["user_id"])


@query("SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1")
def photos_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.months(src.table(spark, sf_dir, "events"), F.col("ts"))


@query("""WITH t AS (SELECT user_id, event_type, max(event_id) AS id FROM events WHERE event_id % 2 = 0 GROUP BY ALL), c AS (SELECT user_id, event_type, max(event_id) AS id FROM events WHERE event_id % 3 = 0 GROUP BY ALL)
SELECT user_id, event_type, coalesce(c.id, t.id) AS id FROM t FULL JOIN c USING (user_id, event_type)""")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = lambda cond: src.table(spark, sf_dir, "events").filter(cond).groupBy("user_id", "event_type").agg(F.max("event_id").alias("id"))
    return catalog.upsert(last("event_id % 2 = 0"), last("event_id % 3 = 0"), ["user_id", "event_type"])


@query("SELECT user_id, event_type, event_id FROM events WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10")
def undo_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = src.table(spark, sf_dir, "events").filter("event_id % 2 = 0").select(F.col("user_id").alias("library_id"), F.lit(2020).alias("album_year"), F.col("event_id").alias("id"), "event_type")
    return catalog.undo_steps(log, 10).select(F.col("library_id").alias("user_id"), "event_type", F.col("id").alias("event_id"))


PHOTOS = """WITH p AS (SELECT event_id, (event_id * 7 % 101) / 100.0::DOUBLE AS sharp, (event_id * 11 % 97) / 96.0::DOUBLE AS expo, (event_id * 13 % 89) / 88.0::DOUBLE AS color, (event_id * 19 % 79) / 78.0::DOUBLE AS motion, (event_id * 23 % 73) / 72.0::DOUBLE AS noise,
CASE WHEN event_id % 41 = 0 THEN 'png' ELSE 'jpeg' END AS format, event_id % 3 <> 0 AS camera FROM events)"""


@query(f"""{PHOTOS} SELECT event_id, CASE WHEN format = 'png' AND NOT camera THEN 'screenshot' WHEN expo < 0.1 THEN 'dark_or_blown' WHEN sharp < 0.15 THEN 'blurry' END AS noise,
CASE WHEN motion >= 0.5 THEN 'motion_blur' WHEN p.noise >= 0.85 THEN 'grainy' END AS flaw FROM p""")
def photo_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = src.photos(spark, sf_dir)
    none = spark.range(0)
    faces = none.select(*(F.lit(None).cast(t).alias(c) for c, t in (("library_id", "string"), ("content_hash", "long"), ("id", "long"), ("h", "double"), ("sharpness", "double"), ("person_id", "long"), ("grp", "long"), ("ignored", "boolean"))))
    decisions = none.select(*(F.lit(None).cast(t).alias(c) for c, t in (("library_id", "string"), ("content_hash", "long"), ("decision", "string"))))
    prefs = photos.select("library_id").distinct().select("library_id", *(F.lit(s).alias(n) for n, (s, _, _) in learn.WEIGHTS.items()))
    return draft.annotate(photos, faces, decisions, prefs).select(F.col("content_hash").alias("event_id"), "noise", "flaw")


@query(f"""{PHOTOS} SELECT event_id, round((sharp * 0.5 + expo * 0.3 + color * 0.2) * 100, 6)::DOUBLE AS score, round(0.40 * sharp + 0.25 * expo + 0.15 * (1 - motion) + 0.10 * (1 - noise) + 0.10, 9)::DOUBLE AS tech FROM p""")
def photo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = src.photos(spark, sf_dir), F.col
    tech = f.technical_quality(c("q_sharp"), c("q_exposure"), c("q_motion"), c("q_noise"), F.lit(0.0))
    return p.select(c("content_hash").alias("event_id"), F.round(f.prototype_score(c("q_sharp"), c("q_exposure"), c("q_color")), 6).alias("score"), F.round(tech, 9).alias("tech"))
