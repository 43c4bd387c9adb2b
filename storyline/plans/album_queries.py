"""More registered queries: catalog tables, faces, choices, pages and reports, built from the driver's tables, each calling the
operator it stands for, and SQL that gives the same rows.

Orders stand for photos (a customer is a library), line items for faces, customers for files and nations for sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.functions import scalar as f
from storyline.operators import catalog, dedup, draft, evaluate, groups, layout, learn, people, select
from storyline.plans.queries import query
from storyline.shared import dealt
from storyline.sources import files
from storyline.sources import tables as src

# Sources and files

FILES = """f AS (SELECT c_custkey AS id, c_nationkey AS source_id, c_name || '.jpg' AS rel_path, c_custkey % 1000 AS size, CASE WHEN c_mktsegment = 'BUILDING' THEN 'cloud_only' ELSE 'local' END AS status FROM customer),
s AS (SELECT n_nationkey AS id, CASE n_regionkey WHEN 0 THEN 'pc' ELSE 'nas' END AS kind, '/photos/' || n_name || '/' AS path FROM nation)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = src.table(spark, sf_dir, "customer")
    return c.select(
        F.lit("a").alias("library_id"), F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("source_id"), F.concat("c_name", F.lit(".jpg")).alias("rel_path"),
        (F.col("c_custkey") % 1000).alias("size"), F.when(F.col("c_mktsegment") == "BUILDING", "cloud_only").otherwise("local").alias("status"), (F.col("c_custkey") % 1301).alias("content_hash"),
    )


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = src.table(spark, sf_dir, "nation")
    return n.select(F.lit("a").alias("library_id"), F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_regionkey") == 0, "pc").otherwise("nas").alias("kind"), F.concat(F.lit("/photos/"), "n_name", F.lit("/")).alias("path"))


@query(f"WITH {FILES} SELECT f.id, '/photos/' || n_name || '/' || rel_path AS path, size FROM f JOIN nation ON n_nationkey = source_id WHERE status = 'cloud_only'")
def cloud_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.cloud_files(_files(spark, sf_dir), _sources(spark, sf_dir)).select("id", "path", "size")


@query(f"WITH {FILES} SELECT kind, count(*) AS n, sum(size)::BIGINT AS size FROM f JOIN s ON s.id = source_id GROUP BY kind")
def files_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.files_of_sources(_files(spark, sf_dir), _sources(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query(f"WITH {FILES} SELECT id, kind, path FROM s")
def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_sources(_sources(spark, sf_dir)).select("id", "kind", "path")


@query("""SELECT n_nationkey AS id, n_name AS path FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 100 + r_regionkey, r_name FROM region WHERE r_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)""")
def sources_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = src.table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("path"))
    new = src.table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).cast("long").alias("id"), F.col("r_name").alias("path"))
    return catalog.insert_new(old, new.unionByName(new), ["path"])


@query("""SELECT c_custkey AS id, CASE WHEN dup IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 AND c_nationkey <> 3) THEN dup END AS duplicate_of
FROM (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1 END AS dup FROM customer) WHERE c_custkey % 3 <> 0 AND c_nationkey <> 3""")
def pruned_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = src.table(spark, sf_dir, "customer").select(F.lit("a").alias("library_id"), F.col("c_custkey").alias("content_hash"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey") + 1).alias("duplicate_of"), "c_nationkey")
    left = catalog.without_source(c.filter("content_hash % 3 <> 0"), F.col("c_nationkey") == 3)
    return catalog.prune_orphans(c, left).select(F.col("content_hash").alias("id"), "duplicate_of")


@query("SELECT date_part('year', o_orderdate)::INT AS year, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def cloud_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = src.table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", "cloud_only").otherwise("local"))
    return catalog.cloud_years(o, F.year("o_orderdate"))


@query("""WITH a AS (SELECT c_nationkey AS k, c_custkey AS id, c_acctbal AS m FROM customer WHERE c_custkey % 4 <> 0), b AS (SELECT c_nationkey AS k, c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 0.0 ELSE c_acctbal END AS m FROM customer WHERE c_custkey % 5 <> 0),
s AS (SELECT coalesce(a.k, b.k) AS k, count(*) FILTER (a.id IS NULL) AS added, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL AND a.m IS DISTINCT FROM b.m) AS changed, count(*) FILTER (b.id IS NULL) AS removed FROM a FULL JOIN b ON a.k = b.k AND a.id = b.id GROUP BY 1),
r AS (SELECT c_nationkey AS k, count(*) FILTER (c_custkey % 11 <> 0) AS "read", count(*) FILTER (c_custkey % 11 = 0) AS unreadable FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1),
p AS (SELECT c_nationkey AS k, count(DISTINCT c_custkey % 900) AS new_photos FROM customer x WHERE c_custkey % 5 <> 0 AND c_custkey % 11 <> 0 AND NOT EXISTS (SELECT 1 FROM customer y WHERE y.c_nationkey = x.c_nationkey AND y.c_custkey % 4 <> 0 AND y.c_custkey % 900 = x.c_custkey % 900) GROUP BY 1)
SELECT k, coalesce(added, 0) AS added, coalesce(changed, 0) AS changed, coalesce(removed, 0) AS removed, coalesce("read", 0) AS "read", coalesce(unreadable, 0) AS unreadable, coalesce(new_photos, 0) AS new_photos FROM s FULL JOIN r USING (k) LEFT JOIN p USING (k)""")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = src.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("m"))
    before, now = c.filter("id % 4 <> 0"), c.filter("id % 5 <> 0")
    seen = catalog.reconcile(before, now.withColumn("m", F.when(F.col("id") % 7 == 0, 0.0).otherwise(F.col("m"))), ["k", "id"], ["m"])
    read = now.select("k", F.when(F.col("id") % 11 != 0, F.col("id") % 900).alias("content_hash"))
    return catalog.ingest_report(seen, read, before.select("k", (F.col("id") % 900).alias("content_hash")).distinct(), ["k"])


@query("SELECT c_name AS name FROM customer WHERE lower(c_name) LIKE 'customer#00000001%'")
def documents_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.prefix_names(src.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), "CUSTOMER#00000001")


PATHS = """p AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'C:\\Users\\A\\OneDrive\\x' WHEN 1 THEN '/home/a/Dropbox/' WHEN 2 THEN '/data/plain' ELSE '/Users/a/My Drive/x' END AS root,
CASE WHEN c_custkey % 3 = 0 THEN '.' || c_name || '.HEIC.icloud' ELSE c_name || '.jpg' END AS name FROM customer)"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    root = F.when(k % 4 == 0, "C:\\Users\\A\\OneDrive\\x").when(k % 4 == 1, "/home/a/Dropbox/").when(k % 4 == 2, "/data/plain").otherwise("/Users/a/My Drive/x")
    name = F.when(k % 3 == 0, F.concat(F.lit("."), "c_name", F.lit(".HEIC.icloud"))).otherwise(F.concat("c_name", F.lit(".jpg")))
    return src.table(spark, sf_dir, "customer").select(k.alias("id"), root.alias("root"), name.alias("name"))


@query(f"WITH {PATHS} SELECT id, CASE WHEN name LIKE '.%.icloud' THEN substr(name, 2, len(name) - 8) END AS target, rtrim(root, '/') || '/' || name AS path, CASE id % 4 WHEN 0 THEN 'pc' WHEN 1 THEN 'dropbox' WHEN 2 THEN 'pc' ELSE 'google_disk' END AS kind FROM p")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paths(spark, sf_dir)
    return p.select("id", files.placeholder_target(F.col("name")).alias("target"), files.full_path(F.col("root"), F.col("name")).alias("path"), files.source_kind(F.col("root")).alias("kind"))


@query("""WITH c AS (SELECT c_custkey AS ordinal, '/r' || c_nationkey || CASE WHEN c_custkey % 3 > 0 THEN '/s' || (c_custkey % 50) ELSE '' END AS path FROM customer),
d AS (SELECT path, min(ordinal) AS ordinal FROM c GROUP BY path)
SELECT ordinal, path FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.ordinal < d.ordinal AND (starts_with(d.path, o.path || '/') OR starts_with(o.path, d.path || '/')))""")
def suggested_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    path = F.concat(F.lit("/r"), F.col("c_nationkey"), F.when(k % 3 > 0, F.concat(F.lit("/s"), k % 50)).otherwise(""))
    named = src.table(spark, sf_dir, "customer").select(k.alias("ordinal"), path.alias("path")).groupBy("path").agg(F.min("ordinal").alias("ordinal"))
    return files.covered_suggestions(named).select("ordinal", "path")


# Photos

ORDERS = """o AS (SELECT o_custkey AS library_id, o_orderkey AS content_hash, o_orderdate AS taken_at, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey - 1 END AS duplicate_of, o_orderkey % 4 <> 0 AS has_thumbnail,
CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS q_sharp, CASE WHEN o_orderkey % 7 > 0 THEN 0.5::DOUBLE END AS q_motion, o_orderkey % 2 = 0 AS faces_done, CASE WHEN o_orderkey % 3 > 0 THEN 'm' || (o_orderkey % 3) END AS faces_model FROM orders)"""


def _photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return src.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("library_id"), k.alias("content_hash"), F.col("o_orderdate").cast("timestamp_ntz").alias("taken_at"), F.when(k % 6 == 0, k - 1).alias("duplicate_of"), (k % 4 != 0).alias("has_thumbnail"),
        F.when(k % 5 > 0, k % 100 / 100.0).alias("q_sharp"), F.lit(0.4).alias("q_exposure"), F.lit(0.3).alias("q_color"), F.lit(0.2).alias("q_skin"), F.when(k % 7 > 0, 0.5).alias("q_motion"), F.lit(0.1).alias("q_noise"), F.lit(0.1).alias("q_cast"),
        (k % 2 == 0).alias("faces_done"), F.when(k % 3 > 0, F.concat(F.lit("m"), k % 3)).alias("faces_model"),
    )


@query(f"WITH {ORDERS} SELECT content_hash FROM o WHERE duplicate_of IS NULL AND taken_at >= '1996-01-01' AND taken_at < '1997-01-01'")
def canonical_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.canonical_year(_photos(spark, sf_dir), 1996).select("content_hash")


@query(f"WITH {ORDERS} SELECT content_hash, q_sharp IS NOT NULL AS measured, round(q_sharp + 0.4, 6)::DOUBLE AS both, q_motion IS NOT NULL AS technical FROM o")
def projected_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalog.photo_projection(_photos(spark, sf_dir))
    return p.select("content_hash", F.col("quality").isNotNull().alias("measured"), F.round(F.col("quality.q_sharp") + F.col("quality.q_exposure"), 6).alias("both"), F.col("tech").isNotNull().alias("technical"))


@query(f"""WITH {ORDERS} SELECT content_hash, 'faces' AS work FROM o WHERE has_thumbnail AND duplicate_of IS NULL AND NOT coalesce(faces_done AND faces_model IS NOT DISTINCT FROM 'm1', false)
UNION ALL SELECT content_hash, 'quality' FROM o WHERE has_thumbnail AND (q_sharp IS NULL OR q_motion IS NULL)""")
def work_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _photos(spark, sf_dir)
    some = lambda rows, work: rows.select("content_hash", F.lit(work).alias("work"))
    return some(catalog.missing_faces(p, "m1"), "faces").unionByName(some(catalog.missing_quality(p), "quality"))


LOG = """l AS (SELECT o_custkey AS library_id, o_orderkey AS id, o_orderkey AS content_hash, o_orderkey - 1 AS other_hash, CASE WHEN o_orderkey % 3 = 0 THEN 'ta_bort' ELSE 'bytt' END AS action FROM orders)"""


@query(f"""WITH {LOG}, p AS (SELECT o_custkey AS library_id, o_orderkey AS h, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS q FROM orders)
SELECT id, CASE WHEN action <> 'ta_bort' THEN a.q END AS added, CASE WHEN action = 'ta_bort' THEN a.q ELSE b.q END AS removed FROM l LEFT JOIN p a ON a.library_id = l.library_id AND a.h = content_hash LEFT JOIN p b ON b.library_id = l.library_id AND b.h = other_hash""")
def feedback_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    log = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("library_id"), k.alias("id"), k.alias("content_hash"), (k - 1).alias("other_hash"), F.when(k % 3 == 0, "ta_bort").otherwise("bytt").alias("action"))
    out = catalog.feedback_with_photos(log, _photos(spark, sf_dir))
    return out.select("id", F.col("added.q_sharp").alias("added"), F.col("removed.q_sharp").alias("removed"))


@query("""WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'confirmed' ELSE 'suggested' END AS status, 0 AS v FROM customer WHERE c_custkey % 2 = 0),
c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'confirmed' ELSE 'suggested' END AS status, 1 AS v FROM customer WHERE c_custkey % 4 < 3)
SELECT coalesce(t.id, c.id) AS id, CASE WHEN c.id IS NULL OR (t.status = 'confirmed' AND c.status <> 'confirmed') THEN t.status ELSE c.status END AS status, CASE WHEN c.id IS NULL OR (t.status = 'confirmed' AND c.status <> 'confirmed') THEN t.v ELSE c.v END AS v FROM t FULL JOIN c ON t.id = c.id""")
def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = lambda cond, m, v: src.table(spark, sf_dir, "customer").filter(cond).select(k.alias("id"), F.when(k % m == 0, "confirmed").otherwise("suggested").alias("status"), F.lit(v).alias("v"))
    return catalog.relation_upsert(rows("c_custkey % 2 = 0", 3, 0), rows("c_custkey % 4 < 3", 5, 1), ["id"])


PHASH = "p AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t, CASE WHEN event_id % 10 > 0 THEN (event_id * 2654435761) % 4294967296 END AS h, event_id % 3 = 0 AS mood, event_id % 13 = 0 AS noisy, event_id % 17 = 0 AS cut FROM events)"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return src.timeline(spark, sf_dir).select(k, "user_id", "t", F.when(k % 10 > 0, k * 2654435761 % 4294967296).alias("h"), (k % 3 == 0).alias("mood"), F.when(k % 13 == 0, "blurry").alias("noise"), F.when(k % 17 == 0, "ikke_med").alias("decision"))


@query(f"WITH {PHASH} SELECT event_id, h IS NOT NULL AS candidate, NOT noisy AND NOT cut AS usable FROM p")
def usable_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _hashed(spark, sf_dir)
    fine = draft.usable(p).select("event_id", F.lit(True).alias("usable"))
    return p.join(fine, "event_id", "left").select("event_id", F.col("h").isNotNull().alias("candidate"), F.coalesce("usable", F.lit(False)).alias("usable"))


@query("""WITH p AS (SELECT 'a' AS library_id, event_id AS id, CASE WHEN event_id % 9 > 0 THEN (event_id * 2654435761) % 1048576 END AS h, CASE WHEN event_id % 3 > 0 THEN epoch_us(ts) // 1000000 // 10000000 END AS x FROM events), d AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h)) AS d, abs(a.x - b.x) AS s FROM p a JOIN p b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 4)
SELECT a, b FROM d WHERE CASE WHEN s IS NULL THEN d <= 3 ELSE d <= 4 AND s <= 2 END""")
def photo_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    p = src.timeline(spark, sf_dir).select(F.lit("a").alias("library_id"), k.alias("id"), F.when(k % 9 > 0, k * 2654435761 % 1048576).alias("phash"), F.when(k % 3 > 0, F.floor(F.col("t") / 10_000_000)).alias("exif_t"))
    return dedup.photo_duplicates(p, 4, 2, 3).select("a", "b")


# Faces and persons

#: Line items by their order and number, which some share: the smallest values of each.
LINES = "u AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL)"
FACES = LINES + """, c AS (SELECT l_suppkey AS library_id, l_orderkey * 10 + l_linenumber AS id, l_orderkey AS content_hash, l_quantity / 100 AS h, l_extendedprice / 100000 AS sharpness, CASE WHEN l_partkey % 7 = 0 THEN l_partkey % 50 END AS person_id,
CASE WHEN l_partkey % 11 = 0 THEN 999999 WHEN l_partkey % 7 = 0 THEN l_partkey % 50 ELSE 1000000 + l_partkey % 20 END AS grp, l_partkey % 5 = 0 AS confirmed, l_partkey % 11 = 0 AS ignored FROM u)"""


#: Lines of orders that a task sorts at once.
LINES_A_PART = 200_000


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
    rows = src.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *values)
    # What follows by order needs no other shuffle, and its sorts and maps hold so many rows each, however large the table.
    return dealt(rows, ["l_orderkey"], rows.count(), LINES_A_PART).groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in values))


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    return _lines(spark, sf_dir).select(
        F.col("l_suppkey").alias("library_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("content_hash"), (F.col("l_quantity") / 100).alias("h"), (F.col("l_extendedprice") / 100_000).alias("sharpness"),
        F.when(p % 7 == 0, p % 50).alias("person_id"), F.when(p % 11 == 0, 999_999).when(p % 7 == 0, p % 50).otherwise(1_000_000 + p % 20).cast("long").alias("grp"), (p % 5 == 0).alias("confirmed"), (p % 11 == 0).alias("ignored"),
    )


STATE = ["id", "person_id", "grp", "confirmed", "ignored"]


@query(f"""WITH {FACES}, o AS (SELECT o_orderkey AS k, o_orderdate AS d FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01') SELECT date_part('month', d)::INT AS month, count(*) AS faces FROM c JOIN o ON k = content_hash GROUP BY 1""")
def faces_in_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = src.table(spark, sf_dir, "orders").select(F.lit("a").alias("library_id"), F.col("o_orderkey").alias("content_hash"), F.col("o_orderdate").cast("timestamp_ntz").alias("taken_at"))
    held = catalog.faces_in_year(_faces(spark, sf_dir).withColumn("library_id", F.lit("a")), photos, 1995)
    return held.groupBy(F.month("taken_at").alias("month")).agg(F.count("*").alias("faces"))


@query(f"WITH {FACES} SELECT id, c_name AS name FROM c LEFT JOIN customer ON c_custkey = person_id AND c_custkey % 2 = 0")
def named_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = src.table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.lit("a").alias("library_id"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return catalog.with_names(_faces(spark, sf_dir).withColumn("library_id", F.lit("a")), persons).select("id", "name")


@query(f"""WITH {FACES} SELECT o_orderkey AS content_hash, count(id) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM orders LEFT JOIN c ON content_hash = o_orderkey WHERE o_orderkey % 2 = 0 GROUP BY 1""")
def scanned_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = src.table(spark, sf_dir, "orders").select(F.lit("a").alias("library_id"), F.col("o_orderkey").alias("content_hash"), (F.col("o_orderkey") % 2 == 0).alias("faces_done"))
    out = catalog.faces_of_photos(photos, _faces(spark, sf_dir).withColumn("library_id", F.lit("a")))
    ids = F.when(F.size("faces") > 0, F.array_join(F.transform("faces", lambda x: x["id"]), ","))
    return out.select("content_hash", F.size("faces").cast("long").alias("n"), ids.alias("ids"))


@query(f"""WITH {FACES}, n AS (SELECT *, CASE WHEN id % 4 = 0 THEN CASE WHEN id % 3 = 0 THEN 17 ELSE 1000050 END END AS g FROM c)
SELECT id, CASE WHEN g IS NULL OR confirmed THEN person_id ELSE CASE WHEN g < 1000000 THEN g END END AS person_id, coalesce(g, grp) AS grp, confirmed, ignored FROM n""")
def groups_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _faces(spark, sf_dir)
    new = faces.filter("id % 4 = 0").select("library_id", "id", F.when(F.col("id") % 3 == 0, 17).otherwise(1_000_050).cast("long").alias("grp"))
    return catalog.set_groups(faces, new).select(*STATE)


@query(f"""WITH {FACES} SELECT id, CASE WHEN grp = 1000005 THEN NULL WHEN grp = 1000003 THEN 42 ELSE person_id END AS person_id, CASE grp WHEN 1000003 THEN 42 WHEN 1000005 THEN 999999 ELSE grp END AS grp, confirmed OR grp = 1000003 AS confirmed, ignored OR grp = 1000005 AS ignored FROM c""")
def groups_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.ignore_group(catalog.name_group(_faces(spark, sf_dir), 1_000_003, 42), 1_000_005).select(*STATE)


@query(f"""WITH {FACES}, x AS (SELECT library_id, greatest(1000000, max(grp) FILTER (grp <> 999999) + 1) AS nxt FROM c GROUP BY 1),
s AS (SELECT c.*, nxt, grp = 1000007 AND id % 2 = 0 AS gone, grp = 1000007 AS here FROM c JOIN x USING (library_id))
SELECT id, CASE WHEN NOT gone THEN person_id END AS person_id, CASE WHEN gone THEN coalesce(nxt, 1000000) ELSE grp END AS grp, confirmed OR gone OR (here AND NOT ignored) AS confirmed, ignored AND NOT gone AS ignored FROM s""")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _faces(spark, sf_dir)
    return catalog.split_group(faces, 1_000_007, faces.filter("id % 2 = 0")).select(*STATE)


@query(f"""WITH {FACES}, m AS (SELECT *, id % 9 = 0 AS hit, CASE WHEN id % 2 = 0 THEN 8 END AS p FROM c)
SELECT id, CASE WHEN hit THEN p ELSE person_id END AS person_id, CASE WHEN hit THEN coalesce(p, 999999) ELSE grp END AS grp, confirmed OR hit AS confirmed, CASE WHEN hit THEN p IS NULL ELSE ignored END AS ignored FROM m""")
def faces_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _faces(spark, sf_dir)
    moves = faces.filter("id % 9 = 0").select("library_id", "id", F.when(F.col("id") % 2 == 0, F.lit(8).cast("long")).alias("to_person"))
    return catalog.move_face(faces, moves).select(*STATE)


@query(f"WITH {FACES} SELECT id, CASE WHEN ignored THEN 999999 WHEN confirmed THEN coalesce(person_id, grp) END AS label FROM c")
def fixed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _faces(spark, sf_dir).select("id", f.fixed_label(c("ignored"), c("confirmed"), c("person_id"), c("grp")).alias("label"))


@query("""SELECT o_orderkey AS id, count(*) AS faces, bool_or(l_quantity * 2 < 1000 * 0.06) AS has_small, greatest(o_orderkey % 1500, 1000) > 768 AND (count(*) >= 8 OR bool_or(l_quantity * 2 < 1000 * 0.06)) AS wants_tiles
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def tile_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = src.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_quantity") * 2).alias("h"))
    photos = found.select("id").distinct().select("id", (F.col("id") % 1500).alias("width"), F.lit(1000).alias("height"))
    return people.wants_tiles(photos, found, ["id"]).select("id", "faces", "has_small", "wants_tiles")


@query("""WITH n AS (SELECT l_orderkey, l_partkey % 12 AS person, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, person, n, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, person)::INT AS place FROM n""")
def person_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.table(spark, sf_dir, "lineitem").select("l_orderkey", F.array(F.col("l_partkey") % 12).alias("persons"))
    return people.person_counts(rows, ["l_orderkey"])


@query("""WITH x AS (SELECT l_orderkey, CASE WHEN l_partkey % 3 = 0 THEN 1000000 + l_partkey % 5 ELSE l_partkey % 8 END AS p FROM lineitem) SELECT l_orderkey, coalesce(string_agg(DISTINCT p::VARCHAR, ',' ORDER BY p::VARCHAR) FILTER (p < 1000000), '') AS persons FROM x GROUP BY 1""")
def distinct_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    rows = src.table(spark, sf_dir, "lineitem").select("l_orderkey", F.array(F.when(p % 3 == 0, 1_000_000 + p % 5).otherwise(p % 8)).alias("persons"))
    return groups.distinct_persons(rows, ["l_orderkey"]).select("l_orderkey", F.array_join("persons", ",").alias("persons"))


@query("""WITH s AS (SELECT o_custkey AS p, count(*) AS have FROM orders GROUP BY 1) SELECT c_custkey AS person_id, CASE c_custkey % 3 WHEN 0 THEN 6 WHEN 1 THEN 2 ELSE 1 END AS want, greatest(CASE c_custkey % 3 WHEN 0 THEN 6 WHEN 1 THEN 2 ELSE 1 END - coalesce(have, 0), 0) AS missing FROM customer LEFT JOIN s ON p = c_custkey""")
def coverage_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    persons = src.table(spark, sf_dir, "customer").select(F.lit("a").alias("library_id"), k.alias("id"), F.when(k % 3 == 0, "barn").when(k % 3 == 1, "besteforeldre").otherwise("venn").alias("role"))
    shown = src.table(spark, sf_dir, "orders").select(F.lit("a").alias("library_id"), F.col("o_custkey").alias("person_id"))
    return people.coverage_deficit(shown, persons).select("person_id", "want", "missing")


# Choices, pages, reports


@query("""SELECT o_custkey AS library_id, bool_or(o_orderkey % 3 = 0 AND o_orderkey % 4 = 0) AS merged, bool_or(o_orderkey % 3 = 0 AND o_orderkey % 4 = 1) AS own_story, bool_or(o_orderkey % 3 = 0 AND o_orderkey % 4 = 2) AS trip_yes, bool_or(o_orderkey % 3 = 0 AND o_orderkey % 4 = 3) AS trip_no FROM orders GROUP BY 1""")
def hint_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("library_id"), k.alias("id"), F.lit(0).alias("grp"))
    kinds = F.get(F.array(*map(F.lit, ("merged", "own_story", "trip_yes", "trip_no"))), (F.col("id") % 4).cast("int"))
    return groups.flags_of_hints(rows, rows.filter("id % 3 = 0").select("library_id", "id", kinds.alias("kind")), ["library_id"], "id").drop("grp")


@query(f"""WITH {LINES}, p AS (SELECT l_orderkey AS page, CASE WHEN l_orderkey % 2 = 0 THEN 'locked' ELSE 'own_story' END AS kind, list(sha256(l_partkey::VARCHAR) ORDER BY l_linenumber) FILTER (l_partkey % 3 > 0) AS good FROM u GROUP BY ALL)
SELECT page, kind, coalesce(len(good), 0) AS n, coalesce(good[1], '') AS first FROM p WHERE kind <> 'locked' OR len(good) > 0""")
def choice_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("l_partkey") % 3 > 0, F.upper(F.sha2(F.col("l_partkey").cast("string"), 256))).otherwise(F.lit("no hash"))
    pages = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("page")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", name.alias("h")))), lambda x: x["h"]).alias("photos"))
    held = pages.select(F.lit("a").alias("library_id"), F.when(F.col("page") % 2 == 0, "locked").otherwise("own_story").alias("kind"), "page", "photos")
    out = groups.hints_of_choices(held)
    return out.select("page", "kind", F.size("photos").cast("long").alias("n"), F.coalesce(F.get("photos", 0), F.lit("")).alias("first"))


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_partkey % 3 = 1) DESC, (l_partkey % 2 = 0) DESC, l_linenumber)::INT AS place FROM u")
def frame_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 3).alias("page"), (F.col("l_partkey") % 2 == 0).alias("included"))
    return groups.frame_candidates(rows, ["l_orderkey"], F.lit(1), "l_linenumber").select("l_orderkey", "l_linenumber", "place")


@query(f"""WITH {LINES}, p AS (SELECT l_orderkey, l_linenumber % 3 AS page, list(l_linenumber ORDER BY l_linenumber) AS x FROM u GROUP BY ALL), q AS (SELECT l_orderkey, page, CASE WHEN page = 1 THEN [1, 2] ELSE list_filter(x, lambda i : i NOT IN (1, 2)) END AS x FROM p)
SELECT l_orderkey, page, array_to_string(x, ',') AS photos FROM q WHERE len(x) > 0""")
def filled_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _lines(spark, sf_dir).groupBy("l_orderkey", (F.col("l_linenumber") % 3).alias("page")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("photos"))
    return groups.fill_frame(pages, ["l_orderkey"], F.lit(1), F.array(F.lit(1), F.lit(2))).select("l_orderkey", "page", F.array_join("photos", ",").alias("photos"))


@query("""WITH y AS (SELECT c_nationkey AS library_id, string_agg(c_name, ', ' ORDER BY c_custkey) AS all_, count(*) AS n, max_by(c_name, c_custkey) AS last FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1)
SELECT n_nationkey AS library_id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '2020' END AS title, CASE WHEN n_nationkey % 3 = 0 THEN 'ours' WHEN n IS NULL THEN '' WHEN n = 1 THEN all_ ELSE substr(all_, 1, len(all_) - len(last) - 2) || ' and ' || last END AS names FROM nation LEFT JOIN y ON library_id = n_nationkey""")
def album_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    albums = src.table(spark, sf_dir, "nation").select(k.alias("library_id"), F.lit(2020).alias("year"), F.when(k % 2 == 0, F.col("n_name")).alias("title"), F.when(k % 3 == 0, "ours").alias("names"))
    persons = src.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("library_id"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "barn").otherwise("venn").alias("role"))
    return groups.album_text(albums, persons, ["library_id"]).select("library_id", "title", "names")


PLACED = "p AS (SELECT l_suppkey AS library_id, l_partkey AS h, l_orderkey AS page, l_extendedprice / 100 AS ppi, l_quantity / 50 AS share FROM lineitem)"
ISSUES = f"""{PLACED}, i AS (SELECT *, CASE WHEN h % 10 = 0 THEN 'missing_file' WHEN ppi < 150 THEN 'low_resolution' END AS issue FROM p),
b AS (SELECT DISTINCT library_id, h FROM i WHERE issue IS NOT NULL)"""


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    placed = src.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("library_id"), F.col("l_partkey").alias("content_hash"), F.col("l_orderkey").alias("page"), (F.col("l_extendedprice") / 100).alias("ppi"), (F.col("l_quantity") / 50).alias("share"))
    keys = placed.select("library_id", "content_hash").distinct()
    return placed, layout.print_checks(placed, keys.filter("content_hash % 10 > 0"), keys.filter("content_hash % 4 = 0"))


@query(f"""WITH {ISSUES} SELECT library_id, page, issue, count(*) AS n FROM (SELECT library_id, page, issue FROM i WHERE issue IS NOT NULL
UNION ALL SELECT library_id, page, 'blurry_and_large' FROM p WHERE share >= 0.5 AND h % 4 = 0 AND (library_id, h) NOT IN (SELECT library_id, h FROM b)) GROUP BY ALL""")
def print_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir)[1].groupBy("library_id", "page", "issue").agg(F.count("*").alias("n"))


@query(f"""WITH {ISSUES} SELECT library_id, count(DISTINCT page) AS pages, count(*) AS photos, count(*) FILTER (issue = 'missing_file') AS missing, count(*) FILTER (issue = 'low_resolution') AS low_resolution FROM i GROUP BY 1""")
def print_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.print_report(*_placed(spark, sf_dir))


@query("SELECT l_orderkey, count(*) FILTER (l_quantity > 25) AS included, ceil(count(*) FILTER (l_quantity > 25) / 4)::BIGINT AS pages FROM lineitem GROUP BY 1")
def local_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.local_recount(src.table(spark, sf_dir, "lineitem").withColumn("included", F.col("l_quantity") > 25), ["l_orderkey"])


@query("""WITH s AS (SELECT l_orderkey AS id, l_linenumber AS n, 0.5 + l_partkey % 10 / 10.0 AS r, 1.0 + l_linenumber % 3 / 10.0 AS fr, l_suppkey % 2 = 0 AS cover, CASE WHEN l_partkey % 3 > 0 THEN 50 + l_partkey % 500 END AS zoom FROM lineitem),
t AS (SELECT *, CASE WHEN CASE WHEN cover THEN r > fr ELSE r < fr END THEN 100.0 ELSE fr * 100.0 / r END AS h, greatest(100, least(400, coalesce(zoom, 100))) / 100.0 AS z FROM s)
SELECT id, n, round(h * r * z, 4)::DOUBLE AS w, round(h * z, 4)::DOUBLE AS h FROM t""")
def drawn_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    ratio, frame = 0.5 + c("l_partkey") % 10 / 10.0, 1.0 + c("l_linenumber") % 3 / 10.0
    size = layout.drawn_size(ratio, frame * 100.0, F.lit(100.0), F.when(c("l_partkey") % 3 > 0, 50 + c("l_partkey") % 500), c("l_suppkey") % 2 == 0)
    return src.table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("id"), c("l_linenumber").alias("n"), F.round(size["w"], 4).cast("double").alias("w"), F.round(size["h"], 4).cast("double").alias("h"))


@query(f"""WITH {LINES}, k AS (SELECT l_orderkey AS e, l_linenumber AS photo, l_partkey % 4 = 0 AS locked, l_linenumber % 3 AS page FROM u), f AS (SELECT e, locked, page, min(photo) AS f FROM k GROUP BY ALL),
n AS (SELECT e, locked, page, row_number() OVER (PARTITION BY e ORDER BY f, NOT locked, page)::INT AS number FROM f) SELECT e, number, locked, photo FROM k JOIN n USING (e, locked, page)""")
def assembled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("e"), F.col("l_linenumber").alias("photo"), (F.col("l_partkey") % 4 == 0).alias("is"), (F.col("l_linenumber") % 3).alias("page"), F.col("l_linenumber").alias("pos"))
    return layout.assemble_pages(rows.filter("is").drop("is"), rows.drop("is"), ["e"]).select("e", "number", "locked", "photo")


@query(f"""WITH {LINES}, k AS (SELECT l_orderkey AS e, l_linenumber AS photo, l_quantity AS skin, l_partkey % 3 > 0 AS people, l_partkey % 9 = 0 AS face FROM u), a AS (SELECT e FROM k WHERE face GROUP BY e HAVING count(*) >= 2),
s AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY skin DESC, photo) AS p, count(*) OVER (PARTITION BY e) AS n FROM k WHERE people AND e NOT IN (SELECT e FROM a)),
z AS (SELECT e, photo FROM k WHERE face AND e IN (SELECT e FROM a) UNION ALL SELECT e, photo FROM s WHERE p <= 9 AND n >= 3) SELECT e, photo, (row_number() OVER (PARTITION BY e ORDER BY photo) - 1)::INT AS pos FROM z""")
def portrait_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("e"), F.col("l_linenumber").alias("photo"), F.col("l_quantity").alias("skin"), (F.col("l_partkey") % 3 > 0).alias("people"), (F.col("l_partkey") % 9 == 0).alias("face"))
    return layout.portrait_page(rows.drop("face"), rows.filter("face").select("e", "photo"), ["e"])


@query("""SELECT event_id, CASE WHEN event_id % 7 IN (3, 4) THEN 'must' WHEN event_id % 7 < 5 THEN 'never' WHEN event_id % 5 = 2 THEN 'must' WHEN event_id % 5 = 1 THEN 'never' WHEN event_id % 2 = 0 AND value > 80 THEN 'free' WHEN event_id % 3 = 0 THEN 'never' ELSE 'free' END AS policy FROM events""")
def page_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    decision = F.when(k % 5 == 0, "opp").when(k % 5 == 1, "demp").when(k % 5 == 2, "fremhev")
    said = layout.page_policy(F.when(k % 7 < 5, k % 7), decision, k % 2 == 0, F.col("value") > 80, k % 3 != 0)
    return src.table(spark, sf_dir, "events").select("event_id", said.alias("policy"))


@query("""WITH d AS (SELECT event_id AS h, user_id AS u, value > 60 AS inc, event_type AS r, event_id % 29 = 0 AS lk, event_id % 31 = 0 AS cv FROM events) SELECT h, inc OR lk OR cv AS included, CASE WHEN lk THEN 'page_you_are_pleased_with' WHEN cv THEN 'all_are_shown' ELSE r END AS reason, count(*) FILTER (inc OR lk OR cv) OVER (PARTITION BY u) AS event_included FROM d""")
def outer_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "events").select(F.col("user_id").alias("library_id"), F.col("event_id").alias("content_hash"), F.lit(0).alias("grp"), (F.col("value") > 60).alias("included"), F.col("event_type").alias("reason"), F.lit(None).cast("long").alias("related"))
    out = draft.outer_reasons(e, e.filter("content_hash % 29 = 0"), e.filter("content_hash % 31 = 0"))
    return out.select(F.col("content_hash").alias("h"), "included", "reason", "event_included")


@query("SELECT o_orderkey AS content_hash, l_quantity AS width, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 1 END, 0) AS rotation, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 150 END, 100) AS zoom FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 AND l_partkey % 2 = 0")
def enriched_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = src.table(spark, sf_dir, "orders").select(F.lit("a").alias("library_id"), F.col("o_orderkey").alias("content_hash"))
    size = src.table(spark, sf_dir, "lineitem").filter("l_linenumber = 1 and l_partkey % 2 = 0").select(F.lit("a").alias("library_id"), F.col("l_orderkey").alias("content_hash"), F.col("l_quantity").alias("width"), F.lit(1.0).alias("height"), F.lit(True).alias("has_thumbnail"))
    looks = o.filter("content_hash % 3 = 0").withColumn("rotation", F.lit(1)).withColumn("zoom", F.lit(150))
    return catalog.enriched(o, size, looks).select("content_hash", "width", "rotation", "zoom")


@query("""WITH c AS (SELECT c_nationkey AS k, c_custkey AS h, c_custkey % 3 > 0 AS people, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 3 > 0 ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer), d AS (SELECT * FROM c WHERE place <= 3),
f AS (SELECT k, CASE WHEN k % 4 = 0 THEN 7 ELSE min_by(h, struct_pack(a := NOT people, b := place)) END AS front FROM d GROUP BY k) SELECT f.k, front, min_by(h, struct_pack(a := people, b := place)) FILTER (h <> front) AS back FROM d JOIN f USING (k) GROUP BY ALL""")
def cover_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = src.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("h"), (F.col("c_custkey") % 3 > 0).alias("people"), "c_acctbal")
    held = catalog.top_per_key(c, ["k", "people"], [F.desc("c_acctbal"), "h"], 3)
    choices = c.select("k").distinct().filter("k % 4 = 0").select("k", F.lit(7).cast("long").alias("front"), F.lit(None).cast("long").alias("back"))
    return select.cover_pair(held, ["k"], choices, "people", "h")


# Evaluation

GOLD = "g AS (SELECT quality::VARCHAR AS name, 2000 + toxic AS year, doc_id, doc_id % 7 AS page, CASE WHEN doc_id % 4 > 0 THEN 'sure' ELSE 'unsure' END AS status FROM labels)"


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return src.table(spark, sf_dir, "labels").select(
        F.lit("a").alias("library_id"), F.col("quality").cast("string").alias("name"), (2000 + F.col("toxic")).alias("year"), F.unhex(F.lpad(F.hex("doc_id"), 16, "0")).alias("content_hash"),
        (k % 7).cast("int").alias("page"), k.cast("int").alias("idx"), (k % 9).cast("int").alias("distance"), F.when(k % 4 > 0, "sure").otherwise("unsure").alias("status"),
    )


@query(f"WITH {GOLD} SELECT name, year, count(*) AS images, round(count(*) FILTER (status = 'sure') / count(*), 6)::DOUBLE AS match_rate FROM g GROUP BY ALL")
def gold_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gold_listing(_gold(spark, sf_dir)).select("name", "year", "images", F.round("match_rate", 6).cast("double").alias("match_rate"))


@query(f"WITH {GOLD} SELECT name, year, page::INT AS page, doc_id::INT AS idx, lpad(upper(to_hex(doc_id)), 16, '0') AS hash, status FROM g")
def gold_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = evaluate.gold_from_json(evaluate.gold_to_json(_gold(spark, sf_dir)))
    return back.select("name", "year", "page", "idx", F.hex("content_hash").alias("hash"), "status")


@query("SELECT l_partkey AS image, count(DISTINCT l_orderkey) AS pages FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 3")
def decorations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.decorations(src.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("image"), F.col("l_orderkey").alias("page")), [])


@query("SELECT l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS first_image FROM lineitem WHERE l_quantity <= 8 GROUP BY 1")
def gold_from_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = src.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("best"), F.when(F.col("l_quantity") <= 8, "sure").otherwise("unsure").alias("status"))
    return evaluate.gold_from_matches(m)


@query("SELECT '| all | ' || printf('%.2f', round(count(*)::DOUBLE, 2)) || ' | ' || printf('%.2f', count(DISTINCT l_partkey)::DOUBLE) || ' |' AS row FROM lineitem")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = src.table(spark, sf_dir, "lineitem").agg(F.count("*").cast("double").alias("n"), F.count_distinct("l_partkey").cast("double").alias("parts"))
    return evaluate.report_row(n, "all")


# Scalar functions


@query("""SELECT o_orderkey AS id, epoch_us(o_orderdate) // 1000000 - CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 25 - 12) * 3600 ELSE 0 END AS utc, CASE WHEN o_orderkey % 2 = 0 THEN epoch_us(o_orderdate) // 1000000 - CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 25 - 12) * 3600 ELSE 0 END END AS exif FROM orders""")
def photo_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = src.table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("t"), F.when(k % 3 > 0, (k % 25 - 12) * 60).alias("offset"), F.when(k % 2 == 0, "exif").otherwise("mtime").alias("source"))
    return o.select("id", f.utc_seconds("t", "offset").alias("utc"), f.exif_time("t", "offset", "source").alias("exif"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 3 AS k, o_orderkey % 4 = 0 AS old, epoch_us(o_orderdate) // 1000000 AS t, o_orderdate AS d FROM orders)
SELECT id, CASE WHEN k = 0 THEN 'exif' WHEN k = 1 THEN 'filename' WHEN NOT old THEN 'mtime' END AS source, CASE WHEN k = 0 THEN t WHEN k = 1 THEN epoch_us(date_trunc('day', d)) // 1000000 WHEN NOT old THEN t + 60 END AS t FROM r""")
def resolved_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    o = src.table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("timestamp_ntz"))
    name = F.when(k == 1, F.concat(F.lit("IMG-"), F.date_format("d", "yyyyMMdd"), F.lit("-WA0001.jpg"))).otherwise(F.lit("DSC01234.JPG"))
    modified = F.when(F.col("o_orderkey") % 4 == 0, 0).otherwise(f.local_seconds("d") + 60)
    got = o.select(F.col("o_orderkey").alias("id"), f.resolve_date(F.when(k == 0, F.col("d")), name, modified).alias("r")).select("id", F.col("r.date_source").alias("source"), F.col("r.taken_at").alias("at"))
    return got.select("id", "source", f.local_seconds("at").alias("t"))


@query("""WITH r AS (SELECT o_orderkey AS id, (o_orderkey % 20)::INT AS h, (o_orderkey % 75)::INT AS m, o_orderkey % 2 = 0 AS minus FROM orders) SELECT id, CASE WHEN h <= 14 AND m < 60 THEN ((h * 60 + m) * CASE WHEN minus THEN -1 ELSE 1 END)::SMALLINT END AS minutes, round(CASE WHEN minus THEN -1 ELSE 1 END * (h + m / 60 + 30 / 3600), 9)::DOUBLE AS degrees FROM r""")
def offsets_and_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    sign = F.when(k % 2 == 0, "-").otherwise("+")
    deg = f.dms_degrees((k % 20).cast("double"), (k % 75).cast("double"), F.lit(30.0), F.when(k % 2 == 0, "s").otherwise("N"))
    return src.table(spark, sf_dir, "orders").select(k.alias("id"), f.utc_offset(F.concat(sign, two(k % 20), F.lit(":"), two(k % 75))).alias("minutes"), F.round(deg, 9).alias("degrees"))


@query("""SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_suppkey <= 2 THEN 2 WHEN l_suppkey = 3 THEN 3 WHEN l_suppkey = 4 THEN 2 WHEN l_suppkey <= 9 THEN 3 ELSE 4 END AS columns, round(20.0 * l_partkey / l_quantity)::INT AS aspect,
round(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity / l_partkey ELSE l_partkey / l_quantity END, 6)::DOUBLE AS ratio, greatest(-1, least(4, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 6 - 1 WHEN l_partkey % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE -1 END))::INT AS size FROM lineitem WHERE l_partkey > 0""")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col, F.col("l_partkey")
    size = f.next_size(F.when(k % 3 > 0, k % 6 - 1), k % 2 == 0, F.when(c("l_suppkey") % 2 == 0, 1).otherwise(-1))
    return src.table(spark, sf_dir, "lineitem").filter("l_partkey > 0").select(
        c("l_orderkey").alias("id"), c("l_linenumber").alias("n"), f.grid_columns(c("l_suppkey")).alias("columns"), f.aspect_key(k, c("l_quantity")).alias("aspect"),
        F.round(f.aspect_ratio(k, c("l_quantity"), c("l_linenumber")), 6).alias("ratio"), size.alias("size"),
    )


@query("""SELECT event_id, round((0.5 * value + 0.3 * 10 + 0.4 * 20) / 1.2, 6)::DOUBLE AS quality FROM events""")
def learned_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = f.learned_quality(F.lit(0.5), F.lit(0.3), F.lit(0.4), F.col("value"), F.lit(10.0), F.lit(20.0))
    return src.table(spark, sf_dir, "events").select("event_id", F.round(q, 6).alias("quality"))


@query("""WITH c AS (SELECT o_custkey AS k, min(o_orderdate) AS a, max(o_orderdate) AS b, list(o_orderpriority ORDER BY o_orderkey) AS names FROM orders GROUP BY 1)
SELECT k, CASE WHEN k % 2 = 0 THEN strftime(a, '%Y-%m') WHEN a::DATE = b::DATE THEN strftime(a, '%Y-%m-%d') ELSE strftime(a, '%Y-%m-%d') || ' - ' || strftime(b, '%Y-%m-%d') END AS title,
CASE WHEN len(names) = 1 THEN names[1] ELSE array_to_string(names[1:len(names) - 1], ', ') || ' and ' || names[len(names)] END AS names FROM c""")
def story_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = src.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("names"))
    title: Column = F.when(F.col("k") % 2 == 0, F.date_format("a", "yyyy-MM")).otherwise(f.date_span(F.col("a"), F.col("b")))
    return c.select("k", title.alias("title"), f.name_line(F.col("names")).alias("names"))


@query("""SELECT c_custkey AS id, 'A%20%26%20' || replace(c_name, '#', '%23') || '%0D%0Ax%0D%0Ay%2A~' AS said FROM customer""")
def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), f.percent_encoded(F.concat(F.lit("A & "), "c_name", F.lit("\nx\r\ny*~"))).alias("said"))


@query("""WITH w AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY 1) SELECT user_id, v AS choices_left, c AS answers FROM w""")
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "events").filter("event_type in ('view', 'click')").withColumn("reason", F.when(F.col("event_type") == "click", "uskarpt"))
    got = learn.feedback_summary(e, ["user_id"])
    all_ = src.table(spark, sf_dir, "events").select("user_id").distinct().join(got, "user_id", "left").fillna(0, ["choices", "answers"])
    return all_.select("user_id", (F.col("choices") - F.col("answers")).alias("choices_left"), "answers")
