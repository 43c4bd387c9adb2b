"""Queries of faces, copies, scans and lessons that rest on folds: boxes carried over, suppression, portraits, the whole learning log.

Line items stand for faces (an order is a photo), documents for photos with a hash, customers for files, events for answers. The folds
are recursive in SQL: step k takes the k-th row of its group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.operators import dedup, learn, people, typeset
from storyline.plans.album_queries import LINES, _lines
from storyline.plans.queries import SIMHASH, query
from storyline.shared import spread
from storyline.sources import files
from storyline.sources import tables as src

BOXES = f"""{LINES}, b AS (SELECT l_orderkey AS e, l_orderkey * 10 + l_linenumber AS id, (l_partkey % 20) / 40.0::DOUBLE AS x, (l_suppkey % 10) / 40.0::DOUBLE AS y,
  0.2::DOUBLE + (l_partkey % 7) / 20.0::DOUBLE AS w, 0.2::DOUBLE + l_linenumber / 40.0::DOUBLE AS h, l_extendedprice::DOUBLE AS score, l_partkey % 3 = 0 AS confirmed, l_partkey % 5 = 0 AS ignored, l_partkey % 50 AS grp FROM u)"""
BOTH = "(greatest(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x), 0.0) * greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), 0.0))"
IOU = f"({BOTH} / ({{a}}.w * {{a}}.h + {{b}}.w * {{b}}.h - {BOTH}))"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = F.col("l_partkey"), F.col("l_linenumber")
    box = F.struct(((p % 20) / F.lit(40.0)).alias("x"), ((F.col("l_suppkey") % 10) / F.lit(40.0)).alias("y"), (0.2 + (p % 7) / F.lit(20.0)).alias("w"), (0.2 + k / F.lit(40.0)).alias("h"))
    return _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("e"), (F.col("l_orderkey") * 10 + k).cast("long").alias("id"), box.alias("box"), F.col("l_extendedprice").cast("double").alias("score"),
        (p % 50).alias("grp"), F.when(p % 3 == 0, p % 50).alias("person_id"), (p % 3 == 0).alias("confirmed"), (p % 5 == 0).alias("ignored"),
    )


def _moved(boxes: DataFrame) -> DataFrame:
    b = F.col("box")
    return boxes.select("e", (-F.col("id")).alias("id"), F.struct((b["x"] + 0.01).alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h")).alias("box"))


#: What is carried from old boxes (some) to new ones: the pairs by overlap, each taken if both ends are free.
CARRIED = f"""m AS (SELECT e, -id AS id, x + 0.01::DOUBLE AS x, y, w, h FROM b WHERE {{photos}}),
s AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY far, n, o) AS k FROM (SELECT m.e, m.id AS n, b.id AS o, -{IOU.format(a="m", b="b")} AS far FROM m JOIN b ON m.e = b.e WHERE {{old}}) WHERE far <= -0.4),
f AS (SELECT DISTINCT e, 0::BIGINT AS k, []::BIGINT[] AS ns, []::BIGINT[] AS os FROM s UNION ALL
  SELECT f.e, s.k, CASE WHEN list_contains(ns, s.n) OR list_contains(os, s.o) THEN ns ELSE list_append(ns, s.n) END, CASE WHEN list_contains(ns, s.n) OR list_contains(os, s.o) THEN os ELSE list_append(os, s.o) END FROM f JOIN s ON s.e = f.e AND s.k = f.k + 1),
c AS (SELECT e, unnest(ns) AS new_id, unnest(os) AS old_id FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY e ORDER BY k DESC) = 1))"""


@query(f"WITH RECURSIVE {BOXES}, {CARRIED.format(photos='true', old='b.grp % 2 = 0')} SELECT e, new_id, old_id FROM c")
def boxes_carried_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    return people.carry_over(boxes.filter("grp % 2 = 0"), _moved(boxes), ["e"])


@query(f"""WITH RECURSIVE {BOXES}, {CARRIED.format(photos='e % 3 = 0', old='b.confirmed OR b.ignored')}
SELECT b.e, b.id, b.grp, CASE WHEN b.confirmed THEN b.grp END AS person_id, b.confirmed, b.ignored FROM b WHERE e % 3 > 0
UNION ALL SELECT m.e, m.id, o.grp, CASE WHEN o.confirmed THEN o.grp END, coalesce(o.confirmed, false), coalesce(o.ignored, false) FROM m LEFT JOIN c ON c.new_id = m.id LEFT JOIN b o ON o.id = c.old_id""")
def faces_put_anew(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _boxes(spark, sf_dir).drop("score")
    return people.put_faces(faces, _moved(faces.filter("e % 3 = 0")), ["e"]).drop("box")


@query(f"""WITH RECURSIVE {BOXES}, s AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY score DESC, id) AS k FROM b),
f AS (SELECT DISTINCT e, 0::BIGINT AS k, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[] AS held FROM s UNION ALL
  SELECT f.e, s.k, CASE WHEN len([p FOR p IN held IF {IOU.format(a="p", b="s")} > 0.3]) > 0 THEN held ELSE list_append(held, {{'id': s.id, 'x': s.x, 'y': s.y, 'w': s.w, 'h': s.h}}) END FROM f JOIN s ON s.e = f.e AND s.k = f.k + 1)
SELECT e, p.id AS id FROM (SELECT e, unnest(held) AS p FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY e ORDER BY k DESC) = 1))""")
def tiles_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of the whole photo and of its tiles, together."""
    boxes = _boxes(spark, sf_dir)
    both = boxes.filter("id % 2 = 0").unionByName(boxes.filter("id % 2 = 1"))
    return people.suppress(both, ["e"]).select("e", "id")


@query(f"""WITH RECURSIVE {LINES}, r AS (SELECT l_suppkey AS e, l_orderkey AS photo, l_partkey % 12 AS person, -(l_quantity * CASE WHEN l_linenumber = 1 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END) AS worse FROM u),
g AS (SELECT e, person, count(*) AS n, list(photo ORDER BY worse, photo) AS p FROM r GROUP BY e, person),
o AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY n DESC, person) AS k FROM g),
f AS (SELECT DISTINCT e, 0::BIGINT AS k, []::BIGINT[] AS photos, []::BIGINT[] AS persons FROM o UNION ALL
  SELECT e, k, CASE WHEN x IS NULL THEN photos ELSE list_append(photos, x) END, CASE WHEN x IS NULL THEN persons ELSE list_append(persons, person) END
  FROM (SELECT f.e, o.k, photos, persons, person, CASE WHEN len(photos) < 9 THEN [q FOR q IN o.p IF NOT list_contains(photos, q)][1] END AS x FROM f JOIN o ON o.e = f.e AND o.k = f.k + 1))
SELECT e, unnest(persons) AS person, unnest(photos) AS photo FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY e ORDER BY k DESC) = 1)""")
def event_portraits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select(F.col("l_suppkey").alias("e"), F.col("l_orderkey").alias("photo"), (F.col("l_partkey") % 12).alias("person"), F.col("l_quantity").alias("score"), (F.col("l_linenumber") == 1).alias("alone"))
    return people.portraits(rows, ["e"])


@query(f"""WITH RECURSIVE {SIMHASH}, p AS MATERIALIZED (SELECT doc_id AS id, source, simhash, n_chars FROM documents JOIN sh USING (doc_id)),
l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.source = b.source AND a.id <> b.id WHERE bit_count(xor(a.simhash, b.simhash)) <= 4),
r AS (SELECT a AS id, a AS o FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.o = l.a),
root AS (SELECT id, min(o) AS root FROM r GROUP BY id), best AS (SELECT root, id AS best FROM root JOIN p USING (id) QUALIFY row_number() OVER (PARTITION BY root ORDER BY n_chars DESC, id) = 1)
SELECT doc_id AS id, CASE WHEN best <> doc_id THEN best END AS duplicate_of FROM documents LEFT JOIN root ON root.id = doc_id LEFT JOIN best USING (root)""")
def copies_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = src.table(spark, sf_dir, "documents").join(src.simhashes(spark, sf_dir), "doc_id", "left")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    photos = docs.select(
        F.col("source").alias("library_id"), F.col("doc_id").alias("id"), F.col("simhash").alias("phash"), none("exif_t", "long"), F.col("n_chars").alias("width"), F.lit(1).alias("height"),
        none("date_source", "string"), none("camera_make", "string"), none("gps_lat", "double"), none("duplicate_of", "long"),
    )
    return dedup.mark_duplicates(photos).select("id", "duplicate_of")


@query("""WITH p AS (SELECT c_custkey AS k, (['2024', '.hidden/x', 'a/node_modules/b', 'Old.photoslibrary/m', 'a/b', '@eaDir'])[c_custkey % 6 + 1] AS folder, (['.jpg', '.HEIC', '.txt', '.png', '.webp'])[c_custkey % 5 + 1] AS ext, c_name, c_nationkey FROM customer)
SELECT folder || '/' || c_name || ext AS rel_path, CASE WHEN k % 7 = 0 THEN 0 ELSE c_nationkey::BIGINT END AS size, k::BIGINT AS modified, CASE WHEN k % 7 = 0 THEN 'cloud_only' ELSE 'local' END AS status
FROM p WHERE folder IN ('2024', 'a/b') AND ext <> '.txt'""")
def files_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (k % len(x) + 1).cast("int"))
    folder, name = pick("2024", ".hidden/x", "a/node_modules/b", "Old.photoslibrary/m", "a/b", "@eaDir"), F.concat("c_name", pick(".jpg", ".HEIC", ".txt", ".png", ".webp"))
    stub = F.when(k % 7 == 0, F.concat(F.lit("."), name, F.lit(".icloud"))).otherwise(name)
    listing = src.table(spark, sf_dir, "customer").select(F.concat(F.lit("file:/photos/"), folder, F.lit("/"), stub).alias("path"), F.col("c_nationkey").cast("long").alias("length"), F.timestamp_seconds(k).alias("modificationTime"))
    return files.scanned(listing, "/photos")


# Reasons that are answered and actions of the log, in the order that the events take them.
ANSWERS = (
    "uskarpt", "daarlig_lys", "for_likt", "for_mange_herfra", "mangler_herfra", "viktig_oyeblikk", "viktig_person", "fint_bilde", "skarpere", "gjenstand", "stemning", "privat", "feil_person", "annet",
)
DONE = ("ta_med", "ta_bort", "bytt", "demp", "bytt")


def _learnt_sql() -> str:
    """The log folded step by step. Each weight moves by what an answer, else an action, says of it, and stays within its bounds."""
    moves = {name: [f"WHEN reason = '{r}' THEN {m[name]}::DOUBLE" for r, m in learn.REASONS.items() if name in m] for name in learn.WEIGHTS}
    acts = {name: [f"WHEN reason IS NULL AND action = '{a}' THEN {m[name]}::DOUBLE" for a, m in learn.ACTIONS.items() if name in m] for name in learn.WEIGHTS}
    acts["quality_importance"].append("WHEN reason IS NULL AND action = 'bytt' AND added + 0.15::DOUBLE < removed THEN -0.01::DOUBLE")
    acts["w_sharp"].append("WHEN reason IS NULL AND action = 'bytt' AND added > removed + 0.15::DOUBLE THEN 0.01::DOUBLE")
    start = ", ".join(f"{s}::DOUBLE AS {n}" for n, (s, _, _) in learn.WEIGHTS.items())
    step = ", ".join(f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, f.{n} + CASE {' '.join(moves[n] + acts[n])} ELSE 0.0::DOUBLE END))" for n, (_, lo, hi) in learn.WEIGHTS.items())
    out = ", ".join(f"round({n}, 6)::DOUBLE AS {n}" for n in learn.WEIGHTS)
    listed = lambda x: "[" + ", ".join(f"'{v}'" for v in x) + "]"
    return f"""WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, ({listed(DONE)})[event_id % 5 + 1] AS action,
  CASE WHEN event_id % 23 < 14 THEN ({listed(ANSWERS)})[event_id % 23 + 1] END AS reason, (event_id * 7 % 101) / 100.0::DOUBLE AS added, (event_id * 11 % 97) / 96.0::DOUBLE AS removed FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS k, {start} FROM o UNION ALL SELECT f.user_id, o.k, {step} FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, {out} FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1"""


@query(_learnt_sql())
def whole_log_learnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons and actions, swaps among them."""
    k = F.col("event_id")
    pick = lambda x, n: F.element_at(F.array(*map(F.lit, x)), (k % n + 1).cast("int"))
    log = src.table(spark, sf_dir, "events").select(
        "user_id", k.alias("id"), pick(DONE, 5).alias("action"), F.when(k % 23 < 14, pick(ANSWERS, 23)).alias("reason"), ((k * 7 % 101) / F.lit(100.0)).alias("added_sharp"), ((k * 11 % 97) / F.lit(96.0)).alias("removed_sharp")
    )
    return learn.learn(log, ["user_id"]).select("user_id", *(F.round(n, 6).cast("double").alias(n) for n in learn.WEIGHTS))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0 OR vec_id % 83 >= 36")
def faces_large_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    faces = src.table(spark, sf_dir, "embeddings").select("vec_id", F.when(k % 50 == 0, k).alias("fixed"), (k % 83).alias("pixels"))
    return people.large_enough(faces).select("vec_id")


# Lines and rows

_LETTERS = " + ".join(f"{w - typeset.WIDE} * (length(w) - length(translate(w, '{x.replace(chr(39), chr(39) * 2)}', '')))" for w, x in typeset.WIDTHS.items())


@query(f"""WITH RECURSIVE p AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS paragraph FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ps FROM documents)),
s AS (SELECT doc_id, paragraph, regexp_extract_all(p, '[^{typeset.SPACE}]+') AS ws FROM p),
x AS MATERIALIZED (SELECT doc_id, paragraph, k, w, {typeset.WIDE} * length(w) + {_LETTERS} AS wide FROM (SELECT doc_id, paragraph, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM s)),
f AS (SELECT doc_id, paragraph, 0::BIGINT AS k, 0 AS line, 0::BIGINT AS open FROM p UNION ALL
  SELECT f.doc_id, f.paragraph, x.k, CASE WHEN f.k > 0 AND open + 278 + wide > 40000 THEN line + 1 ELSE line END, CASE WHEN f.k = 0 OR open + 278 + wide > 40000 THEN wide ELSE open + 278 + wide END
  FROM f JOIN x ON x.doc_id = f.doc_id AND x.paragraph = f.paragraph AND x.k = f.k + 1)
SELECT f.doc_id, f.paragraph, line, coalesce(string_agg(w, ' ' ORDER BY f.k), '') AS said FROM f LEFT JOIN x ON x.doc_id = f.doc_id AND x.paragraph = f.paragraph AND x.k = f.k GROUP BY f.doc_id, f.paragraph, line""")
def wrapped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typeset.wrapped(spread(src.table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", 40_000)


@query(f"""WITH RECURSIVE {LINES}, p AS (SELECT l_orderkey AS page, l_linenumber AS photo, 0.5::DOUBLE + (l_partkey % 7) / 5.0::DOUBLE AS a FROM u),
q AS (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY page) AS n, sum(a) OVER o AS acc FROM p WINDOW o AS (PARTITION BY page ORDER BY photo)),
t AS (SELECT q.*, r, max(acc) OVER (PARTITION BY page) AS total FROM q JOIN range(1, 7) AS z(r) ON r <= n),
f AS (SELECT DISTINCT page, r, -1::BIGINT AS i, 0 AS row, 0 AS next FROM t UNION ALL
  SELECT f.page, f.r, t.i, f.next, f.next + (t.r - f.next - 1 > 0 AND (acc >= total * (f.next + 1) / t.r OR n - t.i - 1 = t.r - f.next - 1))::INT FROM f JOIN t ON t.page = f.page AND t.r = f.r AND t.i = f.i + 1),
d AS (SELECT t.*, row FROM t JOIN f USING (page, r, i)),
h AS (SELECT page, r, row, (100 - 2 * (count(*) - 1)) / sum(a) AS h FROM d GROUP BY page, r, row),
th AS (SELECT page, r, sum(h) + 2 * (count(*) - 1) AS th, count(*) AS n_rows FROM h GROUP BY page, r),
s AS (SELECT *, least(80 / th, 1.0) AS s FROM th),
b AS (SELECT page, r FROM d JOIN h USING (page, r, row) JOIN s USING (page, r) GROUP BY page, r QUALIFY row_number() OVER (PARTITION BY page ORDER BY round(sum(a * pow(h * s, 2)), 9) DESC, r) = 1),
z AS (SELECT d.page, photo, d.row, n_rows, th, s, a * h * s AS w, h * s AS h FROM b JOIN d USING (page, r) JOIN h USING (page, r, row) JOIN s USING (page, r)),
y AS (SELECT page, row, (80 - any_value(th) * any_value(s)) / 2 + coalesce(sum(any_value(h) + 2 * any_value(s)) OVER (PARTITION BY page ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y, sum(w) + 2 * any_value(s) * (count(*) - 1) AS rw FROM z GROUP BY page, row)
SELECT page, photo, n_rows, z.row, round((100 - rw) / 2 + coalesce(sum(w + 2 * s) OVER (PARTITION BY page, z.row ORDER BY photo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 5) AS x, round(y, 5) AS y, round(w, 5) AS w, round(h, 5) AS h FROM z JOIN y USING (page, row)""")
def justified_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("photo"), (0.5 + (F.col("l_partkey") % 7) / F.lit(5.0)).alias("a"))
    out = typeset.justified(photos, ["page"], "photo", "a", 100.0, 80.0, 2.0)
    return out.select("page", "photo", "n_rows", "row", *(F.round(c, 5).alias(c) for c in ("x", "y", "w", "h")))
