"""The steps of the album draft around its greedy pick, each held against SQL: measures and flags, groups with their budgets, and
reasons for a fixed choice of photos. Two faces of each third scanned photo, and a decision of each kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.operators import draft, learn
from storyline.plans.queries import GAPPED, query
from storyline.shared import materialize
from storyline.sources import tables as src

W = {n: start for n, (start, _, _) in learn.WEIGHTS.items()}
DECISIONS = ("med", "ikke_med", "demp", "opp")


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = src.photos(spark, sf_dir)
    key = F.col("content_hash")
    held = photos.filter("faces_done and content_hash % 3 = 0").select("library_id", "content_hash")
    face = lambda n, h, s, person, ignored: held.select("library_id", "content_hash", (key * 2 + n).alias("id"), (key % h / 100.0).alias("h"), (key % s / 10.0).alias("sharpness"), (key % person).alias("person_id"), F.lit(None).cast("long").alias("grp"), (key % 7 == ignored).alias("ignored"))
    faces = face(0, 30, 10, 5, 3).unionByName(face(1, 20, 7, 4, 5))
    names = F.array(*(F.lit(d) for d in DECISIONS))
    decisions = photos.filter("content_hash % 29 = 0").select("library_id", "content_hash", F.get(names, (key % 4).cast("int")).alias("decision"))
    prefs = photos.select("library_id").distinct().select("library_id", *(F.lit(s).alias(n) for n, s in W.items()))
    return draft.annotate(photos, faces, decisions, prefs)


ANNOTATED = f"""{GAPPED},
p AS (SELECT *, (event_id * 7 % 101) / 100::DOUBLE AS q_sharp, (event_id * 11 % 97) / 96::DOUBLE AS q_exposure, (event_id * 13 % 89) / 88::DOUBLE AS q_color, (event_id * 17 % 83) / 82::DOUBLE * 0.1::DOUBLE AS q_skin,
  (event_id * 19 % 79) / 78::DOUBLE AS q_motion, (event_id * 23 % 73) / 72::DOUBLE AS q_noise, event_id * 2654435761 % 4294967296 AS phash, event_id % 2 = 0 AS scanned FROM s),
c AS (SELECT event_id, event_id * 2 AS id, (event_id % 30) / 100::DOUBLE AS h, (event_id % 10) / 10::DOUBLE AS sharpness, event_id % 7 = 3 AS ignored FROM p WHERE scanned AND event_id % 3 = 0
  UNION ALL SELECT event_id, event_id * 2 + 1, (event_id % 20) / 100::DOUBLE, (event_id % 7) / 10::DOUBLE, event_id % 7 = 5 FROM p WHERE scanned AND event_id % 3 = 0),
main AS (SELECT * FROM c WHERE NOT ignored AND h >= 0.04::DOUBLE QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY h DESC, id DESC) = 1),
f AS (SELECT p.*, CASE WHEN scanned THEN main.event_id IS NOT NULL END AS has_faces, CASE WHEN h >= 0.12::DOUBLE THEN sharpness END AS face_sharp,
  CASE WHEN p.event_id % 29 = 0 THEN (['med', 'ikke_med', 'demp', 'opp'])[p.event_id % 4 + 1] END AS decision FROM p LEFT JOIN main USING (event_id)),
sharp AS (SELECT *, CASE WHEN face_sharp IS NULL THEN q_sharp ELSE 0.65::DOUBLE * face_sharp + 0.35::DOUBLE * q_sharp END AS sharp FROM f),
ranked AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY user_id) <= 1 THEN 0.5::DOUBLE ELSE percent_rank() OVER (PARTITION BY user_id ORDER BY sharp) END AS rank FROM sharp),
flagged AS (SELECT *, CASE WHEN scanned THEN has_faces OR q_skin >= 0.08::DOUBLE ELSE q_skin >= 0.02::DOUBLE END AS people,
  CASE WHEN event_id % 41 = 0 AND event_id % 3 = 0 THEN 'screenshot' WHEN q_exposure < 0.1::DOUBLE THEN 'dark_or_blown' WHEN q_sharp < 0.15::DOUBLE THEN 'blurry' END AS noise,
  CASE WHEN q_motion >= 0.5::DOUBLE THEN 'motion_blur' WHEN q_noise >= 0.85::DOUBLE THEN 'grainy' END AS flaw,
  0.4::DOUBLE * q_color + 0.3::DOUBLE * q_exposure + 0.3::DOUBLE * rank AS aesthetic FROM ranked),
a AS (SELECT *, coalesce(flaw = 'motion_blur', false) OR (rank < 0.2::DOUBLE AND sharp < 0.55::DOUBLE) AS blurry,
  (({W["w_sharp"]}::DOUBLE * rank + {W["w_exposure"]}::DOUBLE * q_exposure + {W["w_color"]}::DOUBLE * q_color) / ({W["w_sharp"]}::DOUBLE + {W["w_exposure"]}::DOUBLE + {W["w_color"]}::DOUBLE)
    + CASE WHEN people THEN 0.3::DOUBLE ELSE 0 END) * greatest(0, 1 - 0.35::DOUBLE * q_motion - 0.2::DOUBLE * q_noise)
  + CASE decision WHEN 'demp' THEN -0.15::DOUBLE WHEN 'opp' THEN 0.25::DOUBLE ELSE 0 END AS quality FROM flagged)"""
GROUPED = f"""{ANNOTATED},
k AS (SELECT *, count(*) OVER (PARTITION BY user_id, event) < 3 AS everyday, strftime(make_timestamp(min(t) OVER (PARTITION BY user_id, event) * 1000000), '%Y-%m') AS month,
  CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 20 THEN 1 ELSE 0 END AS jump FROM a),
l AS (SELECT *, CASE WHEN everyday THEN month ELSE event::VARCHAR END AS gathered, sum(jump) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM k),
o AS (SELECT *, first_value(t) OVER w AS ft, first_value(event_id) OVER w AS fk FROM l WINDOW w AS (PARTITION BY user_id, everyday, gathered ORDER BY t, event_id)),
r AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY ft, fk) - 1 AS grp, count(*) OVER (PARTITION BY user_id, burst) AS burst_size FROM o),
n AS (SELECT *, count(*) FILTER (people) OVER (PARTITION BY user_id, grp) < count(*) OVER (PARTITION BY user_id, grp) * 0.25 AS nature,
  row_number() OVER (PARTITION BY user_id ORDER BY aesthetic) - 1 AS i, count(*) OVER (PARTITION BY user_id) - 1 AS last FROM r),
cut AS (SELECT user_id, max(aesthetic) FILTER (i = round(last * {W["mood_percentile"]}::DOUBLE)) AS mood_cut, max(aesthetic) FILTER (i = round(last * 0.5::DOUBLE)) AS middle, max(aesthetic) FILTER (i = round(last * 0.97::DOUBLE)) AS top FROM n GROUP BY user_id),
t1 AS (SELECT n.*, top, NOT people AND noise IS NULL AS thing, aesthetic >= CASE WHEN nature THEN middle ELSE mood_cut END AS fine FROM n JOIN cut USING (user_id)),
g1 AS (SELECT * EXCLUDE (noise), CASE WHEN thing AND NOT fine THEN 'thing' ELSE noise END AS noise, thing AND fine AS mood, thing AND fine AND aesthetic >= top AS exceptional FROM t1)"""


@query(f"WITH {ANNOTATED} SELECT event_id, people, noise, flaw, blurry, decision, round(rank, 9) AS rank, round(quality, 9) AS quality, round(aesthetic, 9) AS aesthetic FROM a")
def draft_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8-P12, P14, F15-F17, J12, W3."""
    r = lambda c: F.round(c, 9).alias(c)
    return _annotated(spark, sf_dir).select(F.col("content_hash").alias("event_id"), "people", "noise", "flaw", "blurry", "decision", r("rank"), r("quality"), r("aesthetic"))


@query(f"WITH {GROUPED} SELECT event_id, grp, everyday, nature, burst_size, mood, exceptional, noise FROM g1")
def draft_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, W2, W7, A9, A10, F22."""
    return draft.group(_annotated(spark, sf_dir)).select(F.col("content_hash").alias("event_id"), "grp", "everyday", "nature", "burst_size", "mood", "exceptional", "noise")


@query(f"""WITH {GROUPED}, z AS (SELECT user_id, grp, everyday, nature, count(*) AS n FROM g1 GROUP BY ALL),
y AS (SELECT *, CASE WHEN everyday THEN ceil(1.5 * sqrt(n) / 4.0) ELSE greatest(1.0, least(16.0, round(0.6 * sqrt(n)))) END::BIGINT AS pages FROM z)
SELECT user_id, grp, n, pages, greatest(round(least(pages * 4.0, greatest(ceil(n * 0.5), 1))), 1)::BIGINT AS quota, CASE WHEN nature THEN 4 ELSE 1 END::INT AS mood_max FROM y""")
def draft_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18-F21."""
    return draft.budget(draft.group(_annotated(spark, sf_dir))).select(F.col("library_id").cast("long").alias("user_id"), "grp", "n", "pages", "quota", "mood_max")


@query(f"""WITH {GROUPED}, x AS (SELECT *, event_id % 4 = 0 AS included, count(*) FILTER (event_id % 4 = 0) OVER (PARTITION BY user_id, grp) AS in_group FROM g1),
pair AS (SELECT a.event_id,
  first(b.event_id ORDER BY b.t, b.event_id) FILTER (a.burst = b.burst) AS same_series,
  first(b.event_id ORDER BY b.t, b.event_id) FILTER (abs(a.t - b.t) <= 600 AND bit_count(xor(a.phash, b.phash)) <= {W["similar_hamming"]}) AS near_identical,
  first(b.event_id ORDER BY abs(a.t - b.t), b.t, b.event_id) AS nearest, bool_or(b.mood) AS event_mood
  FROM x a JOIN x b ON a.user_id = b.user_id AND a.grp = b.grp AND NOT a.included AND b.included GROUP BY a.event_id),
alike AS (SELECT a.event_id, first(b.event_id ORDER BY b.t, b.event_id) AS same_thing FROM x a JOIN x b ON a.user_id = b.user_id AND a.mood AND b.mood AND NOT a.included AND b.included AND bit_count(xor(a.phash, b.phash)) <= 20 GROUP BY a.event_id),
said AS (SELECT x.*, same_series, near_identical, same_thing, nearest, CASE WHEN included THEN
    CASE WHEN coalesce(decision <> 'ikke_med', false) THEN 'chosen_by_you' WHEN in_group = 1 AND (noise IS NOT NULL OR blurry OR flaw IS NOT NULL) THEN 'weak_but_only' WHEN in_group = 1 THEN 'only_one' WHEN mood AND NOT people THEN 'mood'
      WHEN burst_size > 1 THEN 'best_in_series' WHEN event_id % 8 = 0 THEN 'best_of_event' WHEN event_id % 12 = 0 THEN 'other_part_of_event' ELSE 'good_quality' END
    ELSE CASE WHEN decision = 'ikke_med' THEN 'excluded_by_you' WHEN noise IS NOT NULL THEN noise WHEN same_series IS NOT NULL THEN 'same_series' WHEN near_identical IS NOT NULL THEN 'near_identical' WHEN same_thing IS NOT NULL THEN 'same_thing'
      WHEN flaw IS NOT NULL THEN flaw WHEN blurry THEN 'blurry' WHEN mood AND coalesce(event_mood, false) THEN 'one_mood_is_enough' ELSE 'no_room' END END AS reason
  FROM x LEFT JOIN pair USING (event_id) LEFT JOIN alike USING (event_id))
SELECT event_id, grp, included, reason, CASE WHEN NOT included THEN CASE reason WHEN 'same_series' THEN same_series WHEN 'near_identical' THEN near_identical WHEN 'same_thing' THEN same_thing ELSE nearest END END AS related FROM said""")
def draft_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F24, F25, J11, P16, P17, W8, W10, for every fourth photo taken."""
    items, key = materialize(draft.group(_annotated(spark, sf_dir)), "draft-items"), F.col("content_hash")
    picked = items.select("library_id", "content_hash", (key % 4 == 0).alias("included"), (key % 8 == 0).alias("first"), (key % 12 == 0).alias("jumped"))
    return draft.with_reasons(items, picked).select(key.alias("event_id"), "grp", "included", "reason", "related")
