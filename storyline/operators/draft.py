"""The album draft: photos annotated and grouped with Columns, a greedy pick for each library, reasons as Columns.

The pick looks at what was chosen before, in this event and in the album, so it is a fold; the photos given are those of
one year of each library (canonical_year()), so a fold has some thousand rows. All else is relational.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyline.functions.scalar import aesthetic, hamming, mood_cap, natural_pages, quota, target_pages
from storyline.operators import hashes, timeline
from storyline.shared import dealt, materialize

BY = ["library_id"]
SIMILAR_SECONDS, SAME_THING, CHILD_BALANCE = 600, 20, 0.3


def faces_in_photos(faces: DataFrame) -> DataFrame:
    """Of the faces that count (not ignored, at least 0.04 of the height) whether there are any, the sharpness of the
    largest if it is at least 0.12 high, and the persons with their best face."""
    counts = ~F.col("ignored") & (F.col("h") >= 0.04)
    main = F.max_by(F.struct("h", "sharpness"), F.when(counts, F.struct("h", "id")))
    return faces.groupBy("library_id", "content_hash").agg(
        F.coalesce(F.bool_or(counts), F.lit(False)).alias("has_faces"),
        F.when(main["h"] >= 0.12, main["sharpness"]).alias("face_sharp"),
        F.collect_set(F.when(counts, F.coalesce("person_id", "grp"))).alias("persons"),
    )


def annotate(photos: DataFrame, faces: DataFrame, decisions: DataFrame, prefs: DataFrame) -> DataFrame:
    """People, noise, flaw, quality, blur and aesthetic of each dated photo.
    photos: id, content_hash, t and measures; decisions: content_hash, decision; prefs: the weights, one row for each library."""
    key = ["library_id", "content_hash"]
    # faces: those of scanned photos; a scanned photo without faces has has_faces false, others have no row.
    scanned = photos.filter("faces_done").select(*key).join(faces_in_photos(faces), key, "left")
    scanned = scanned.withColumn("has_faces", F.coalesce("has_faces", F.lit(False)))
    held = photos.filter("t is not null").join(scanned, key, "left").join(decisions, key, "left").join(prefs, BY, "left")
    held = held.withColumn("measured", F.col("q_sharp").isNotNull() & F.col("q_exposure").isNotNull() & F.col("q_color").isNotNull() & F.col("q_skin").isNotNull())
    sharp = F.when(F.col("face_sharp").isNotNull(), 0.65 * F.col("face_sharp") + 0.35 * F.col("q_sharp")).otherwise(F.col("q_sharp"))
    # The windows from here to the end of group() are over a library's rows: one deal serves them all, and its parts bound their sorts.
    held = dealt(held, BY, photos.count())
    held = timeline.relative_rank(held.withColumn("sharp", F.when(F.col("measured"), sharp)), BY, "sharp")
    w = lambda n: F.col(n)
    raw = (w("w_sharp") * w("rank") + w("w_exposure") * w("q_exposure") + w("w_color") * w("q_color")) / (w("w_sharp") + w("w_exposure") + w("w_color"))
    skin = F.coalesce(F.col("q_skin"), F.lit(0.0))
    people = F.when(F.col("has_faces").isNotNull(), F.col("has_faces") | (F.col("measured") & (skin >= 0.08))).when(F.col("measured"), F.col("q_skin") >= 0.02)
    screenshot = F.coalesce((F.col("format") == "png") & F.col("camera_make").isNull(), F.lit(False))
    noise = F.when(screenshot, "screenshot").when(F.col("measured") & (F.col("q_exposure") < 0.1), "dark_or_blown").when(F.col("measured") & (F.col("q_sharp") < 0.15), "blurry")
    has_tech = F.col("q_motion").isNotNull() & F.col("q_noise").isNotNull()
    flaw = F.when(has_tech & (F.col("q_motion") >= 0.5), "motion_blur").when(has_tech & (F.col("q_noise") >= 0.85), "grainy")
    q = F.when(F.col("measured"), raw).otherwise(0.5) + F.when(F.col("people"), 0.3).otherwise(0.0)
    q = q * F.when(has_tech, F.greatest(F.lit(0.0), 1 - 0.35 * F.col("q_motion") - 0.2 * F.col("q_noise"))).otherwise(1.0)
    q = q + F.when(F.col("decision") == "demp", -0.15).when(F.col("decision") == "opp", 0.25).otherwise(0.0)
    held = held.withColumn("people", people).withColumn("noise", noise).withColumn("flaw", flaw).withColumn("quality", q)
    soft = F.coalesce((F.col("rank") < 0.2) & (F.col("sharp") < 0.55), F.lit(False))
    held = held.withColumn("blurry", F.coalesce(F.col("flaw") == "motion_blur", F.lit(False)) | soft)
    return held.withColumn("aesthetic", aesthetic(F.col("q_color"), F.col("q_exposure"), F.col("rank")))


def group(items: DataFrame) -> DataFrame:
    """Event group, burst, nature flag, mood and exceptional photos; dull things become noise."""
    out = timeline.everyday_groups(timeline.assign_events(items, BY, "t", "content_hash"), BY, "t", "content_hash")
    out = timeline.assign_bursts(out, BY, "t", "content_hash")
    # Windows of a library's rows, which are together already: no step reads them anew to join counts to them.
    library, members = Window.partitionBy(*BY), Window.partitionBy(*BY, "grp")
    out = out.withColumn("nature", F.count_if("people").over(members) < F.count("people").over(members) * timeline.NATURE_SHARE)
    out = out.withColumn("_i", F.row_number().over(Window.partitionBy(*BY, "measured").orderBy("aesthetic")) - 1).withColumn("_n", F.count_if("measured").over(library))
    at = lambda share: F.max(F.when(F.col("measured") & (F.col("_i") == F.round((F.col("_n") - 1) * share)), F.col("aesthetic"))).over(library)
    out = out.withColumns({"mood_cut": at(F.col("mood_percentile")), "middle": at(F.lit(0.5)), "top": at(F.lit(0.97))}).drop("_i", "_n")
    thing = F.coalesce((F.col("people") == False) & F.col("noise").isNull() & F.col("top").isNotNull(), F.lit(False))  # noqa: E712
    fine = F.col("aesthetic") >= F.when(F.col("nature"), F.col("middle")).otherwise(F.col("mood_cut"))
    out = out.withColumn("mood", thing & fine).withColumn("exceptional", thing & fine & (F.col("aesthetic") >= F.col("top")))
    return out.withColumn("noise", F.when(thing & ~fine, "thing").otherwise(F.col("noise")))


def budget(items: DataFrame, wanted: int | None = None) -> DataFrame:
    """Pages, quota and mood cap of each group."""
    from storyline.operators.select import page_scale

    groups = items.groupBy(*BY, "grp", "everyday", "nature").agg(F.count("*").alias("n"), F.min("event_density").alias("density"))
    groups = groups.withColumn("natural", natural_pages(F.col("n"), F.col("everyday"), F.lit(False), F.lit(None).cast("int")))
    if wanted is None:
        groups = groups.withColumn("scale", F.lit(1.0))
    else:
        groups = groups.join(page_scale(groups, BY, wanted).select(*BY, "scale"), BY)
    groups = groups.withColumn("pages", target_pages(F.col("natural"), F.col("scale")))
    groups = groups.withColumn("quota", quota(F.col("n"), F.col("pages"), F.col("scale"), F.coalesce("density", F.lit(1.0))))
    return groups.withColumn("mood_max", mood_cap(F.col("nature"), F.lit(False))).drop("density")


def _pick(held: pd.DataFrame) -> pd.DataFrame:
    """K6, K7, K8: the greedy pick of one library's year, event after event."""
    held = held.sort_values(["t", "content_hash"], kind="stable").reset_index(drop=True)
    plain = lambda c: [None if x is None or x != x else x for x in held[c].tolist()]
    t, q, phash, burst, mood, decision, noise, grp = (plain(c) for c in ("t", "quality", "phash", "burst", "mood", "decision", "noise", "grp"))
    quotas, mood_max = plain("quota"), plain("mood_max")
    child = [() if x is None else tuple(x) for x in held["children"]]
    imp, limit = float(held["quality_importance"].iloc[0]), float(held["similar_hamming"].iloc[0])
    included, jumped, first = [False] * len(held), [False] * len(held), [False] * len(held)
    apart = lambda a, b: ((int(phash[a]) ^ int(phash[b])) & (2**64 - 1)).bit_count() if phash[a] is not None and phash[b] is not None else 65
    album_moods: list[int] = []
    members_of: dict[int, list[int]] = {}
    for i, g in enumerate(grp):
        members_of.setdefault(g, []).append(i)
    for g in sorted(members_of):
        members = members_of[g]
        chosen = [i for i in members if decision[i] is not None and decision[i] != "ikke_med"]
        open_ = [i for i in members if decision[i] is None and noise[i] is None]
        want, most = int(quotas[members[0]]), int(mood_max[members[0]])
        if not chosen and not open_:
            want, open_ = 1, [i for i in members if decision[i] is None and noise[i] != "screenshot"]
        step = max(max(t[members[-1]] - t[members[0]], 1) / (want + 1), 60.0)
        moods, started = sum(bool(mood[i]) for i in chosen), False
        blocks = lambda i, j: burst[i] == burst[j] or (abs(t[i] - t[j]) <= SIMILAR_SECONDS and apart(i, j) <= limit)
        same = lambda i, j: mood[i] and mood[j] and apart(i, j) <= SAME_THING
        open_ = [i for i in open_ if not any(blocks(i, j) for j in chosen) and not any(same(i, j) for j in [*chosen, *album_moods])]
        near = {i: min((abs(t[i] - t[j]) for j in chosen), default=None) for i in open_}
        shown: dict[int, int] = {}
        for i in chosen:
            for c in child[i]:
                shown[c] = shown.get(c, 0) + 1
        while len(chosen) < want:
            able = [i for i in open_ if not mood[i] or moods < most]
            if not able:
                break
            value = lambda i: imp * q[i] + (1 - imp) * (1.0 if near[i] is None else min(near[i] / step, 1.0)) + max((CHILD_BALANCE / (1 + shown.get(c, 0)) for c in child[i]), default=0.0)  # noqa: B023, E731
            best = max(able, key=lambda i: (value(i), -i))
            jumped[best] = q[best] + 1e-6 < max(q[i] for i in able)
            first[best], started = not started, True
            moods += bool(mood[best])
            chosen.append(best)
            for c in child[best]:
                shown[c] = shown.get(c, 0) + 1
            open_ = [i for i in open_ if i != best and not blocks(i, best) and not same(i, best)]
            near = {i: abs(t[i] - t[best]) if near[i] is None else min(near[i], abs(t[i] - t[best])) for i in open_}
        album_moods += [i for i in chosen if mood[i]]
        for i in chosen:
            included[i] = True
    return held[["library_id", "content_hash"]].assign(included=included, first=first, jumped=jumped)


def pick(items: DataFrame, budgets: DataFrame) -> DataFrame:
    """Included, first of its event, and chosen over a better one for its time."""
    if "children" not in items.columns:
        items = items.withColumn("children", F.array().cast("array<bigint>"))
    held = items.join(budgets.select(*BY, "grp", "quota", "mood_max"), [*BY, "grp"])
    cols = ["library_id", "content_hash", "t", "quality", "phash", "burst", "mood", "decision", "noise", "grp", "quota", "mood_max", "quality_importance", "similar_hamming", "children"]
    hash_type = items.schema["content_hash"].dataType.simpleString()
    return held.select(*cols).groupBy(*BY).applyInPandas(_pick, f"library_id string, content_hash {hash_type}, included boolean, first boolean, jumped boolean")


def with_reasons(items: DataFrame, picked: DataFrame) -> DataFrame:
    """Why each photo is in or out, and the photo it is out for."""
    key = [*BY, "content_hash"]
    # What a photo is told from its group are windows: the first chosen of its burst, and the chosen ones before and after it.
    held = dealt(items.join(picked, key), BY, items.count())
    group_, chosen = Window.partitionBy(*BY, "grp"), F.col("included")
    held = held.withColumn("in_group", F.count_if("included").over(group_)).withColumn("event_mood", F.bool_or(F.when(chosen, F.col("mood"))).over(group_))
    at = lambda h: F.when(chosen, F.struct(F.col("t").alias("t"), F.col(h).alias("h")))
    held = held.withColumn("same_series", F.min(at("content_hash")).over(Window.partitionBy(*BY, "grp", "burst"))["h"])
    held = held.withColumn("_h", F.min(F.when(chosen, F.col("content_hash"))).over(Window.partitionBy(*BY, "grp", "t")))
    held = held.withColumn("_was", F.max(at("_h")).over(group_.orderBy("t"))).withColumn("_next", F.min(at("_h")).over(group_.orderBy(F.desc("t"))))
    later = F.col("_was").isNull() | (F.col("_next.t") - F.col("t") < F.col("t") - F.col("_was.t"))
    held = materialize(held.withColumn("nearest", F.when(later, F.col("_next.h")).otherwise(F.col("_was.h"))).drop("_h", "_was", "_next"), "draft-chosen")
    # Hashes are compared only for photos that nothing said before tells the reason of; a photo meets the slot of its time and those beside it.
    asked = held.filter(~chosen & (F.coalesce("decision", F.lit("")) != "ikke_med") & F.col("noise").isNull() & F.col("same_series").isNull() & F.col("phash").isNotNull())
    slot = F.floor(F.col("t") / SIMILAR_SECONDS)
    left = asked.select(*key, "grp", "t", "phash", "similar_hamming", F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    others = held.filter("included").select(*BY, "grp", slot.alias("slot"), *(F.col(c).alias(f"o_{c}") for c in ("content_hash", "t", "phash")))
    alike = (F.abs(F.col("t") - F.col("o_t")) <= SIMILAR_SECONDS) & (hamming("phash", "o_phash") <= F.col("similar_hamming"))
    first = lambda t, k: F.min(F.struct(t, k))[k]
    found = left.join(others, [*BY, "grp", "slot"]).filter(alike).groupBy(*key).agg(first("o_t", "o_content_hash").alias("near_identical"))
    moods = held.filter("included and mood and phash is not null").select(*BY, F.col("phash").cast("long").alias("h"), "t", F.col("content_hash").alias("item"))
    mine = asked.filter("mood").select(*BY, F.col("content_hash").alias("k"), F.col("phash").cast("long").alias("h"))
    things = hashes.first_within(mine, moods, *BY, SAME_THING).groupBy(*BY, F.col("k").alias("content_hash")).agg(first("t", "first").alias("same_thing"))
    held = held.join(found, key, "left").join(things, key, "left")
    weak = F.col("noise").isNotNull() | F.col("blurry") | F.col("flaw").isNotNull()
    chosen_by_user = F.coalesce(F.col("decision") != "ikke_med", F.lit(False))
    reason_in = (
        F.when(chosen_by_user, "chosen_by_you").when((F.col("in_group") == 1) & weak, "weak_but_only").when(F.col("in_group") == 1, "only_one")
        .when(F.col("mood") & ~F.coalesce("people", F.lit(True)), "mood").when(F.col("burst_size") > 1, "best_in_series").when(F.col("first"), "best_of_event")
        .when(F.col("jumped"), "other_part_of_event").otherwise("good_quality")
    )
    reason_out = (
        F.when(F.col("decision") == "ikke_med", "excluded_by_you").when(F.col("noise").isNotNull(), F.col("noise")).when(F.col("same_series").isNotNull(), "same_series")
        .when(F.col("near_identical").isNotNull(), "near_identical").when(F.col("same_thing").isNotNull(), "same_thing").when(F.col("flaw").isNotNull(), F.col("flaw"))
        .when(F.col("blurry"), "blurry").when(F.col("mood") & F.coalesce("event_mood", F.lit(False)), "one_mood_is_enough").otherwise("no_room")
    )
    other = F.when(reason_out == "same_series", F.col("same_series")).when(reason_out == "near_identical", F.col("near_identical")).when(reason_out == "same_thing", F.col("same_thing")).otherwise(F.col("nearest"))
    return held.select(*BY, "grp", "content_hash", "t", "quality", "mood", "exceptional", "people", "decision", "included", F.when(F.col("included"), reason_in).otherwise(reason_out).alias("reason"), F.when(~F.col("included"), other).alias("related"))


def usable(items: DataFrame) -> DataFrame:
    """Photos without a fault that keeps them out, and not excluded by the user."""
    return items.filter(F.col("noise").isNull() & (F.coalesce("decision", F.lit("")) != "ikke_med"))


def outer_reasons(draft: DataFrame, locked: DataFrame, covering: DataFrame) -> DataFrame:
    """photos of locked pages and those added for coverage are in and say so, whatever else was said of them. locked,
    covering: library_id, content_hash. A photo for which there was no room tells how many its event has."""
    key = [*BY, "content_hash"]
    mark = lambda df, c: df.select(*key).distinct().withColumn(c, F.lit(True))
    held = draft.join(mark(locked, "_locked"), key, "left").join(mark(covering, "_covering"), key, "left")
    outer = F.coalesce("_locked", "_covering")
    held = held.withColumn("included", F.coalesce(outer, "included")).withColumn("related", F.when(outer.isNull(), F.col("related")))
    held = held.withColumn("reason", F.when(F.col("_locked"), "page_you_are_pleased_with").when(F.col("_covering"), "all_are_shown").otherwise(F.col("reason")))
    of_event = F.count_if("included").over(Window.partitionBy(*BY, "grp"))
    return held.withColumn("event_included", of_event).drop("_locked", "_covering")


def make_draft(photos: DataFrame, faces: DataFrame, decisions: DataFrame, prefs: DataFrame, wanted: int | None = None, children: DataFrame | None = None) -> DataFrame:
    """A reason for every dated photo of every library. children: library_id and person of those whose shares are balanced."""
    held = annotate(photos, faces, decisions, prefs)
    if children is not None:
        own = children.groupBy(*BY).agg(F.collect_set("person").alias("_own"))
        none = F.array().cast("array<bigint>")
        held = held.join(own, BY, "left").withColumn("children", F.coalesce(F.array_intersect("persons", "_own"), none)).drop("_own")
    items = materialize(group(held), "draft-items")
    return with_reasons(items, pick(items, budget(items, wanted)))
