"""Preferences learnt from an ordered log of choices. Weights are clamped after every step, so the order matters and the
steps cannot be summed: the log of a library is folded in one pass with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Start and bounds of each weight.
WEIGHTS = {
    "w_sharp": (0.5, 0.3, 0.8),
    "w_exposure": (0.3, 0.15, 0.6),
    "w_color": (0.2, 0.1, 0.5),
    "quality_importance": (0.75, 0.4, 0.95),
    "event_density": (1.0, 0.6, 1.6),
    "similar_hamming": (10.0, 6.0, 16.0),
    "mood_percentile": (0.9, 0.7, 0.99),
}
# What each answered reason moves; reasons not named here are kept in the log and move nothing.
REASONS = {
    "uskarpt": {"w_sharp": 0.04, "quality_importance": 0.02},
    "daarlig_lys": {"w_exposure": 0.04},
    "for_likt": {"similar_hamming": 1.0},
    "for_mange_herfra": {"event_density": -0.04},
    "mangler_herfra": {"event_density": 0.04},
    "viktig_oyeblikk": {"quality_importance": -0.03},
    "viktig_person": {"quality_importance": -0.02},
    "fint_bilde": {"w_color": 0.03},
    "skarpere": {"w_sharp": 0.03},
    "gjenstand": {"mood_percentile": 0.02},
    "stemning": {"mood_percentile": -0.03},
}
# What an action without an answer moves.
ACTIONS = {"ta_med": {"event_density": 0.01}, "ta_bort": {"event_density": -0.01}}
SWAP, SWAP_GAP, SWAP_STEP = "bytt", 0.15, 0.01
# Lesson, weight, sign of the change, least change.
LESSONS = (
    ("sharpness_counts_more", "w_sharp", 1, 0.05),
    ("light_counts_more", "w_exposure", 1, 0.05),
    ("colour_counts_more", "w_color", 1, 0.05),
    ("moment_before_quality", "quality_importance", -1, 0.05),
    ("quality_before_moment", "quality_importance", 1, 0.05),
    ("fewer_alike", "similar_hamming", 1, 2.0),
    ("more_of_each_event", "event_density", 1, 0.05),
    ("fewer_of_each_event", "event_density", -1, 0.05),
    ("things_only_if_great", "mood_percentile", 1, 0.04),
    ("likes_mood_photos", "mood_percentile", -1, 0.05),
)


def _moves(name: str, e: Column) -> Column:
    """By how much a log row moves a weight."""
    by_reason, by_action = F.lit(0.0), F.lit(0.0)
    for reason, moves in REASONS.items():
        if name in moves:
            by_reason = F.when(e["reason"] == reason, moves[name]).otherwise(by_reason)
    for action, moves in ACTIONS.items():
        if name in moves:
            by_action = F.when(e["action"] == action, moves[name]).otherwise(by_action)
    swap = e["action"] == SWAP
    if name == "quality_importance":
        by_action = F.when(swap & (e["added_sharp"] + SWAP_GAP < e["removed_sharp"]), -SWAP_STEP).otherwise(by_action)
    if name == "w_sharp":
        by_action = F.when(swap & (e["added_sharp"] > e["removed_sharp"] + SWAP_GAP), SWAP_STEP).otherwise(by_action)
    return F.when(e["reason"].isNotNull(), by_reason).otherwise(by_action)


def learn(log: DataFrame, by: list[str]) -> DataFrame:
    """The weights after the whole log of each library, the oldest row first. log: id, action, reason, added_sharp, removed_sharp."""
    rows = log.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("id", "action", "reason", "added_sharp", "removed_sharp"))).alias("log"))
    start = F.struct(*(F.lit(s).alias(n) for n, (s, _, _) in WEIGHTS.items()))

    def step(p: Column, e: Column) -> Column:
        return F.struct(*(F.greatest(F.lit(lo), F.least(F.lit(hi), p[n] + _moves(n, e))).alias(n) for n, (_, lo, hi) in WEIGHTS.items()))

    return rows.select(*by, F.aggregate("log", start, step).alias("p")).select(*by, "p.*")


def lessons(weights: DataFrame, by: list[str]) -> DataFrame:
    """What was learnt, in fixed order. A hair is given to sums of steps that reach the least change."""
    said = lambda w, sign, least: sign * (F.col(w) - WEIGHTS[w][0]) >= least - 1e-9
    return weights.select(*by, F.filter(F.array(*(F.when(said(w, s, m), name) for name, w, s, m in LESSONS)), lambda x: x.isNotNull()).alias("lessons"))


def feedback_summary(log: DataFrame, by: list[str]) -> DataFrame:
    """A20"""
    return log.groupBy(*by).agg(F.count("*").alias("choices"), F.count("reason").alias("answers"))
