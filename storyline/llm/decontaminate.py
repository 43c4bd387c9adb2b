"""Benchmark decontamination by spaced seeds.

A mask is laid over each window of words; the words at its marked places are hashed together, those between are ignored,
so that a window still matches when a word there was replaced. Hashes of documents and of benchmark items are joined.
Hits are reduced to alignments, one for each item and shift. Along an alignment document and item are compared word by
word: an equal word counts +1, a replaced one -MISS, and the best stretch decides. The hash join carries no texts; the
documents with hits are joined with their alignments, and of them only the aligned words go on.

Words are maximal runs of letters and digits in lower case. Null texts have no words. Items shorter than a window use
the front of a mask. Items under ``whole`` words must stand in a document word for word, and those of one or two words must be
all that the document says. Repeated rows and ties give the same result row once: one row for each document id and item, of
equal stretches the first. Empty tables give no rows. Columns other than doc_id, item_id and text are not looked at.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import unused

#: Marked places of each mask: 8 of 12 words.
MASKS = ("111101001101", "110010111011", "101110110101")
SPAN, MISS, ALONE = 12, 3, 2
#: Benchmark windows broadcast at once, about 100 MB; a larger benchmark is joined in so many slices by item.
MOST_SEEDS = 2_000_000


def words(text: Column) -> Column:
    """Hashes of the words, in order."""
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(split, ""), lambda w: F.xxhash64(w))


def seed(hashes: Column, at: Column, mask: int, span: int) -> Column:
    """Hash of the marked words of the window at the place, the mask and the span."""
    marked = [i for i, m in enumerate(MASKS[mask][:span]) if m == "1"]
    return F.xxhash64(F.lit(mask), F.lit(span), *(F.get(hashes, at + i) for i in marked))


def _seeds(rows: DataFrame, hashes: str, spans: list[int], *keep: str) -> DataFrame:
    """A row for each window and mask: pos and hash, which also tells span and mask."""
    # The front of a mask can be the whole of another one's: for short spans one mask is enough.
    kinds = [(span, m) for span in spans for m in (range(len(MASKS)) if span == SPAN else [0])]
    size = F.size(hashes)
    starts = F.when(size >= min(spans), F.sequence(F.lit(0), size - min(spans)))
    at = rows.select(*keep, hashes, F.explode(starts).alias("pos"))
    room = lambda span: (F.col("pos") + span <= size) & ((size == span) if span <= ALONE else F.lit(True))
    each = F.array(*(F.when(room(span), seed(F.col(hashes), F.col("pos"), m, span)) for span, m in kinds))
    # No function of arrays here: those end generated code, and each window would carry a copy of its document.
    return at.select(*keep, "pos", F.explode(each).alias("hash")).filter("hash is not null")


def _best(equal: Column) -> Column:
    """Score, first, end and equal words of the best stretch."""
    zero = F.struct(*(F.lit(0).alias(c) for c in ("at", "run", "since", "same", "score", "first", "end", "equal")))

    def step(acc: Column, hit: Column) -> Column:
        fresh = acc["run"] <= 0
        run = F.when(fresh, F.lit(0)).otherwise(acc["run"]) + F.when(hit, 1).otherwise(-MISS)
        since = F.when(fresh, acc["at"]).otherwise(acc["since"])
        same = F.when(fresh, F.lit(0)).otherwise(acc["same"]) + hit.cast("int")
        better = run > acc["score"]
        pick = lambda new, old: F.when(better, new).otherwise(acc[old])
        return F.struct((acc["at"] + 1).alias("at"), run.alias("run"), since.alias("since"), same.alias("same"), pick(run, "score").alias("score"), pick(since, "first").alias("first"), pick(acc["at"] + 1, "end").alias("end"), pick(same, "equal").alias("equal"))

    return F.aggregate(equal, zero, step, lambda acc: F.struct(acc["score"].alias("score"), acc["first"].alias("first"), acc["end"].alias("end"), acc["equal"].alias("equal")))


def _stretches(docs: DataFrame, benchmark: DataFrame, least: int = 12, share: float = 0.7, whole: int = 6) -> DataFrame:
    """doc_id, text_hash, item_id, at (the first aligned word) and b (the best stretch) of each alignment that find() counts."""
    items = benchmark.select("item_id", words(F.col("text")).alias("item")).filter(F.size("item") > 0).dropDuplicates(["item_id", "item"])
    items = items.withColumn("item_key", F.xxhash64("item_id", "item"))
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    held = texts.select("doc_id", "text_hash", words(F.col("text")).alias("doc"))
    sizes = items.agg(F.sum(F.size("item")), F.collect_set(F.least(F.size("item"), F.lit(SPAN)))).first()
    slices = max(1, math.ceil((sizes[0] or 0) * len(MASKS) / MOST_SEEDS))
    spans = sorted(sizes[1] or [SPAN])
    hits = None
    for k in range(slices):
        some = items if slices == 1 else items.filter(F.pmod("item_key", F.lit(slices)) == k)
        # An item has seeds of its own span only: the whole item if it is short, else a window.
        theirs = [_seeds(some.filter(F.least(F.size("item"), F.lit(SPAN)) == span), "item", [span], "item_key") for span in spans]
        theirs = reduce(DataFrame.unionByName, theirs).withColumnRenamed("pos", "item_pos")
        met = _seeds(held, "doc", spans, "doc_id", "text_hash").join(F.broadcast(theirs), "hash")
        met = met.select("doc_id", "text_hash", "item_key", (F.col("pos") - F.col("item_pos")).alias("shift"))
        hits = met if hits is None else hits.unionByName(met)
    # A document's hits come from one task, which leaves one row for each alignment.
    hits = hits.distinct().join(items.select("item_key", F.size("item").alias("n")), "item_key")
    by_doc = hits.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item_key", "shift", "n")).alias("hits"))
    by_doc = by_doc.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    found = texts.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("doc_id", "text_hash", words(F.col("text")).alias("doc"), "hits")

    def cut(h: Column) -> Column:
        first = F.greatest(h["shift"], F.lit(0))
        end = F.least(F.size("doc"), h["shift"] + h["n"])
        return F.struct(h["item_key"].alias("item_key"), h["n"].alias("n"), first.alias("at"), (first - h["shift"]).alias("skip"), F.slice("doc", first + 1, end - first).alias("part"))

    parts = found.select("doc_id", "text_hash", F.explode(F.transform("hits", cut)).alias("h")).select("doc_id", "text_hash", "h.*").join(items, "item_key")
    equal = F.zip_with("part", F.slice("item", F.col("skip") + 1, F.size("part")), lambda a, b: a == b)
    best = parts.select("doc_id", "text_hash", "item_id", "n", "at", _best(equal).alias("b"))
    enough = F.when(F.col("n") < whole, F.col("n")).otherwise(F.least(F.lit(least), F.ceil(F.col("n") * share)))
    return best.filter(F.col("b.score") >= enough)


def find(docs: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """doc_id, item_id, first_word, end_word, equal_words and score of the best stretch, where the score reaches ``least``
    or, for short items, ``share`` of the item's words."""
    best = _stretches(docs, benchmark, **limits)
    best = best.groupBy("doc_id", "item_id").agg(F.max(F.struct("b.score", (-F.col("at") - F.col("b.first")).alias("first"), (F.col("at") + F.col("b.end")).alias("end"), "b.equal")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.first")).alias("first_word"), F.col("b.end").alias("end_word"), F.col("b.equal").alias("equal_words"), F.col("b.score").alias("score"))


def clean(docs: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """The rows of docs without those in whose text an item was found, whatever their ids."""
    i, h = unused(docs, "_id"), unused(docs, "_hash")
    hit = _stretches(docs, benchmark, **limits).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct()
    same = F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(h)
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(i)) & same, "left_anti")
