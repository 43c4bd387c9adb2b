"""Secrets: base patterns, and strings whose sliding windows look random for their character class.

Candidates are maximal runs of a class's characters that hold a digit and a letter. A window of fixed width slides over
the run; the Shannon entropy of its characters is log2(w) - S / w with S the sum of c * log2(c) over the character
counts c, and a step changes only the counts of the character that enters and the one that leaves. Windows at or over
the class's threshold are flagged; a flagged stretch runs from the first such window to the end of the last. The
allow-list drops candidates of known harmless form; it never drops base spans.

Nulls count as empty texts, and an empty text has no spans. Rows are independent, so ties and repeated rows need no
rule. Input columns other than doc_id and text are left out.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.llm import spans as S
from storyline.llm.common import texts

KINDS = ("assign", "access", "hex")
ENTROPY = "entropy"


class CharClass(NamedTuple):
    letters: str
    pattern: str
    width: int
    bits: float


# Runs are at least as long as a window. A random hex window of 20 has about 3.5 bits a character, a random one of
# letters, digits and signs about 4.1; words of the same length stay under 3.7 and have no digits.
CLASSES = (
    CharClass("0123456789abcdef", r"(?<![0-9A-Za-z])[0-9a-f]{20,}+(?![0-9A-Za-z])", 20, 3.0),
    CharClass("0123456789ABCDEF", r"(?<![0-9A-Za-z])[0-9A-F]{20,}+(?![0-9A-Za-z])", 20, 3.0),
    CharClass("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-", r"(?<![0-9A-Za-z+/_-])[0-9A-Za-z+/_-]{20,}+", 20, 3.75),
)
#: Harmless forms: UUIDs, dates and times, words joined by signs, decimal numbers, and texts that say they are examples.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9/_-]+$",
    r"^[A-Za-z]++(?:[/_-]++[A-Za-z]++)*+(?:[/_-]*+[0-9]{1,4})?$",
    r"(?i)example|sample|dummy|placeholder|changeme|0123456789|abcdefgh",
)
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
PATTERNS = {"assign": _ASSIGN, "access": r"AKIA[A-Z0-9]{16,}+", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+"}
_SECRET = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""


#: Bits of a packed count, which holds widths up to 31, and counts in a 64-bit integer.
COUNT_BITS, PACKED = 5, 12


def _stretch(run: Column, kind: CharClass) -> Column:
    """Struct of the first and the end offset of the flagged stretch in a run, null where no window reaches the threshold."""
    w, cells = kind.width, -(-len(kind.letters) // PACKED)
    part = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    codes = F.transform(F.split(run, ""), lambda ch: F.instr(F.lit(kind.letters), ch) - 1)
    shift = lambda code: F.pmod(code, F.lit(PACKED)) * COUNT_BITS

    def move(came: Column, went: Column) -> Column:
        place = lambda c, n: (F.floor(c / PACKED).cast("int").alias(f"{n}_cell"), shift(c).alias(f"{n}_shift"))
        return F.struct(came.alias("came"), went.alias("went"), *place(came, "came"), *place(went, "went"))

    moves = S.let(codes, lambda c: F.zip_with(c, F.slice(F.concat(F.array_repeat(F.lit(-1), w), c), 1, F.size(c)), move))
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), cells).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("at"), F.lit(-1).alias("first"), F.lit(-1).alias("end"))
    unit = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), by)
    held = lambda acc, cell, by: F.call_function("shiftright", F.get(acc["n"], cell), by).bitwiseAND(F.lit(31)).cast("int")

    def slide(acc: Column, m: Column) -> Column:
        old_went = held(acc, m["went_cell"], m["went_shift"])
        old_came = held(acc, m["came_cell"], m["came_shift"]) - (m["came"] == m["went"]).cast("int")
        less = lambda i: F.when((i == m["went_cell"]) & (m["went"] >= 0), unit(m["went_shift"])).otherwise(F.lit(0).cast("long"))
        more = lambda i: F.when(i == m["came_cell"], unit(m["came_shift"])).otherwise(F.lit(0).cast("long"))
        counts = F.transform(acc["n"], lambda c, i: c - less(i) + more(i))
        s = acc["s"] + F.when(m["went"] >= 0, part(old_went - 1) - part(old_went)).otherwise(F.lit(0.0)) + part(old_came + 1) - part(old_came)
        at = acc["at"] + 1
        hit = (at >= w) & (F.lit(math.log2(w)) - s / w >= kind.bits - 1e-9)
        first = F.when(hit & (acc["first"] < 0), at - w).otherwise(acc["first"])
        return F.struct(counts.alias("n"), s.alias("s"), at.alias("at"), first.alias("first"), F.when(hit, at).otherwise(acc["end"]).alias("end"))

    done = lambda acc: F.when(acc["first"] >= 0, F.struct(acc["first"].alias("first"), acc["end"].alias("end")))
    return F.aggregate(moves, zero, slide, done)


def _candidate(value: Column) -> Column:
    ok = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    for form in ALLOW:
        ok = ok & ~value.rlike(form)
    return ok


def _random_spans(name: str, kind: CharClass) -> Column:
    runs = F.filter(S.placed(name, ENTROPY, len(KINDS)), lambda s: _candidate(s["value"]))
    cut = F.filter(F.transform(runs, lambda s: F.struct(s.alias("run"), _stretch(s["value"], kind).alias("hit"))), lambda x: x["hit"].isNotNull())

    def one(x: Column) -> Column:
        run, first, end = x["run"], x["hit"]["first"], x["hit"]["end"]
        return S.span(run["start"] + first, len(KINDS), run["start"] + end, ENTROPY, F.substring(run["value"], first + 1, end - first))

    return F.transform(cut, one)


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (base kinds and entropy) for each row of docs."""
    t = F.col("text")
    patterns = {f"_{k}": PATTERNS[k] for k in KINDS} | {f"_c{i}": c.pattern for i, c in enumerate(CLASSES)}
    only_if = {"_access": F.instr(t, "AKIA") > 0}
    found = texts(docs).select("doc_id", *(c for name, p in patterns.items() for c in S.found(name, t, p, only_if.get(name))))
    base = [S.placed(f"_{k}", k, i) for i, k in enumerate(KINDS)]
    base[0] = F.filter(base[0], lambda s: F.length(F.regexp_extract(s["value"], _SECRET, 1)) >= 6)
    random = [_random_spans(f"_c{i}", c) for i, c in enumerate(CLASSES)]
    both = found.select("doc_id", F.concat(*base).alias("base"), F.concat(*random).alias("random"))
    return both.select("doc_id", F.array_sort(F.concat("base", F.when(F.size("random") > 0, S.outermost(F.col("random"))).otherwise(S.none()))).alias("spans"))


def redact(docs: DataFrame, label: str = "[SECRET]") -> DataFrame:
    """The texts with each span replaced, as doc_id and text, one row for each row of docs."""
    keyed = texts(docs).withColumn("_hash", F.xxhash64("text"))
    got = find(keyed.select(F.struct("doc_id", "_hash").alias("doc_id"), "text")).dropDuplicates(["doc_id"])
    got = got.filter(F.size("spans") > 0).select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id._hash").alias("_h"), "spans")
    both = keyed.join(got, keyed["doc_id"].eqNullSafe(got["_id"]) & (keyed["_hash"] == got["_h"]), "left")
    return both.select("doc_id", F.when(F.col("spans").isNotNull(), S.replaced(F.col("text"), F.col("spans"), lambda s: F.lit(label))).otherwise(F.col("text")).alias("text"))
