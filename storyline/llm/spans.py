"""Spans of pattern matches in whole texts, as Column expressions only.

A span is a struct of start, ord (the kind's place in its list), end, kind and value; starts and ends count code
points from 0, the end is exclusive. Spark's pattern functions give matches but no positions: these follow from the
lengths of the pieces between the matches, which split() gives for the same pattern. Running sums and maxima go by
blocks, so that the cost follows the number of matches however many a text has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,ord:int,end:int,kind:string,value:string>"
SPANS = f"array<{SPAN}>"
#: Values that a running sum takes at once, and spans from which on a text is cut by its letters.
BLOCK, MANY = 128, 64


def let(value: Column, say: Callable[[Column], Column]) -> Column:
    """say(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), say), 0)


def before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of some non-negative numbers the sum, or what join makes, of those before it; 0 for the first."""
    zero = F.struct(F.lit(0).alias("all"), F.array().cast("array<int>").alias("out"))

    def put(acc: Column, x: Column) -> Column:
        return F.struct(join(acc["all"], x).alias("all"), F.concat(acc["out"], F.array(acc["all"])).alias("out"))

    def blocks(v: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.aggregate(F.slice(v, k * BLOCK + 1, BLOCK), zero, put))
        return let(each, lambda b: F.flatten(F.zip_with(b, F.aggregate(F.transform(b, lambda x: x["all"]), zero, put, lambda acc: acc["out"]), lambda x, base: F.transform(x["out"], lambda y: join(y, base)))))

    return let(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(F.array().cast("array<int>")))


def plus(a: Column, b: Column) -> Column:
    return a + b


def none() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, ord_: Column | int, end: Column, kind: Column | str, value: Column) -> Column:
    put = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.struct(start.alias("start"), put(ord_).alias("ord"), end.alias("end"), put(kind).alias("kind"), value.alias("value")).cast(SPAN)


def found(name: str, text: Column, pattern: str, only_if: Column | None = None) -> list[Column]:
    """Two columns: the matches, leftmost first and without overlap, and the lengths of the pieces around them. Columns of
    their own, so that the plan runs each pattern once however often they are used."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gap = F.transform(F.split(text, pattern, -1), F.char_length)
    return [c.alias(n) if only_if is None else F.when(only_if, c).alias(n) for c, n in ((match, name), (gap, f"{name}_gap"))]


def placed(name: str, kind: str, ord_: int) -> Column:
    """The spans of what found() gave under that name; none for null."""
    match, gap = F.col(name), F.slice(F.col(f"{name}_gap"), 1, F.size(name))
    steps = F.zip_with(match, gap, lambda m, g: F.char_length(m) + g)
    each = F.arrays_zip(match.alias("match"), gap.alias("gap"), before(steps, plus).alias("at"))

    def one(x: Column) -> Column:
        start = x["at"] + x["gap"]
        return span(start, ord_, start + F.char_length(x["match"]), kind, x["match"])

    return F.when(F.coalesce(F.size(match), F.lit(0)) > 0, F.transform(each, one)).otherwise(none())


def outermost(spans: Column) -> Column:
    """The spans without those inside another one, each place once, sorted."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s.alias("s"))))
    each = let(order, lambda o: F.arrays_zip(o.alias("o"), before(F.transform(o, lambda x: -x["last"]), F.greatest).alias("most")))
    return F.transform(F.filter(each, lambda x: x["o"]["s"]["end"] > x["most"]), lambda x: x["o"]["s"])


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def replaced(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """The text with each span replaced by what label gives for it. Of overlapping spans the first gives the label."""

    def joined_up(s: Column, cut: Callable[[Column, Column], Column]) -> Column:
        each = F.arrays_zip(s.alias("s"), before(F.transform(s, lambda x: x["end"]), F.greatest).alias("at"))
        said = F.transform(each, lambda x: F.when(x["s"]["start"] >= x["at"], F.concat(cut(x["at"], x["s"]["start"]), label(x["s"]))).otherwise(F.lit("")))
        return F.concat(F.array_join(said, ""), cut(F.array_max(F.transform(s, lambda x: x["end"])), F.char_length(text)))

    plain = lambda a, b: F.substring(text, a + 1, b - a)
    by_letter = let(F.split(text, ""), lambda t: let(F.array_sort(spans), lambda s: joined_up(s, lambda a, b: F.array_join(F.slice(t, a + 1, b - a), ""))))
    few = let(F.array_sort(spans), lambda s: joined_up(s, plain))
    return F.when(F.size(spans) > MANY, by_letter).when(F.size(spans) > 0, few).otherwise(text)
