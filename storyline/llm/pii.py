"""Personal data: base patterns, and terms that reveal the protected values by what the corpus tells of both.

The protected entities are what the values that the base patterns find have in common: the value itself, the part of it that
others share (the domain of an address, the first two numbers of an ip, the first six digits of a card, the country code of
a number), and its kind. Information theory tells how much a term gives away of an entity that stands in the same document:
with counts over all documents, the pointwise mutual information of term and entity, as a share of the entity's own
information. Few sightings prove little, so the share shrinks by (t / (t + 1)) ** 2, where t different texts hold both; this is
the disclosure. It nears 1 for a term that is seen often, and only where the entity is: leaving it in would leave the entity
readable. Terms over ``generalise`` become a general word that tells the term's form, terms over ``remove`` go, wherever they
stand in a document with the entity. Copies of one text are no evidence: they count as rows, and t is of texts.

No pair is joined of a term that could not disclose anything: t texts must be enough for the threshold, and as a pair is no
more frequent than its term, a term in n documents tells an entity in m of N no more than log(N / n) / log(N / m). Pairs are
counted in the tasks that hold the texts, before they are shuffled.

Nulls count as empty texts. Rows with the same text get the same spans. Rows of an empty table give no rows. Ties need
no rule, for each term is judged on its own counts. Input columns other than doc_id and text are left out.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.llm import spans as S
from storyline.llm.common import materialize, texts, unused

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
WORD = r"(?<![\p{L}\p{N}])\p{L}++(?![\p{L}\p{N}])"
#: Bits of the map of wanted values: 128 KiB, whatever the data. What passes it in error is dropped by an exact join.
MAP_BITS = 1 << 20
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "gone": "", "code": "[CODE]", "name": "[NAME]", "term": "[TERM]"}

# The patterns below find what the plain patterns find, but in linear time and without recursion: a match can start only
# where the run of its first class starts or where the last match ended, and the quantifiers need no way back.
_NAME = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_NAME})|\G){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _holds(kind: str) -> Callable[[Column], Column]:
    """What a match of the kind has to fulfil besides its pattern."""
    if kind == "ip":
        return lambda s: s["value"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return lambda s: F.length(_digits(s["value"])).between(12, 19) & F.call_function("luhn_check", _digits(s["value"]))
    if kind == "phone":
        return lambda s: F.length(_digits(s["value"])).between(9, 15)
    return lambda s: F.lit(True)


def base_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """docs with the spans of the base patterns, sorted."""
    t = F.col(text)
    only_if = {"email": F.instr(t, "@") > 0, "phone": F.instr(t, "+") > 0}
    kept = [c for c in docs.columns if c != out]
    found = docs.select(*kept, *(c for k, p in PATTERNS.items() for c in S.found(f"_{k}", t, p, only_if.get(k))))
    each = [F.filter(S.placed(f"_{k}", k, i), _holds(k)) for i, k in enumerate(KINDS)]
    return found.select(*kept, F.array_sort(F.concat(*each)).alias(out))


def _entities(spans: Column) -> Column:
    """What the spans protect, each once: the values in plain form, the part that others share, and the kinds."""

    def each(s: Column) -> Column:
        v, kind = s["value"], s["kind"]
        plain = F.when(kind == "email", F.lower(v)).when(kind == "ip", v).otherwise(_digits(v))
        code = F.substring(F.regexp_extract(v, "^[+]([0-9]+)", 1), 1, 3)
        shared = F.when(kind == "email", F.substring_index(F.lower(v), "@", -1)).when(kind == "ip", F.substring_index(v, ".", 2)).when(kind == "card", F.substring(plain, 1, 6)).otherwise(code)
        return F.array(F.concat_ws(":", kind, plain), F.concat_ws(":", kind, F.lit("part"), shared), kind)

    return F.array_distinct(F.flatten(F.transform(spans, each)))


def least_texts(generalise: float) -> int:
    """So few texts that t / (t + 1) squared can reach the threshold."""
    t = 1
    while (t / (t + 1)) ** 2 < generalise:
        t += 1
    return t


def _text_key(text: Column) -> Column:
    """Tells texts apart: 64 bits of hash, 32 of checksum, and the length."""
    return F.struct(F.xxhash64(text).alias("h"), F.crc32(text).alias("c"), F.octet_length(text).alias("n"))


def _among(value: Column, wanted: DataFrame) -> Column:
    """Whether a value may be one of wanted, a table of one column: true for each that is, and by chance for some others. A bit map
    of fixed size; it keeps most other rows out of the exact joins that follow."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    bits = wanted.select(place(F.col(wanted.columns[0])).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    cells = dict(bits.collect())  # MAP_BITS / 64 rows at most
    bit_map = F.from_json(F.lit(json.dumps([cells.get(i, 0) for i in range(MAP_BITS // 64)])), "array<bigint>")
    return F.getbit(F.get(bit_map, F.shiftright(place(value), 6).cast("int")), place(value).bitwiseAND(F.lit(63)).cast("int")) == 1


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def _told(docs: DataFrame, seen: DataFrame, generalise: float, remove: float) -> DataFrame | None:
    """text_hash, and the terms of the text that tell one of its entities: gone and general. docs: text_hash and text; seen: text_hash
    and spans of all rows."""
    total, least = max(seen.count(), 1), least_texts(generalise)
    holds = seen.filter(F.size("spans") > 0).select("text_hash", _entities(F.col("spans")).alias("entities"))
    of_text = holds.groupBy("text_hash", "entities").agg(F.count("*").alias("copies")).select("text_hash", "copies", F.explode("entities").alias("entity"))
    entities = of_text.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("texts"))
    entities = materialize(entities.filter((F.col("texts") >= least) & (F.col("n_entity") < total)).drop("texts"), "pii-entities")
    most = entities.agg(F.max("n_entity")).first()[0]
    if most is None:
        return None
    held = of_text.join(entities.select("entity"), "entity").groupBy("text_hash", "copies").agg(F.collect_list("entity").alias("entities"))
    held = materialize(held, "pii-held")
    # One row for each text that holds an entity: its entities and its words. All pairs are of these rows.
    blank = S.replaced(F.col("text"), F.col("spans"), lambda s: F.lit(" "))
    some = base_spans(docs.filter(_among(F.col("text_hash"), held.select("text_hash")))).select("text_hash", _words(blank).alias("terms"))
    near = materialize(some.dropDuplicates(["text_hash"]).join(held, "text_hash"), "pii-near")
    # In enough of these texts, and in so few documents that the term could tell the most frequent entity.
    shared = near.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("c")).filter(F.col("c") >= least)
    shared = materialize(shared.select("term"), "pii-shared")
    rare = math.exp(math.log(total) - generalise * (math.log(total) - math.log(most))) * (1 + 1e-9)
    each = docs.select(F.explode(_words(F.col("text"))).alias("term"))
    n_term = each.filter(_among(F.col("term"), shared)).groupBy("term").agg(F.count("*").alias("n_term")).filter(F.col("n_term") <= rare)
    n_term = materialize(n_term.join(shared, "term", "left_semi"), "pii-terms")
    # Counted by pair before the shuffle: texts have few entities in common.
    pairs = near.select("copies", "entities", F.explode("terms").alias("term")).filter(_among(F.col("term"), n_term.select("term")))
    pairs = pairs.select("copies", "term", F.explode("entities").alias("entity")).groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.count("*").alias("texts"))
    pairs = pairs.filter(F.col("texts") >= least).join(n_term, "term").join(entities, "entity")
    own = F.log2(F.lit(float(total)) / F.col("n_entity"))
    disclosure = F.log2(F.lit(float(total)) * F.col("n_both") / (F.col("n_term") * F.col("n_entity"))) / own * F.pow(F.col("texts") / (F.col("texts") + 1), 2)
    told = pairs.withColumn("disclosure", disclosure).filter(F.col("disclosure") >= generalise - 1e-9).select("entity", "term", (F.col("disclosure") >= remove - 1e-9).alias("gone"))
    told = materialize(told, "pii-pairs")
    marked = near.select("text_hash", "entities", F.explode("terms").alias("term")).filter(_among(F.col("term"), told.select("term").distinct()))
    marked = marked.select("text_hash", "term", F.explode("entities").alias("entity")).join(told, ["entity", "term"]).groupBy("text_hash", "term").agg(F.max("gone").alias("gone"))
    of = lambda gone: F.collect_list(F.when(F.col("gone") == gone, F.col("term")))
    return materialize(marked.groupBy("text_hash").agg(of(True).alias("gone"), of(False).alias("general")), "pii-told")


def _term_spans(docs: DataFrame, told: DataFrame) -> DataFrame:
    """text_hash and more: the spans of telling terms outside the base spans. Their value says how they are replaced."""
    some = docs.filter(_among(F.col("text_hash"), told.select("text_hash"))).join(told, "text_hash")
    found = base_spans(some).select("text_hash", "spans", "gone", "general", *S.found("_word", F.col("text"), WORD))
    flag = lambda names: F.map_from_arrays(names, F.transform(names, lambda _: F.lit(True)))
    found = found.select("text_hash", "spans", flag(F.col("gone")).alias("gone"), flag(F.col("general")).alias("general"), S.placed("_word", TERM, len(KINDS)).alias("words"))
    form = lambda v: F.when(v.rlike(r"^\p{Lu}\p{Lu}"), "code").when(v.rlike(r"^\p{Lu}"), "name").otherwise("term")

    def how(s: Column) -> Column:
        word = F.lower(s["value"])
        return F.when(F.element_at("gone", word).isNotNull(), "gone").when(F.element_at("general", word).isNotNull(), form(s["value"]))

    said = F.filter(F.transform("words", lambda s: S.span(s["start"], s["ord"], s["end"], s["kind"], how(s))), lambda s: s["value"].isNotNull())
    free = F.filter(said, lambda s: ~F.exists("spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return found.select("text_hash", free.alias("more")).dropDuplicates(["text_hash"])


def find(docs: DataFrame, generalise: float = 0.5, remove: float = 0.7) -> DataFrame:
    """doc_id, text_hash and spans (base and term; a term's value says what takes its place) for each row of docs."""
    docs = texts(docs).withColumn("text_hash", _text_key(F.col("text")))
    seen = materialize(base_spans(docs).select("doc_id", "text_hash", "spans"), "pii-base")
    told = _told(docs.select("text_hash", "text"), seen.select("text_hash", "spans"), generalise, remove)
    if told is None or told.isEmpty():
        return seen
    more = _term_spans(docs.select("text_hash", "text"), told)
    back = seen.join(more, "text_hash", "left")
    return back.select("doc_id", "text_hash", F.array_sort(F.concat("spans", F.coalesce("more", S.none()))).alias("spans"))


def sanitise(docs: DataFrame, **limits: float) -> DataFrame:
    """docs with base values and telling terms replaced in text; all other columns and all rows stay. A null text stays null."""
    own, h, found = (unused(docs, name) for name in ("_hash", "_h", "_spans"))
    keyed = docs.withColumn(own, _text_key(F.coalesce("text", F.lit(""))))
    got = find(docs, **limits).filter(F.size("spans") > 0).select(F.col("text_hash").alias(h), F.col("spans").alias(found)).dropDuplicates([h])
    both = keyed.join(got, F.col(own) == F.col(h), "left")
    labels = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    label = lambda s: F.element_at(labels, F.when(s["kind"] == TERM, s["value"]).otherwise(s["kind"]))
    clean = F.when(F.col(found).isNotNull(), S.replaced(F.col("text"), F.col(found), label)).otherwise(F.col("text"))
    return both.withColumn("text", clean).select(*docs.columns)
