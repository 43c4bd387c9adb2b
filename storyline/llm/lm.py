"""Language-model scores from a log-frequency Bloom filter.

All words and word pairs of the training texts are counted; a count c becomes the level 1 + floor(log_BASE c), and the
n-gram is put in the filter once for each level up to its own. A scorer probes level after level until one is missing:
the last one found is the quantised count. A wrong bit can only raise it, and each further level needs further wrong
bits. The score is the log10 probability under word pairs, p(w | v) = (c(v w) + MASS p(w)) / (c(v) + MASS), where p(w) is
the single word's probability smoothed by half a count, and all counts of n-grams are the quantised ones.

The filter is cut in sections by a hash of the n-gram. Tasks send the fingerprints of their n-grams, counted before the
shuffle, to the sections; the number of sections grows with the corpus, so that a section's task does not. A table holds all
counted n-grams and their levels. The filter of those of a high enough level is broadcast: all of them while BITS for
each level fit in MOST_BITS, and else the levels from the least on with which they do. N-grams of the texts that are not in it
are then joined with the rest of the table. So nothing is left out at any size, and what is broadcast has a bound.

The base score is exact. Counts of the FREQUENT most frequent words are broadcast; the other words of each document
are joined with their counts.

Null texts count as empty: they have one token, the end. Texts whose id is null are trained on. Repeated rows are
counted and scored as rows of their own; words of equal frequency go by their bytes. Columns other than doc_id and text
are left out. An empty table has no rows; without training texts all counts are 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import in_arrow, in_slices, materialize, texts, worker_table

END = b"\n"  # no word holds white space
#: The last level is that of counts over 10 ** 13.
BASE, PROBES, LEVELS, BITS, MOST_BITS = 1.6, 4, 66, 10, 1 << 30
FREQUENT = 100_000
MASS = 32.0
#: Words that a task counts, tokens whose n-grams it holds, n-grams that meet in a section, and hashes probed together.
MOST_COUNTED, MOST_HELD, SECTION_ROWS, PROBED_AT_ONCE = 400_000, 1_000_000, 500_000, 1 << 16
MOST_WORDS = 100_000
#: At most two to the power of so many sections, 16 bytes each in what is broadcast; from 5 * 10 ** 11 n-grams on sections get longer.
MOST_SECTIONS = 20
_A, _B, _C = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column, of: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % of == 1, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode().lower().split()
    out.append(END)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _A
    x = (x ^ (x >> np.uint64(33))) * _B
    return x ^ (x >> np.uint64(33))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * _C + (second ^ (second >> np.uint64(29))) * _A)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Words(NamedTuple):
    """The frequent words, the most frequent first, and the totals of the training texts."""

    index: dict[bytes, int]
    count: np.ndarray
    total: int
    distinct: int

    def unit(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


def count_words(docs: DataFrame) -> DataFrame:
    """token and c, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])
            seen.clear()
            return got

        for b in in_slices(batches):
            for t in b.column("text").to_pylist():
                seen.update(tokens(t))
            if len(seen) >= MOST_COUNTED:
                yield out()
        yield out()

    return in_arrow(docs.select("text"), run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        h = self[word] = word_hash(word)
        return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(worker_table(__name__, "words", _Hashes).__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each token and the one before it; before a text's first token stands an end."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[starts] = word_hash(END)
    return pair_hash(before, h)


def key(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Section and 32-bit fingerprint."""
    return h >> np.uint64(64 - bits), (h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)


PACKED = ("section", "once", "more", "counts")


def packed(held: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """A row for each section with the fingerprints of the hashes: those held once, those held more often, and how often."""
    h, n = np.unique(np.concatenate(held), return_counts=True)
    section, print_ = key(h, bits)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(section)) + 1, [len(h)]])
    print_, many = print_.astype(np.uint32), n > 1
    rows = []
    for a, b in zip(starts, starts[1:], strict=False):
        p, m, c = print_[a:b], many[a:b], n[a:b]
        rows.append((int(section[a]), p[~m].tobytes(), p[m].tobytes(), c[m].astype(np.uint32).tobytes()))
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(PACKED))


def unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of one section and their counts over all of its rows."""
    read = lambda c: np.frombuffer(b"".join(t[c].to_pylist()), np.uint32)
    once, more = read("once"), read("more")
    print_, back = np.unique(np.concatenate([once, more]), return_inverse=True)
    return print_, np.bincount(back, np.concatenate([np.ones(len(once)), read("counts")]), len(print_))


def _ngrams(train: DataFrame, bits: int) -> DataFrame:
    """section, prints, levels and n_bits (by level from the first on, of n-grams of that level) of all n-grams."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in in_slices(batches):
            each = [tokens(t) for t in b.column("text").to_pylist()]
            h = word_hashes([w for t in each for w in t])
            held += [h, grams(h, np.cumsum([0] + [len(t) for t in each[:-1]]))]
            size += len(h)
            if size >= MOST_HELD:
                yield packed(held, bits)
                held.clear()
                size = 0
        if held:
            yield packed(held, bits)

    def meet(group: tuple, t: pa.Table) -> pa.Table:
        print_, n = unpacked(t)
        level = levels(n)
        each = np.bincount(level, minlength=LEVELS + 1)[1:] * np.arange(1, LEVELS + 1) * BITS
        cells = ([group[0].as_py()], [print_.tobytes()], [level.astype(np.uint8).tobytes()], [each.tolist()])
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("section", "prints", "levels", "n_bits"), cells, kinds, strict=True)})

    sent = in_arrow(train.select("text"), send, "section int, once binary, more binary, counts binary")
    return materialize(sent.groupBy("section").applyInArrow(meet, "section int, prints binary, levels binary, n_bits array<long>"), "lm-grams")


def _level(h: np.ndarray, j: int) -> np.ndarray:
    return mixed(h + np.uint64(j * int(_C) & 0xFFFFFFFFFFFFFFFF))


def _probe(g: np.ndarray, k: int, size: np.ndarray) -> np.ndarray:
    """The bit of probe k within the section, from the hash of n-gram and level."""
    step = (g >> np.uint64(32)) | np.uint64(1)
    return (((g + np.uint64(k) * step) & np.uint64(0xFFFFFFFFFFFF)) % size).astype(np.int64)


def levels(count: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(np.maximum(count, 1)) / math.log(BASE) + 1e-9), LEVELS).astype(np.int64)


def build_section(h: np.ndarray, level: np.ndarray, most_bits: int | None = None) -> np.ndarray:
    """The section's bits, packed. Where they would pass most_bits, all entries stay, the least frequent with one level, and
    the bits are shared by more entries."""
    size = max(64, -(-int(level.sum()) * BITS // 8) * 8)
    if most_bits is not None:
        order = np.argsort(-level, kind="stable")
        h, level = h[order], level[order].copy()
        more = max(most_bits - len(h) * BITS, most_bits // 4)
        level[int(np.searchsorted(np.cumsum(level - 1) * BITS, more, side="right")) :] = 1
        size = max(64, min(-(-int(level.sum()) * BITS // 8) * 8, most_bits // 8 * 8))
    bits = np.zeros(size, np.bool_)
    for j in range(1, LEVELS + 1):
        some = h[level >= j]
        if not len(some):
            break
        g = _level(some, j)
        for k in range(PROBES):
            bits[_probe(g, k, np.uint64(size))] = True
    return np.packbits(bits)


class Filter(NamedTuple):
    data: np.ndarray
    start: np.ndarray
    size: np.ndarray  # bits of each section

    def level(self, print_: np.ndarray, section: np.ndarray) -> np.ndarray:
        """Level of each fingerprint, 0 if it is not held."""
        out = np.zeros(len(print_), np.int64)
        if len(self.size):
            for k in range(0, len(print_), PROBED_AT_ONCE):
                out[k : k + PROBED_AT_ONCE] = self._level(print_[k : k + PROBED_AT_ONCE], section[k : k + PROBED_AT_ONCE].astype(np.int64))
        return out

    def _level(self, h: np.ndarray, section: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(h), np.int64), np.arange(len(h))
        start, size = self.start[section], self.size[section].astype(np.uint64)
        for j in range(1, LEVELS + 1):
            g = _level(h, j)
            for k in range(PROBES):
                at = _probe(g, k, size)
                held = (self.data[start + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                if not held.all():
                    h, rows, start, size, g = h[held], rows[held], start[held], size[held], g[held]
                if not len(rows):
                    return out
            out[rows] = j
        return out


def quantised(level: np.ndarray) -> np.ndarray:
    """The count that stands for a level: 0, 1, and from then on the middle of the level."""
    return np.where(level <= 1, level, (BASE ** (level - 1.0) + BASE**level) / 2)


def assembled(got: dict[int, bytes], sections: int) -> Filter:
    """The filter of these sections, which are let go one after another: the driver never holds it twice."""
    length = np.array([len(got.get(k, bytes(8))) for k in range(sections)], np.int64)
    start, data = np.cumsum(length) - length, np.zeros(int(length.sum()), np.uint8)
    for k in list(got):
        bits = np.frombuffer(got.pop(k), np.uint8)
        data[start[k] : start[k] + len(bits)] = bits
    return Filter(data, start, length * 8)


def _filter(table: DataFrame, bits: int) -> tuple[Filter, int]:
    """The filter of the n-grams from the least level on with which it fits, and that level."""
    each = table.select(F.posexplode("n_bits").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()  # LEVELS rows
    need = dict(each)
    least = LEVELS + 1
    while least > 1 and sum(need.get(k, 0) for k in range(least - 2, LEVELS)) <= MOST_BITS:
        least -= 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for section, prints, level in zip(*(b.column(c).to_pylist() for c in ("section", "prints", "levels")), strict=True):
                level = np.frombuffer(level, np.uint8).astype(np.int64)
                some = level >= least
                if some.any():
                    data = build_section(np.frombuffer(prints, np.uint32)[some].astype(np.uint64), level[some])
                    yield pa.RecordBatch.from_arrays([pa.array([section], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["section", "data"])

    built = materialize(in_arrow(table.select("section", "prints", "levels"), build, "section int, data binary"), "lm-filter")
    return assembled({r["section"]: r["data"] for r in built.toLocalIterator()}, 1 << bits), least  # MOST_BITS in all


class Model(NamedTuple):
    words: Words
    filter: Filter
    bits: int  # of the section
    least: int  # the level from which on the filter holds all n-grams


def fit(train: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the table of all words' counts (token and c) and that of all n-grams."""
    counts = materialize(count_words(train), "lm-words")
    totals = counts.agg(F.sum("c"), F.count("*")).first()
    total = totals[0] or 0
    top = counts.orderBy(F.desc("c"), "token").limit(FREQUENT).toArrow()
    words = Words({t: i for i, t in enumerate(top["token"].to_pylist())}, top["c"].to_numpy().astype(np.float64), total, totals[1])
    bits = min(MOST_SECTIONS, max(4, (2 * total // SECTION_ROWS).bit_length()))
    table = _ngrams(train, bits)
    found, least = _filter(table, bits)
    return Model(words, found, bits, least), counts, table


#: What a token of a text still asks for: the hashes of the pair, of the word before and of the word itself, null where the level is known.
ASKS = "asks array<struct<at:int,hash:array<long>,level:array<int>>>"


def _probability(pair: Column, before: Column, word: Column, unit: float) -> Column:
    """log10 of a token's probability, from quantised counts."""
    single = (word + 0.5) / F.lit(unit)
    return F.log10((F.least(pair, before) + F.lit(MASS) * single) / (before + F.lit(MASS)))


def _scored(ids: list, said: list[str | None], m: Model) -> pa.RecordBatch:
    w = m.words
    flat: list[bytes] = []
    ends = [0]
    for t in said:
        flat.extend(tokens(t))
        ends.append(len(flat))
    starts = np.array(ends[:-1])
    sums = lambda x: np.add.reduceat(x, starts)
    i = np.fromiter((w.index.get(t, -1) for t in flat), np.int64, len(flat))
    frequent = i >= 0
    log = np.zeros(len(i))
    log[frequent] = np.log10(w.count[i[frequent]] + 0.5)
    rest = np.flatnonzero(~frequent)

    h = word_hashes(flat)
    pairs = grams(h, starts)
    each, back = np.unique(np.concatenate([h, pairs, [np.uint64(word_hash(END))]]), return_inverse=True)
    section, print_ = key(each, m.bits)
    level = m.filter.level(print_, section)
    level[level < m.least] = 0
    level = level[back]
    word, pair = level[: len(h)], level[len(h) : -1]
    before = np.concatenate([level[-1:], word[:-1]])
    before[starts] = level[-1]
    c = quantised(before)
    p = (np.minimum(quantised(pair), c) + MASS * (quantised(word) + 0.5) / w.unit()) / (c + MASS)
    known = np.log10(p)
    asks = []
    if m.least > 1:  # what the filter doesn't hold is joined
        open_ = (word == 0) | (pair == 0) | (before == 0)
        known[open_] = 0.0
        prior = np.concatenate([[np.uint64(0)], h[:-1]])
        prior[starts] = word_hash(END)
        for a, b in zip(ends, ends[1:], strict=False):
            asks.append([{"at": int(k - a), "hash": [int(x) if n == 0 else None for x, n in zip(np.array([pairs[k], prior[k], h[k]]).view(np.int64), (pair[k], before[k], word[k]), strict=True)], "level": [int(pair[k]), int(before[k]), int(word[k])]} for k in a + np.flatnonzero(open_[a:b])])
    else:
        asks = [[]] * len(ids)

    offsets = np.concatenate([[0], np.cumsum(sums((~frequent).astype(np.int64)))]).astype(np.int32)
    tail = pa.ListArray.from_arrays(pa.array(offsets), pa.array([flat[k] for k in rest], pa.binary()))
    kind = pa.list_(pa.struct([("at", pa.int32()), ("hash", pa.list_(pa.int64())), ("level", pa.list_(pa.int32()))]))
    out = [pa.array(ids, pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(sums(frequent.astype(np.int64)), pa.int64()), pa.array(sums(log)), pa.array(sums(known)), tail, pa.array(asks, kind)]
    return pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "n_frequent", "log", "score", "tail", "asks"])


def _asked(rows: DataFrame, table: DataFrame, m: Model) -> DataFrame:
    """row and the log10 probability of the tokens whose n-grams the filter does not hold. rows: row and asks."""

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for section, prints, level in zip(*(b.column(c).to_pylist() for c in ("section", "prints", "levels")), strict=True):
                level = np.frombuffer(level, np.uint8)
                some = level < m.least
                h = (np.uint64(section) << np.uint64(32)) | np.frombuffer(prints, np.uint32)[some]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(level[some].astype(np.int32))], ["gram", "found"])

    rest = in_arrow(table.select("section", "prints", "levels"), unroll, "gram long, found int")
    open_ = rows.select("row", F.inline("asks"))
    # The section's bits and the fingerprint's: what a section knows of a hash.
    gram = lambda h: F.shiftrightunsigned(h, 32 - m.bits)
    parts = open_.select("row", "at", F.posexplode("hash").alias("part", "h")).filter("h is not null").select("row", "at", "part", gram(F.col("h")).alias("gram"))
    known = open_.select("row", "at", F.posexplode("level").alias("part", "found")).filter("found > 0")
    every = parts.join(rest, "gram").select("row", "at", "part", "found").unionByName(known)
    level = lambda k: F.max(F.when(F.col("part") == k, F.col("found")))
    count = lambda c: F.when(c.isNull(), 0.0).when(c == 1, 1.0).otherwise((F.pow(F.lit(BASE), c - 1) + F.pow(F.lit(BASE), c)) / 2)
    # A token of which nothing is known has no row there: the number of asked tokens tells how many.
    got = every.groupBy("row", "at").agg(level(0).alias("pair"), level(1).alias("before"), level(2).alias("word"))
    p = _probability(count(F.col("pair")), count(F.col("before")), count(F.col("word")), m.words.unit())
    none = _probability(F.lit(0.0), F.lit(0.0), F.lit(0.0), m.words.unit())
    said = got.groupBy("row").agg(F.sum(p).alias("p"), F.count("*").alias("n"))
    asked = rows.select("row", F.size("asks").alias("asked")).filter("asked > 0")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return asked.join(said, "row", "left").select("row", (zero(F.col("p")) + (F.col("asked") - zero(F.col("n"))) * none).alias("more_score"))


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of docs, after learning from train."""
    model, counts, table = fit(texts(train))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            yield _scored(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), held.value)

    rows = in_arrow(texts(docs), run, "doc_id long, n_tokens long, n_frequent long, log double, score double, tail array<binary>, " + ASKS)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = rows.select("row", F.explode("tail").alias("token")).join(counts, "token", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.count("c").alias("known"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = F.col("log") + zero("more") - F.col("n_tokens") * math.log10(model.words.unit())
    full = rows.drop("tail", "asks").join(rare, "row", "left")
    if model.least > 1:
        full = full.join(_asked(rows.select("row", "asks"), table, model), "row", "left").withColumn("score", F.col("score") + zero("more_score"))
    return full.select(
        "doc_id", "n_tokens", (F.col("n_frequent") + zero("known")).alias("n_known"), F.lit(model.words.total).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )
