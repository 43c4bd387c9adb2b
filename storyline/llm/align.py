"""Alignment of two tokenizations of the same text by a transducer over dangling suffixes.

Both tokenizers spell the same bytes. The transducer reads tokens of both and remembers only which side leads and the bytes
it has spelled beyond the other, a suffix of its last token. It always reads the side that lags: its token either is used up
by the residual, or is longer and takes the lead with what is left over. An empty residual closes a group, and both sides are read.
A transition depends on the residual and the token alone, so it is worked out once and then looked up. A token read while the
residual is not empty overlaps the leader's last token, and that is every overlap there is: it is a link.

Links are counted over the corpus by id pair. Pairs are counted within batches of documents before they are shuffled; the
most frequent ones, up to ``MOST_PAIRS``, and the highest count of each id of side B, a bound by its vocabulary, are broadcast;
pairs beyond that are joined with their counts, so that none is left out.

Null and empty texts, and texts that either side does not spell byte by byte after a space (a normalised letter, a sign of
the vocabulary's own for the space), have no tokens: zeros and an empty string. Every row counts, repeated ones too; equal counts
are all highest. Input columns other than doc_id and text are left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.llm.bpe import PRE_SPLIT, byte_letters
from storyline.llm.common import in_arrow, in_slices, materialize, texts, worker_table

#: Transitions that a worker remembers; when there are more it forgets all and starts anew, which only costs time.
MOST_STEPS = 600_000
#: Pairs whose counts are broadcast, 16 bytes each; pairs that a task counts before it hands them on.
MOST_PAIRS, AT_ONCE = 1 << 20, 1 << 21
TOKEN_BITS = 20


class Transducer:
    """States are numbered: 0 is the empty residual, even ones have B in the lead and odd ones A, so a state's last bit tells
    whose turn it is. From the empty residual a token of each side is read at once: the first of them leads, the second lags."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.spelled = (a, b)
        self._forget()

    def _forget(self) -> None:
        self.residual: list[bytes] = [b"", b""]
        self.number: dict[tuple[bytes, int], int] = {}
        self.steps: dict[int, int] = {}
        self.starts: dict[int, int] = {}

    def _state(self, residual: bytes, leader: int) -> int:
        """The state with that residual, of A (0) or B (1)."""
        if not residual:
            return 0
        found = self.number.get((residual, leader))
        if found is None:
            found = self.number[residual, leader] = len(self.residual) + 1 - leader
            self.residual += [residual, residual]
        return found

    def _after(self, rest: bytes, more: bytes, turn: int) -> int:
        """The state after the lagging side's token, -1 if the sides spell different bytes."""
        if not rest or not more or not (more.startswith(rest) or rest.startswith(more)):
            return -1
        if len(more) < len(rest):
            return self._state(rest[len(more) :], 1 - turn)
        return self._state(more[len(rest) :], turn)

    def step(self, key: int) -> int:
        """The state after a token in a state with a residual."""
        state, token = key >> TOKEN_BITS, key & (1 << TOKEN_BITS) - 1
        to = self.steps[key] = self._after(self.residual[state], self.spelled[state & 1][token], state & 1)
        return to

    def start(self, key: int) -> int:
        """The state after a token of A and one of B from the empty residual."""
        to = self.starts[key] = self._after(self.spelled[0][key >> TOKEN_BITS], self.spelled[1][key & (1 << TOKEN_BITS) - 1], 1)
        return to

    def run(self, a: list[int], b: list[int]) -> list[int] | None:
        """The state after each token that met a residual, which is one for each link; None if the sides do not spell the same bytes."""
        if len(self.steps) + len(self.starts) > MOST_STEPS:
            self._forget()
        next_a, next_b = iter(a).__next__, iter([*b, -1]).__next__  # -1 is no token: whatever it is read with is negative
        step, start, state, path = self.steps.get, self.starts.get, 0, []
        put = path.append
        try:
            while True:
                if state == 0:
                    key = next_a() << TOKEN_BITS | next_b()
                    state = start(key)
                    if state is None:
                        state = self.start(key) if key >= 0 else -1
                else:
                    key = state << TOKEN_BITS | (next_b() if state & 1 else next_a())
                    state = step(key)
                    if state is None:
                        state = self.step(key) if key >= 0 else -1
                if state < 0:
                    return None
                put(state)
        except StopIteration:
            return path if state == 0 and next_b() < 0 else None


class Pair:
    """Both tokenizers, what their ids spell, and the transducer between them."""

    def __init__(self, bpe: str, piece: bytes):
        import sentencepiece
        import tiktoken

        letters = byte_letters()
        read = json.loads(bpe)
        special = {x["content"] for x in read["added_tokens"]}
        ranks = {bytes(letters[x] for x in s): i for s, i in read["model"]["vocab"].items() if s not in special}
        # Merges of this kind of vocabulary stand in the order of the ids they make, so the ids are the ranks.
        self.a = tiktoken.Encoding("align", pat_str=PRE_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece)
        spelled_a = [b""] * (max(ranks.values()) + 1)
        for s, i in ranks.items():
            spelled_a[i] = s
        n = self.b.get_piece_size()
        spelled_b = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(n)
        ]
        self.size_b = n
        self.transducer = Transducer(spelled_a, spelled_b)
        self.length_a = np.array([len(x) for x in spelled_a])
        # Each id as it stands in the text of groups: within a group, at the end of a group's side, and (B) at the text's end.
        digits_a = [f"{i}{end}" for i in range(len(spelled_a)) for end in (",", "|")]
        digits_b = [f"{i}{end}" for i in range(n) for end in (",", ";", "")]
        self.first_b = len(digits_a)
        self.digits = pa.array(digits_a + digits_b, pa.large_binary())

    def aligned(self, said: list[str]) -> tuple[dict[str, np.ndarray], list[bytes]]:
        """For each text the numbers of tokens, groups and links, its groups as text; and for all links their text and pair."""
        ids_a = [x.tolist() for x in map(self.a.encode_to_numpy, [" " + t for t in said])]
        ids_b = self.b.encode(said, num_threads=1)
        n_a, n_b, n_links = (np.zeros(len(said), np.int64) for _ in range(3))
        path: list[int] = []
        flat_a: list[int] = []
        flat_b: list[int] = []
        spelled = self.transducer.spelled[0]
        for k, t in enumerate(said):
            if t and (way := self.transducer.run(ids_a[k], ids_b[k])) is not None and b"".join([spelled[i] for i in ids_a[k]]) == b" " + t.encode():
                path += way
                flat_a += ids_a[k]
                flat_b += ids_b[k]
                n_a[k], n_b[k], n_links[k] = len(ids_a[k]), len(ids_b[k]), len(way)
            ids_a[k] = ids_b[k] = None
        state = np.array(path, np.int64)
        before = np.concatenate([[0], state[:-1]]) if len(state) else state
        # Each entry is a link: of the last tokens read of both sides. From the empty residual both sides were read.
        at_a, at_b = np.cumsum(before & 1 ^ 1), np.cumsum((before & 1) | (before == 0))
        a, b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        closes = state == 0
        end_a, end_b = at_a[closes], at_b[closes]
        groups = np.concatenate([[0], np.cumsum(closes)])[np.concatenate([[0], np.cumsum(n_links)])]
        pairs = a[at_a - 1] * self.size_b + b[at_b - 1]
        return {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(groups), "n_links": n_links, "pairs": pairs}, self._groups(a, b, end_a, end_b, n_a, n_b)

    def _groups(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[bytes]:
        """a1,a2|b1;a3|b2,b3 of each text."""
        if not len(a):
            return [b""] * len(n_a)
        size_a, size_b = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)
        out = np.empty(len(a) + len(b), np.int64)
        a_at = np.arange(len(a)) + np.repeat(end_b - size_b, size_a)
        b_at = np.arange(len(b)) + np.repeat(end_a, size_b)
        kind_a, kind_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        kind_a[end_a - 1] = kind_b[end_b - 1] = 1
        ends_b = np.cumsum(n_b)[n_b > 0]
        kind_b[ends_b - 1] = 2
        out[a_at] = a * 2 + kind_a
        out[b_at] = self.first_b + b * 3 + kind_b
        spelled = self.digits.take(pa.array(out))
        offsets = np.frombuffer(spelled.buffers()[1], np.int64)[spelled.offset : spelled.offset + len(spelled) + 1]
        data, cut = memoryview(spelled.buffers()[2]), offsets[np.concatenate([[0], np.cumsum(n_a + n_b)])]
        return [data[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]


def _distinct(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of their numbers (of ones)."""
    if n is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def align(docs: DataFrame, bpe: str, piece: str, spell: bool = False) -> DataFrame:
    """A row for each document: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs
    of linked ids as packed int64 ``pairs`` (a * size of B + b, rising) and int32 ``times``. With ``spell`` the groups as text in
    ``groups``. bpe and piece are paths of vocabulary files, read on the driver."""
    spark = docs.sparkSession
    with open(bpe, encoding="utf-8") as f, open(piece, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))
    owner = (bpe, piece)
    rows = texts(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = worker_table(__name__, owner, lambda: Pair(*files.value))
        for s in in_slices(batches):
            found, groups = pair.aligned([t or "" for t in s.column("text").to_pylist()])
            texts_of = np.repeat(np.arange(s.num_rows), found["n_links"])
            # Text and pair in one number: a slice has at most 1,024 rows.
            keys, times = _distinct(texts_of << 40 | found["pairs"])
            cut = np.searchsorted(keys, np.arange(s.num_rows + 1) << 40)
            keys, times = keys & (1 << 40) - 1, times.astype(np.int32)
            packed = [keys[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], [times[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            columns = [
                s.column("row"), s.column("doc_id"), *(pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                pa.array([hashlib.sha256(g).hexdigest() if len(g) else "" for g in groups], pa.string()), *(pa.array(x, pa.binary()) for x in packed),
            ]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
            if spell:
                columns.append(pa.array([bytes(g).decode() for g in groups], pa.string()))
                names.append("groups")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary" + (", groups string" if spell else "")
    return in_arrow(rows, run, schema)


def _unpacked(b: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.frombuffer(x, np.int64) for x in b.column("pairs").to_pylist()], [np.frombuffer(x, np.int32) for x in b.column("times").to_pylist()]


def counts(aligned: DataFrame) -> DataFrame:
    """pair and n, its links in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])
        keys, n, waiting = [], [], 0
        for b in batches:
            k, t = _unpacked(b)
            keys += k
            n += [x.astype(np.int64) for x in t]
            waiting += sum(map(len, k))
            if waiting > AT_ONCE:
                one, some = _distinct(np.concatenate(keys), np.concatenate(n))
                keys, n, waiting = [one], [some], len(one)
                if waiting > AT_ONCE // 2:
                    yield put(one, some)
                    keys, n, waiting = [], [], 0
        if waiting:
            yield put(*_distinct(np.concatenate(keys), np.concatenate(n)))

    return in_arrow(aligned.select("pairs", "times"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _frequent(counted: DataFrame, most: int) -> int:
    """The least power of two such that at most so many pairs have as many links; a count by levels tells it."""
    levels = {r.level: r.n for r in counted.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    held, level = 0, max(levels, default=0) + 1
    while level > 0 and held + levels.get(level - 1, 0) <= most:
        level -= 1
        held += levels.get(level, 0)
    return 1 << level if level else 0


def score(docs: DataFrame, bpe: str, piece: str, most: int = MOST_PAIRS, spell: bool = False) -> DataFrame:
    """align() with n_best, the links whose pair has the most links of all pairs of its id of B, and count_sum, the sum over links
    of their pair's links in the corpus."""
    spark = docs.sparkSession
    with open(piece, "rb") as g:
        import sentencepiece

        size_b = sentencepiece.SentencePieceProcessor(model_proto=g.read()).get_piece_size()
    aligned = materialize(align(docs, bpe, piece, spell), "aligned")
    counted = materialize(counts(aligned), "pairs")
    least = _frequent(counted, most)
    frequent = counted.filter(F.col("n") >= least).select("pair", "n").toArrow()
    keys, n = frequent.column("pair").to_numpy(), frequent.column("n").to_numpy()
    order = np.argsort(keys)
    best = counted.groupBy((F.col("pair") % size_b).cast("int").alias("b")).agg(F.max("n").alias("n")).toArrow()
    highest = np.zeros(size_b, np.int64)
    highest[best.column("b").to_numpy()] = best.column("n").to_numpy()
    told = spark.sparkContext.broadcast((keys[order], n[order], highest))
    rest = least > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, highest = told.value
        for b in batches:
            n_best, count_sum, open_pairs, open_times = [], [], [], []
            for pairs, times in zip(*_unpacked(b), strict=True):
                at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                found = n[at[known]]
                count_sum.append(int((found * times[known]).sum()))
                n_best.append(int(times[known][found == highest[pairs[known] % size_b]].sum()))
                open_pairs.append(pairs[~known])
                open_times.append(times[~known])
            columns = [*(b.column(c) for c in kept), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())]
            names = [*kept, "n_best", "count_sum"]
            if rest:
                columns += [pa.array(open_pairs, pa.list_(pa.int64())), pa.array(open_times, pa.list_(pa.int32()))]
                names += ["open", "open_times"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    fields = {c: aligned.schema[c].dataType.simpleString() for c in kept} | {"n_best": "bigint", "count_sum": "bigint"}
    fields |= {"open": "array<bigint>", "open_times": "array<int>"} if rest else {}
    scored = in_arrow(aligned, run, ", ".join(f"{c} {t}" for c, t in fields.items()))
    if not rest:
        return scored.drop("row")
    scored = materialize(scored, "scored")
    return _with_rare(scored, counted.filter(F.col("n") < least), counted, size_b).drop("row")


def _with_rare(scored: DataFrame, rare: DataFrame, counted: DataFrame, size_b: int) -> DataFrame:
    """The links of pairs that were not broadcast, joined with their counts. A rare pair has few links, so no key is hot."""
    best = counted.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("highest"))
    rare = rare.join(F.broadcast(best), F.col("pair") % size_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("highest")).alias("is_best"))
    x: Column = F.col("x")
    links = scored.select("row", F.explode(F.arrays_zip(F.col("open").alias("pair"), F.col("open_times").alias("times"))).alias("x")).select("row", x["pair"].alias("pair"), x["times"].cast("long").alias("times"))
    more = links.join(rare, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best"))
    both = scored.drop("open", "open_times").join(more, "row", "left")
    return both.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).drop("more_best", "more_sum")
