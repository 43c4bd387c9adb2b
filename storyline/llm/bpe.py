"""Byte-pair encoding and decoding by a deterministic automaton over tokens.

Compilation starts from one state with a loop for each byte and applies one gadget per merge, in rank order. The gadget
of a merge (a, b) -> c splits the state that follows a: the copy loses its arc b, every arc a is led to the copy, and
each state that had a followed by b gains an arc c. A string then has exactly one path, and its arc labels are the BPE
tokens. Here a state is named by the token that leads to it. A merge records which arc its gadget takes away
(``cut``), and a merged token records whose arcs it inherits and since which gadget (``right`` and ``born`` for the
state it leads to, ``left`` and ``born`` for the arc itself); ``step`` reads a transition off these tables and fills
the transition table with it. Decoding emits the labels.

Nulls count as empty texts; an empty text has no tokens. Rows are independent, so repeated rows and ties need no rule.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from storyline.llm.common import in_arrow, worker_table

#: Fixed value: the pre-split pattern that byte-level vocabularies of this kind are defined with.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds of the tables that a worker fills as it goes; a full table is emptied, which only costs time.
MOST_WORDS, MOST_STEPS, LONG_WORD = 200_000, 1_000_000, 64
ROWS_AT_ONCE = 512
START = -1


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Automaton:
    """Tables compiled from a vocabulary and its merges in rank order."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], added: dict[str, int]):
        self.ids = vocab
        self.added = added
        self.labels = dict((i, b) for b, i in vocab.items()) | {i: s.encode() for s, i in added.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        alive = {vocab[bytes([b])] for b in range(256) if bytes([b]) in vocab}
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b], alive)
        self.ids = {s: i for s, i in vocab.items() if i in alive}
        self.longest = max(map(len, self.ids), default=1)
        self.steps: dict[int, bool] = {}

    def _gadget(self, rank: int, a: int, b: int, c: int, alive: set[int]) -> None:
        if a not in alive or b not in alive or not self._open(a, b, rank):
            return  # no state has a followed by b: the gadget finds nothing to split
        self.cut[a, b] = rank
        if c not in alive:
            alive.add(c)
            self.left[c], self.right[c], self.born[c] = a, b, rank

    def _open(self, t: int, v: int, rank: int) -> bool:
        """Whether the state after t has an arc v once the gadgets before rank are in place."""
        state, until = t, rank
        while True:
            arc, since = v, rank - 1
            while True:
                at = self.cut.get((state, arc))
                if at is not None and at < until and at <= since:
                    return False
                if arc not in self.left:
                    break
                since, arc = self.born[arc], self.left[arc]
            if state not in self.right:
                return True
            until, state = self.born[state], self.right[state]

    def step(self, t: int, v: int) -> bool:
        key = t << 20 | v
        found = self.steps.get(key)
        if found is None:
            if len(self.steps) >= MOST_STEPS:
                self.steps.clear()
            found = self.steps[key] = self._open(t, v, 1 << 30)
        return found

    def run(self, word: bytes) -> tuple[int, ...]:
        """The labels of the one path that spells the word."""
        if not word:
            return ()
        if (whole := self.ids.get(word)) is not None:
            return (whole,)
        # Longest arc first. The path to a position is the same whichever way led there, so a position without a way on is dead for good.
        n, ids, known, most = len(word), self.ids, self.steps, self.longest
        path, ends, dead, at, last = [], [0], set(), 0, START
        while at < n:
            for end in range(min(n, at + most), at, -1):
                arc = ids.get(word[at:end])
                if arc is None or end in dead:
                    continue
                if last >= 0:
                    fits = known.get(last << 20 | arc)
                    if not (self.step(last, arc) if fits is None else fits):
                        continue
                path.append(arc)
                ends.append(end)
                at, last = end, arc
                break
            else:
                dead.add(at)
                path.pop()
                ends.pop()
                at, last = ends[-1], path[-1] if path else START
        return tuple(path)


class Words(dict):
    """Pre-split words and their tokens, filled by the automaton."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.run = automaton.run

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.run(word.encode())
        if len(word) <= LONG_WORD:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Coder:
    def __init__(self, spec: str):
        read = json.loads(spec)
        letters = byte_letters()
        raw = lambda s: bytes(letters[x] for x in s)
        added = {x["content"]: x["id"] for x in read["added_tokens"]}
        vocab = {raw(s): i for s, i in read["model"]["vocab"].items() if s not in added}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in read["model"]["merges"])
        self.automaton = Automaton(vocab, [(raw(a), raw(b)) for a, b in pairs], added)
        self.words = Words(self.automaton)
        self.split = regex.compile(PRE_SPLIT).findall
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        size = 1 + max(self.automaton.labels, default=-1)
        self.labels = pa.array([self.automaton.labels.get(i, b"") for i in range(size)], pa.large_binary())

    def encode(self, text: str) -> np.ndarray:
        get, parts = self.words.__getitem__, [text]
        if self.parts and any(x in text for x in self.automaton.added):
            parts = self.parts(text)
        if len(parts) == 1:
            return np.fromiter(chain.from_iterable(map(get, self.split(text))), np.int32)
        each = (((self.automaton.added[p],),) if k % 2 else map(get, self.split(p)) for k, p in enumerate(parts))
        return np.fromiter(chain.from_iterable(chain.from_iterable(each)), np.int32)

    def decode(self, ids: pa.Array, ends: np.ndarray) -> list[str]:
        """One text for each list, from the flat ids and the lists' offsets."""
        spelled = self.labels.take(ids)
        at = np.frombuffer(spelled.buffers()[1], np.int64)[spelled.offset : spelled.offset + len(spelled) + 1]
        data, at = memoryview(spelled.buffers()[2] or b""), at[ends]
        return [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def coder(spec: str) -> Coder:
    """The compiled tables, once in each worker process."""
    return worker_table(__name__, hash(spec), lambda: Coder(spec))


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _with(docs: DataFrame, name: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    kept = [c for c in docs.columns if c != name]
    return kept, T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, kind)])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(k, ROWS_AT_ONCE)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with a column of token ids. A column of that name is replaced, all others stay. tokenizer: path of a byte-level
    vocabulary file, read on the driver; its size is that of the vocabulary, whatever the data."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    kept, schema = _with(docs, out, T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(spec.value)
        for b in _pieces(batches):
            each = [c.encode(x or "") for x in b.column(text).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
            flat = pa.array(np.concatenate(each) if each else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in kept), pa.ListArray.from_arrays(pa.array(ends), flat)], [*kept, out])

    return in_arrow(docs, run, schema)


def decode(coded: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """coded with the text that the ids spell; a null list spells the empty text, unknown ids spell nothing."""
    spec = coded.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    kept, schema = _with(coded, out, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(spec.value)
        size = len(c.labels)
        for b in _pieces(batches):
            lists = b.column(ids)
            count = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            flat = np.where((flat >= 0) & (flat < size), flat, size)
            known = pa.array(flat, pa.int64(), mask=flat == size)
            said = c.decode(known, np.concatenate([[0], np.cumsum(count)]))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in kept), pa.array(said, pa.string())], [*kept, out])

    return in_arrow(coded, run, schema)
