"""Licence scans by a generalised suffix automaton over words.

All templates are read into one automaton whose states are the sets of word runs that end at the same template places. A
document streams through it, and at each word the state and its length give the matching statistics: the longest run ending
there that stands in some template. Runs that cannot be made longer become anchors, one for each template place; anchors of one
template in rising order are chained over small gaps, which are the changed or missing words, and a chain that covers enough of
its template becomes a span. Overlapping spans of different templates give way to the one that covers more words.

Fixed phrases are templates of the automaton too: a phrase ends at a word if its state is that of the run there or
lies on that state's path of suffix links.

Words are maximal runs of a-z, 0-9 and all characters from U+0080 on, after A-Z are lower-cased. Null texts count as empty; an
empty text has no words, labels or spans and a score of 0. Texts are read in pieces, so a long one needs no more memory than
its matches. Rows are independent, so repeated rows and ties need no rule; of equal spans the one whose label sorts first
stays. Input columns other than doc_id and text are left out. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import in_arrow, in_slices, texts, worker_table
from storyline.llm.licence_texts import TEMPLATES

#: The phrases of the base labels.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: A run of at least so many words is an anchor (a whole template that is shorter counts too); anchors are chained over gaps of
#: so many words at most; a chain is a span if it covers such a share of its template.
LEAST_RUN, MOST_GAP, LEAST_SHARE = 4, 12, 0.7
#: Letters that a text is read at once.
PIECE = 1 << 18
SPAN = "struct<label:string,start:long,end:long,words:long,share:double>"
OUT = f"doc_id long, n_words long, base array<struct<label:string,start:long,end:long>>, spans array<{SPAN}>"

_kept = set(b"abcdefghijklmnopqrstuvwxyz0123456789") | set(range(128, 256))
_LETTERS = bytes((c + 32 if 65 <= c <= 90 else c) if (c in _kept or 65 <= c <= 90) else 32 for c in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_LETTERS).split()


class Automaton:
    """States 0.. with their arcs, suffix links, longest lengths and the template places that their runs end at."""

    def __init__(self, templates: Mapping[str, str], phrases: Mapping[str, str]):
        self.arcs: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.word: dict[bytes, int] = {}
        self.labels: list[str] = []
        self.size: list[int] = []
        phrase_at: dict[int, list[tuple[str, int]]] = {}
        read = [(label, words(line.encode()), False) for label, line in templates.items()] + [(label, words(line.encode()), True) for label, line in phrases.items()]
        runs = []
        for label, said, phrase in read:
            ids, last = [self.word.setdefault(w, len(self.word)) for w in said], 0
            for w in ids:
                last = self._grown(last, w)
            runs.append((label, ids, phrase))
        ends: list[list[tuple[int, int]]] = [[] for _ in self.arcs]
        for label, ids, phrase in runs:
            at = 0
            if not phrase:
                self.labels.append(label)
                self.size.append(len(ids))
            for k, w in enumerate(ids):
                at = self.arcs[at][w]
                if not phrase:
                    ends[at].append((len(self.labels) - 1, k + 1))
            if phrase:
                phrase_at.setdefault(at, []).append((label, len(ids)))
        # What ends at a state also ends at the states on its path of links: longer runs first.
        for s in sorted(range(1, len(self.arcs)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                ends[self.link[s]] += ends[s]
        self.ends = [sorted(set(x)) for x in ends]
        self.phrases: list[tuple[tuple[str, int], ...]] = [()] * len(self.arcs)
        for s in sorted(range(1, len(self.arcs)), key=self.length.__getitem__):
            self.phrases[s] = tuple(phrase_at.get(s, ())) + self.phrases[max(self.link[s], 0)]
        pairs = {(a, b) for _, ids, _ in runs for a, b in zip(ids, ids[1:], strict=False)}
        self.pairs = np.array(sorted(a * len(self.word) + b for a, b in pairs), np.int64)

    def _new(self, length: int, arcs: dict[int, int], link: int) -> int:
        self.arcs.append(arcs)
        self.length.append(length)
        self.link.append(link)
        return len(self.arcs) - 1

    def _divided(self, p: int, w: int, q: int) -> int:
        """A copy of q for the runs no longer than those of p and w."""
        copy = self._new(self.length[p] + 1, dict(self.arcs[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.arcs[p].get(w) == q:
            self.arcs[p][w] = copy
            p = self.link[p]
        return copy

    def _grown(self, last: int, w: int) -> int:
        """The state of the template read so far and w."""
        if (q := self.arcs[last].get(w)) is not None:  # another template has this run
            return q if self.length[q] == self.length[last] + 1 else self._divided(last, w, q)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.arcs[p]:
            self.arcs[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.arcs[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._divided(p, w, q)
        return new

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The matching statistics after one more word."""
        while state and w not in self.arcs[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.arcs[state].get(w)
        return (0, 0) if to is None else (to, length + 1)


Anchor = tuple[int, int, int, int]  # template, first word in the document, first word in the template, words


class Reader:
    """Matching statistics of one document, piece by piece."""

    def __init__(self, automaton: Automaton):
        self.a = automaton
        self.n = 0
        self.state = self.length = 0
        self.last = len(automaton.word)
        self.base: list[tuple[str, int, int]] = []
        self.anchors: list[Anchor] = []

    def read(self, said: list[bytes]) -> None:
        if not said:
            return
        a, other = self.a, len(self.a.word)
        ids = np.fromiter(map(a.word.get, said, repeat(other)), np.int64, len(said))
        before = np.concatenate([[self.last], ids[:-1]])
        # A run of two words or more goes on wherever the pair of words stands in a template; elsewhere it starts anew.
        known = np.flatnonzero((ids < other) & (before < other))
        goes_on = known[np.isin(before[known] * other + ids[known], a.pairs)]
        if not len(goes_on) or goes_on[0]:
            self.close(self.n)
        for stretch in np.split(goes_on, np.flatnonzero(np.diff(goes_on) > 1) + 1) if len(goes_on) else []:
            first, last = int(stretch[0]), int(stretch[-1])
            if not self.length:
                self.state, self.length = a.step(0, 0, int(before[first]))
            for k, w in enumerate(ids[first : last + 1].tolist(), self.n + first):
                state, length = a.step(self.state, self.length, w)
                if length <= self.length:
                    self._ended(k)
                self.state, self.length = state, length
                for label, size in a.phrases[state]:
                    if size <= length:
                        self.base.append((label, k + 1 - size, k + 1))
            if last + 1 < len(ids):
                self.close(self.n + last + 1)
        self.n += len(ids)
        self.last = int(ids[-1])

    def _ended(self, at: int) -> None:
        """The run that ends before the word at the place cannot be made longer: an anchor wherever a template has it."""
        if not self.length:
            return
        for t, end in self.a.ends[self.state]:
            if self.length >= min(LEAST_RUN, self.a.size[t]):
                self.anchors.append((t, at - self.length, end - self.length, self.length))

    def close(self, at: int) -> None:
        self._ended(at)
        self.state = self.length = 0


def chained(anchors: list[Anchor], size: int) -> list[tuple[int, int, int]]:
    """Start, end and covered words of the best disjoint chains of one template's anchors that cover enough of it."""
    anchors = sorted(anchors, key=lambda x: (x[1] + x[3], x[2] + x[3]))
    ends = [x[1] + x[3] for x in anchors]
    best: list[tuple[int, int]] = []  # words covered by the best chain that ends with the anchor, and where it starts
    for k, (_, d, t, n) in enumerate(anchors):
        most = (n, d)
        for j in range(bisect_left(ends, d - MOST_GAP), k):
            _, d2, t2, n2 = anchors[j]
            over = max(d2 + n2 - d, t2 + n2 - t, 0)  # words that both have
            if d2 < d and t2 < t and over < n and d - d2 - n2 <= MOST_GAP and t - t2 - n2 <= MOST_GAP:
                most = max(most, (best[j][0] + n - over, best[j][1]))
        best.append(most)
    out: list[tuple[int, int, int]] = []
    for k in sorted(range(len(anchors)), key=lambda k: (-best[k][0], ends[k])):
        covered, start = best[k]
        if covered < LEAST_SHARE * size:
            break
        at = bisect_left(out, (ends[k],))
        if (at == len(out) or out[at][0] >= ends[k]) and (at == 0 or out[at - 1][1] <= start):
            out.insert(at, (start, ends[k], covered))
    return out


def found(automaton: Automaton, text: str) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int, int, float]]]:
    """Number of words, places of phrases, and spans (label, start, end, covered words, covered share)."""
    reader, raw, at = Reader(automaton), text.encode(), 0
    while at < len(raw):
        stop = min(at + PIECE, len(raw))
        while stop < len(raw) and _LETTERS[raw[stop - 1]] != 32:
            stop += 1
        reader.read(words(raw[at:stop]))
        at = stop
    reader.close(reader.n)
    each: dict[int, list[Anchor]] = {}
    for x in reader.anchors:
        each.setdefault(x[0], []).append(x)
    spans = [(-covered, automaton.labels[t].split("|")[0], s, e, covered / automaton.size[t]) for t, x in each.items() for s, e, covered in chained(x, automaton.size[t])]
    kept: list[tuple[int, int, str, int, float]] = []
    for less, label, s, e, share in sorted(spans, key=lambda x: (x[0], -x[4], x[1], x[2])):
        at = bisect_left(kept, (s,))
        if (at == len(kept) or kept[at][0] >= e) and (at == 0 or kept[at - 1][1] <= s):
            kept.insert(at, (s, e, label, -less, share))
    return reader.n, sorted(reader.base, key=lambda x: (x[1], x[0])), [(label, s, e, n, share) for s, e, label, n, share in kept]


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, phrases: Mapping[str, str] | None = None) -> DataFrame:
    """A row for each document: doc_id, n_words, base (places of the phrases) and spans (of templates), places in words. A label
    of templates may go on with ``|`` and anything: only what is before it is told."""
    templates, phrases = dict(TEMPLATES if templates is None else templates), dict(PHRASES if phrases is None else phrases)
    key = (tuple(templates.items()), tuple(phrases.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = worker_table(__name__, key, lambda: Automaton(templates, phrases))
        base_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        span_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("share", pa.float64())]))
        for b in in_slices(batches):
            each = [found(automaton, t) for t in b.column("text").to_pylist()]
            base = [[dict(zip(("label", "start", "end"), x, strict=True)) for x in y] for _, y, _ in each]
            spans = [[dict(zip(("label", "start", "end", "words", "share"), x, strict=True)) for x in y] for _, _, y in each]
            columns = [b.column("doc_id"), pa.array([n for n, _, _ in each], pa.int64()), pa.array(base, base_type), pa.array(spans, span_type)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "base", "spans"])

    docs = texts(docs)
    return in_arrow(docs.withColumn("doc_id", F.col("doc_id").cast("long")), run, OUT)
