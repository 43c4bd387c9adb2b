"""Exact Jaccard join over word shingles by grouped prefixes, and the classes of linked documents.

A document is the set of its shingles, as 64-bit hashes. All sets are ordered the same way, rare shingles first; two sets
of the asked similarity share a shingle among their first few, their prefixes. Documents with equal sets are one node;
nodes with equal prefix and size are one group. Groups that share a prefix shingle meet in its bucket; buckets of two
groups go through size and position filters. The buckets with the same first group (by hash) are one star, so that
copies, which share many buckets, meet in few stars. A star's groups are expanded, and its nodes verified on their full
sets in chunks.

How rare a shingle is comes from a log-frequency filter: tasks send the fingerprints of their shingles, counted before
the shuffle, to sections; each section keeps those that two documents share, with quantised counts, in a Bloom filter.
The filter only orders the sets, so its errors cost time, never a link. A shingle that it doesn't hold is in no other
document; a document whose prefix is made of such shingles has no partner and is not looked at again. Its size follows
the number of shared shingles up to MOST_BITS; beyond that all shared shingles are still held, in fewer bits each, so
that more shingles seem shared than are, and the least frequent ones are ordered less well.

Only classes are asked for, so no star is turned into all its pairs: a chunk of nodes gives the links that join its
classes, at most one for each node. Stars of one chunk, nearly all, are done then. In larger ones the nodes outside the
largest class are verified, in blocks, against all the others. Every pair that could join two classes is verified, so
no link is lost, and copies by the thousand give no more rows than there are copies.

Null texts and texts without words have the empty set, which is linked with nothing. Texts with fewer words than a
shingle are one shingle of their own. Repeated rows each get their row. A class is named by its smallest doc_id; null
ids name none, but their rows are linked and chosen like all others: what is one class goes by nodes, not by names. Columns other than doc_id and text are left out by classes() and kept by one_of_each().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.llm import lm
from storyline.llm.common import in_arrow, in_slices, materialize, unused, worker_table
from storyline.operators.graph import components

#: Shingles that a task holds before it sends them on, the fingerprints that meet in a section, and the filter's bits (128 MB).
MOST_HELD, SECTION_ROWS, MOST_BITS = 1_000_000, 500_000, 1 << 30
MOST_WORDS = 100_000
#: Nodes of a star that are verified together and their shingles, and shingles of a call.
CHUNK, CHUNK_SHINGLES, BIN_SHINGLES = 1024, 400_000, 400_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_SIGN = np.uint64(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted set of hashed shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(worker_table(__name__, "words", _Hashes).__getitem__, words), np.uint64, len(words))
    if len(h) < size:
        return _mix((h * _ODD[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    n = len(h) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += h[k : k + n] * _ODD[k]
    return np.unique(_mix(total + np.uint64(size)))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _frequency(docs: DataFrame, size: int, bits: int) -> lm.Filter:
    """The filter of shared shingles, in 2 ** bits sections."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in in_slices(batches):
            held += [s for t in set(b.column("text").to_pylist()) if len(s := shingles(t, size))]
            if sum(map(len, held)) >= MOST_HELD:
                yield lm.packed(held, bits)
                held.clear()
        if held:
            yield lm.packed(held, bits)

    def build(key: tuple, t: pa.Table) -> pa.Table:
        print_, n = lm.unpacked(t)
        data = lm.build_section(print_[n > 1].astype(np.uint64), lm.levels(n[n > 1] - 1), MOST_BITS >> bits)
        return pa.table({"section": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([data.tobytes()], pa.binary())})

    sent = in_arrow(docs.select("text"), send, "section int, once binary, more binary, counts binary")
    built = materialize(sent.groupBy("section").applyInArrow(build, "section int, data binary"), "join-filter")
    return lm.assembled({r["section"]: r["data"] for r in built.toLocalIterator()}, 1 << bits)  # MOST_BITS in all


def _base(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n (set size), node, grp, first and prefix of each row. node: 16 bytes that stand for the set. prefix:
    the shared shingles of the prefix, the first of them at place ``first``."""
    length = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, max(6, (length // 5 // SECTION_ROWS).bit_length()))
    held = docs.sparkSession.sparkContext.broadcast(_frequency(docs, size, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            sets = [shingles(t, size) for t in b.column("text").to_pylist()]
            ends = np.cumsum([0] + [len(s) for s in sets])
            section, print_ = lm.key(np.concatenate(sets), bits)
            often = held.value.level(print_, section)
            nodes, groups, firsts, prefixes = [], [], [], []
            for s, at in zip(sets, ends[:-1], strict=True):
                n, seen = len(s), often[at : at + len(s)]
                shared = seen > 0
                alone = n - int(shared.sum())
                take = n - -(-n * percent // 100) + 1 - alone if n else 0
                late = s[shared]
                prefix = late[np.lexsort((late, seen[shared]))[:take]] if take > 0 else late[:0]
                nodes.append(np.array([_mix(s ^ _ODD[0]).sum(), _mix(s ^ _ODD[1]).sum()], np.uint64).tobytes())
                groups.append(int((_mix(prefix + _ODD[2]) * np.arange(1, 2 * len(prefix), 2, dtype=np.uint64)).sum() + np.uint64(n)))
                firsts.append(alone)
                prefixes.append(_signed(prefix))
            starts = np.cumsum([0] + [len(p) for p in prefixes]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(prefixes)))
            out = [b.column("doc_id"), b.column("text_hash"), pa.array(np.diff(ends), pa.int32()), pa.array(nodes, pa.binary()), pa.array(_signed(np.array(groups, np.uint64))), pa.array(firsts, pa.int32()), lists]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "text_hash", "n", "node", "grp", "first", "prefix"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return materialize(in_arrow(rows, run, "doc_id long, text_hash long, n int, node binary, grp long, first int, prefix array<long>"), "join-base")


def _row(text_hash: Column) -> Column:
    """Stands for the rows of one doc_id, which may be null, and one text. Rows that share it in error cost time only."""
    return F.xxhash64("doc_id", text_hash)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node and set for the wanted nodes. wanted: row and node."""
    held = docs.select(_row(F.xxhash64("text")).alias("row"), "text").join(wanted.select("row").distinct(), "row", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            each = [shingles(t, size) for t in b.column("text").to_pylist()]
            nodes = [np.array([_mix(s ^ _ODD[0]).sum(), _mix(s ^ _ODD[1]).sum()], np.uint64).tobytes() for s in each]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([_signed(s) for s in each], pa.list_(pa.int64()))], ["node", "set"])

    got = in_arrow(held.select("text"), run, "node binary, set array<long>")
    return materialize(got.join(wanted.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "join-sets")


def _close(x: Column, y: Column, percent: int) -> Column:
    """Size and position filters for two groups (grp, n and pos) that meet in a bucket and nowhere before it."""
    rest = F.least(x["n"] - x["pos"], y["n"] - y["pos"])
    return (F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent) & (rest * (100 + percent) >= (x["n"] + y["n"]) * percent)


def _shared(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posting lists of the shingles that two sets share: the sets, the lists' offsets, and each set's lists (flat, by set)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    back = np.where(count[back] > 1, back, -1)
    order = np.argsort(back, kind="stable")
    order = order[back[order] >= 0]
    return owner[order], np.concatenate([[0], np.cumsum(np.where(count > 1, count, 0))]), back


def _partners(sets: list[np.ndarray], asked: Iterable[int], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each asked set the sets as similar as asked, itself among them if it has a shared shingle."""
    size = np.array([len(s) for s in sets])
    owner, offset, lists = _shared(sets)
    ends = np.cumsum(size)
    for i in asked:
        own = lists[ends[i] - size[i] : ends[i]]
        own = own[own >= 0]
        if len(own):
            both = np.bincount(np.concatenate([owner[offset[k] : offset[k + 1]] for k in own]), minlength=len(sets))
            yield i, np.flatnonzero(both * 100 >= (size[i] + size - both) * percent)


def _spanning(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the classes of some sets, at most one for each set."""
    up, out = list(range(len(sets))), []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, others in _partners(sets, range(len(sets)), percent):
        for j in others:
            if (a := root(i)) != (b := root(int(j))):
                up[a] = b
                out.append((i, int(j)))
    return out


def _columns(t: pa.Table, *names: str) -> list[list]:
    return [t[c].to_pylist() for c in names]


def _links_within(rows: DataFrame, percent: int, bins: int) -> DataFrame:
    """Links (a, b) of each star's chunk. rows: star, chunk, node, set; some chunks share a bin, so that calls are few."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("star", "ascending"), ("chunk", "ascending"), ("node", "ascending")])
        stars, chunks, nodes = _columns(t, "star", "chunk", "node")
        sets = [np.asarray(x) for x in t["set"].to_numpy()]
        edges = [0, *(k for k in range(1, len(nodes)) if (stars[k], chunks[k]) != (stars[k - 1], chunks[k - 1])), len(nodes)]
        pairs = [(nodes[a + i], nodes[a + j]) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1 for i, j in _spanning(sets[a:b], percent)]
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.binary()), "b": pa.array([y for _, y in pairs], pa.binary())})

    binned = rows.withColumn("bin", F.pmod(F.xxhash64("star", "chunk"), F.lit(bins)))
    return binned.select("bin", "star", "chunk", "node", "set").groupBy("bin").applyInArrow(run, "a binary, b binary")


def _links_across(rows: DataFrame, percent: int) -> DataFrame:
    """Links of the nodes outside a star's largest class with nodes of other classes. rows: star, chunk, chunks, node, n, set, root."""
    sizes = rows.groupBy("star", "root").agg(F.sum("n").alias("c"))
    main = sizes.groupBy("star").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("all"))
    main = main.select("star", F.col("main.root").alias("main"), (F.col("all") - F.col("main.c")).alias("rest")).filter("rest > 0")
    held = rows.join(main, "star")
    parts = F.ceil(F.col("rest") / CHUNK_SHINGLES).cast("int")
    last = lambda n: F.sequence(F.lit(0), n - 1)
    asked = held.filter("root <> main").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "node"), parts).cast("int")).withColumn("chunk", F.explode(last(F.col("chunks").cast("int"))))
    there = held.withColumn("part", F.explode(last(parts)))
    cols = ["star", "chunk", "part", "node", "root", "set"]
    both = asked.select(*cols, F.lit(True).alias("asked")).unionByName(there.select(*cols, F.lit(False).alias("asked")))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("asked", "descending"), ("node", "ascending")])
        nodes, roots, asks = _columns(t, "node", "root", "asked")
        sets = [np.asarray(x) for x in t["set"].to_numpy()]
        pairs = []
        for i, others in _partners(sets, range(sum(asks)), percent):
            found = {roots[j]: nodes[j] for j in others if not asks[j] and roots[j] != roots[i]}
            pairs += [(nodes[i], x) for x in found.values()]
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.binary()), "b": pa.array([y for _, y in pairs], pa.binary())})

    return both.groupBy("star", "chunk", "part").applyInArrow(run, "a binary, b binary")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _link_classes(base: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame | None:
    """node and root of the nodes that are linked with others; None if there are none."""
    filled = base.filter(F.size("prefix") > 0)
    tokens = filled.select(F.posexplode("prefix").alias("at", "key"), "grp", "n", "first").select("key", "grp", "n", (F.col("at") + F.col("first")).alias("pos"))
    row = F.struct("grp", "n", "pos")
    buckets = tokens.groupBy("key").agg(F.min(row).alias("lo"), F.max(row).alias("hi"), F.count("*").alias("c"), F.min(F.struct(F.xxhash64("grp").alias("h"), "grp")).alias("p"))
    buckets = buckets.filter((F.col("lo.grp") != F.col("hi.grp")) & ((F.col("c") > 2) | _close(F.col("lo"), F.col("hi"), percent)))
    stars = tokens.join(buckets.select("key", F.col("p.grp").alias("star")), "key").select("star", "grp").distinct()
    members = filled.groupBy("grp", "node", "n").agg(F.min(_row(F.col("text_hash"))).alias("row"))
    many = members.groupBy("grp").agg(F.count("*").alias("c")).filter("c > 1").select("grp", F.col("grp").alias("star"))
    rows = members.join(stars.unionByName(many.select("star", "grp")).distinct(), "grp").select("star", "node", "n", "row")
    rows = materialize(rows.groupBy("star", "node", "n").agg(F.min("row").alias("row")), "join-stars")
    total = rows.agg(F.sum("n")).first()[0]
    if not total:
        return None
    sets = _sets(docs, rows.select("row", "node"), size)
    sizes = rows.groupBy("star").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).alias("chunks"))
    chunked = rows.join(sizes, "star").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    bins = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BIN_SHINGLES)
    links = materialize(_links_within(chunked.join(sets, "node"), percent, bins), "join-links")
    if links.isEmpty() and sizes.filter("chunks > 1").isEmpty():
        return None
    roots = components(links)
    large = chunked.filter("chunks > 1")
    if not large.isEmpty():
        more = materialize(_links_across(_rooted(large, roots).join(sets, "node"), percent), "join-links")
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    return roots


def _classes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and root, the node that stands for the class (null for empty sets)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = _base(docs, size, percent)
    roots = _link_classes(base, docs, size, percent)
    named = base.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("name")).withColumn("root", F.col("node"))
    if roots is not None:
        held = _rooted(named.drop("root"), roots)
        named = held.join(held.groupBy("root").agg(F.min("name").alias("least")), "root").select("node", F.col("least").alias("name"), "root")
    rows = base.select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    full = rows.filter("n > 0").join(named, "node").select("doc_id", "text_hash", "n", "name", "root")
    empty = rows.filter("n = 0").select("doc_id", "text_hash", "n", F.col("doc_id").alias("name"), F.lit(None).cast("binary").alias("root"))
    return full.unionByName(empty).select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.col("name").alias("component_id"), "root")


def classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id of each row of docs. Two documents link when their sets' Jaccard
    similarity is at least percent / 100."""
    return _classes(docs, size, percent).drop("root")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class of linked documents, that of the smallest doc_id, a null one last; all columns stay. Of rows
    with empty sets one of each doc_id and text stays."""
    found = materialize(_classes(docs, size, percent), "join-classes")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = found.filter("root is not null").groupBy("root").agg(F.min(row).alias("f")).select("f.doc_id", "f.text_hash")
    first = first.unionByName(found.filter("root is null").select("doc_id", "text_hash").distinct())
    own, i, h = (unused(docs, name) for name in ("_hash", "_id", "_th"))
    first = first.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h))
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(first, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(own) == F.col(h)), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).select(*docs.columns)
