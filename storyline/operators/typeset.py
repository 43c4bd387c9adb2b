"""Text in lines of a width, and photos in rows of equal height."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Widths of a common sans-serif face in thousandths of its size, and the letters that are as wide; others are WIDE.
WIDTHS = {
    222: "ijl'", 278: "ft.,:;/!I[]|\\ ", 333: "r-()`", 355: '"', 389: "*", 500: "cksvxyzJ", 556: "abdeghnopqu0123456789?_$#L", 584: "+<=>~", 611: "FTZ", 667: "AEBKPSVXY&", 722: "wCDHNRU", 778: "GOQ",
    833: "mM", 889: "%", 944: "W", 1015: "@",
}
WIDE = 556
#: White space as Unicode has it, but for the end of a line.
SPACE = r"\t\x0B\x0C\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPACES = np.zeros(0x3002, bool)
_SPACES[[9, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
#: Bytes of text that a task works on at once.
SLICE_BYTES = 1 << 20


def text_width(text: Column, widths: dict[int, str] | None = None) -> Column:
    """width in thousandths of the size: letters of each width are counted, so the cost does not rest on their order."""
    n = F.char_length(text)
    each = (((w - WIDE) * (n - F.char_length(F.translate(text, letters, ""))) for w, letters in (widths or WIDTHS).items()))
    return sum(each, n * WIDE)


def wrapped(rows: DataFrame, key: str, text: str, most: int, widths: dict[int, str] | None = None) -> DataFrame:
    """key, paragraph, line and said: the text in lines at most ``most`` wide, words joined by a blank; a longer word is a line of
    its own, and a paragraph without words is an empty line. Widths are running sums over slices of at most 1 MB of texts (or one longer
    text). A null text is one empty paragraph."""
    of = dict(widths or WIDTHS)
    blank = 1000 if widths is not None and not any(" " in x for x in widths.values()) else next(w for w, x in of.items() if " " in x)
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.full(max(ord(c) for x in of.values() for c in x) + 2, WIDE, np.int64)
        for w, letters in of.items():
            for c in set(letters):
                wide[ord(c)] += w - WIDE
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
                row, paragraph, line, said = _broken([x or "" for x in batch.column(text)[at:stop].to_pylist()], wide, blank, most)
                keys = batch.column(key)[at:stop].take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(paragraph, pa.int32()), pa.array(line, pa.int32()), pa.array(said, pa.string())], [key, "paragraph", "line", "said"])
                at = stop

    kind = T.StructType([rows.schema[key], T.StructField("paragraph", T.IntegerType()), T.StructField("line", T.IntegerType()), T.StructField("said", T.StringType())])
    return rows.select(key, text).mapInArrow(run, kind)


def _broken(texts: list[str], wide: np.ndarray, blank: int, most: int) -> tuple[list, list, list, list]:
    """For each line of these texts the number of its text, of its paragraph and its own, and what it says. The word that a line from any
    word on would end before is looked up for all words at once; lines then follow one another."""
    whole = "\n".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    ends_here = codes == 10
    in_word = ~(_SPACES[np.minimum(codes, len(_SPACES) - 1)] | ends_here)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], in_word, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate(([0], np.cumsum(wide[np.minimum(codes, len(wide) - 1)])))
    widths = sums[ends] - sums[starts] + blank
    upto = np.cumsum(widths)
    first = np.searchsorted(starts, np.concatenate(([0], np.flatnonzero(ends_here) + 1)))
    last = np.append(first[1:], len(starts))
    following = np.maximum(np.searchsorted(upto, upto - widths + most + blank, side="right"), np.arange(1, len(starts) + 1))
    following = np.minimum(following, np.repeat(last, last - first)).tolist()
    # Words with one blank between them need not be joined anew.
    apart = np.concatenate(([0], np.cumsum((starts[1:] - ends[:-1] != 1) | (codes[ends[:-1]] != 32)))).tolist()
    starts, ends = starts.tolist(), ends.tolist()
    out: tuple[list, list, list, list] = ([], [], [], [])
    k = 0
    for row, text in enumerate(texts):
        for paragraph in range(text.count("\n") + 1):
            i, stop, lines = int(first[k]), int(last[k]), []
            k += 1
            while i < stop:
                j = following[i]
                lines.append(whole[starts[i] : ends[j - 1]] if apart[j - 1] == apart[i] else " ".join(whole[starts[n] : ends[n]] for n in range(i, j)))
                i = j
            for line, said in enumerate(lines or [""]):
                for x, v in zip(out, (row, paragraph, line, said), strict=True):
                    x.append(v)
    return out


ROWS_MOST = 6


def justified(photos: DataFrame, by: list[str], order: str, ratio: str, width: float, height: float, gap: float) -> DataFrame:
    """L4: rows of equal height for the photos of each page, all of each photo shown: of one to six rows those that draw the largest sum
    of squared heights by ratio. A row is closed when the photos so far are as wide as so many rows should be, or when the
    rest are needed for a row each. Adds n_rows, row, x, y, w and h, in the middle of the box. A page is a few photos: an array."""
    item = F.struct(F.col(order).alias("o"), F.col(ratio).cast("double").alias("a"))
    pages = photos.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("p")).withColumn("n", F.size("p"))
    pages = pages.withColumn("total", F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x["a"]))
    tried = pages.withColumn("r", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(ROWS_MOST)))))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("row"), F.lit(0.0).alias("acc"), F.array().cast("array<int>").alias("of"))

    def put(s: Column, x: Column) -> Column:
        acc, left, rows_left = s["acc"] + x["a"], F.col("n") - s["i"] - 1, F.col("r") - s["row"] - 1
        close = (rows_left > 0) & ((acc >= F.col("total") * (s["row"] + 1) / F.col("r")) | (left == rows_left))
        return F.struct((s["i"] + 1).alias("i"), (s["row"] + close.cast("int")).alias("row"), acc.alias("acc"), F.concat(s["of"], F.array(s["row"])).alias("of"))

    dealt = tried.withColumn("of", F.aggregate("p", zero, put, lambda s: s["of"]))
    # One array of heights, for each row that has photos.
    in_row = lambda k: F.filter(F.arrays_zip(F.col("p").alias("p"), F.col("of").alias("of")), lambda z: z["of"] == k)
    wide = lambda k: F.aggregate(in_row(k), F.lit(0.0), lambda acc, z: acc + z["p"]["a"])
    dealt = dealt.withColumn("hs", F.transform(F.sequence(F.lit(0), F.array_max("of")), lambda k: (F.lit(width) - gap * (F.size(in_row(k)) - 1)) / wide(k)))
    dealt = dealt.withColumn("th", F.aggregate("hs", F.lit(0.0), lambda acc, h: acc + h) + gap * (F.size("hs") - 1)).withColumn("s", F.least(F.lit(height) / F.col("th"), F.lit(1.0)))
    area = F.aggregate(F.zip_with("p", "of", lambda p, k: p["a"] * F.pow(F.get("hs", k) * F.col("s"), 2)), F.lit(0.0), lambda acc, x: acc + x)
    best = dealt.withColumn("area", F.round(area, 9)).groupBy(*by).agg(F.min(F.struct((-F.col("area")).alias("less"), "r", "p", "of", "hs", "th", "s")).alias("b"))
    each = best.select(*by, F.inline(F.arrays_zip(F.col("b.p").alias("p"), F.col("b.of").alias("row"))), "b.hs", "b.th", "b.s")
    each = each.select(*by, F.col("p.o").alias(order), F.size("hs").alias("n_rows"), "row", (F.get("hs", F.col("row")) * F.col("s")).alias("h"), F.col("p.a").alias("_a"), "hs", "th", "s").withColumn("w", F.col("_a") * F.col("h"))
    row = Window.partitionBy(*by, "row")
    before = F.coalesce(F.sum(F.col("w") + gap * F.col("s")).over(row.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    row_wide = F.sum("w").over(row) + gap * F.col("s") * (F.count("*").over(row) - 1)
    above = F.aggregate(F.slice("hs", 1, F.col("row")), F.lit(0.0), lambda acc, h: acc + h) * F.col("s") + gap * F.col("s") * F.col("row")
    placed = each.withColumn("x", (width - row_wide) / 2 + before).withColumn("y", (height - F.col("th") * F.col("s")) / 2 + above)
    return placed.select(*by, order, "n_rows", "row", "x", "y", "w", "h")
