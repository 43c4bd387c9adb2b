"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """node and root for each end of an edge (a, b); root is the least node that can be reached. Alternates large stars
    (each node's larger neighbours go to its least one) and small stars (a node and its smaller neighbours go to the
    least) until the edges stay the same; every step is a grouped minimum and a join, so hubs are no burden to one task."""
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = materialize(ordered.filter("a < b").distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(now)
    while True:
        near = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").filter("v > u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.col("v").alias("x"), "m").filter("x <> m").unionByName(lows.select(F.col("u").alias("x"), "m"))
        now = materialize(small.select(F.col("m").alias("a"), F.col("x").alias("b")).distinct(), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    ends = now.select(F.col("a").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("root")))
    return ends.groupBy("node").agg(F.min("root").alias("root"))
