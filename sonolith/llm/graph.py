"""Connected components over edge tables, by alternating large and small stars.

Each round joins edges with the smallest neighbour of their end points, so every round moves at
most one row an edge; labels never reach the driver. A node with very many neighbours is a hot key
of a sort-merge join, which adaptive execution splits, and its smallest neighbour is found by
partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stage


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) with u > v, each node's neighbours hung on the smallest of them and itself; and the staged table that they are made with."""
    sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = stage(sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
    both = sides.join(least, "u")
    if large:
        out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b), 64-bit integers: (node, root), the root being the smallest node reachable. No edges: no rows."""
    edges = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        large, first = _star(edges, True)
        small, second = _star(large, False)
        made = stage(small, "stars")
        release(first, second, edges)
        edges = made
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
