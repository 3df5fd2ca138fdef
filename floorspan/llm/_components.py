"""Connected components of a set of edges, without collecting any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspan.llm._common import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every end of the edges (a, b); the root is the smallest id that can be reached.

    Alternates large stars (each id's larger neighbours move to its smallest neighbour) and small stars (so do
    its smaller ones), which ends after about log2 rounds of the longest path.  A hot id's edges are only
    counted and joined, both of which Spark splits.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.union(small).distinct())
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return stars.union(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
