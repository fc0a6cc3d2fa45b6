"""Connected components by alternating large and small stars.

Only minima by key move, never a list of neighbours; each round is a written table that replaces the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """A written table of every node of an edge: node, component (the smallest node that it reaches).

    Repeated edges and loops change nothing, edges with a null end are left out; no edges, no rows.
    """
    x, y = F.col(a), F.col(b)
    now = written(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "stars")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not state["n"] or state == before:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
            out = written(out, "components")
            dropped(now)
            return out
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.union(least).distinct(), "stars")
        dropped(now, large)
        now = new
