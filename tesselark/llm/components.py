"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Rows (node, root) for every node of the undirected ``edges`` (a, b): root is the least node of its component.

    Every round is a pair of star steps. A step takes the least neighbour of each node with a partial
    aggregate before the shuffle and joins it to the edges; the rows of a node with very many neighbours meet one
    row there, so the join may split them (adaptive skew joins do). Rounds are written to the shared folder, each
    in place of the one before; they stop when nothing changes.
    Edges with a null end, and loops, are left out; repeated edges count once.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(now, "edges")
    state = None
    for _ in range(most):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: all neighbours here are smaller.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "m", "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, stored(small, "edges")
        discard(before)
        seen = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("a", "b")
    return roots.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b").distinct())
