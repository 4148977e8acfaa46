"""Forests of graphs that stay in Spark: components by pointer jumping, greatest spanning forests by rounds, merge trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.sources.files import materialised


def roots(parents: DataFrame) -> DataFrame:
    """Rows (node, root) from pointers (node, parent); a root points to itself. Every round each node takes its parent's parent, so rounds grow with
    the logarithm of the depth."""
    now = parents.select("node", "parent")
    while True:
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        now = materialised(now.join(up, "parent").select("node", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("moved")), "pointers")
        if not now.where("moved").limit(1).count():
            return now.select("node", F.col("parent").alias("root"))
        now = now.select("node", "parent")


def _best_first():
    """An order without ties in which heavier edges come first."""
    return F.min(F.struct((-F.col("weight")).alias("n"), "a", "b", "ca", "cb"))


def hooked(first: DataFrame) -> DataFrame:
    """Rows (node, root) of the groups that first edges outward (node, f with ca and cb) make of nodes: of two that point at each other the lesser is a root."""
    other = F.when(F.col("f.ca") == F.col("node"), F.col("f.cb")).otherwise(F.col("f.ca"))
    point = first.select("node", other.alias("parent"))
    back = point.select(F.col("node").alias("parent"), F.col("parent").alias("again"))
    parents = point.join(back, "parent").select("node", F.when((F.col("again") == F.col("node")) & (F.col("node") < F.col("parent")), F.col("node")).otherwise(F.col("parent")).alias("parent"))
    return roots(parents)


def spanning_forest(edges: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """The forest of greatest weights (of each module, if given): (module, a, b, weight); ties by a, then b.

    Rounds: each component takes its first edge outward (a partial aggregate), which joins it to another; the joined ones are found by pointer
    jumping and become one. Of the edges between two components only the first is kept. Loops and edges with nulls are left out.
    """
    e = edges.where("a <> b AND weight IS NOT NULL")
    e = e.select(F.lit(0).alias("module"), "a", "b", "weight") if modules is None else (
        e.join(modules.toDF("a", "module"), "a").join(modules.toDF("b", "other"), "b").where("module = other").select("module", "a", "b", "weight")
    )
    live = materialised(e.select("module", "a", "b", "weight", F.col("a").alias("ca"), F.col("b").alias("cb")), "live")
    kept = None
    while live.limit(1).count():
        ends = live.select("*", F.explode(F.array(F.struct(F.col("ca").alias("node"), F.col("cb").alias("other")), F.struct(F.col("cb").alias("node"), F.col("ca").alias("other")))).alias("p"))
        first = materialised(ends.groupBy("module", F.col("p.node").alias("node")).agg(_best_first().alias("f")), "first")
        chosen = first.select("module", "f.a", "f.b", (-F.col("f.n")).alias("weight")).distinct()
        kept = chosen if kept is None else kept.union(chosen)
        root = hooked(first)
        moved = live.join(root.toDF("ca", "ra"), "ca").join(root.toDF("cb", "rb"), "cb").where("ra <> rb")
        one = moved.select("module", "a", "b", "weight", F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb"))
        live = materialised(one.groupBy("module", "ca", "cb").agg(_best_first().alias("f")).select("module", "f.a", "f.b", (-F.col("f.n")).alias("weight"), "f.ca", "f.cb"), "live")
    return kept if kept is not None else live.select("module", "a", "b", "weight")


def bridges(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """The strongest edge of each two modules, of which the forest between modules keeps some: (a, b, weight, ma, mb)."""
    e = edges.join(modules.toDF("a", "ma"), "a").join(modules.toDF("b", "mb"), "b").where("ma <> mb")
    top = e.groupBy(F.least("ma", "mb").alias("p"), F.greatest("ma", "mb").alias("q")).agg(F.min(F.struct((-F.col("weight")).alias("n"), "a", "b")).alias("t"))
    best = top.select("p", "q", (-F.col("t.n")).alias("weight"), F.col("t.a").alias("x"), F.col("t.b").alias("y"))
    tree = spanning_forest(best.select(F.col("p").alias("a"), F.col("q").alias("b"), "weight"))
    kept = best.join(tree.select(F.col("a").alias("p"), F.col("b").alias("q")), ["p", "q"], "left_semi")
    return kept.select(F.col("x").alias("a"), F.col("y").alias("b"), "weight", F.col("p").alias("ma"), F.col("q").alias("mb"))


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of every node of the undirected edges (a, b); root is one node of each component, the least.

    Rounds: each node's pointer goes to the least root among its neighbours' (a partial aggregate), pointers are jumped, and edges between
    roots take the place of the edges; those within one component go.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = materialised(e, "ends")
    now = materialised(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "roots")
    while live.limit(1).count():
        both = live.union(live.select("b", "a")).toDF("node", "other")
        point = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("parent"))
        root = roots(point)
        now = materialised(now.join(root.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        moved = live.join(root.toDF("a", "ra"), "a").join(root.toDF("b", "rb"), "b").where("ra <> rb")
        live = materialised(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "ends")
    return now
