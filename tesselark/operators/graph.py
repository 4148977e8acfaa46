"""Graphs of features: thresholds, consensus over restarts, quality of clusters."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselark.functions.ranks import values_at
from tesselark.sources.files import materialised


def symmetric(edges: DataFrame, value: str = "weight", how=F.max) -> DataFrame:
    """One row for each unordered pair, loops left out: the maximum (or mean) of both directions."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), value).groupBy("a", "b").agg(how(value).alias(value))


def quantile_filter(edges: DataFrame, nodes: DataFrame, q: float) -> DataFrame:
    """Weights at least the q-quantile of the full square matrix, its absent cells and both directions included.

    The position is found by arithmetic: zeros are counted, not made, and the weights next to it come from ``ranks``. Weights are not negative.
    """
    n, stored = nodes.count(), edges.count()
    if not stored:
        return edges
    zeros = n * n - 2 * stored
    # Each edge fills two cells; sorted, the zeros come first.
    at = q * (n * n - 1)
    places = [floor(at), ceil(at)]
    held = sorted({(p - zeros) // 2 for p in places if p >= zeros})
    value = dict(zip(held, values_at(edges, "weight", held)))
    low, high = (value[(p - zeros) // 2] if p >= zeros else 0.0 for p in places)
    return edges.where(F.round("weight", 9) >= F.round(F.lit(low + (at - places[0]) * (high - low)), 9))


def threshold_graph(pairs: DataFrame, least: float, value: str = "l") -> DataFrame:
    """Edges (a, b, weight) of pairs at or above a value; negatives and loops go, directions are joined by maximum."""
    return symmetric(pairs.where((F.round(value, 9) >= least) & (F.col(value) > 0)).withColumnRenamed(value, "weight"))


def where_value(pairs: DataFrame, op: str, cut: float, value: str = "l", triangle: str = "upper") -> DataFrame:
    """Pairs whose value is gt, ge, lt, le, ne or eq a cut (at 9 digits), of the upper or lower triangle, or of all (loops left out)."""
    v, c = F.round(value, 9), F.lit(cut)
    kept = {"gt": v > c, "ge": v >= c, "lt": v < c, "le": v <= c, "ne": v != c, "eq": v == c}[op]
    side = {"upper": F.col("a") < F.col("b"), "lower": F.col("a") > F.col("b"), "all": F.col("a") != F.col("b")}[triangle]
    return pairs.where(kept & side)


def consensus(labels: DataFrame, least: float = 0.95) -> DataFrame:
    """Share of runs in which two features have one label, for pairs at or above it; labels (run, feature, label)."""
    runs = labels.select("run").distinct().agg(F.count("*").alias("runs"))
    other = labels.select("run", "label", F.col("feature").alias("b"))
    both = labels.withColumnRenamed("feature", "a").join(other, ["run", "label"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("k")).crossJoin(F.broadcast(runs))
    return both.where(F.col("k") >= F.ceil(F.lit(least) * F.col("runs") - 1e-12)).select("a", "b", (F.col("k") / F.col("runs")).alias("share"))


def consensus_on(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The same share on given edges only."""
    p = labels.select("run", F.col("feature").alias("a"), F.col("label").alias("la"))
    q = labels.select("run", F.col("feature").alias("b"), F.col("label").alias("lb"))
    return edges.select("a", "b").join(p, "a").join(q, ["run", "b"]).groupBy("a", "b").agg(F.avg((F.col("la") == F.col("lb")).cast("double")).alias("share"))


def prune(modules: DataFrame, edges: DataFrame, fewest: int) -> DataFrame:
    """Members with an edge inside their module, in modules of enough such members; modules numbered anew from 1."""
    m = modules.where("module IS NOT NULL AND module >= 0")
    inner = edges.where("weight > 0").select("a", "b").join(m.toDF("a", "ma"), "a").join(m.toDF("b", "mb"), "b").where("ma = mb")
    held = m.join(inner.select(F.explode(F.array("a", "b")).alias("feature")).distinct(), "feature", "left_semi")
    size = F.count("*").over(Window.partitionBy("module"))
    kept = held.withColumn("k", size).where(F.col("k") >= fewest)
    ids = kept.select("module").distinct().withColumn("stable", F.row_number().over(Window.orderBy("module")))
    return modules.join(kept.select("feature", "module").join(ids, "module").select("feature", "stable"), "feature", "left").select("feature", F.col("stable").cast("int").alias("module"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("a", "b")).alias("feature"), "weight")
    return ends.groupBy("feature").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def module_sums(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Per module: edges inside and outward (an outward edge counts for both modules), cohesion, separation and conductance."""
    m = modules.where("module >= 0")
    e = edges.join(m.toDF("a", "ma"), "a").join(m.toDF("b", "mb"), "b")
    ends = e.select("weight", (F.col("ma") == F.col("mb")).alias("inside"), F.explode(F.when(F.col("ma") == F.col("mb"), F.array("ma")).otherwise(F.array("ma", "mb"))).alias("module"))
    inside, outside = F.coalesce(F.sum(F.when(F.col("inside"), F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~F.col("inside"), F.col("weight"))), F.lit(0.0))
    sums = ends.groupBy("module").agg(
        inside.alias("within_sum"), F.sum(F.col("inside").cast("long")).alias("within_n"), outside.alias("between_sum"), F.sum((~F.col("inside")).cast("long")).alias("between_n")
    )
    mean = lambda s, n: F.col(s) / F.nullif(n, F.lit(0).cast("long"))
    return sums.withColumns({"cohesion": mean("within_sum", "within_n"), "separation": mean("between_sum", "between_n"), "conductance": F.col("between_sum") / F.nullif(F.col("within_sum") + F.col("between_sum"), F.lit(0.0))})


def member_scores(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Per feature: mean weight inside its module and outward, the margin, and its rank in the module (least for ties)."""
    m = modules.where("module >= 0")
    e = edges.join(m.toDF("a", "ma"), "a").join(m.toDF("b", "mb"), "b")
    ends = e.select("weight", (F.col("ma") == F.col("mb")).alias("inside"), F.explode(F.array(F.struct(F.col("a").alias("feature"), F.col("ma").alias("module")), F.struct(F.col("b").alias("feature"), F.col("mb").alias("module")))).alias("p"))
    s = ends.groupBy("p.feature", "p.module").agg(F.avg(F.when(F.col("inside"), F.col("weight"))).alias("within"), F.avg(F.when(~F.col("inside"), F.col("weight"))).alias("between"))
    margin = F.coalesce("within", F.lit(0.0)) - F.coalesce("between", F.lit(0.0))
    s = s.withColumn("margin", margin)
    return s.withColumn("rank", F.rank().over(Window.partitionBy("module").orderBy(F.round("margin", 9).desc())))


def gene_metrics(consensus_edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Per feature: mean consensus with its module's other members, and the best mean with another module (absent pairs are 0)."""
    m = modules.where("module >= 0")
    size = m.groupBy("module").agg(F.count("*").alias("k"))
    ends = consensus_edges.select("a", "b", "share").union(consensus_edges.select("b", "a", "share")).toDF("feature", "other", "share")
    sums = ends.join(m.toDF("other", "om"), "other").groupBy("feature", "om").agg(F.sum("share").alias("s"))
    full = m.join(size.toDF("om", "k")).join(sums, ["feature", "om"], "left")
    mean = F.coalesce("s", F.lit(0.0)) / F.nullif(F.col("k") - (F.col("om") == F.col("module")).cast("long"), F.lit(0).cast("long"))
    own = F.col("om") == F.col("module")
    return full.groupBy("feature", "module").agg(F.max(F.when(own, mean)).alias("p_in"), F.max(F.when(~own, mean)).alias("p_best_out"))


def modularity(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """One row: sum over modules of inside share minus squared share of ends."""
    e = edges.join(modules.toDF("a", "ma"), "a").join(modules.toDF("b", "mb"), "b")
    m = e.agg(F.sum("weight").alias("m"))
    ends = e.select(F.explode(F.array("ma", "mb")).alias("module"), (F.col("weight") / 2).alias("half"), F.when(F.col("ma") == F.col("mb"), F.col("weight") / 2).otherwise(0.0).alias("inside"))
    per = ends.groupBy("module").agg(F.sum("half").alias("tot"), F.sum("inside").alias("ins")).crossJoin(F.broadcast(m))
    return per.agg(F.sum(F.col("ins") / F.col("m") - (F.col("tot") / F.col("m")) ** 2).alias("modularity"))


def preference(values: DataFrame, nodes: DataFrame, inverted: bool = False) -> DataFrame:
    """Shares (feature, share) of where a walk begins anew, from a value of each feature: clamped to the nodes' outer tenths, then exponential.

    Nodes without a value take the median of those that have one; ``inverted`` prefers small values.
    """
    known = nodes.select("feature").join(values.select("feature", F.col("value").cast("double").alias("value")), "feature", "left")
    filled = known.crossJoin(F.broadcast(known.agg(F.percentile("value", 0.5).alias("middle")))).select("feature", F.coalesce("value", "middle", F.lit(0.0)).alias("value"))
    ends = filled.agg(F.percentile("value", 0.1).alias("low"), F.percentile("value", 0.9).alias("high"))
    clamped = filled.crossJoin(F.broadcast(ends)).select("feature", F.greatest("low", F.least("high", "value")).alias("v"), "low", "high")
    power = F.exp((F.col("low") - F.col("v")) if inverted else (F.col("v") - F.col("high"))).alias("e")
    raw = clamped.select("feature", power)
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("e").alias("total")))).select("feature", (F.col("e") / F.col("total")).alias("share"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, prefer: DataFrame | None = None) -> DataFrame:
    """PageRank of an undirected weighted graph by power iteration; a round is a join and a sum; every fifth is written out, so lineage stays short.

    Walks begin anew at all features alike, or by the shares ``prefer`` (feature, share).
    """
    both = edges.select("a", "b", "weight").union(edges.select("b", "a", "weight")).toDF("src", "dst", "weight")
    walk = both.withColumn("p", F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).select("src", "dst", "p")
    nodes = both.select(F.col("src").alias("feature")).distinct()
    if prefer is None:
        start = nodes.crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n")))).select("feature", (1 / F.col("n")).alias("share"))
    else:
        start = nodes.join(prefer, "feature", "left").select("feature", F.coalesce("share", F.lit(0.0)).alias("share"))
    rank = start.select("feature", "share", F.col("share").alias("pr"))
    for step in range(1, rounds + 1):
        came = walk.join(rank.select(F.col("feature").alias("src"), "pr"), "src").groupBy(F.col("dst").alias("feature")).agg(F.sum(F.col("p") * F.col("pr")).alias("in"))
        rank = start.join(came, "feature").select("feature", "share", ((1 - damping) * F.col("share") + damping * F.col("in")).alias("pr"))
        if step % 5 == 0 and step < rounds:
            rank = materialised(rank, "rank")
    return rank.select("feature", "pr")


def reweighted(edges: DataFrame, rank: DataFrame, low: float = 0.0) -> DataFrame:
    """Edges (a, b, weight) times the mean rank of their ends; those not above ``low`` get 0."""
    w = edges.join(rank.toDF("a", "pa"), "a").join(rank.toDF("b", "pb"), "b").withColumn("w", F.col("weight") * (F.col("pa") + F.col("pb")) / 2)
    return w.select("a", "b", F.when(F.col("w") > low, F.col("w")).otherwise(0.0).alias("weight"))


def paths(edges: DataFrame, start: str, cutoff: int = 3) -> DataFrame:
    """Simple paths from a feature with at most ``cutoff`` edges, as arrays; every step is written out, so lineage stays short."""
    both = materialised(edges.select("a", "b").union(edges.select("b", "a")).toDF("src", "dst").where("src <> dst").distinct(), "steps")
    now = both.where(F.col("src") == start).select(F.array("src", "dst").alias("path"))
    out = now
    for _ in range(cutoff - 1):
        now = materialised(now.join(both, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")), "paths")
        out = out.union(now)
    return out


def paths_through(edges: DataFrame, feature: str, other: str | None = None, cutoff: int = 8, most: int = 50_000) -> DataFrame:
    """Simple paths (path, length in features) of at most ``cutoff`` edges that hold a feature, and another if given; each once, from its lesser end.

    A path is two arms that begin at the feature and share nothing else: arms are made step by step, and meet by an equi-join on the number of
    edges that they leave each other. More than ``most`` paths are refused. Without another feature every arm is a path, so arms are bounded too.
    """
    arms = paths(edges, feature, cutoff)
    if other is None and arms.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} paths; lower the cutoff")
    arms = materialised(arms.union(edges.sparkSession.createDataFrame([([feature],)], "path array<string>")), "arms")
    left = arms.select(F.col("path").alias("p"), F.explode(F.sequence(F.lit(0), cutoff + 1 - F.size("path"))).alias("k"))
    right = arms.select(F.col("path").alias("q"), (F.size("path") - 1).alias("k"))
    met = left.join(right, "k").where((F.element_at("p", -1) < F.element_at("q", -1)) & (F.size(F.array_intersect("p", "q")) == 1))
    # q leads from the feature to the greater end.
    path = F.concat(F.reverse("p"), F.slice("q", 2, cutoff))
    out = met.select(path.alias("path"))
    if other is not None:
        out = out.where(F.array_contains("path", other))
    out = materialised(out.limit(most + 1), "through")
    if out.count() > most:
        raise ValueError(f"more than {most} paths; lower the cutoff")
    return out.select("path", F.size("path").alias("length"))
