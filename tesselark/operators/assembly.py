"""From partitions to modules: the second stage's graph, weak members, splits, and the edges of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.operators import association as A
from tesselark.operators import trees as T


def co_membership(modules: DataFrame) -> DataFrame:
    """Pairs a < b of one module (the consensus of a single partition); features without a module have none."""
    m = modules.where("module >= 0")
    return m.toDF("a", "module").join(m.toDF("b", "module"), "module").where("a < b").select("a", "b", "module")


def above_band(edges: DataFrame, r: DataFrame, curve: DataFrame) -> DataFrame:
    """Edges (a, b, weight) whose weight is over the curve's upper bound (r, hi) at their correlation (a, b, r)."""
    pairs = edges.select("a", "b", F.col("weight").alias("l")).join(r.select("a", "b", "r"), ["a", "b"])
    return A.outside_curve(pairs, curve.select("r", F.lit(-1e300).alias("lo"), "hi")).select("a", "b", F.col("l").alias("weight"))


def overlap_weighted(edges: DataFrame, overlap: DataFrame) -> DataFrame:
    """Weights times the pair's overlap (a, b, value), the median overlap where a pair has none."""
    middle = overlap.agg(F.percentile("value", F.lit(0.5)).alias("middle"))
    return edges.join(overlap.select("a", "b", "value"), ["a", "b"], "left").crossJoin(F.broadcast(middle)).select("a", "b", (F.col("weight") * F.coalesce("value", "middle")).alias("weight"))


def with_backbone(edges: DataFrame, full: DataFrame, modules: DataFrame, q: float = 0.02) -> DataFrame:
    """Edges, with those of every module's strongest forest raised to a floor, the q-quantile (0.25 at most) of all weights.

    A module without inner edges takes its forest from ``full``.
    """
    m = modules.where("module >= 0")
    inside = lambda e: e.join(m.toDF("a", "module"), "a").join(m.toDF("b", "other"), "b").where("module = other AND weight > 0").select("module", "a", "b", "weight")
    own = inside(edges)
    lent = inside(full).join(own.select("module").distinct(), "module", "left_anti")
    tree = T.spanning_forest(own.union(lent).select("a", "b", "weight"), m).select("a", "b", F.lit(True).alias("kept"))
    floor = edges.where("weight > 0").agg(F.coalesce(F.greatest(F.lit(1e-8), F.percentile("weight", F.lit(min(max(q, 0.0), 0.25)))), F.lit(1e-6)).alias("floor"))
    both = edges.select("a", "b", "weight").join(tree, ["a", "b"], "full").crossJoin(F.broadcast(floor))
    return both.select("a", "b", F.when(F.col("kept"), F.greatest(F.coalesce("weight", F.lit(0.0)), "floor")).otherwise(F.col("weight")).alias("weight"))


def smoothed(edges: DataFrame, low: float = 0.05, high: float = 0.95, power: float = 0.5) -> DataFrame:
    """log1p of positive weights, clipped to two quantiles, brought to 0..1 and raised to a power."""
    e = edges.where("weight > 0").select("a", "b", F.log1p("weight").alias("w"))
    cuts = e.agg(F.percentile("w", F.lit(low)).alias("lo"), F.percentile("w", F.lit(high)).alias("hi"))
    part = (F.least(F.greatest("w", "lo"), "hi") - F.col("lo")) / (F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-8)) + 1e-12)
    return e.crossJoin(F.broadcast(cuts)).select("a", "b", F.pow(part, F.lit(power)).alias("weight"))


def inner_weights(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Per member of a module: the sum of its edges' weights to the module's other members, and their number (0 without any)."""
    m = modules.where("module >= 0")
    e = edges.join(m.toDF("a", "ma"), "a").join(m.toDF("b", "mb"), "b").where("ma = mb")
    ends = e.select(F.explode(F.array("a", "b")).alias("feature"), "weight").groupBy("feature").agg(F.sum("weight").alias("w_in"), F.count("*").alias("degree_in"))
    return m.join(ends, "feature", "left").select("feature", "module", F.coalesce("w_in", F.lit(0.0)).alias("w_in"), F.coalesce("degree_in", F.lit(0)).cast("long").alias("degree_in"))


def without_weak(modules: DataFrame, metrics: DataFrame, least_in: float = 0.25, most_out: float = 0.6, q: float = 0.05) -> DataFrame:
    """Modules (feature, module), null for members of low consensus inside (p_in), high consensus with another module (p_best_out) and
    an inner weight (w_in) in the least q of all."""
    cut = metrics.agg(F.percentile("w_in", F.lit(q)).alias("cut"))
    weak = metrics.crossJoin(F.broadcast(cut)).where((F.col("p_in") < least_in) & (F.col("p_best_out") > most_out) & (F.col("w_in") <= F.col("cut"))).select("feature", F.lit(True).alias("weak"))
    return modules.join(weak, "feature", "left").select("feature", F.when(F.col("weak").isNull(), F.col("module")).alias("module"))


def split(
    modules: DataFrame, parts: DataFrame, consensus: DataFrame, metrics: DataFrame,
    least_size: int = 10, most_within: float = 0.5, least_conductance: float = 0.6, most_parts: int = 3, least_part: int = 5, gain: float = 0.07,
) -> DataFrame:
    """Modules after the splits that are accepted; their parts are numbered on from the greatest module.

    A module (metrics: module, size, within, conductance) is split if it is large, loose and open enough, has two to ``most_parts`` parts
    (parts: feature, module, part) of enough members, and the parts' mean consensus, weighted by size, is above the module's by ``gain``.
    Pairs without a consensus count as zero, a part of one member too.
    """
    member = parts.where("part IS NOT NULL")
    inner = consensus.join(member.toDF("a", "module", "part"), "a").join(member.toDF("b", "mb", "pb"), "b").where("module = mb AND part = pb").groupBy("module", "part").agg(F.sum("share").alias("share"))
    sizes = member.groupBy("module", "part").agg(F.count("*").alias("k")).join(inner, ["module", "part"], "left")
    mean = F.when(F.col("k") > 1, F.coalesce("share", F.lit(0.0)) / (F.col("k") * (F.col("k") - 1) / 2)).otherwise(0.0)
    found = sizes.groupBy("module").agg(F.count("*").alias("parts"), F.min("k").alias("least"), (F.sum(mean * F.col("k")) / F.sum("k")).alias("now"))
    good = found.join(metrics, "module").where(
        (F.col("size") >= least_size) & (F.col("within") < most_within) & (F.col("conductance") > least_conductance) & F.col("parts").between(2, most_parts) & (F.col("least") >= least_part) & (F.col("now") >= F.col("within") + gain)
    )
    top = modules.agg(F.coalesce(F.max("module"), F.lit(0)).alias("top"))
    ids = F.row_number().over(A.Window.orderBy("module", "part"))
    new = sizes.join(good.select("module"), "module", "left_semi").select("module", "part", ids.alias("id")).crossJoin(F.broadcast(top)).select("module", "part", (F.col("id") + F.col("top")).alias("new"))
    named = member.join(new, ["module", "part"]).select("feature", "new")
    return modules.join(named, "feature", "left").select("feature", F.coalesce("new", "module").cast("int").alias("module"))


def assembled(consensus: DataFrame, edges: DataFrame, modules: DataFrame, least: float, log1p: bool = True) -> DataFrame:
    """The result's edges (a, b, weight, sign, kind): consensus pairs that are edges, and edges of at least ``least`` between modules.

    ``edges`` (a, b, weight) are those of the similarity, symmetric, zero and below left out; a pair of both kinds is there once.
    """
    value = F.log1p("weight") if log1p else F.col("weight")
    e = edges.where("weight > 0")
    intra = e.join(consensus.where("share > 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_semi").select("a", "b", value.alias("weight"), F.lit("within").alias("kind"))
    m = modules.where("module >= 0")
    cross = e.where(F.round("weight", 9) >= least).join(m.toDF("a", "ma"), "a").join(m.toDF("b", "mb"), "b").where("ma <> mb").select("a", "b", value.alias("weight"), F.lit("between").alias("kind"))
    return intra.union(cross).groupBy("a", "b", "weight").agg(F.max("kind").alias("kind")).withColumn("sign", F.when(F.col("weight") < 0, "neg").otherwise("pos"))


def graph_quality(pairs: DataFrame, features: DataFrame, modules: DataFrame, least: float) -> DataFrame:
    """One row on the graph of pairs with |l| >= least: density, components, mean and deviation of degrees, share of hubs (over twice the median degree)
    and modularity of ``modules`` (a partition of it, say), unweighted."""
    from tesselark.operators import graph as K

    e = K.symmetric(pairs.where(F.round(F.abs("l"), 9) >= least).select("a", "b", F.lit(1.0).alias("weight")))
    f = features.select("feature").distinct()
    deg = f.join(K.degrees(e), "feature", "left").select("feature", F.coalesce("degree", F.lit(0)).alias("degree"))
    facts = deg.agg(F.count("*").alias("n"), F.avg("degree").alias("mean_degree"), F.stddev_samp("degree").alias("sd_degree"), F.percentile("degree", F.lit(0.5)).alias("middle"))
    hubs = deg.crossJoin(F.broadcast(facts)).agg(F.avg((F.col("degree") > 2 * F.col("middle")).cast("double")).alias("hub_ratio"))
    # A forest has one edge less than nodes in every component.
    tree = T.spanning_forest(e).agg(F.count("*").alias("tree"))
    n = F.col("n").cast("double")
    return facts.crossJoin(hubs).crossJoin(tree).crossJoin(K.modularity(e, modules)).select(
        (F.col("mean_degree") / (n - 1)).alias("density"), (F.col("n") - F.col("tree")).alias("components"), "mean_degree", "sd_degree", "hub_ratio", "modularity"
    )
