"""How good modules are: permuted labels, tests of within against between, agreement with a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselark.functions import testing

ODD = ["1", "3", "5", "7", "9", "b", "d", "f"]


def edge_table(pairs: DataFrame, value: str = "weight") -> DataFrame:
    """Edges (a, b, score): absolute values, loops left out."""
    return pairs.where("a <> b").select("a", "b", F.abs(value).alias("score"))


def permuted_labels(modules: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """(draw, feature, module): the members' modules dealt anew by hashes of draw and feature. Features are few; their windows are small."""
    m = modules.where("module >= 0")
    placed = m.withColumn("k", F.row_number().over(Window.orderBy("feature")))
    many = m.select("feature").crossJoin(m.sparkSession.range(1, draws + 1).withColumnRenamed("id", "draw"))
    h = F.md5(F.concat_ws("|", F.lit(seed), "draw", "feature"))
    dealt = many.select("draw", "feature", F.row_number().over(Window.partitionBy("draw").orderBy(h, "feature")).alias("k"))
    return dealt.join(F.broadcast(placed.select("k", "module")), "k").select("draw", "feature", "module")


def _ends(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Every edge from both of its ends, with whether both have one label, per draw."""
    one, two = (labels.select("draw", F.col("feature").alias(x), F.col("module").alias(f"m{x}")) for x in "ab")
    e = edges.select("a", "b", "weight").join(one, "a").join(two, ["draw", "b"])
    return e.select("draw", "weight", (F.col("ma") == F.col("mb")).alias("inside"), F.explode(F.array(F.struct(F.col("a").alias("feature"), F.col("ma").alias("module")), F.struct(F.col("b").alias("feature"), F.col("mb").alias("module")))).alias("p"))


def member_null(edges: DataFrame, modules: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """Per feature: mean and deviation over draws of its margin (mean weight inside its module less outward) under permuted labels."""
    ends = _ends(edges, permuted_labels(modules, draws, seed))
    margin = F.coalesce(F.avg(F.when(F.col("inside"), F.col("weight"))), F.lit(0.0)) - F.coalesce(F.avg(F.when(~F.col("inside"), F.col("weight"))), F.lit(0.0))
    return ends.groupBy("draw", "p.feature").agg(margin.alias("v")).groupBy("feature").agg(F.avg("v").alias("null_mean"), F.stddev_samp("v").alias("null_sd"))


def module_null(edges: DataFrame, modules: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """Per module: mean and deviation over draws of separation (mean weight outward) and conductance under permuted labels."""
    ends = _ends(edges, permuted_labels(modules, draws, seed))
    out, inner = (F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0.0)) for c in (~F.col("inside"), F.col("inside")))
    # An inner edge is met from both of its ends.
    per = ends.groupBy("draw", "p.module").agg(F.avg(F.when(~F.col("inside"), F.col("weight"))).alias("separation"), (out / F.nullif(out + inner / 2, F.lit(0.0))).alias("conductance"))
    return per.groupBy("module").agg(*(f(c).alias(f"{c}_{n}") for c in ("separation", "conductance") for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"))))


def against_null(scores: DataFrame, null: DataFrame, key: str, value: str) -> DataFrame:
    """Adds z, two-sided normal p and BH (null z don't count) to scores whose null has columns null_mean and null_sd."""
    j = scores.join(null.select(key, "null_mean", "null_sd"), key, "left")
    z = j.withColumn("z", (F.col(value) - F.col("null_mean")) / F.nullif("null_sd", F.lit(0.0)))
    return testing.adjust(z.withColumn("p", F.when(F.col("z").isNotNull(), testing.two_sided_normal("z"))), "p", "bh")


def top_members(scores: DataFrame, n: int = 5) -> DataFrame:
    """Per module its size and its n best members (a report's limit) by rank, then name, joined by commas."""
    k = F.row_number().over(Window.partitionBy("module").orderBy("rank", "feature"))
    best = F.array_sort(F.collect_list(F.when(F.col("k") <= n, F.struct("k", "feature"))))
    return scores.withColumn("k", k).groupBy("module").agg(F.count("*").alias("size"), F.array_join(F.transform(best, lambda x: x["feature"]), ",").alias("members"))


def reference_within_between(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Per module: its size, the mean reference score of edges (a, b, score) inside it and of those with one end in it, and the difference."""
    m = modules.where("module >= 0")
    e = edges.where("score IS NOT NULL").join(m.toDF("a", "ma"), "a").join(m.toDF("b", "mb"), "b")
    ends = e.select("score", (F.col("ma") == F.col("mb")).alias("inside"), F.explode(F.array_distinct(F.array("ma", "mb"))).alias("module"))
    mean = lambda c: F.avg(F.when(c, F.col("score")))
    got = ends.groupBy("module").agg(mean(F.col("inside")).alias("within"), mean(~F.col("inside")).alias("between"))
    return m.groupBy("module").agg(F.count("*").alias("size")).join(got, "module", "left").select("module", "size", "within", "between", (F.col("within") - F.col("between")).alias("delta"))


def _upper(z: Column) -> Column:
    """P(N >= z)."""
    tail = testing.two_sided_normal(z) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def signed_rank(deltas: DataFrame, value: str = "diff") -> DataFrame:
    """One row: Wilcoxon's sum of ranks of positive values, the number of values other than zero, z (with continuity and ties) and p, for values above zero."""
    d = deltas.select(F.round(value, 9).alias("d")).where("d <> 0 AND NOT isnan(d)")
    w = Window.partitionBy("m")
    ranked = d.withColumn("m", F.abs("d")).withColumn("t", F.count("*").over(w)).withColumn("r", F.rank().over(Window.orderBy("m")) + (F.col("t") - 1) / 2)
    s = ranked.agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("v"), F.count("*").alias("n"), F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("ties"))
    n = F.col("n").cast("double")
    z = (F.col("v") - n * (n + 1) / 4 - 0.5) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return s.select("v", "n", F.when(F.col("n") > 0, z).alias("z")).withColumn("p", F.when(F.col("z").isNotNull(), _upper(F.col("z"))))


def sign_flips(deltas: DataFrame, draws: int, key: str = "feature", value: str = "diff", seed: int = 1) -> DataFrame:
    """One row: the mean of the values, and the share of draws with signs from a hash of draw and key whose mean is at least that, itself among them."""
    d = deltas.where(F.col(value).isNotNull()).select(key, value)
    many = d.crossJoin(d.sparkSession.range(1, draws + 1).withColumnRenamed("id", "draw"))
    sign = F.when(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "draw", key)), 1, 1).isin(ODD), 1.0).otherwise(-1.0)
    means = many.groupBy("draw").agg(F.avg(sign * F.col(value)).alias("v"))
    return means.crossJoin(F.broadcast(d.agg(F.avg(value).alias("mean")))).groupBy("mean").agg(((F.sum((F.round("v", 9) >= F.round("mean", 9)).cast("long")) + 1) / (F.count("*") + 1)).alias("p"))


def signatures(values: DataFrame, bits: int = 8, tables: int = 4, seed: int = 1) -> DataFrame:
    """(feature, table, signature): on which sides of random planes a feature's values (gx, gy, feature, z) lie; signs come from hashes of plane and bin."""
    planes = values.sparkSession.range(bits * tables).select((F.col("id") / bits).cast("int").alias("table"), (F.col("id") % bits).cast("int").alias("bit"))
    plane = values.select("gx", "gy").distinct().crossJoin(F.broadcast(planes))
    sign = F.when(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "table", "bit", "gx", "gy")), 1, 1).isin(ODD), 1.0).otherwise(-1.0)
    side = values.join(plane.withColumn("sign", sign), ["gx", "gy"]).groupBy("feature", "table", "bit").agg((F.round(F.sum(F.col("sign") * F.col("z")), 9) >= 0).cast("long").alias("side"))
    return side.groupBy("feature", "table").agg(F.sum(F.col("side") * F.pow(F.lit(2.0), F.col("bit"))).cast("long").alias("signature"))


def candidates(signs: DataFrame, scores: DataFrame, value: str, n: int) -> DataFrame:
    """The n best pairs (a, b) by a value for every a, among those that share a signature in some table; ties by b."""
    met = signs.withColumnRenamed("feature", "a").join(signs.withColumnRenamed("feature", "b"), ["table", "signature"]).where("a <> b").select("a", "b").distinct()
    k = F.row_number().over(Window.partitionBy("a").orderBy(F.round(value, 9).desc(), "b"))
    return scores.join(met, ["a", "b"], "left_semi").select("a", "b", value, k.alias("k")).where(F.col("k") <= n)
