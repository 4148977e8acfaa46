"""Pairs over another statistic: samples, strata, and knees of curves; the local regression is in ``regression``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def downsample(pairs: DataFrame, most: int, share: float | None = None) -> DataFrame:
    """At most so many pairs, the same ones in every run; or a share of them, without a sort."""
    h = F.xxhash64("a", "b")
    if share is not None:
        return pairs.where(F.pmod(h, F.lit(1 << 20)) < share * (1 << 20))
    return pairs.orderBy(h, "a", "b").limit(most)


def strata(pairs: DataFrame, by: str = "r", n: int = 10) -> DataFrame:
    """Adds stratum (from 1): between quantiles of ``by``; equal breaks are one."""
    breaks = pairs.agg(F.array_distinct(F.percentile(by, [k / n for k in range(n + 1)])).alias("br"))
    above = F.size(F.filter("br", lambda q: q < F.col(by)))
    return pairs.crossJoin(F.broadcast(breaks)).withColumn("stratum", F.greatest(above, F.lit(1))).drop("br")


def exceed_error(p: str, draws: int):
    """Monte Carlo standard error of a permutation's p."""
    return F.sqrt(F.col(p) * (1 - F.col(p)) / draws)


def knee_input(values: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Means (feature, size, v) by feature and size of clamped values within 1.5 spans of the outer quantiles."""
    v = values.where("feature IS NOT NULL AND size IS NOT NULL AND v IS NOT NULL").select("feature", "size", F.greatest("v", F.lit(0.0)).alias("v"))
    q = v.groupBy("feature").agg(F.percentile("v", low).alias("ql"), F.percentile("v", high).alias("qu"))
    span = 1.5 * (F.col("qu") - F.col("ql"))
    inside = v.join(q, "feature").where(F.col("v").between(F.col("ql") - span, F.col("qu") + span))
    return inside.groupBy("feature", "size").agg(F.avg("v").alias("v"))


def knees(curves: DataFrame, by: list[str], x: str = "size", y: str = "v", fewest: int = 6) -> DataFrame:
    """For each curve the place of the greatest curvature of y over its places in order; curves of fewer places have none."""
    w = Window.partitionBy(*by).orderBy(x)
    before, after = F.lag(y).over(w), F.lead(y).over(w)
    bend = F.abs(after - 2 * F.col(y) + before) / F.pow(1 + F.pow((after - before) / 2, 2), 1.5)
    c = curves.withColumn("bend", F.round(bend, 9)).groupBy(*by)
    agg = c.agg(F.count("*").alias("n"), F.max(F.when(F.col("bend").isNotNull(), F.struct("bend", (-F.col(x)).alias("nx")))).alias("m"))
    return agg.select(*by, F.when(F.col("n") >= fewest, -F.col("m.nx")).alias("knee"))
