"""Multiple-testing adjustments as windows, and distribution functions as vectorised UDFs."""

from __future__ import annotations

import math
import statistics

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window


def adjust(df: DataFrame, p: str, out: str = "fdr", method: str = "bh", by: list[str] | None = None) -> DataFrame:
    """Adjusted p-values over the rows (or groups of them): bh, by or bonferroni; null p stay null and don't count.

    Ranks are global by nature; rows here are pairs of features, many fewer than points.
    """
    group = Window.partitionBy(*(by or []), F.col(p).isNull())
    m = F.count(p).over(group)
    if method == "bonferroni":
        return df.withColumn(out, F.least(F.lit(1.0), F.col(p) * m))
    rank = F.count(p).over(group.orderBy(p).rangeBetween(Window.unboundedPreceding, 0))
    ranked = df.withColumn("_m", m).withColumn("_r", rank)
    factor = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("_m")), F.lit(0.0), lambda s, i: s + 1 / i.cast("double")) if method == "by" else F.lit(1.0)
    ranked = ranked.withColumn("_q", F.col(p) * F.col("_m") * factor / F.col("_r"))
    best = F.min("_q").over(group.orderBy(p).rangeBetween(0, Window.unboundedFollowing))
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), best))).drop("_m", "_r", "_q")


def storey(df: DataFrame, p: str, out: str = "q") -> DataFrame:
    """BH times pi0, the least estimate over thresholds .5, .55, ..., .95 in (0, 1]."""
    cuts = [0.5 + 0.05 * i for i in range(10)]
    share = lambda c: F.avg((F.col(p) > round(c, 2)).cast("double")) / (1 - round(c, 2))
    pi0 = df.where(F.col(p).isNotNull()).agg(F.least(*[share(c) for c in cuts], F.lit(1.0)).alias("_pi"))
    pi0 = pi0.select(F.when(F.col("_pi") > 0, F.col("_pi")).otherwise(1.0).alias("_pi"))
    adjusted = adjust(df, p, "_b").crossJoin(F.broadcast(pi0))
    raw = adjusted.withColumn(out, F.least(F.lit(1.0), F.col("_pi") * F.col("_b")))
    return raw.drop("_b", "_pi")


def hashed_uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) from a hash of seed and keys, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *keys)), 1, 8), 16, 10).cast("double") / 2.0**32


def smoothed_p(exceed: Column, draws: int, mode: str = "disc", u: Column | None = None) -> Column:
    """A permutation p-value from the number of draws at least as extreme; "uniform" adds u, in [0, 1), to the number."""
    if mode == "uniform":
        return (exceed + u) / (draws + 1)
    return {"disc": (exceed + 1) / (draws + 1), "beta": (exceed + 1) / (draws + 2), "mid": (exceed + 0.5) / (draws + 1)}[mode]


_erf = np.vectorize(math.erfc, otypes=[float])


@F.pandas_udf(DoubleType())
def two_sided_normal(z: pd.Series) -> pd.Series:
    """P(|N| >= |z|)."""
    return pd.Series(_erf(np.abs(z.to_numpy(dtype=float)) / math.sqrt(2)))


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, out = 1.0, 0.0, 1.0
    for i in range(400):
        k = i // 2
        if i == 0:
            t = 1.0
        elif i % 2 == 0:
            t = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        else:
            t = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / (1 + t * d or 1e-300)
        c = 1 + t / c or 1e-300
        out *= c * d
        if i and abs(c * d - 1) < 1e-14:
            break
    return front * (out - 1)


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation of n pairs, by Student's t; r is clipped to +-0.9999."""
    out = []
    for x, k in zip(r, n):
        if pd.isna(x) or k <= 2:
            out.append(None)
        else:
            x = min(0.9999, max(-0.9999, x))
            out.append(_beta_tail(1 - x * x, (k - 2) / 2, 0.5))
    return pd.Series(out, dtype=float)


@F.pandas_udf(DoubleType())
def fisher_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """One-sided Fisher p of the table (a, b; c, d): a at least as large, margins fixed."""
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    out = []
    for w, x, y, z in zip(a, b, c, d):
        row, col, n = int(w + x), int(w + y), int(w + x + y + z)
        out.append(min(1.0, sum(math.exp(choose(col, k) + choose(n - col, row - k) - choose(n, row)) for k in range(int(w), min(row, col) + 1) if row - k <= n - col)))
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """The z with P(N <= z) = p; null outside (0, 1)."""
    n = statistics.NormalDist()
    return pd.Series([n.inv_cdf(x) if x is not None and 0 < x < 1 else None for x in p], dtype=float)


@F.pandas_udf(DoubleType())
def beta_quantile(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """The x with P(Beta(a, b) <= x) = p, by halving; null for null."""

    def find(q: float, u: float, v: float) -> float | None:
        if any(pd.isna(t) for t in (q, u, v)):
            return None
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _beta_tail(mid, u, v) < q else (lo, mid)
        return (lo + hi) / 2

    return pd.Series([find(*t) for t in zip(p, a, b)], dtype=float)


def permutation_error(exceed: Column, draws: int, level: float = 0.95) -> tuple[Column, Column, Column]:
    """Of a permutation p-value (exceed + 1) / (draws + 1): its sampling error, and the ends of its interval from beta quantiles."""
    p, tail = (exceed + 1) / (draws + 1), (1 - level) / 2
    a, b = (exceed + 1).cast("double"), (F.lit(draws) - exceed + 1).cast("double")
    return F.sqrt(p * (1 - p) / draws), beta_quantile(F.lit(tail), a, b), beta_quantile(F.lit(1 - tail), a, b)
