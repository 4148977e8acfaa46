"""Values at exact ranks of a column, without sorting it as a whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024


def breaks(df: DataFrame, column: str, buckets: int = BUCKETS) -> np.ndarray:
    """Ascending values that cut a column in parts of about equal numbers; bounded by ``buckets``."""
    if buckets < 2:
        return np.empty(0)
    got = df.agg(F.percentile_approx(column, [k / buckets for k in range(1, buckets)], 10 * buckets).alias("q")).first().q
    return np.unique(np.array(got or [], float))


def bucketed(df: DataFrame, column: str, cuts: np.ndarray) -> DataFrame:
    """``df`` (of any columns but bucket) with the number of cuts below each value."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(bucket=np.searchsorted(cuts, f[column].to_numpy(float), side="left").astype(np.int32))

    return df.mapInPandas(run, df.withColumn("bucket", F.lit(0)).schema)


def values_at(df: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """The values at ranks (from 0) of a column without nulls or NaN.

    Values are dealt to buckets by approximate quantiles; exact counts of the buckets tell in which one a rank lies, and only those
    buckets are sorted, equal values being one row.
    """
    if not ranks:
        return []
    v = df.select(F.col(column).cast("double").alias("v"))
    counts = bucketed(v.groupBy("v").agg(F.count("*").alias("n")), "v", breaks(v, "v"))
    sizes = {r.bucket: r.n for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    number = np.array(sorted(sizes))
    end = np.cumsum([sizes[b] for b in number])
    at = np.searchsorted(end, np.asarray(ranks), side="right")
    wanted: dict[int, list[int]] = {}
    for r, k in zip(ranks, at.tolist()):
        wanted.setdefault(int(number[k]), []).append(int(r - (end[k] - sizes[number[k]])))

    def chosen(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("v")
        inside = wanted[int(f["bucket"].iloc[0])]
        return pd.DataFrame({"bucket": f["bucket"].iloc[0], "rank": inside, "v": f["v"].to_numpy()[np.searchsorted(f["n"].cumsum().to_numpy(), inside, side="right")]})

    got = counts.where(F.col("bucket").isin(list(wanted))).groupBy("bucket").applyInPandas(chosen, "bucket int, rank long, v double").collect()
    found = {(g.bucket, g["rank"]): g.v for g in got}
    return [found[int(number[k]), int(r - (end[k] - sizes[number[k]]))] for r, k in zip(ranks, at.tolist())]


def median(df: DataFrame, column: str) -> float | None:
    n = df.count()
    if not n:
        return None
    low, high = values_at(df, column, [(n - 1) // 2, n // 2])
    return (low + high) / 2


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Quantiles by linear interpolation between the ranks next to share * (n - 1)."""
    n = df.count()
    if not n:
        return []
    at = [s * (n - 1) for s in shares]
    low, high = [int(np.floor(a)) for a in at], [int(np.ceil(a)) for a in at]
    v = values_at(df, column, low + high)
    return [a + (p - b) * (c - a) for a, c, p, b in zip(v[: len(at)], v[len(at) :], at, low)]
