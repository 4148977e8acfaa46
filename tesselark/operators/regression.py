"""Local regression of all pairs, and bootstrap bands, as sums over the pairs.

Pairs of equal x are one row (count, sum of y). Rows are dealt to at most ``ranks.BUCKETS`` buckets by x; the driver keeps each bucket's limits, number and
power sums, so what it holds does not grow with the pairs. A fit at a place takes

- the distance d of the k-th nearest pair: for every x the nearest x that has k pairs from there on is found by its rank; the places at which one
  such span gives way to the next stand in order, so each place has its span by a search in one bucket;
- the tricube weights' sums. Within a bucket that lies on one side of the place and within d the weight is a polynomial of x, so its sums
  follow from the bucket's power sums; the at most three other buckets get the place as a request and answer with their own rows' sums.

So a fit at all pairs shuffles each of them a few times, where a plain one would compare all with all. A band redraws residuals within strata; a draw's fits
are sums over the pairs again, which each task adds up for all draws and places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, comb
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselark.functions import ranks
from tesselark.sources.files import materialised

#: Places times rows that a step works on.
HELD = 1 << 20
#: Residuals of a stratum that are drawn from: all of them, or so many chosen by hash.
POOL = 65_536
#: Coefficients by power of u of the tricube weight (1 - u^3)^3 and of its square.
WEIGHT, SQUARE = {0: 1, 3: -3, 6: 3, 9: -1}, {0: 1, 3: -6, 6: 15, 9: -20, 12: 15, 15: -6, 18: 1}
_SUMS = ["s0", "s1", "s2", "t0", "t1", "w2", "c", "sy"]


def usable(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Rows (a, b, x, y) of numbers."""
    ok = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in (x, y))
    return pairs.where(ok).select("a", "b", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


@dataclass
class Layout:
    """Rows (x, c, s, bucket) and, by bucket, limits, numbers of pairs and power sums around the middle in units of half the width."""

    rows: DataFrame
    n: int
    low: np.ndarray
    high: np.ndarray
    mid: np.ndarray
    half: np.ndarray
    count: np.ndarray
    cuts: np.ndarray
    m: np.ndarray
    my: np.ndarray

    @property
    def end(self) -> np.ndarray:
        """Pairs up to each bucket's end."""
        return np.cumsum(self.count)


def layout(values: DataFrame) -> Layout:
    """Of rows (x, y)."""
    one = materialised(values.groupBy("x").agg(F.count("*").alias("c"), F.sum("y").alias("s")), "places")
    distinct = one.count()
    cuts = ranks.breaks(one, "x", int(min(ranks.BUCKETS, max(1, distinct**0.5))))
    rows = materialised(ranks.bucketed(one, "x", cuts), "bucketed")
    number = len(cuts) + 1
    low, high, count = np.full(number, np.inf), np.full(number, -np.inf), np.zeros(number, np.int64)
    for r in rows.groupBy("bucket").agg(F.min("x").alias("l"), F.max("x").alias("h"), F.sum("c").alias("c")).collect():
        low[r.bucket], high[r.bucket], count[r.bucket] = r.l, r.h, r.c
    # Buckets without rows are empty ranges.
    used = count > 0
    mid, half = np.zeros(number), np.ones(number)
    mid[used], half[used] = (low[used] + high[used]) / 2, np.maximum((high[used] - low[used]) / 2, 1e-300)

    def powers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((number, 19 + 11))
        for f in frames:
            b = f["bucket"].to_numpy()
            t = (f["x"].to_numpy() - mid[b]) / half[b]
            c, s, p = f["c"].to_numpy(float), f["s"].to_numpy(), np.ones(len(f))
            for j in range(19):
                total[:, j] += np.bincount(b, c * p, number)
                if j < 11:
                    total[:, 19 + j] += np.bincount(b, s * p, number)
                p = p * t
        some = np.flatnonzero(total[:, 0])
        yield pd.DataFrame({"bucket": some.astype(np.int32), **{f"p{j}": total[some, j] for j in range(30)}})

    m = np.zeros((number, 30))
    parts = rows.mapInPandas(powers, "bucket int, " + ", ".join(f"p{j} double" for j in range(30)))
    for r in parts.groupBy("bucket").agg(*[F.sum(f"p{j}").alias(f"p{j}") for j in range(30)]).collect():
        m[r.bucket] = [r[f"p{j}"] for j in range(30)]
    return Layout(rows, int(count.sum()), low, high, mid, half, count, cuts, m[:, :19], m[:, 19:])


def neighbours(size: int, span: float, k_max: int) -> int:
    k = max(2, ceil((span if span > 0 else 0.3) * size))
    return min(k, size, k_max) if k_max > 0 else min(k, size)


def spans(at: Layout, k: int) -> DataFrame:
    """Rows (bucket, v, w): every x (v, of that bucket) with k pairs from there on, and the x (w) at which these are reached."""
    end, before = at.end, at.end - at.count

    def targets(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("x")
        b = int(f["bucket"].iloc[0])
        t = before[b] + f["c"].cumsum().to_numpy() - f["c"].to_numpy() + k
        keep = t <= at_n
        return pd.DataFrame({"to": np.searchsorted(end, t[keep]).astype(np.int32), "bucket": np.int32(b), "v": f["x"].to_numpy()[keep], "t": t[keep]})

    at_n = at.n
    asked = at.rows.groupBy("bucket").applyInPandas(targets, "to int, bucket int, v double, t long")

    def reached(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame({"bucket": np.empty(0, np.int32), "v": np.empty(0), "w": np.empty(0)})
        rows = rows.sort_values("x")
        c = before[int(rows["bucket"].iloc[0])] + rows["c"].cumsum().to_numpy()
        return pd.DataFrame({"bucket": asks["bucket"], "v": asks["v"], "w": rows["x"].to_numpy()[np.searchsorted(c, asks["t"].to_numpy())]})

    return at.rows.groupBy("bucket").cogroup(asked.groupBy("to")).applyInPandas(reached, "bucket int, v double, w double")


def distances(at: Layout, places: DataFrame, k: int) -> DataFrame:
    """``places`` (id, x0) with d, the distance of the k-th nearest pair."""
    number = len(at.count)
    held = materialised(spans(at, k), "spans")
    last_s, last_v = np.full(number, -np.inf), np.full(number, -np.inf)
    for r in held.groupBy("bucket").agg(F.max((F.col("v") + F.col("w")) / 2).alias("s"), F.max("v").alias("v")).collect():
        last_s[r.bucket], last_v[r.bucket] = r.s, r.v
    last_s, last_v = np.maximum.accumulate(last_s), np.maximum.accumulate(last_v)

    def routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            # Beyond the last turn the last span holds: its bucket answers.
            b = np.minimum(np.searchsorted(last_s, f["x0"].to_numpy(float)), int(np.argmax(last_s == last_s[-1])))
            yield f[["id", "x0"]].assign(bucket=b.astype(np.int32))

    def found(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame({"id": np.empty(0, np.int64), "x0": np.empty(0), "d": np.empty(0)})
        rows = rows.sort_values("v")
        v, w, x0 = rows["v"].to_numpy(), rows["w"].to_numpy(), asks["x0"].to_numpy()
        b = int(rows["bucket"].iloc[0])
        earlier = np.r_[last_v[b - 1] if b else -np.inf, v]
        i = np.searchsorted((v + w) / 2, x0)
        right = np.where(i < len(v), w[np.minimum(i, len(v) - 1)] - x0, np.inf)
        return pd.DataFrame({"id": asks["id"], "x0": x0, "d": np.minimum(right, x0 - earlier[i])})

    asked = places.mapInPandas(routed, "id long, x0 double, bucket int")
    return held.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(found, "id long, x0 double, d double")


def _poly(u: np.ndarray, coefficients: dict[int, int], shift: int = 0) -> np.ndarray:
    return sum(c * u[p + shift] for p, c in coefficients.items())


def sums(at: Layout, measured: DataFrame, square: bool = False) -> DataFrame:
    """For places with their distances (id, x0, d) the weights' sums: of 1, x - x0 and its square (s0, s1, s2), of y and y (x - x0) (t0, t1), of squares
    (w2, if asked); and number and y of all pairs within d (c, sy). With d = 0 the pairs at the place itself weigh 1."""
    low, high, mid, half, m, my = at.low, at.high, at.mid, at.half, at.m, at.my
    top = 18 if square else 11
    schema = "bucket int, id long, x0 double, d double, " + ", ".join(f"{c} double" for c in _SUMS)

    def shifted(alpha: np.ndarray, beta: np.ndarray, powers: np.ndarray, most: int) -> list[np.ndarray]:
        """Sums of (alpha + beta t)^p from those of t^j, for p up to most, by bucket."""
        a, b = [np.ones_like(alpha)], [np.ones_like(beta)]
        for _ in range(most):
            a.append(a[-1] * alpha)
            b.append(b[-1] * beta)
        return [sum(comb(p, j) * a[p - j] * b[j] * powers[:, j] for j in range(p + 1)) for p in range(most + 1)]

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for begin in range(0, len(f), max(1, HELD // (16 * len(low)))):
                g = f.iloc[begin : begin + max(1, HELD // (16 * len(low)))]
                x0, d = g["x0"].to_numpy(float), g["d"].to_numpy(float)
                p, q, e = x0[:, None], d[:, None], np.maximum(d, 1e-300)[:, None]
                touches = (low <= p + q) & (high >= p - q)
                right, left = touches & (low >= p) & (high <= p + q) & (q > 0), touches & (high <= p) & (low >= p - q) & (q > 0)
                left &= ~right
                side = np.where(right, 1.0, -1.0)
                full = right | left
                alpha, beta = np.where(full, side * (mid - p) / e, 0), np.where(full, side * half / e, 0)
                u, v = shifted(alpha, beta, m, top), shifted(alpha, beta, my, 10)
                add = lambda z: np.where(full, z, 0).sum(axis=1)  # noqa: E731, B023
                out = {
                    "s0": add(_poly(u, WEIGHT)), "s1": add(side * q * _poly(u, WEIGHT, 1)), "s2": add(q * q * _poly(u, WEIGHT, 2)), "t0": add(_poly(v, WEIGHT)), "t1": add(side * q * _poly(v, WEIGHT, 1)),
                    "w2": add(_poly(u, SQUARE)) if square else np.zeros(len(g)), "c": add(u[0]), "sy": add(v[0]),
                }
                yield pd.DataFrame({"bucket": np.int32(-1), "id": g["id"], "x0": x0, "d": d, **out})
                who, bucket = np.nonzero(touches & ~full)
                yield pd.DataFrame({"bucket": bucket.astype(np.int32), "id": g["id"].to_numpy()[who], "x0": x0[who], "d": d[who], **dict.fromkeys(_SUMS, 0.0)})

    both = materialised(measured.mapInPandas(whole, schema), "sums")

    def part(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = asks.copy()
        if not len(rows):
            return out
        x, c, s = rows["x"].to_numpy(), rows["c"].to_numpy(float), rows["s"].to_numpy()
        step = max(1, HELD // len(x))
        for begin in range(0, len(asks), step):
            x0, d = (asks[k].to_numpy()[begin : begin + step, None] for k in ("x0", "d"))
            off = x - x0
            near = np.abs(off) <= d
            w = np.where(d > 0, np.clip(1 - (np.abs(off) / np.maximum(d, 1e-300)) ** 3, 0, None) ** 3, off == 0)
            for name, value in (("s0", w @ c), ("s1", (w * off) @ c), ("s2", (w * off * off) @ c), ("t0", w @ s), ("t1", (w * off) @ s), ("w2", (w * w) @ c), ("c", near @ c), ("sy", near @ s)):
                out.iloc[begin : begin + step, out.columns.get_loc(name)] = value
        return out

    parts = at.rows.groupBy("bucket").cogroup(both.where("bucket >= 0").groupBy("bucket")).applyInPandas(part, schema)
    return both.where("bucket < 0").union(parts).groupBy("id", "x0", "d").agg(*[F.sum(c).alias(c) for c in _SUMS])


def fitted(sums_: DataFrame, n: int, degree: int = 1):
    """``sums_`` with ``fit``: the weighted line at the place (degree 1) or mean (0); a plain mean where no pair has weight, or of fewer than three pairs."""
    den = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    mean = F.col("t0") / F.col("s0")
    slope = (F.col("s0") * F.col("t1") - F.col("s1") * F.col("t0")) / den
    fit = F.when((F.col("d") <= 0) | (F.col("s0") <= 0) | F.lit(n < 3), F.col("sy") / F.col("c"))
    fit = fit.when(F.lit(not degree) | (F.abs(den) < 1e-14), mean).otherwise((F.col("t0") - slope * F.col("s1")) / F.col("s0"))
    return sums_.withColumn("fit", fit)


def _at(at: Layout, places: DataFrame, span: float, degree: int, k_max: int, square: bool = False) -> DataFrame:
    if at.n < 3:  # the mean of all
        far = places.select("id", "x0", F.lit(float("1e300")).alias("d"))
        total = at.rows.agg(F.sum("c").cast("double").alias("c"), F.sum("s").alias("sy"))
        zero = [F.lit(0.0).alias(k) for k in _SUMS[:6]]
        return fitted(far.crossJoin(F.broadcast(total)).select("id", "x0", "d", *zero, "c", "sy"), at.n, degree)
    return fitted(sums(at, distances(at, places, neighbours(at.n, span, k_max)), square), at.n, degree)


def loess(pairs: DataFrame, at: list[float], x: str = "r", y: str = "l", span: float = 0.45, degree: int = 1, k_max: int = 0) -> DataFrame:
    """Local regression of y on x over all pairs: rows (x, fit) at the places asked for; NaN everywhere without pairs. Pairs without both numbers take no part."""
    spark = pairs.sparkSession
    held = layout(usable(pairs, x, y))
    places = spark.createDataFrame(list(enumerate(map(float, at))), "id long, x0 double")
    if not held.n:
        return places.select(F.col("x0").alias("x"), F.lit(float("nan")).alias("fit"))
    return _at(held, places, span, degree, k_max).select(F.col("x0").alias("x"), "fit")


def residuals(values: DataFrame, at: Layout, span: float, degree: int, k_max: int) -> DataFrame:
    """``values`` (a, b, x, y) with fit, res and own (the share of a pair's own weight at its place), stored."""
    # A place of every x; ids only tell them apart.
    places = at.rows.select(F.xxhash64("x").alias("id"), F.col("x").alias("x0"))
    own = F.when((F.col("d") <= 0) | F.lit(at.n < 3), F.lit(0.0 if at.n < 3 else 1.0)).otherwise(F.when(F.col("s0") > 0, 1 / F.col("s0")).otherwise(0.0))
    fits = _at(at, places, span, degree, k_max).select(F.col("x0").alias("x"), "fit", own.alias("own"))
    return materialised(values.join(fits, "x").withColumn("res", F.col("y") - F.col("fit")), "residuals")


def loess_facts(pairs: DataFrame, x: str = "r", y: str = "l", span: float = 0.45, degree: int = 1, k_max: int = 0) -> DataFrame:
    """One row: n, effective degrees of freedom (sum of own kernel shares), residual variances and the residuals' median deviation."""
    values = usable(pairs, x, y)
    held = layout(values)
    schema = "n long, edf double, sigma2 double, sigma2_edf double, mad double"
    if not held.n:
        return pairs.sparkSession.createDataFrame([(0, 0.0, 0.0, 0.0, None)], schema)
    res = residuals(values, held, span, degree, k_max)
    edf, ss = res.agg(F.sum("own"), F.sum(F.col("res") * F.col("res"))).first()
    middle = ranks.median(res, "res")
    mad = 1.4826 * ranks.median(res.select(F.abs(F.col("res") - middle).alias("off")), "off")
    return pairs.sparkSession.createDataFrame([(held.n, edf, ss / max(1, held.n - 1), ss / max(1.0, held.n - max(1.0, edf)), mad)], schema)


def drawn(keys: np.ndarray, draws: int, seed: int, sizes: np.ndarray) -> np.ndarray:
    """For each pair (by a hash of its key) and draw the place of a residual among those of its stratum."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64)[:, None] + (np.arange(draws, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return ((h ^ (h >> np.uint64(32))) % sizes.astype(np.uint64)[:, None]).astype(np.int64)


def band_quantile(v: np.ndarray, p: float) -> float:
    """The quantile at rank p (n + 1) of sorted numbers, linear between ranks, clamped at the ends."""
    h = p * (len(v) + 1)
    if h <= 1 or h >= len(v):
        return float(v[0] if h <= 1 else v[-1])
    i = int(h) - 1
    return float(v[i] + (h - int(h)) * (v[i + 1] - v[i]))


def loess_band(pairs: DataFrame, x: str = "r", y: str = "l", places: int = 1000, draws: int = 1000, span: float = 0.45, degree: int = 1, k_max: int = 0, level: float = 0.95, kind: str = "percentile", n_strata: int = 10, seed: int = 1) -> DataFrame:
    """Curve (r, fit, lo, hi, w2) on an even grid, with a band from residuals redrawn within strata of x.

    kind: percentile, basic (mirrored at the fit) or bc (bias corrected). Every pair takes part in every draw. A stratum's residuals are drawn from all of
    them, or from POOL of them if there are more. What a task holds and sends is places x draws numbers.
    """
    spark = pairs.sparkSession
    values = usable(pairs, x, y)
    held = layout(values)
    if held.n < 3:
        return spark.createDataFrame([], "r double, fit double, lo double, hi double, w2 double")
    grid = np.linspace(held.low[held.count > 0].min(), held.high[held.count > 0].max(), places)
    asked = spark.createDataFrame(list(enumerate(grid.tolist())), "id long, x0 double")
    curve = _at(held, asked, span, degree, k_max, square=True).orderBy("id").toPandas()  # as many rows as places
    # A pair's share in the fit at a place, from the place's sums.
    d, s0, s1, s2, c = (curve[k].to_numpy()[:, None] for k in ("d", "s0", "s1", "s2", "c"))
    den = s0 * s2 - s1 * s1
    line = (np.abs(den) >= 1e-14) & bool(degree)

    def shares(xs: np.ndarray) -> np.ndarray:
        off = xs - grid[:, None]
        w = np.where(d > 0, np.clip(1 - (np.abs(off) / np.maximum(d, 1e-300)) ** 3, 0, None) ** 3, 0)
        straight = w * (s2 - s1 * off) / np.where(line, den, 1)
        return np.where((d <= 0) | (s0 <= 0), (np.abs(off) <= d) / c, np.where(line, straight, w / np.where(s0 > 0, s0, 1)))

    cuts = np.unique(ranks.quantiles(values, "x", [k / n_strata for k in range(n_strata + 1)]))
    number = max(1, len(cuts) - 1)
    stratum = lambda xs: np.clip(np.searchsorted(cuts, xs, "left") - 1, 0, number - 1)
    res = residuals(values, held, span, degree, k_max)
    inner = F.array(*[F.lit(float(v)) for v in cuts])
    group = F.greatest(F.least(F.size(F.filter(inner, lambda q: q < F.col("x"))) - 1, F.lit(number - 1)), F.lit(0))
    by_hash = Window.partitionBy("g").orderBy(F.xxhash64("a", "b", F.lit(seed)), "a", "b", "x", "y")
    pool = res.withColumn("g", group).withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= POOL).select("g", "k", "res").orderBy("g", "k").toPandas()  # n_strata x POOL
    size = np.bincount(pool["g"], minlength=number)
    begin, flat = np.cumsum(size) - size, pool["res"].to_numpy()
    step = max(1, HELD // max(places, draws))

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((places, draws))
        for f in frames:
            for b in range(0, len(f), step):
                g = f.iloc[b : b + step]
                s = stratum(g["x"].to_numpy())
                y2 = g["fit"].to_numpy()[:, None] + flat[begin[s][:, None] + drawn(g["key"].to_numpy(), draws, seed, size[s])]
                total += shares(g["x"].to_numpy()) @ y2
        yield pd.DataFrame({"id": np.arange(places), "v": list(total)})

    fit, alpha, normal = curve["fit"].to_numpy(), 1 - level, NormalDist()

    def judged(f: pd.DataFrame) -> pd.DataFrame:
        j = int(f["id"].iloc[0])
        v = np.sort(np.sum(np.stack(f["v"].to_list()), axis=0))
        p = alpha / 2, 1 - alpha / 2
        if kind == "bc":
            z0 = normal.inv_cdf((np.searchsorted(v, fit[j]) + 0.5) / (len(v) + 1))
            p = tuple(normal.cdf(2 * z0 + normal.inv_cdf(q)) for q in p)
        lo, hi = (band_quantile(v, q) for q in p)
        if kind == "basic":
            lo, hi = 2 * fit[j] - hi, 2 * fit[j] - lo
        return pd.DataFrame({"id": [j], "lo": [lo], "hi": [hi]})

    parts = res.select("x", "fit", F.xxhash64("a", "b").alias("key")).mapInPandas(summed, "id long, v array<double>")
    sides = parts.groupBy("id").applyInPandas(judged, "id long, lo double, hi double")
    w2 = np.where(s0[:, 0] > 0, curve["w2"] / np.where(s0[:, 0] > 0, s0[:, 0] ** 2, 1), 0)
    base = spark.createDataFrame(pd.DataFrame({"id": np.arange(places), "r": grid, "fit": fit, "w2": w2}))
    return base.join(sides, "id").select("r", "fit", "lo", "hi", "w2")


def widen(curve: DataFrame, pairs: DataFrame, least: float = 0.0, neighbours: int = 200, factor: float = 1.0, x: str = "r", y: str = "l") -> DataFrame:
    """A band at least ``least`` wide and, on each side, ``factor`` median deviations of the residuals of the nearest pairs (ties by x, a and b)."""
    spark = pairs.sparkSession
    curve = materialised(curve, "curve")
    c = curve.orderBy("r").toPandas()  # as many rows as places
    values = usable(pairs, x, y)
    held = layout(values)
    if not held.n or not len(c):
        return curve
    at, fit, k = c["r"].to_numpy(float), c["fit"].to_numpy(float), min(neighbours, held.n)
    places = spark.createDataFrame(list(enumerate(at.tolist())), "id long, x0 double")
    low, high = held.low, held.high

    def routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x0, d = f["x0"].to_numpy()[:, None], f["d"].to_numpy()[:, None]
            who, bucket = np.nonzero((low <= x0 + d) & (high >= x0 - d))
            yield f.iloc[who][["id", "x0", "d"]].assign(bucket=bucket.astype(np.int32))

    def nearest(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"id": np.empty(0, np.int64), "off": np.empty(0), "x": np.empty(0), "a": [], "b": [], "res": np.empty(0)})]
        rows = rows.sort_values(["x", "a", "b"])
        for i, x0, d in zip(asks["id"], asks["x0"], asks["d"]):
            near = rows.assign(id=i, off=(rows["x"] - x0).abs())
            found.append(near[near["off"] <= d].sort_values("off", kind="stable").head(k)[["id", "off", "x", "a", "b", "res"]])
        return pd.concat(found, ignore_index=True).astype({"a": object, "b": object})

    def with_residual(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(res=f["y"] - np.interp(f["x"], at, fit))[["x", "a", "b", "res", "bucket"]]

    # Of pairs of one x no more than k can be among the nearest.
    of_x = Window.partitionBy("x").orderBy("a", "b", "y")
    some = values.withColumn("i", F.row_number().over(of_x)).where(F.col("i") <= k).drop("i")
    rows = ranks.bucketed(some, "x", held.cuts).mapInPandas(with_residual, "x double, a string, b string, res double, bucket int")
    asked = distances(held, places, k).mapInPandas(routed, "id long, x0 double, d double, bucket int")
    near = rows.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(nearest, "id long, off double, x double, a string, b string, res double")
    first = near.withColumn("i", F.row_number().over(Window.partitionBy("id").orderBy("off", "x", "a", "b"))).where(F.col("i") <= k)

    def deviation(f: pd.DataFrame) -> pd.DataFrame:
        r = f["res"].to_numpy()
        return pd.DataFrame({"r": [at[int(f["id"].iloc[0])]], "mad": [1.4826 * float(np.median(np.abs(r - np.median(r))))]})

    mad = first.groupBy("id").applyInPandas(deviation, "r double, mad double")
    side = F.greatest(F.lit(least / 2), factor * F.col("mad"))
    return curve.join(mad, "r").select("r", "fit", F.least("lo", F.col("fit") - side).alias("lo"), F.greatest("hi", F.col("fit") + side).alias("hi"), *[c for c in curve.columns if c not in ("r", "fit", "lo", "hi")])
