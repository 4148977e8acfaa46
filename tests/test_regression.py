"""Local regression and bands against plain code over all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesselark.functions import ranks
from tesselark.operators import regression as L


def _near(x: np.ndarray, at: np.ndarray, span: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the indexes of the nearest points and their tricube weights (zero throughout if all coincide)."""
    k = max(2, int(np.ceil(span * len(x))))
    k = min(k, len(x), most) if most else min(k, len(x))
    d = np.abs(at[:, None] - x[None, :])
    idx = np.argpartition(d, k - 1, axis=1)[:, :k]
    d = np.take_along_axis(d, idx, axis=1)
    far = d.max(axis=1, keepdims=True)
    w = np.where(far > 0, np.clip(1 - np.divide(d, far, out=np.zeros_like(d), where=far > 0) ** 3, 0, None) ** 3, 0)
    return idx, w


class Smoother:
    """Local regression at fixed places as one linear map of the values."""

    def __init__(self, x: np.ndarray, at: np.ndarray, span: float = 0.45, degree: int = 1, most: int = 0):
        self.map = np.zeros((len(at), len(x)))
        self.weight = np.zeros_like(self.map)
        if not len(x):
            self.map[:] = np.nan
            return
        if len(x) < 3:
            self.map[:] = 1 / len(x)
            return
        for start in range(0, len(at), 256):
            part = at[start : start + 256]
            idx, w = _near(x, part, span if span > 0 else 0.3, most)
            total = w.sum(axis=1, keepdims=True)
            flat = total[:, 0] <= 0
            w0 = np.where(total > 0, w / np.where(total > 0, total, 1), 0)
            c = np.where(flat[:, None], 1 / idx.shape[1], w0)
            if degree:
                xc = x[idx] - part[:, None]
                s0, s1, s2 = total[:, 0], (w * xc).sum(axis=1), (w * xc * xc).sum(axis=1)
                den = s0 * s2 - s1 * s1
                ok = (np.abs(den) >= 1e-14) & ~flat
                line = w * (s2[:, None] - s1[:, None] * xc) / np.where(ok, den, 1)[:, None]
                c = np.where(ok[:, None], line, c)
            rows = np.arange(start, start + len(part))[:, None]
            self.map[rows, idx] = c
            self.weight[rows, idx] = w0
        self.at = at

    def __call__(self, y: np.ndarray) -> np.ndarray:
        return self.map @ y


SCHEMA = "a string, b string, r double, l double"


def pairs_of(spark, x, y):
    return spark.createDataFrame([(f"g{i:05}", "h", float(u), float(v)) for i, (u, v) in enumerate(zip(x, y))], SCHEMA)


def cases():
    r = np.random.default_rng(7)
    x = np.r_[np.sort(r.uniform(-1, 1, 900)), np.full(400, 0.25), np.round(r.normal(0, 0.3, 300), 1)]
    yield x, np.sin(3 * x) + r.normal(0, 0.1, len(x))
    yield np.arange(12.0), r.normal(size=12)
    yield np.full(30, 2.0), r.normal(size=30)
    yield np.array([0.0, 1.0, 2.0]), np.array([1.0, 5.0, 2.0])


@pytest.mark.parametrize("case", range(4))
@pytest.mark.parametrize("span, degree, k_max", [(0.45, 1, 0), (0.1, 0, 0), (0.5, 1, 50)])
def test_fits(spark, case, span, degree, k_max):
    x, y = list(cases())[case]
    at = np.r_[np.linspace(x.min() - 0.2, x.max() + 0.2, 9), 0.25, x[:3]]
    got = {t.x: t.fit for t in L.loess(pairs_of(spark, x, y), at.tolist(), span=span, degree=degree, k_max=k_max).collect()}
    m = Smoother(x, at, span, degree, k_max)
    want = m(y)
    for k, x0 in enumerate(at):
        near = np.sort(np.abs(x - x0))
        size = L.neighbours(len(x), span, k_max)
        if near[0] < near[size - 1]:
            assert got[x0] == pytest.approx(want[k], abs=1e-7)
        else:  # all as far: the mean of all that are (the plain way picks some)
            assert got[x0] == pytest.approx(y[np.abs(x - x0) <= near[0]].mean())


def test_distances_are_those_of_the_nearest(spark):
    x, y = next(cases())
    held = L.layout(L.usable(pairs_of(spark, x, y), "r", "l"))
    at = np.r_[np.linspace(-3, 3, 25), x[::50]]
    places = spark.createDataFrame(list(enumerate(at.tolist())), "id long, x0 double")
    for k in (1, 2, 77, 700, len(x)):
        got = {r.id: r.d for r in L.distances(held, places, k).collect()}
        assert [got[i] for i in range(len(at))] == [pytest.approx(np.sort(np.abs(x - v))[k - 1], abs=1e-12) for v in at]


def test_facts(spark):
    x, y = next(cases())
    got = L.loess_facts(pairs_of(spark, x, y)).first()
    m = Smoother(x, x)
    res = y - m(y)
    own = m.weight[np.arange(len(x)), np.arange(len(x))].sum()
    assert got.n == len(x) and got.edf == pytest.approx(own) and got.sigma2_edf == pytest.approx((res**2).sum() / (len(x) - own))
    assert got.mad == pytest.approx(1.4826 * np.median(np.abs(res - np.median(res))))
    none = pairs_of(spark, [], [])
    assert L.loess_facts(none).first().n == 0 and np.isnan(L.loess(none, [0.5]).first().fit) and L.loess_band(none).count() == 0
    odd = none.union(spark.createDataFrame([("a", "b", None, 1.0), ("a", "c", float("nan"), 1.0), ("a", "d", 1.0, 3.0), ("a", "e", 2.0, 5.0)], SCHEMA))
    assert [r.fit for r in L.loess(odd, [0.0, 9.0]).collect()] == [4.0, 4.0] and L.loess_facts(odd).first().n == 2


@pytest.mark.parametrize("kind", ["percentile", "basic", "bc"])
def test_bands(spark, kind):
    from statistics import NormalDist

    x, y = next(cases())
    x, y = x[::3], y[::3]
    pairs = pairs_of(spark, x, y)
    got = L.loess_band(pairs, places=7, draws=40, kind=kind, n_strata=4).orderBy("r").toPandas()
    grid = np.linspace(x.min(), x.max(), 7)
    fit = Smoother(x, x)(y)
    cuts = np.unique(np.quantile(x, [0, 0.25, 0.5, 0.75, 1]))
    group = np.clip(np.searchsorted(cuts, x, "left") - 1, 0, len(cuts) - 2)
    keys = pairs.select("a", F.xxhash64("a", "b").alias("key"), F.xxhash64("a", "b", F.lit(1)).alias("turn")).orderBy("a").toPandas()
    turn, key = keys["turn"].to_numpy(), keys["key"].to_numpy()
    members = [np.flatnonzero(group == g)[np.argsort(turn[group == g])] for g in range(len(cuts) - 1)]
    sizes = np.array([len(m) for m in members])[group]
    at = L.drawn(key, 40, 1, sizes)
    res = y - fit
    y2 = fit[:, None] + np.array([[res[members[group[i]][j]] for j in at[i]] for i in range(len(x))])
    m = Smoother(x, grid)
    boot, curve = m(y2), m(y)
    normal, want = NormalDist(), []
    for v, f in zip(np.sort(boot, axis=1), curve):
        p = (0.025, 0.975)
        if kind == "bc":
            z = normal.inv_cdf(((v < f).sum() + 0.5) / 41)
            p = tuple(normal.cdf(2 * z + normal.inv_cdf(q)) for q in p)
        lo, hi = (L.band_quantile(v, q) for q in p)
        want.append((2 * f - hi, 2 * f - lo) if kind == "basic" else (lo, hi))
    assert got.fit.to_numpy() == pytest.approx(curve, abs=1e-9) and got.w2.to_numpy() == pytest.approx((m.weight**2).sum(axis=1), abs=1e-9)
    assert got[["lo", "hi"]].to_numpy() == pytest.approx(np.array(want), abs=1e-9)


def test_bands_repeat_and_hold_the_fit(spark):
    r = np.random.default_rng(2)
    x = r.uniform(-1, 1, 200)
    y = x * 0.5 + r.normal(0, 0.1, 200)
    one, two = (L.loess_band(pairs_of(spark, x, y).repartition(n), places=20, draws=50).orderBy("r").toPandas() for n in (1, 3))
    assert np.allclose(one, two, atol=1e-9) and ((one.lo <= one.fit) & (one.fit <= one.hi)).mean() > 0.9


def test_widened(spark):
    x, y = next(cases())
    pairs = pairs_of(spark, x, y)
    curve = spark.createDataFrame(pd.DataFrame({"r": [-0.5, 0.25, 0.6], "fit": [0.1, 0.2, 0.3], "lo": [0.05, 0.2, 0.0], "hi": [0.11, 0.2, 0.9]}))
    got = L.widen(curve, pairs, least=0.02, neighbours=50).orderBy("r").toPandas()
    res = y - np.interp(x, [-0.5, 0.25, 0.6], [0.1, 0.2, 0.3])
    for row, (r, f, lo, hi) in zip(got.itertuples(), [(-0.5, 0.1, 0.05, 0.11), (0.25, 0.2, 0.2, 0.2), (0.6, 0.3, 0.0, 0.9)]):
        near = res[np.lexsort((np.arange(len(x)), x, np.abs(x - r)))[:50]]
        side = max(0.01, 1.4826 * np.median(np.abs(near - np.median(near))))
        assert row.lo == pytest.approx(min(lo, f - side)) and row.hi == pytest.approx(max(hi, f + side))


def test_values_at_ranks(spark):
    v = np.r_[np.random.default_rng(1).normal(size=500), np.zeros(300), 1e9]
    df = spark.createDataFrame([(float(u),) for u in v], "v double")
    assert ranks.values_at(df, "v", [0, 400, 800, 400, 799]) == np.sort(v)[[0, 400, 800, 400, 799]].tolist()
    assert ranks.median(df, "v") == np.median(v) and ranks.median(df.limit(0), "v") is None
    assert ranks.quantiles(df, "v", [0.1, 0.55, 1]) == pytest.approx(np.quantile(v, [0.1, 0.55, 1]).tolist())
