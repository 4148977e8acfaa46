"""Sums of products by blocks of features, spots, quantiles with counted zeros, paths through features."""

import itertools

import numpy as np
import pytest

from tesselark.operators import association as A
from tesselark.operators import graph as K
from tesselark.operators import grid as G


def test_gram_by_blocks(spark, monkeypatch):
    r = np.random.default_rng(1)
    u, v = (np.where(r.random((60, 23)) < 0.3, r.integers(1, 9, (60, 23)), 0).astype(float) for _ in range(2))
    table = lambda m, name: spark.createDataFrame([(int(i), f"f{j:02}", float(m[i, j])) for i, j in zip(*np.nonzero(m))], f"i int, feature string, {name} double")
    want = {(f"f{a:02}", f"f{b:02}"): x for (a, b), x in np.ndenumerate(u.T @ v) if x}
    for size in (2048, 5):
        monkeypatch.setattr(A, "BLOCK", size)
        assert {(r.a, r.b): r.num for r in A.gram(table(u, "u"), table(v, "v"), ["i"]).collect()} == want
    monkeypatch.setattr(A, "MOST_FEATURES", 20)
    with pytest.raises(ValueError, match="more than 20"):
        A.gram(table(u, "u"), table(v, "v"), ["i"])


def test_quantiles_with_counted_zeros(spark):
    r = np.random.default_rng(2)
    dense = np.where(r.random((40, 6)) < np.array([0.0, 0.02, 0.1, 0.3, 0.8, 1]), np.round(r.random((40, 6)), 2) + 0.01, 0)
    values = spark.createDataFrame([(int(i), f"f{j}", float(dense[i, j])) for i, j in zip(*np.nonzero(dense))], "i int, feature string, v double")
    for q in (0.95, 0.5, 0.9, 1.0):
        got = {(x.i, x.feature): x.v for x in G.winsorise_sparse(values, 40, "v", q).collect()}
        capped = np.minimum(dense, np.quantile(dense, q, axis=0))
        assert got == {(i, f"f{j}"): pytest.approx(capped[i, j]) for i, j in zip(*np.nonzero(dense))}


def test_detected_features(spark):
    rows = [(i, 1, "often", 1) for i in range(10)] + [(1, 1, "loud", 50), (2, 1, "loud", 1), (3, 1, "rare", 2), (4, 1, "none", 0)]
    counts = spark.createDataFrame(rows, "gx int, gy int, feature string, n long")
    assert [r.feature for r in A.detected(counts, 10, 0.2).collect()] == ["loud", "often"]
    assert [r.feature for r in A.detected(counts, 10, 0.1, 2).collect()] == ["loud", "often"]


def simple_paths(pairs, cutoff):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, todo = [], [(v,) for v in near]
    while todo:
        p = todo.pop()
        if len(p) > 1 and p[0] < p[-1]:
            out.append(p)
        if len(p) <= cutoff:
            todo += [(*p, v) for v in near[p[-1]] - set(p)]
    return out


def test_paths_through_features(spark):
    r = np.random.default_rng(6)
    pairs = sorted({tuple(sorted(map(str, p))) for p in r.integers(0, 9, (16, 2)).tolist() if p[0] != p[1]})
    e = spark.createDataFrame([*pairs, pairs[0][::-1], ("1", "1")], "a string, b string")
    for cutoff, other in itertools.product((2, 8), (None, "3")):
        want = sorted(p for p in simple_paths(pairs, cutoff) if "1" in p and (other is None or other in p))
        got = K.paths_through(e, "1", other, cutoff).collect()
        assert sorted(tuple(x.path) for x in got) == want and all(x.length == len(x.path) for x in got) and want
    with pytest.raises(ValueError, match="more than 5 paths"):
        K.paths_through(e, "1", most=5)
    assert K.paths_through(e, "absent").count() == 0


def test_shifted_rows_are_told_and_used(spark):
    from tesselark.operators import weights as W

    for even in (True, False):
        rows = [(x, y, x + (0.5 if (y % 2 == 0) == even else 0.0), y * 0.8660254) for x in range(1, 7) for y in range(1, 7)]
        at = spark.createDataFrame(rows, "gx int, gy int, cx double, cy double")
        assert W.hex_parity(at).first().kind == ("evenr" if even else "oddr")
        near = {(p[0], p[1], q[0], q[1]) for p in rows for q in rows if 0 < np.hypot(p[2] - q[2], p[3] - q[3]) < 1.01}
        assert {(r.gx, r.gy, r.hx, r.hy) for r in W.neighbours(at, W.topology(at, platform="visium")).collect()} == near
    level = spark.createDataFrame([(x, y, float(x), float(y)) for x in range(1, 4) for y in range(1, 4)], "gx int, gy int, cx double, cy double")
    assert W.hex_parity(level).first().kind == "oddr" and W.topology(level) == "queen" and W.topology(level, "rook") == "rook"


def test_walks_that_prefer(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 3.0)], "a string, b string, weight double")
    share = {r.feature: r.share for r in K.preference(spark.createDataFrame([("a", 5.0), ("b", 1.0), ("c", 1.0)], "feature string, value double"), K.degrees(e)).collect()}
    assert sum(share.values()) == pytest.approx(1) and share["a"] > share["b"] == share["d"]
    p = np.array([share[k] for k in "abcd"])
    w = np.array([[0, 1, 0, 0], [1, 0, 1, 0], [0, 1, 0, 3], [0, 0, 3, 0]], float)
    rank = p
    for _ in range(7):
        rank = 0.15 * p + 0.85 * (w / w.sum(axis=1, keepdims=True)).T @ rank
    got = K.pagerank(e, rounds=7, prefer=spark.createDataFrame(list(share.items()), "feature string, share double"))
    assert {r.feature: r.pr for r in got.collect()} == {k: pytest.approx(v) for k, v in zip("abcd", rank)}
    low = K.reweighted(e, got, 0.3).collect()
    assert [(r.a, r.weight > 0) for r in sorted(low)] == [("a", False), ("b", False), ("c", True)]
