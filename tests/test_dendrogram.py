"""Merge trees, leaf order and branches against plain code."""

import math

import numpy as np
import pytest

from tesselark.operators import dendrogram as D
from tesselark.operators import trees as T


def random_forest(seed, n, skip=()):
    r = np.random.default_rng(seed)
    out = []
    for v in range(1, n):
        if v not in skip:
            a, b = sorted((f"n{v:02}", f"n{r.integers(max(0, v - 6), v):02}"))
            out.append((a, b, float(round(r.random(), 1))))
    return out


def plain_dendrogram(rows):
    """Merges one by one: {(a, b): leaves in order}, {(a, b): parent}, and the trees' leaves."""
    group = {v: ("", 0, [v], None) for t in rows for v in t[:2]}
    at, above = {}, {}
    for k, (a, b, _) in enumerate(sorted(rows, key=lambda t: (-t[2], t[0], t[1])), 1):
        x, y = sorted((group[a], group[b]), key=lambda g: (g[1], g[2][0] if not g[1] else ""))
        for side in (x, y):
            if side[3]:
                above[side[3]] = (a, b)
        at[a, b] = x[2] + y[2]
        new = ("", k, x[2] + y[2], (a, b))
        for v in new[2]:
            group[v] = new
    return at, above, {tuple(g[2]) for g in group.values()}


def test_merges_and_leaf_order(spark):
    rows = random_forest(1, 40, skip=(11, 25)) + [("z1", "z2", 0.5)]
    f = spark.createDataFrame(rows, "a string, b string, weight double").repartition(3)
    places = D.arranged(D.merge_tree(f))
    at, above, trees = plain_dendrogram(rows)
    leaves = D.leaf_order(places).collect()
    got = {}
    for x in sorted(leaves, key=lambda x: x.position):
        got.setdefault(x.tree, []).append(x.feature)
    assert {tuple(v) for v in got.values()} == trees and all(k == min(v) for k, v in got.items())
    merged = D.merges(places).collect()
    assert len(merged) == len(rows) and {(m.a, m.b, m.weight) for m in merged} == set(rows)
    for m in merged:
        whole = next(t for t in trees if m.a in t)
        assert list(whole[m.start - 1 : m.start - 1 + m.size]) == at[m.a, m.b]
        assert above.get((m.a, m.b)) == ((m.above_a, m.above_b) if m.above_a else None)


def test_a_long_chain_and_nothing(spark):
    rows = [(f"{k:03}", f"{k + 1:03}", 1.0 - k / 100) for k in range(70)]  # each merge takes one more feature
    f = spark.createDataFrame(rows, "a string, b string, weight double")
    at, _, trees = plain_dendrogram(rows)
    got = [x.feature for x in D.leaf_order(D.arranged(D.merge_tree(f))).orderBy("position").collect()]
    assert {tuple(got)} == trees
    none = D.arranged(D.merge_tree(f.limit(0)))
    assert D.leaf_order(none).count() == 0 and D.merges(none).count() == 0
    assert D.branches(f.limit(0).selectExpr("1 AS module", "a", "b")).count() == 0


def test_lengths(spark):
    f = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 6.0), ("c", "d", 4.0)], "a string, b string, weight double")
    got = {r.a: r.length for r in D.lengths(f, scale=1.0).collect()}
    assert got == {"a": pytest.approx(-math.log(1e-6)), "b": 0.0, "c": pytest.approx(math.log(2))}
    got = {r.a: r.length for r in D.lengths(f, "inverse", normalise=False, clip=(3.0, 5.0), power=2.0, scale=1.0).collect()}
    assert got == {"a": pytest.approx(1 / 9), "b": pytest.approx(1 / 25), "c": pytest.approx(1 / 16)}


def plain_branches(module, rows, most, with_root):
    near = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    parts = []
    for r in near:
        for t in near[r]:
            seen, todo = {t}, [t]
            while todo:
                new = near[todo.pop()] - seen - {r}
                seen |= new
                todo += new
            if len(near[r]) > 1 and len(seen) >= 3:
                parts.append((-len(seen), r, t, seen | ({r} if with_root else set())))
    out, used, k = {v: None for v in near}, set(), 0
    for _, _, _, part in sorted(parts, key=lambda p: p[:3]):
        if k < most and not part & used:
            k += 1
            used |= part
            out |= {v: f"{module}_sub{k}" for v in part}
    return out


@pytest.mark.parametrize("with_root", [True, False])
def test_branches(spark, with_root):
    first = [t[:2] for t in random_forest(3, 30, skip=(12,))]
    spider = [("m", f"x{k}0") for k in range(4)] + [(f"x{k}{i}", f"x{k}{i + 1}") for k in range(4) for i in range(k + 2)]
    star = [("s", f"s{k}") for k in range(5)]
    rows = [(1, *t) for t in first] + [(2, *t) for t in spider] + [(3, *t) for t in star]
    f = spark.createDataFrame(rows, "module int, a string, b string")
    want = plain_branches(1, first, 3, with_root) | plain_branches(2, spider, 3, with_root) | plain_branches(3, star, 3, with_root)
    got = {r.feature: r.branch for r in D.branches(f, 3, with_root).collect()}
    assert got == want and {v for v in want.values() if v} > {"2_sub1"} and got["s"] is None


def test_tours(spark):
    rows = random_forest(5, 25)
    up = {r.node: r for r in D.rooted(spark.createDataFrame(rows, "a string, b string, weight double")).collect()}
    assert {tuple(sorted((r.node, r.parent))) for r in up.values() if r.parent} == {t[:2] for t in rows}
    for r in up.values():
        assert r.tree == "n00" and r.size == sum(r.enter <= x.enter <= r.leave for x in up.values())
        assert r.parent is None or up[r.parent].enter < r.enter < r.leave < up[r.parent].leave
    assert T.components(spark.createDataFrame(rows, "a string, b string, weight double").select("a", "b")).count() == 25
