"""Polygons of a table, forests and components against plain code."""

import numpy as np
import pytest

from tesselark.operators import polygons as P
from tesselark.operators import trees as T


def plainly_inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]]):
            if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                odd = not odd
    return odd


@pytest.mark.parametrize("cell", [None, 3.0, 50.0])
def test_polygons_of_a_table(spark, cell):
    r = np.random.default_rng(2)
    shapes = {}
    for k in range(40):
        n, c, size = int(r.integers(3, 9)), r.uniform(0, 100, 2), r.uniform(1, 30 if k % 10 else 90)
        turn = np.sort(r.uniform(0, 2 * np.pi, n))
        ring = [(float(c[0] + size * np.cos(t)), float(c[1] + size * np.sin(t))) for t in turn]
        hole = [(float(c[0] + size / 4 * np.cos(t)), float(c[1] + size / 4 * np.sin(t))) for t in (0, 2, 4)]
        shapes[k] = [ring, hole] if k % 3 == 0 else [ring]
    square = [(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0)]  # its sides lie on points
    shapes[40] = [square]
    rows = [(k, g, i, x, y) for k, rings in shapes.items() for g, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]
    rows += [(41, 0, 0, None, 1.0), (None, 0, 0, 1.0, 1.0), (42, 0, 0, 5.0, float("nan"))]
    v = spark.createDataFrame(rows, "polygon int, ring int, k int, x double, y double")
    at = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(-5, 105, (300, 2)).tolist() + [(x, y) for x in (10, 15, 20) for y in (10, 15, 20)])]
    pts = spark.createDataFrame(at + [(999, None, 1.0), (998, 15.0, 15.0), (998, 15.0, 15.0)], "id int, x double, y double")
    want = {(i, k) for i, x, y in at + [(998, 15.0, 15.0)] for k, rings in shapes.items() if plainly_inside(x, y, rings)}
    got = P.polygons_of(pts, v, "ring", cell).select("id", "polygon").collect()
    assert {tuple(g) for g in got} == want and len(got) == len(want) + sum(i == 998 for i, _ in want)
    some = sorted(g.id for g in P.inside_any(pts, v, "ring", cell).collect())
    assert sorted(set(some)) == sorted({i for i, _ in want}) and len(some) == len(set(some)) + 1  # the repeated point comes twice
    assert P.inside_any(pts, v.limit(0), "ring", cell).count() == 0 and P.inside_any(pts.limit(0), v, "ring", cell).count() == 0


def test_points_on_one_place_are_judged_once(spark):
    corners = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]
    many = spark.range(5000).selectExpr("id AS polygon", "CAST(id % 2 AS DOUBLE) AS dx").crossJoin(spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(corners)], "k int, x double, y double"))
    v = many.selectExpr("polygon", "k", "x + 4 * dx AS x", "y")
    pts = spark.range(1_000_000).selectExpr("CAST(id % 4 AS DOUBLE) * 3 + 1 AS x", "1D AS y", "id % 2 AS feature")  # at 1, 4, 7 and 10
    got = P.counts_by_polygon(pts, v, ["feature"])
    # 2.5 thousand million pairs of a point and a polygon, but some thousand of a place and a polygon.
    assert {(r.odd, r.feature, r.n, r["count"]) for r in got.selectExpr("polygon % 2 AS odd", "feature", "n").groupBy("odd", "feature", "n").count().collect()} == {(0, 0, 500_000, 2500), (0, 1, 250_000, 2500), (1, 0, 250_000, 2500), (1, 1, 500_000, 2500)}
    assert P.inside_any(pts, v).count() == 1_000_000


def test_polygons_meet_by_equi_joins(spark):
    pts = spark.createDataFrame([(1.0, 1.0)], "x double, y double")
    v = spark.createDataFrame([(1, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (3.0, 0.0), (0.0, 3.0)])], "polygon int, k int, x double, y double")
    plan = P.inside_any(pts, v)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def edges(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, weight double")


def plain_forest(rows):
    root = {v: v for t in rows for v in t[:2]}
    out = []
    for a, b, w in sorted(rows, key=lambda t: (-t[2], t[0], t[1])):
        if root[a] != root[b]:
            out.append((a, b, w))
            old = root[b]
            root = {k: root[a] if v == old else v for k, v in root.items()}
    return sorted(out), root


def test_spanning_forest_by_brute_force(spark):
    r = np.random.default_rng(4)
    pairs = {(f"n{min(p)}", f"n{max(p)}"): float(round(r.random(), 1)) for p in r.integers(0, 40, (70, 2)).tolist() if p[0] != p[1]}
    rows = [(a, b, w) for (a, b), w in sorted(pairs.items())]
    want, root = plain_forest(rows)
    g = edges(spark, rows + [rows[0], ("n1", "n1", 9.0), ("n1", None, 9.0)]).repartition(4)
    assert sorted(tuple(x)[1:] for x in T.spanning_forest(g).collect()) == want
    assert T.spanning_forest(g.limit(0)).count() == 0
    got = {x.node: x.root for x in T.components(g.select("a", "b").where("b IS NOT NULL")).collect()}
    groups = {}
    for v, k in root.items():
        groups.setdefault(k, set()).add(v)
    assert got == {v: min(g) for g in groups.values() for v in g}


def test_a_long_path_is_one_tree(spark):
    rows = [(f"{k:03}", f"{k + 1:03}", 1.0) for k in range(150)]
    assert sorted(tuple(x)[1:] for x in T.spanning_forest(edges(spark, rows)).collect()) == rows
    assert {x.root for x in T.components(edges(spark, rows).select("a", "b")).collect()} == {"000"}
