"""Selected pairs, permuted ids, tables of density plots."""

import hashlib
import statistics

import pytest

from tesselark.operators import association as A
from tesselark.operators import benchmark as B
from tesselark.operators import grid as G
from tesselark.plans import catalog as C
from tesselark.plans import views as V


def test_selected_pairs(spark):
    rows = [("a", "b", 0.9, 0.1, 0.8), ("a", "c", 0.5, 0.4, 0.1), ("a", "d", 0.8, 0.0, 0.8), ("b", "c", -0.7, 0.1, -0.8), ("b", "d", 0.2, 0.9, -0.7), ("c", "d", None, 0.1, None)]
    pairs = spark.createDataFrame(rows, "a string, b string, l double, r double, delta double")
    curve = spark.createDataFrame([(-1.0, -1.5, -0.5), (1.0, 0.5, 1.5)], "r double, lo double, hi double")
    names = lambda df: sorted(x.a + x.b for x in df.collect())
    assert names(A.top_pairs(pairs, 1, rule="none")) == ["ab", "ad"]  # a tie stays whole
    assert names(A.top_pairs(pairs, 1, "smallest", rule="none")) == ["bc"]
    assert names(A.top_pairs(pairs, 1, "both", rule="none", r_range=(0.05, 1.0))) == ["ab", "bc"]
    assert names(A.top_pairs(pairs, 9, "both", curve)) == ["ab", "ad", "bc", "bd"]
    assert names(A.top_pairs(pairs, 9, "both", curve, "remove_outside")) == ["ac"]
    assert names(A.top_pairs(pairs, 9, "largest", curve, l_range=(5.0, 6.0))) == []
    with pytest.raises(ValueError, match="needs a curve"):
        A.top_pairs(pairs, 1)
    with pytest.raises(ValueError, match="unknown rule"):
        A.top_pairs(pairs, 1, rule="keep")
    with pytest.raises(ValueError, match="unknown direction"):
        A.top_pairs(pairs, 1, "most", curve)


def test_permuted_ids_by_brute_force(spark):
    names = [f"f{k}" for k in range(9)]
    ids = {v: None if k == 4 else f"i{k}" for k, v in enumerate(names)}
    edges = [(a, b, float((i * 7 + j * 5) % 6)) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    reference = {("i0", "i1"): 900, ("i2", "i3"): 800, ("i1", "i5"): 700, ("i6", "i8"): 100, ("i0", "i7"): 950}
    want = {}
    for draw in range(21):
        order = sorted(names, key=lambda v: (hashlib.md5(f"1|{draw}|{v}".encode()).hexdigest(), v)) if draw else names
        mapped = {v: ids[names[k]] for k, v in enumerate(order)}
        kept = [(mapped[a], mapped[b]) for a, b, _ in sorted(edges, key=lambda t: (-t[2], t[0], t[1])) if mapped[a] and mapped[b]]
        for top in (3, 10, 99):
            first = [reference.get(tuple(sorted(p)), 0) >= 700 for p in kept[:top]]
            want.setdefault(top, []).append(sum(first) / len(first))
    e = spark.createDataFrame([*edges, ("f0", "f1", None)], "a string, b string, weight double")
    r = spark.createDataFrame([(q, p, s) for (p, q), s in reference.items()] + [("i0", "i1", 5)], "p string, q string, score int")
    got = {x.top: x for x in B.label_null(e, spark.createDataFrame(list(ids.items()), "feature string, id string"), r, [3, 10, 99], 20, rate=0.5).collect()}
    for top, (seen, *null) in want.items():
        x = got[top]
        assert (x.observed, x.null_mean, x.null_sd) == pytest.approx((seen, statistics.mean(null), statistics.stdev(null)))
        assert x.p == pytest.approx((1 + sum(v >= seen for v in null)) / 21) and x.enrichment == pytest.approx(seen / 0.5)
    assert B.label_null(e.limit(0), spark.createDataFrame([], "feature string, id string"), r, [3], 5).count() == 0


def test_density_tables(spark):
    v = spark.createDataFrame([(1, 4.0), (2, 1.0), (3, None)], "gx int, density double")
    assert {x.gx: (x.density, x.cut) for x in G.clipped(v, "density", 0.5).collect()} == {1: (2.0, 2.0), 2: (1.0, 2.0), 3: (0.0, 2.0)}
    counts = spark.createDataFrame([("c1", "p", 8), ("c2", "p", 2), ("c2", "p", 1), ("c2", "q", 5), ("c3", "q", 0), ("c4", "p", 9), ("c1", "other", 9)], "cell string, feature string, n int")
    at = spark.createDataFrame([("c1", 0.0, 1.0), ("c2", 2.0, 3.0), ("c3", 4.0, 5.0)], "cell string, x double, y double")
    got = {(x.feature, x.cell): (x.x, x.y, x.e) for x in G.expression_points(counts, at, {"p": 0.5, "q": 1.0}).collect()}
    assert got == {("p", "c1"): (0.0, 1.0, 4.5), ("p", "c2"): (2.0, 3.0, 3.0), ("q", "c2"): (2.0, 3.0, 5.0)}
    assert G.expression_points(counts.limit(0), at, {"p": 1.0}).count() == 0


def test_shared_orders_are_counted_without_a_self_join_and_once(spark, sf_dir, monkeypatch):
    made, make = [], V._interactions
    plan = make(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("lineitem") <= 1  # with the parts only
    monkeypatch.setattr(V, "_interactions", lambda s, d: made.append(1) or make(s, d))
    with V.one_query():
        assert V.interactions(spark, sf_dir).count() == V.reference(spark, sf_dir).count() > 0
    assert len(made) == 1


def test_labelled_edges_are_made_once(spark, sf_dir, monkeypatch):
    made = []
    few = lambda s, d: made.append(1) or s.createDataFrame([("m", "Brand#12", "Brand#13", 1.0), ("m", "Brand#12", "Brand#11", 2.0)], "method string, a string, b string, weight double")
    monkeypatch.setattr(C, "_methods", few)
    with V.one_query():
        found = [C._labelled(spark, sf_dir), C._labelled(spark, sf_dir)]
        assert len(made) == 1 and all("parquet" in x.inputFiles()[0] and len(x.inputFiles()) < 9 for x in found)
    assert {(x.a, x.b, x.score is None) for x in found[0].collect()} == {("Brand#12", "Brand#13", False), ("Brand#12", "Brand#11", True)}
