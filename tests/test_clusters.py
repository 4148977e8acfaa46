"""The modules' second stage, quality, scoring: queries against DuckDB, and small cases by hand."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesselark.functions import testing
from tesselark.operators import assembly as Y
from tesselark.operators import association as A
from tesselark.operators import benchmark as B
from tesselark.operators import grid as G
from tesselark.operators import quality as Q
from tesselark.operators import weights as W
from tesselark.plans import catalog, clusters

NAMES = [n for n in vars(clusters) if n in catalog.SQL and n in catalog.QUERIES and getattr(vars(clusters)[n], "__module__", "") == clusters.__name__] + ["association_fdr", "quantile_normalised"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_queries_agree_with_sql(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(catalog.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    value = lambda v: None if pd.isna(v) else round(v, 5) + 0.0 if isinstance(v, float) else v
    key = lambda df: sorted((tuple(map(value, r)) for r in df[cols].itertuples(index=False)), key=str)
    for g, w in zip(key(got), key(want)):
        assert g == pytest.approx(w, abs=2e-5) if all(isinstance(v, (int, float)) for v in g) else g == w


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "a string, b string, weight double")


def modules(spark, **of):
    return spark.createDataFrame(list(of.items()), "feature string, module int")


def test_backbone_raises_the_forest(spark):
    e = edges(spark, ("a", "b", 1), ("b", "c", 0.001), ("a", "c", 0.0005), ("a", "x", 5), ("x", "p", 5))
    full = edges(spark, ("x", "y", 0.2), ("a", "b", 9))
    got = {(r.a, r.b): r.weight for r in Y.with_backbone(e, full, modules(spark, a=0, b=0, c=0, x=1, y=1), 0.25).collect()}
    floor = 0.001  # the quantile 0.25 of five weights
    assert got == {("a", "b"): 1.0, ("b", "c"): floor, ("a", "c"): 0.0005, ("a", "x"): 5.0, ("x", "p"): 5.0, ("x", "y"): floor}


def test_splits_need_a_gain(spark):
    m = modules(spark, a=1, b=1, c=1, d=1)
    parts = spark.createDataFrame([(f, 1, k) for f, k in zip("abcd", (0, 0, 1, 1))], "feature string, module int, part int")
    cons = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 0.9)], "a string, b string, share double")
    facts = lambda within: spark.createDataFrame([(1, 4, within, 0.9)], "module int, size long, within double, conductance double")
    split = lambda within: {r.feature: r.module for r in Y.split(m, parts, cons, facts(within), least_size=4, least_part=2).collect()}
    assert split(0.3) == {"a": 2, "b": 2, "c": 3, "d": 3} and set(split(0.5).values()) == {1}


def test_bins_without_enough_vertices_stay(spark):
    c = spark.createDataFrame([(1, 1, "a", 3), (2, 1, "a", 1)], "gx int, gy int, feature string, n long")
    v = c.select("gx", "gy", F.col("n").alias("vertices"))
    assert G.keep_segmented(c, v, 2).count() == 1 and G.keep_segmented(c, v, 9).count() == 2


def test_delta_permutations_without_correlation_are_those_of_l(spark, sf_dir):
    with catalog.V.one_query():
        z, w = catalog._z_w(spark, sf_dir)
        pairs = catalog._assoc(spark, sf_dir).where("a < b").limit(5)
        one = A.permutation_counts(z, w, pairs, 5).collect()
        two = A.permutation_counts(z, w, pairs.withColumn("r", F.lit(0.0)), 5).collect()
        all_ = A.permutation_counts(z, w, pairs.withColumn("r", F.col("l")), 5).collect()
    assert sorted(one) == sorted(two) and {r.exceed for r in all_} == {5}


def test_quantile_functions(spark):
    r = spark.createDataFrame([(0.975, 2.0, 3.0)], "p double, a double, b double").select(testing.normal_quantile("p").alias("z"), testing.beta_quantile("p", "a", "b").alias("x"), *(c.alias(f"e{i}") for i, c in enumerate(testing.permutation_error(F.lit(9), 99)))).first()
    assert r.z == pytest.approx(1.959964, abs=1e-6) and r.x == pytest.approx(0.805880, abs=1e-5)
    assert r.e0 == pytest.approx((0.1 * 0.9 / 99) ** 0.5) and r.e1 < 0.1 < r.e2


def test_unmapped_edges_in_both_ways(spark):
    e = spark.createDataFrame([("m", "a", "b", 3.0, 900), ("m", "a", "c", 2.0, None), ("m", "b", "c", 1.0, 0)], "method string, a string, b string, weight double, score int")
    back = spark.createDataFrame([(10, 2)], "pairs long, positives long")
    one, two = B.payload(e, back).first(), B.payload(e, back, unmapped="drop").first()
    assert (one.n_comparable, one.positive_rate, two.n_comparable, two.positive_rate) == (3, pytest.approx(1 / 3), 2, 0.5)
    assert B.payload(e.where("score IS NULL"), back, unmapped="drop").first().reason == "no_comparable_edges"
    assert [r.status for r in B.refill(e, 2, 1).collect()] == ["insufficient_mappable_edges"] and B.refill(e, 2, 2).count() == 2


def test_hexagons_one_step_away(spark):
    b = spark.createDataFrame([(x, y) for x in range(1, 6) for y in range(1, 6)], "gx int, gy int")
    for kind in ("oddr", "evenr", "oddq", "evenq"):
        one = {tuple(r) for r in W.hex_kernel(b, 1, kind=kind).select("gx", "gy", "hx", "hy").collect()}
        assert one == {tuple(r) for r in W.neighbours(b, kind).select("gx", "gy", "hx", "hy").collect()}
        assert W.hex_kernel(b, 2, kind=kind).where("gx = 3 AND gy = 3").count() == 18


def test_signed_ranks_by_hand(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", -2.0), ("c", 3.0), ("d", 0.0), ("e", 4.0)], "feature string, diff double")
    r = Q.signed_rank(d).first()
    assert (r.v, r.n) == (8.0, 4) and r.z == pytest.approx((8 - 5 - 0.5) / (4 * 5 * 9 / 24) ** 0.5) and r.p == pytest.approx(0.180655, abs=1e-4)
