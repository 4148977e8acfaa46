"""Hand-computed cases, and every query's SQL against DuckDB at the smallest scale."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tesselark.functions import testing
from tesselark.operators import association as A
from tesselark.operators import benchmark as B
from tesselark.operators import graph as K
from tesselark.operators import grid as G
from tesselark.operators import weights as W
from tesselark.plans import catalog


def grid3(spark, n=3):
    return spark.createDataFrame([(x, y) for x in range(1, n + 1) for y in range(1, n + 1)], "gx int, gy int")


def test_dispersion(spark):
    c = spark.createDataFrame([(1, 1, "a", 3), (1, 2, "a", 1), (1, 1, "b", 1)], "gx int, gy int, feature string, n long")
    assert {r.feature: r.idelta for r in A.dispersion(c, 4).collect()} == {"a": 2.0, "b": None}


def test_association_of_two_bins(spark):
    z = spark.createDataFrame([(1, 1, f, v) for f in "ab" for v in (1.0,)] + [(2, 1, f, -1.0) for f in "ab"], "gx int, gy int, feature string, z double")
    w = W.neighbours(z)
    for engine in ("sql", "gram"):
        assert {round(r.l, 9) for r in A.association(z, w, engine=engine).collect()} == {-1.0}


@pytest.mark.parametrize("kind, n, edges", [("queen", 3, 40), ("rook", 3, 24), ("oddr", 2, 10)])
def test_neighbour_numbers(spark, kind, n, edges):
    assert W.neighbours(grid3(spark, n), kind).count() == edges


def test_overlap(spark):
    c = spark.createDataFrame([(1, 1, "a", 2), (1, 1, "b", 1), (1, 2, "b", 1)], "gx int, gy int, feature string, n long")
    e = spark.createDataFrame([("a", "b")], "a string, b string")
    assert A.morisita_horn(c, e).first().mh == pytest.approx(2 / 3)


def test_consensus(spark):
    rows = [(0, "1", 0), (0, "2", 0), (0, "3", 1), (1, "1", 0), (1, "2", 0), (1, "3", 0)]
    got = K.consensus(spark.createDataFrame(rows, "run int, feature string, label int")).collect()
    assert [(r.a, r.b, r.share) for r in got] == [("1", "2", 1.0)]


def test_adjustments(spark):
    p = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.5,), (None,)], "p double")
    got = {r.p: r.fdr for r in testing.adjust(p, "p").collect()}
    assert got[None] is None and [got[x] for x in (0.01, 0.02, 0.03, 0.5)] == pytest.approx([0.04, 0.04, 0.04, 0.5])


def test_distribution_functions(spark):
    d = spark.createDataFrame([(1.959964, 0.632, 10)], "z double, r double, n long")
    r = d.select(testing.two_sided_normal("z").alias("p"), testing.correlation_p("r", "n").alias("q"), testing.fisher_greater(F.lit(3), F.lit(1), F.lit(1), F.lit(3)).alias("f")).first()
    assert r.p == pytest.approx(0.05, abs=1e-6) and r.q == pytest.approx(0.05, abs=1e-3) and r.f == pytest.approx(17 / 70)


def test_permuted_tiles_keep_their_inner_order(spark):
    """Brute force: every draw is the tiles' bins, one tile after the other, laid on the bins by gy, then gx."""
    bins = [(x, y) for y in range(1, 6) for x in range(1, 5) if (x, y) != (2, 3)]
    z = spark.createDataFrame([(x, y, "a", float(10 * y + x)) for x, y in bins], "gx int, gy int, feature string, z double")
    tile = lambda x, y: ((y - 1) // 2, (x - 1) // 2)
    rows = A.permuted(z, 6, 1, side=2).collect()
    seen = set()
    for draw in range(1, 7):
        at = {(r.gx, r.gy): (int(r.z) % 10, int(r.z) // 10) for r in rows if r.draw == draw}
        moved = [at[b] for b in bins]
        order = list(dict.fromkeys(tile(*b) for b in moved))
        assert moved == [b for t in order for b in bins if tile(*b) == t] and len(order) == 6
        seen.add(tuple(order))
    assert len(seen) > 1
    assert A.permuted(z.limit(0), 2, 1, side=2).count() == 0


def test_layers(spark):
    bins = grid3(spark)
    rows = [(1, y, "p", 2.0) for y in (1, 2, 3)] + [(1, y, "q", 1.0) for y in (1, 2)] + [(2, 1, "q", 1.0), (1, 1, "few", 5.0), (1, 1, "q2", None)]
    layers = spark.createDataFrame(rows, "gx int, gy int, feature string, v double")
    got = {m: [(r.a, r.b, round(r.value, 6)) for r in A.layer_similarity(layers, bins, m, fewest=2).collect()] for m in ("jaccard", "pearson", "spearman", "cosine")}
    assert got == {"jaccard": [("p", "q", 0.5)], "pearson": [("p", "q", 0.5)], "spearman": [("p", "q", 0.5)], "cosine": [("p", "q", 0.5)]}
    assert [(r.a, r.b, round(r.value, 6)) for r in A.layer_similarity(layers, bins, "cosine", scaled=False, fewest=2).collect()] == [("p", "q", round(2 / 3, 6))]
    assert A.layer_similarity(layers.limit(0), bins, "jaccard").count() == 0


def test_module_enrichment_says_why(spark):
    """One module whose pair scores best of all, one with a single member, one with too little outside, and odd rows."""
    rows = [("m", 0, "a"), ("m", 0, "b"), ("m", 0, "b"), ("m", 1, "c"), ("m", -1, "d"), ("m", 2, None), ("n", 0, "a"), ("n", 0, "b"), ("n", 0, "c"), ("n", 0, "d"), ("n", 0, "e")]
    modules = spark.createDataFrame(rows, "method string, module int, feature string")
    known = spark.createDataFrame([(f,) for f in "abcdef"] + [(None,)], "feature string")
    scores = spark.createDataFrame([("b", "a", 900), ("a", "c", 100), ("a", "b", 800)], "p string, q string, score int")
    got = {(r.method, r.module): r for r in B.module_enrichment(modules, known, scores, 50).collect()}
    assert {k: (r.status, r.status_reason) for k, r in got.items()} == {("m", 0): ("ok", None), ("m", 1): ("skipped", "n_pairs_total_zero"), ("n", 0): ("null_insufficient", "cross_edge_space_too_small")}
    best = got["m", 0]
    assert (best.mean, best.strong, best.p_mean, best.q_mean) == (900, 1, pytest.approx(1 / 51), pytest.approx(1 / 51)) and best.null_mean <= 100
    assert got["n", 0].p_mean is None and got["n", 0].pairs == 10
    for draws, fewest, reason in ((0, None, "n_random_nonpositive"), (5, 6, "valid_null_draws_lt_min")):
        why = {(r.method, r.module): r.status_reason for r in B.module_enrichment(modules, known, scores, draws, fewest=fewest).collect()}
        assert why["m", 0] == reason and why["m", 1] == "n_pairs_total_zero"
    assert B.module_enrichment(modules.limit(0), known, scores, 3).count() == 0


def test_top_features(spark):
    c = spark.createDataFrame([(1, 1, "a", 4), (1, 2, "b", 2), (2, 1, "b", 2), (2, 2, "c", 5), (2, 2, "d", 4)], "gx int, gy int, feature string, n long")
    names = lambda by: [r.feature for r in G.top_features(c, 2, by).collect()]
    assert names("mean") == ["c", "a"] and names("variance") == ["c", "a"] and names("presence") == ["b", "a"]
    assert names("random") == names("random") and len(set(names("random"))) == 2


def test_permutations_take_all_pairs(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalog, "ALL_DRAWS", 20)
    got = catalog.QUERIES["association_permuted_all"](spark, sf_dir).toPandas()
    assert len(got) == 300 and got.p.between(1 / 21 - 1e-6, 1).all() and (got.p < 1 / 9).any()


def test_areas(spark):
    e = spark.createDataFrame([("m", "a", "b", 3.0, True), ("m", "a", "c", 2.0, False), ("m", "a", "d", 1.0, True)], "method string, a string, b string, weight double, label boolean")
    assert B.auroc(e).first().auroc == 0.5 and B.auprc(e).first().auprc == pytest.approx(5 / 6)


def test_trapezoids(spark):
    s = spark.createDataFrame([("x", 0.0, 0.0), ("x", 1.0, 2.0), ("x", 3.0, 2.0)], "series string, sec double, v double")
    assert B.time_mean(s, "v").first()["mean"] == pytest.approx(5 / 3)
    assert [r.v for r in B.resample(s, 0.5, "v").orderBy("grid").collect()] == [0, 1, 2, 2, 2, 2, 2]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["bin_counts", "feature_z_scores", "association_pairs", "points_in_polygon", "consensus_pairs", "run_resampled"])
def test_queries_agree_with_sql(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(catalog.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    key = lambda df: sorted(tuple(round(v, 4) + 0.0 if isinstance(v, float) else v for v in r) for r in df[cols].itertuples(index=False))
    assert key(got) == key(want)
