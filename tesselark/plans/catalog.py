"""All queries over the reference tables, by name, with their SQL.

Doubles are rounded to six digits on both sides, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.functions import testing
from tesselark.operators import association as A
from tesselark.operators import benchmark as B
from tesselark.operators import graph as K
from tesselark.operators import grid as G
from tesselark.operators import weights as W
from tesselark.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "association_pairs"
FEATURES = ["Brand#11", "Brand#23", "Brand#4"]
DRAWS = 8
#: Draws of the permutation queries without SQL.
ALL_DRAWS = 1000
#: Draws of those of whole tiles, held to their SQL.
TILE_DRAWS = 200


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    """Registers a query, and its SQL with the views that it names."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with V.one_query():
                return rounded(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = V.sql(sql)
        return f

    return register


def r6(**columns: str) -> str:
    return ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in columns.items())


# ---- points and bins -----------------------------------------------------------------------------------------------


@query("SELECT feature, count(*) AS n, " + r6(x="avg(x)", y="avg(y)") + " FROM kept GROUP BY feature")
def filtered_points(s, d):
    return V.kept(s, d).groupBy("feature").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


@query("SELECT feature, count(*) AS n FROM kept WHERE feature IN ('Brand#11', 'Brand#23', 'Brand#4') AND NOT regexp_matches(feature, '^Brand#4') GROUP BY feature")
def filtered_by_name(s, d):
    return G.filter_points(V.molecules(s, d), FEATURES, exclude="^Brand#4").groupBy("feature").agg(F.count("*").alias("n"))


@query("SELECT * FROM lim")
def point_bounds(s, d):
    return G.bounds(V.kept(s, d))


@query("SELECT feature, " + r6(y="sum(ymax - y)") + " FROM kept, lim GROUP BY feature")
def flipped_points(s, d):
    p = V.kept(s, d)
    return G.flip_y(p, G.bounds(p)).groupBy("feature").agg(F.sum("y").alias("y"))


_SIDES = " + ".join(
    f"CASE WHEN ({y0} > y) <> ({y1} > y) AND x < ({x1 - x0}) * (y - {y0}) / CAST({y1 - y0} AS DOUBLE) + {x0} THEN 1 ELSE 0 END" for (x0, y0), (x1, y1) in zip(V.ROI, [*V.ROI[1:], V.ROI[0]])
)


@query(f"SELECT feature, count(*) AS n FROM kept WHERE ({_SIDES}) % 2 = 1 GROUP BY feature")
def points_in_polygon(s, d):
    return G.in_polygon(V.kept(s, d), V.ROI).groupBy("feature").agg(F.count("*").alias("n"))


@query("SELECT gx, gy, feature, n FROM cnt")
def bin_counts(s, d):
    return V.bin_counts(s, d)


@query(
    "SELECT CAST(size AS DOUBLE) AS size, CAST(floor((x - floor(xmin/size)*size)/size) + 1 AS INTEGER) AS gx, CAST(floor((y - floor(ymin/size)*size)/size) + 1 AS INTEGER) AS gy, feature, count(*) AS n FROM kept, lim, (VALUES (40.0), (50.0), (100.0)) t(size) GROUP BY ALL"
)
def bin_counts_by_size(s, d):
    p = V.kept(s, d)
    return G.count_sizes(p, G.bounds(p), [40, 50, 100])


@query("SELECT gx, gy, 'g' || gx || '_' || gy AS grid_id, floor(xmin/50)*50 + (gx - 1)*50 + 25 AS cx, floor(ymin/50)*50 + (gy - 1)*50 + 25 AS cy FROM lat, lim")
def lattice_bins(s, d):
    return G.lattice(G.bounds(V.kept(s, d)), 50).select("gx", "gy", "grid_id", "cx", "cy")


@query("SELECT gx, gy, count(DISTINCT feature) AS k FROM cnt GROUP BY gx, gy HAVING k BETWEEN 2 AND 20")
def bins_by_feature_number(s, d):
    return G.keep_bins(V.bins(s, d), 2, 20).groupBy("gx", "gy").agg(F.countDistinct("feature").alias("k"))


@query("SELECT gx, gy, feature, " + r6(v="v") + " FROM rown")
def row_normalised(s, d):
    return G.row_normalise(V.bin_counts(s, d)).select("gx", "gy", "feature", "v")


@query("SELECT gx, gy, feature, " + r6(z="z") + " FROM z")
def feature_z_scores(s, d):
    return V.z(s, d)


@query("SELECT cell, feature, " + r6(v="ln(1 + n * 10000.0 / sum(n) OVER (PARTITION BY cell))") + " FROM cellcnt")
def cell_log_cpm(s, d):
    return G.log_cpm(V.cells(s, d)).select("cell", "feature", "v")


@query("SELECT gx, gy, feature, " + r6(v="least(v, quantile_cont(v, 0.95) OVER (PARTITION BY feature))") + " FROM dense")
def winsorised(s, d):
    c = G.row_normalise(V.bins(s, d))
    dense = c.select("gx", "gy").distinct().crossJoin(c.select("feature").distinct()).join(c, ["gx", "gy", "feature"], "left").select("gx", "gy", "feature", F.coalesce("v", F.lit(0.0)).alias("v"))
    return G.winsorise(dense, "feature", "v")


@query("SELECT gx, gy, " + r6(density="coalesce(v, 0) / 2500.0") + " FROM lat LEFT JOIN (SELECT gx, gy, sum(v) AS v FROM rown WHERE feature IN ('Brand#11', 'Brand#23', 'Brand#4') GROUP BY ALL) USING (gx, gy)")
def density_by_bin_share(s, d):
    p = G.bounds(V.kept(s, d))
    return G.density(V.bin_counts(s, d), G.lattice(p, 50), FEATURES, "bin")


def _densities(normalise: str, value: str, source: str) -> None:
    @query("SELECT gx, gy, " + r6(density="coalesce(v, 0) / 2500.0") + f" FROM lat LEFT JOIN (SELECT gx, gy, sum(v) AS v FROM (SELECT gx, gy, feature, {value} AS v FROM cnt) WHERE feature IN ('Brand#11', 'Brand#23', 'Brand#4') GROUP BY ALL) USING (gx, gy)")
    def f(s, d):
        return G.density(V.bins(s, d), G.lattice(G.bounds(V.kept(s, d)), 50), FEATURES, normalise)

    QUERIES[source], SQL[source] = QUERIES.pop("f"), SQL.pop("f")


_densities("none", "n", "density_plain")
_densities("feature", "n / sum(n) OVER (PARTITION BY feature)", "density_by_feature_share")


@query("SELECT feature, " + r6(pct="count(*) * 100.0 / (SELECT count(*) FROM bins)") + " FROM cnt GROUP BY feature")
def feature_coverage(s, d):
    return G.coverage(V.bins(s, d))


_TOP = "WITH o AS (SELECT feature, sum(n) / b AS mean, sum(n * n) / b - (sum(n) / b) * (sum(n) / b) AS variance, count(*) / b AS presence, CAST(CAST('0x' || substr(md5(concat_ws('|', 1, feature)), 1, 8) AS BIGINT) AS DOUBLE) AS random FROM cnt, (SELECT CAST(count(*) AS DOUBLE) AS b FROM bins) GROUP BY feature, b) "


@query(_TOP + "SELECT * FROM (" + " UNION ALL ".join(f"(SELECT '{by}' AS measure, feature, round({by}, 6) + 0.0 AS value FROM o ORDER BY round({by}, 9) DESC, feature LIMIT 10)" for by in ("mean", "variance", "presence", "random")) + ")")
def top_features(s, d):
    c = V.bins(s, d)
    found = [G.top_features(c, 10, by).select(F.lit(by).alias("measure"), "feature", "value") for by in ("mean", "variance", "presence", "random")]
    return found[0].union(found[1]).union(found[2]).union(found[3])


# ---- weights -------------------------------------------------------------------------------------------------------


def _weights(kind: str, sql: str):
    @query(sql)
    def f(s, d):
        return W.neighbours(V.bin_counts(s, d), kind)

    QUERIES[f"weights_{kind}"], SQL[f"weights_{kind}"] = QUERIES.pop("f"), SQL.pop("f")


_PAIR = "SELECT a.gx, a.gy, b.gx AS hx, b.gy AS hy, CAST(1 AS DOUBLE) AS w FROM bins a JOIN bins b ON "
_weights("rook", _PAIR + "abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1")
_weights("queen", "SELECT * FROM w")
for _kind, _shifted in (("oddr", "(a.gy - 1) % 2 = 1"), ("evenr", "(a.gy - 1) % 2 = 0")):
    _weights(_kind, _PAIR + f"(a.gy = b.gy AND abs(a.gx - b.gx) = 1) OR (abs(a.gy - b.gy) = 1 AND b.gx - a.gx IN (0, CASE WHEN {_shifted} THEN 1 ELSE -1 END))")
for _kind, _shifted in (("oddq", "(a.gx - 1) % 2 = 1"), ("evenq", "(a.gx - 1) % 2 = 0")):
    _weights(_kind, _PAIR + f"(a.gx = b.gx AND abs(a.gy - b.gy) = 1) OR (abs(a.gx - b.gx) = 1 AND b.gy - a.gy IN (0, CASE WHEN {_shifted} THEN 1 ELSE -1 END))")


@query("SELECT gx, gy, hx, hy, " + r6(w="w / sum(w) OVER (PARTITION BY gx, gy)") + " FROM w")
def weights_row_standardised(s, d):
    return W.row_standardise(W.neighbours(V.bin_counts(s, d)))


@query(
    "WITH e AS (SELECT a.gx, a.gy, b.gx AS hx, b.gy AS hy, exp(-((a.gx-b.gx)*(a.gx-b.gx) + (a.gy-b.gy)*(a.gy-b.gy)) / 2.0) AS e FROM bins a JOIN bins b ON greatest(abs(a.gx-b.gx), abs(a.gy-b.gy)) BETWEEN 1 AND 2) SELECT gx, gy, hx, hy, " + r6(w="e / sum(e) OVER (PARTITION BY gx, gy)") + " FROM e"
)
def weights_gaussian(s, d):
    return W.kernel(V.bins(s, d))


@query("SELECT a.gx, a.gy, b.gx AS hx, b.gy AS hy FROM bins a JOIN bins b ON abs(a.gx-b.gx) + abs(a.gy-b.gy) IN (1, 2)")
def weights_two_steps(s, d):
    return W.within_hops(W.neighbours(V.bin_counts(s, d), "rook"), 2)


@query("SELECT gx, gy, dense_rank() OVER (ORDER BY (gy - 1) // 8, (gx - 1) // 8)::INTEGER AS tile FROM bins")
def bin_tiles(s, d):
    return W.tiles(V.bins(s, d).select("gx", "gy").distinct())


_DIFFUSED = "SELECT gx, gy, feature, least(1.0, greatest(0.0, sum(v))) AS v FROM (SELECT gx, gy, feature, v FROM rown UNION ALL SELECT w.gx, w.gy, feature, w.w * v * 0.05 FROM w JOIN rown r ON r.gx = hx AND r.gy = hy) GROUP BY ALL"


@query(f"SELECT gx, gy, feature, {r6(v='v')} FROM ({_DIFFUSED})")
def diffused(s, d):
    c = V.bins(s, d)
    return W.diffuse(G.row_normalise(c), W.neighbours(c), 0.05, 1)


@query(
    "WITH f AS (SELECT * FROM dense WHERE feature IN ('Brand#11', 'Brand#23', 'Brand#4')) SELECT p.feature AS a, q.feature AS b, " + r6(jaccard="sum(least(p.v, q.v)) / nullif(sum(greatest(p.v, q.v)), 0)") + " FROM f p JOIN f q USING (gx, gy) WHERE p.feature < q.feature GROUP BY ALL"
)
def fuzzy_jaccard(s, d):
    return W.fuzzy_jaccard(G.row_normalise(V.bins(s, d)), FEATURES)


# ---- association -----------------------------------------------------------------------------------------------------


def _z_w(s, d):
    z = V.z(s, d)
    return z, W.neighbours(V.bins(s, d))


def _assoc(s, d):
    """L of all pairs, made once in a query."""
    return V.once(s, "assoc", lambda: A.association_of(G.row_normalise(V.bins(s, d)), W.neighbours(V.bins(s, d))))


@query("SELECT a, b, " + r6(l="l") + " FROM assoc")
def association_pairs(s, d):
    return A.association_of(G.row_normalise(V.bins(s, d)), W.neighbours(V.bins(s, d)))


@query("SELECT a, b, " + r6(l="l") + " FROM assoc")
def association_pairs_by_join(s, d):
    return A.association(*_z_w(s, d), engine="sql")


@query(
    "WITH s2 AS (SELECT sum(r*r) AS s FROM (SELECT sum(w) AS r FROM w GROUP BY gx, gy)), m AS (SELECT x.feature AS a, y.feature AS b, sum(x.wz * y.wz) AS num FROM lag x JOIN lag y USING (gx, gy) GROUP BY ALL) SELECT a, b, " + r6(l="CASE WHEN p.norm * q.norm = 0 THEN 0 ELSE n / s * num / (p.norm * q.norm) END") + " FROM m JOIN norms p ON p.feature = a JOIN norms q ON q.feature = b, k, s2"
)
def association_s2(s, d):
    return A.association(*_z_w(s, d), formula="s2")


@query("SELECT a, b, " + r6(l="l", zscore="(l + 1.0/(n-1)) / sqrt(CAST(n AS DOUBLE)*n*(n-2) / ((n-1.0)*(n-1)*(n-3)*s0))") + " FROM assoc, k")
def association_z(s, d):
    z, w = _z_w(s, d)
    return A.analytic_z(_assoc(s, d), z, w)


_PERM = f"""WITH br AS (SELECT gx, gy, row_number() OVER (ORDER BY gy, gx) AS rank FROM bins),
tgt AS (SELECT draw, gx AS tx, gy AS ty, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('|', 1, draw, gx, gy)), gy, gx) AS rank FROM br, range(1, {DRAWS + 1}) t(draw)),
pz AS (SELECT draw, tx AS gx, ty AS gy, feature, z FROM tgt JOIN br USING (rank) JOIN z USING (gx, gy)),
plag AS (SELECT draw, w.gx, w.gy, feature, sum(w*z) AS wz FROM w JOIN pz ON pz.gx = hx AND pz.gy = hy GROUP BY ALL),
sel AS (SELECT a, b, l FROM assoc WHERE a < b AND a IN ('Brand#11', 'Brand#23', 'Brand#4')),
pn AS (SELECT a, b, l, pz.draw, sum(z*wz) AS num FROM sel JOIN pz ON pz.feature = a JOIN plag ON plag.feature = b AND plag.draw = pz.draw AND plag.gx = pz.gx AND plag.gy = pz.gy GROUP BY ALL),
ex AS (SELECT a, b, CAST(sum(CASE WHEN round(abs(n / s0 * num / (p.norm * q.norm)), 9) >= round(abs(l), 9) THEN 1 ELSE 0 END) AS BIGINT) AS exceed FROM pn JOIN norms p ON p.feature = a JOIN norms q ON q.feature = b, k GROUP BY ALL)
"""


@query(_PERM + f"SELECT a, b, exceed, {r6(p=f'(exceed + 1) / {DRAWS + 1}.0')} FROM ex")
def association_permuted(s, d):
    z, w = _z_w(s, d)
    chosen = _assoc(s, d).where((F.col("a") < F.col("b")) & F.col("a").isin(FEATURES))
    return A.permutation_counts(z, w, chosen, DRAWS).select("a", "b", "exceed", testing.smoothed_p(F.col("exceed"), DRAWS).alias("p"))


@query()
def association_permuted_all(s, d):
    z, w = _z_w(s, d)
    pairs = _assoc(s, d).where("a < b")
    return A.permutation_counts(z, w, pairs, ALL_DRAWS).select("a", "b", "exceed", testing.smoothed_p(F.col("exceed"), ALL_DRAWS).alias("p"))


@query(
    "WITH m AS (SELECT feature, covar_pop(gx, gx) AS xx, covar_pop(gy, gy) AS yy, covar_pop(gx, gy) AS xy, covar_pop(gx, z) AS xz, covar_pop(gy, z) AS yz FROM z GROUP BY feature) SELECT feature, " + r6(slope_x="(yy*xz - xy*yz) / nullif(xx*yy - xy*xy, 0)", slope_y="(xx*yz - xy*xz) / nullif(xx*yy - xy*xy, 0)") + " FROM m"
)
def feature_gradients(s, d):
    return A.gradients(V.z(s, d))


@query("SELECT p.feature AS a, q.feature AS b, " + r6(r="corr(p.v, q.v)") + ", count(*) AS n FROM dense p JOIN dense q USING (gx, gy) WHERE p.feature < q.feature GROUP BY ALL")
def bin_correlation(s, d):
    return A.pearson(G.row_normalise(V.bins(s, d)), ["gx", "gy"])


_CELLS = "WITH lc AS (SELECT cell, feature, ln(1 + n * 10000.0 / sum(n) OVER (PARTITION BY cell)) AS v FROM cellcnt), dc AS (SELECT cell, feature, coalesce(v, 0) AS v FROM (SELECT DISTINCT cell FROM lc) CROSS JOIN (SELECT DISTINCT feature FROM lc) LEFT JOIN lc USING (cell, feature)) "


@query(_CELLS + "SELECT p.feature AS a, q.feature AS b, " + r6(r="corr(p.v, q.v)") + ", count(*) AS n FROM dc p JOIN dc q USING (cell) WHERE p.feature < q.feature GROUP BY ALL")
def cell_correlation(s, d):
    return A.pearson(G.log_cpm(V.cells(s, d)), ["cell"])


@query()
def cell_correlation_fdr(s, d):
    p = A.pearson(G.log_cpm(V.cells(s, d)), ["cell"])
    return testing.adjust(p.withColumn("p", testing.correlation_p("r", "n")), "p")


@query(
    "WITH rk AS (SELECT gx, gy, feature, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS v FROM dense) SELECT p.feature AS a, q.feature AS b, " + r6(r="corr(p.v, q.v)") + ", count(*) AS n FROM rk p JOIN rk q USING (gx, gy) WHERE p.feature < q.feature GROUP BY ALL"
)
def bin_rank_correlation(s, d):
    c = G.row_normalise(V.bins(s, d))
    return A.spearman(c, ["gx", "gy"], c.select("gx", "gy").distinct())


@query("SELECT feature, " + r6(idelta="CASE WHEN sum(n) >= 2 THEN (SELECT count(*) FROM lat) * sum(n*(n-1)) / (sum(n) * (sum(n) - 1.0)) END") + " FROM cnt GROUP BY feature")
def dispersion_index(s, d):
    q = G.lattice(G.bounds(V.kept(s, d)), 50).agg(F.count("*").alias("q"))
    return A.dispersion(V.bin_counts(s, d), q)


@query(
    "WITH o AS (SELECT feature, CAST(sum(n) AS DOUBLE) AS t, CAST(sum(n*n) AS DOUBLE) AS q FROM cnt GROUP BY 1), c AS (SELECT x.feature AS a, y.feature AS b, CAST(sum(x.n*y.n) AS DOUBLE) AS ab FROM cnt x JOIN cnt y USING (gx, gy) WHERE x.feature < y.feature GROUP BY ALL) SELECT a, b, " + r6(mh="2 * ab / ((p.q/(p.t*p.t) + r.q/(r.t*r.t)) * p.t * r.t)") + " FROM c JOIN o p ON p.feature = a JOIN o r ON r.feature = b"
)
def overlap_morisita_horn(s, d):
    c = V.bins(s, d)
    f = c.select("feature").distinct()
    return A.morisita_horn(c, f.toDF("a").crossJoin(f.toDF("b")).where("a < b"))


@query("SELECT a, b, " + r6(jaccard="j") + " FROM jac UNION ALL SELECT feature, feature, 1.0 FROM (SELECT DISTINCT feature FROM cnt)")
def overlap_jaccard(s, d):
    return A.jaccard(V.bins(s, d))


@query("WITH e AS (SELECT vec_id, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)) SELECT p.dim AS a, q.dim AS b, " + r6(cosine="sum(p.v*q.v) / nullif(sqrt(sum(p.v*p.v)) * sqrt(sum(q.v*q.v)), 0)") + " FROM e p JOIN e q USING (vec_id) WHERE p.dim < q.dim GROUP BY ALL")
def column_cosines(s, d):
    e = V.table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("feature", "v"))
    return A.cosine(e.select("vec_id", F.col("feature").cast("long").alias("feature"), F.col("v").cast("double").alias("v")), "vec_id")


_DELTA = "WITH rr AS (SELECT p.feature AS a, q.feature AS b, corr(p.v, q.v) AS r FROM dense p JOIN dense q USING (gx, gy) WHERE p.feature < q.feature GROUP BY ALL), dl AS (SELECT a, b, round(l, 6) AS l, round(r, 6) AS r, round(l - r, 6) AS delta FROM assoc JOIN rr USING (a, b)) "


def _delta(s, d):
    r = A.pearson(G.row_normalise(V.bins(s, d)), ["gx", "gy"]).select("a", "b", "r")
    return rounded(A.delta(_assoc(s, d), r))


@query(_DELTA + "SELECT a, b, " + r6(l="l", r="r", delta="delta") + " FROM dl QUALIFY rank() OVER (ORDER BY delta DESC) <= 10 OR rank() OVER (ORDER BY delta) <= 10")
def delta_extremes(s, d):
    return A.extremes(_delta(s, d), "delta", 10)


_CURVE = [(-1.0, -1.2, -0.4), (-0.5, -0.6, 0.1), (0.0, -0.3, 0.3), (0.5, 0.1, 0.8), (1.0, 0.4, 1.4)]


@query(
    _DELTA + ", cv(x0, lo, hi) AS (VALUES " + ", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE))" for a, b, c in _CURVE) + "), seg AS (SELECT *, lead(x0) OVER (ORDER BY x0) AS nx, lead(lo) OVER (ORDER BY x0) AS l2, lead(hi) OVER (ORDER BY x0) AS h2 FROM cv) "
    "SELECT a, b, " + r6(l="l", r="r", delta="delta") + " FROM dl JOIN seg ON r >= x0 AND r < nx WHERE NOT (l >= lo + (r - x0)/(nx - x0)*(l2 - lo) AND l <= hi + (r - x0)/(nx - x0)*(h2 - hi))"
)
def delta_outside_curve(s, d):
    return A.outside_curve(_delta(s, d), s.createDataFrame(_CURVE, "r double, lo double, hi double"))


@query("WITH e AS (SELECT a AS feature, b AS other, l FROM assoc WHERE a <> b) SELECT e.feature, m.module, " + r6(within="avg(l) FILTER (m.module = o.module)", between="avg(l) FILTER (m.module <> o.module)", diff="avg(l) FILTER (m.module = o.module) - avg(l) FILTER (m.module <> o.module)") + " FROM e JOIN mods m USING (feature) JOIN mods o ON o.feature = e.other GROUP BY ALL")
def within_between_modules(s, d):
    # L is symmetric for these weights, so pairs a < b stand for both directions.
    return A.within_between(_assoc(s, d).where("a < b"), V.modules(s, d).where("module >= 0"), "l")


@query()
def association_fdr(s, d):
    z, w = _z_w(s, d)
    p = A.analytic_z(_assoc(s, d), z, w).withColumn("p", testing.two_sided_normal("zscore"))
    return testing.storey(testing.adjust(p, "p", "bh"), "p", "storey")


_P = "WITH pv AS (SELECT a, b, round(abs(l), 6) AS p FROM assoc WHERE a < b), rk AS (SELECT a, b, p, count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r FROM pv) "


@query(_P + "SELECT a, b, " + r6(p="p", bh="least(1.0, min(p * m / r) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING))", bonferroni="least(1.0, p * m)") + " FROM rk")
def adjusted_p(s, d):
    p = _assoc(s, d).where("a < b").select("a", "b", F.round(F.abs("l"), 6).alias("p"))
    return testing.adjust(testing.adjust(p, "p", "bh"), "p", "bonferroni", "bonferroni")


# ---- graphs ------------------------------------------------------------------------------------------------------------


def _edges(s, d):
    return _assoc(s, d).where("a < b AND l > 0").select("a", "b", F.col("l").alias("weight"))


@query("SELECT a, b, " + r6(weight="weight") + " FROM medges WHERE round(weight, 9) >= 0.1")
def graph_threshold(s, d):
    return K.threshold_graph(_assoc(s, d), 0.1)


_FULL = "WITH fm AS (SELECT p.feature AS a, q.feature AS b, coalesce(e.weight, f.weight, 0) AS weight FROM (SELECT DISTINCT feature FROM cnt) p CROSS JOIN (SELECT DISTINCT feature FROM cnt) q LEFT JOIN medges e ON e.a = p.feature AND e.b = q.feature LEFT JOIN medges f ON f.b = p.feature AND f.a = q.feature) "


@query(_FULL + "SELECT a, b, " + r6(weight="weight") + " FROM fm WHERE a < b AND weight > 0 AND round(weight, 9) >= round((SELECT quantile_cont(weight, 0.9) FROM fm), 9)")
def graph_quantile(s, d):
    z, w = _z_w(s, d)
    return K.quantile_filter(_edges(s, d), z.select("feature").distinct(), 0.9)


@query("SELECT x.feature AS a, y.feature AS b, " + r6(share="count(*) / 10.0") + " FROM runlabels x JOIN runlabels y ON x.run = y.run AND x.label = y.label AND x.feature < y.feature GROUP BY 1, 2 HAVING count(*) >= 5")
def consensus_pairs(s, d):
    return K.consensus(V.labels(s, d), 0.5)


@query("SELECT a, b, " + r6(share="avg(CASE WHEN x.label = y.label THEN 1.0 ELSE 0.0 END)") + " FROM medges JOIN runlabels x ON x.feature = a JOIN runlabels y ON y.feature = b AND y.run = x.run GROUP BY a, b")
def consensus_of_edges(s, d):
    return K.consensus_on(_edges(s, d), V.labels(s, d))


@query(
    "WITH hold AS (SELECT DISTINCT unnest([a, b]) AS feature FROM mends WHERE ins AND weight >= 0.1), big AS (SELECT feature, module, count(*) OVER (PARTITION BY module) AS k FROM mods JOIN hold USING (feature)), ok AS (SELECT feature, dense_rank() OVER (ORDER BY module) AS module FROM big WHERE k >= 3) SELECT feature, CAST(ok.module AS INTEGER) AS module FROM modules LEFT JOIN ok USING (feature)"
)
def modules_pruned(s, d):
    return K.prune(V.modules(s, d), _edges(s, d).where("weight >= 0.1"), 3)


@query("SELECT feature, count(*) AS degree, " + r6(strength="sum(weight)") + " FROM (SELECT unnest([a, b]) AS feature, weight FROM medges) GROUP BY feature")
def node_degrees(s, d):
    return K.degrees(_edges(s, d))


_MS = "WITH en AS (SELECT weight, ins, unnest(CASE WHEN ins THEN [ma] ELSE [ma, mb] END) AS module FROM mends), ms AS (SELECT module, coalesce(sum(weight) FILTER (ins), 0) AS ws, count(*) FILTER (ins) AS wn, coalesce(sum(weight) FILTER (NOT ins), 0) AS bs, count(*) FILTER (NOT ins) AS bn FROM en GROUP BY module) "


@query(_MS + "SELECT module, wn AS within_n, bn AS between_n, " + r6(within_sum="ws", between_sum="bs", cohesion="ws / nullif(wn, 0)", separation="bs / nullif(bn, 0)", conductance="bs / nullif(ws + bs, 0)") + " FROM ms")
def module_quality(s, d):
    return K.module_sums(_edges(s, d), V.modules(s, d))


@query(
    "WITH en AS (SELECT weight, ins, a AS feature, ma AS module FROM mends UNION ALL SELECT weight, ins, b, mb FROM mends), ag AS (SELECT feature, module, avg(weight) FILTER (ins) AS w, avg(weight) FILTER (NOT ins) AS b FROM en GROUP BY ALL) SELECT feature, module, " + r6(within="w", between="b", margin="coalesce(w, 0) - coalesce(b, 0)") + ", CAST(rank() OVER (PARTITION BY module ORDER BY round(coalesce(w, 0) - coalesce(b, 0), 9) DESC) AS INTEGER) AS rank FROM ag"
)
def member_scores(s, d):
    return K.member_scores(_edges(s, d), V.modules(s, d))


@query(
    "WITH co AS (SELECT x.feature AS feature, y.feature AS other, count(*) / 10.0 AS share FROM runlabels x JOIN runlabels y ON x.run = y.run AND x.label = y.label AND x.feature <> y.feature GROUP BY 1, 2), fm AS (SELECT m.feature, m.module, o.module AS om, sum(coalesce(share, 0)) / count(*) AS p FROM mods m JOIN mods o ON o.feature <> m.feature LEFT JOIN co ON co.feature = m.feature AND co.other = o.feature GROUP BY ALL) SELECT feature, module, " + r6(p_in="max(p) FILTER (om = module)", p_best_out="max(p) FILTER (om <> module)") + " FROM fm GROUP BY feature, module"
)
def gene_metrics(s, d):
    return K.gene_metrics(K.consensus(V.labels(s, d), 0.01), V.modules(s, d))


@query(
    "WITH e AS (SELECT weight, x.module AS ma, y.module AS mb FROM medges JOIN modules x ON x.feature = a JOIN modules y ON y.feature = b), h AS (SELECT unnest([ma, mb]) AS module, weight / 2 AS half, CASE WHEN ma = mb THEN weight / 2 ELSE 0 END AS ins FROM e), p AS (SELECT module, sum(half) AS t, sum(ins) AS i FROM h GROUP BY 1) SELECT " + r6(modularity="sum(i / m - (t / m) * (t / m))") + " FROM p, (SELECT sum(weight) AS m FROM e)"
)
def graph_modularity(s, d):
    return K.modularity(_edges(s, d), V.modules(s, d))


@query(
    "WITH RECURSIVE bt AS (SELECT a AS src, b AS dst, weight FROM medges UNION ALL SELECT b, a, weight FROM medges), sh AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM bt), nn AS (SELECT count(DISTINCT src) AS n FROM bt), "
    "r0 AS (SELECT DISTINCT src AS f, 1.0 / n AS pr FROM bt, nn)" + "".join(f", r{i} AS (SELECT dst AS f, 0.15 / any_value(n) + 0.85 * sum(p * pr) AS pr FROM sh JOIN r{i - 1} ON f = src, nn GROUP BY dst)" for i in range(1, 6)) + " SELECT f AS feature, " + r6(pr="pr") + " FROM r5"
)
def node_pagerank(s, d):
    return K.pagerank(_edges(s, d), rounds=5)


@query(
    "WITH RECURSIVE bt AS (SELECT a AS src, b AS dst FROM medges WHERE weight >= 0.15 UNION SELECT b, a FROM medges WHERE weight >= 0.15), wk AS (SELECT [src, dst] AS p, 1 AS n FROM bt WHERE src = 'Brand#11' UNION ALL SELECT list_append(p, dst), n + 1 FROM wk JOIN bt ON src = p[-1] WHERE n < 3 AND NOT list_contains(p, dst)) SELECT array_to_string(p, '>') AS path FROM wk"
)
def simple_paths(s, d):
    return K.paths(_edges(s, d).where("weight >= 0.15"), "Brand#11").select(F.array_join("path", ">").alias("path"))


# ---- against a reference ------------------------------------------------------------------------------------------------


def _methods(s, d):
    one = _assoc(s, d).where("a < b").select(F.lit("m1").alias("method"), "a", "b", F.round("l", 6).alias("weight"))
    two = A.jaccard(V.bins(s, d), 1, 1000).where("a < b").select(F.lit("m2").alias("method"), "a", "b", F.round("jaccard", 6).alias("weight"))
    return one.union(two)


def _labelled(s, d):
    """Labelled edges, made once in a query: curves, areas and numbers each read them."""
    return V.once(s, "labelled", lambda: _labels(s, d))


def _labels(s, d):
    e = V.once(s, "methods", lambda: _methods(s, d))
    scored = B.label_edges(e.select("a", "b", F.col("weight")).withColumn("m", F.lit(0)).drop("m").distinct(), V.ids(s, d), V.reference(s, d)).select("a", "b", "score", "label").distinct()
    return e.join(scored, ["a", "b"])


@query("SELECT method, a, b, " + r6(weight="weight") + ", score, score >= 700 AS label FROM lab")
def labelled_edges(s, d):
    return _labelled(s, d).select("method", "a", "b", "weight", "score", "label")


@query("SELECT method, a, b, k::INTEGER AS k, " + r6(precision="tp / k", recall="tp / nullif(pos, 0)", fpr="(k - tp) / nullif(n - pos, 0)") + " FROM cur")
def precision_recall_curve(s, d):
    return B.curve(_labelled(s, d)).select("method", "a", "b", "k", "precision", "recall", "fpr")


@query("SELECT method, " + r6(auprc="CASE WHEN max(pos) > 0 AND max(pos) < max(n) THEN sum(CASE WHEN label THEN tp / k / pos ELSE 0 END) END") + " FROM cur GROUP BY method")
def area_precision_recall(s, d):
    return B.auprc(_labelled(s, d))


@query("WITH pr AS (SELECT p.method, CASE WHEN p.weight > q.weight THEN 1.0 WHEN p.weight = q.weight THEN 0.5 ELSE 0.0 END AS w FROM cur p JOIN cur q ON p.method = q.method AND p.label AND NOT q.label) SELECT method, " + r6(auroc="avg(w)") + " FROM (SELECT DISTINCT method FROM cur) LEFT JOIN pr USING (method) GROUP BY method")
def area_roc(s, d):
    return B.auroc(_labelled(s, d))


@query("SELECT method, CAST(k AS INTEGER) AS top, " + r6(precision="tp / k", recall="tp / nullif(pos, 0)") + " FROM cur WHERE k IN (10, 30, 50, 100)")
def precision_at(s, d):
    return B.precision_at(_labelled(s, d), [10, 30, 50, 100])


@query("SELECT method, " + r6(enrichment="(count(*) FILTER (label AND k <= 30) / count(*) FILTER (k <= 30)) / (max(pos) / max(n))") + " FROM cur GROUP BY method")
def enrichment_top(s, d):
    return B.enrichment(_labelled(s, d), 30)


_PAIRS = "WITH mp AS (SELECT x.module, score AS s FROM mods x JOIN mods y ON x.module = y.module AND x.feature < y.feature LEFT JOIN inter ON p = x.feature AND q = y.feature) "


@query(_PAIRS + "SELECT module, count(*) AS pairs, count(s) AS mapped, CAST(count(*) FILTER (s >= 700) AS BIGINT) AS strong, " + r6(total="CAST(coalesce(sum(s), 0) AS DOUBLE)", mean="coalesce(sum(s), 0) / count(*)", strong_share="count(*) FILTER (s >= 700) / count(*)") + " FROM mp GROUP BY module")
def module_pair_scores(s, d):
    return B.module_pairs(V.modules(s, d), V.interactions(s, d))


@query(
    _PAIRS + f""", sz AS (SELECT module, count(*) * (count(*) - 1) // 2 AS need FROM mods GROUP BY module),
ob AS (SELECT module, coalesce(sum(s), 0) / count(*) AS obs FROM mp GROUP BY module),
dr AS (SELECT m.module, draw, m.feature, g.feature AS other, row_number() OVER (PARTITION BY m.module, draw ORDER BY md5(concat_ws('|', 1, draw, m.feature, g.feature)), m.feature, g.feature) AS k FROM mods m JOIN modules g ON g.module <> m.module, range(1, {DRAWS + 1}) t(draw)),
nl AS (SELECT dr.module, draw, avg(coalesce(score, 0)) AS v FROM dr JOIN sz USING (module) LEFT JOIN inter ON p = least(feature, other) AND q = greatest(feature, other) WHERE k <= need GROUP BY ALL)
SELECT module, """ + r6(obs="obs", p="(count(*) FILTER (round(v, 9) >= round(obs, 9)) + 1) / (count(*) + 1)", null_mean="avg(v)", null_sd="stddev_samp(v)") + " FROM nl JOIN ob USING (module) GROUP BY module, obs"
)
def module_null_scores(s, d):
    return B.module_null(V.modules(s, d), V.brands(s, d).select("feature"), V.interactions(s, d), DRAWS)


@query()
def module_null_scores_all(s, d):
    return B.module_null(V.modules(s, d), V.brands(s, d).select("feature"), V.interactions(s, d), ALL_DRAWS)


@query("WITH e AS (SELECT method, a, b, weight, round(1 - weight, 6) AS fdr FROM edges WHERE weight > 0) SELECT method, a, b, " + r6(weight="weight", fdr="fdr") + " FROM e WHERE fdr < 0.95 QUALIFY row_number() OVER (PARTITION BY method ORDER BY fdr, a, b) <= (SELECT min(c) FROM (SELECT count(*) AS c FROM e WHERE fdr < 0.95 GROUP BY method))")
def common_pool(s, d):
    return B.common_pool(B.significant(_methods(s, d).withColumn("fdr", F.round(1 - F.col("weight"), 6)), 0.95))


@query()
def quantile_normalised(s, d):
    return B.quantile_normalise(_methods(s, d))


_H = "WITH o AS (SELECT method, weight AS v, row_number() OVER (PARTITION BY method ORDER BY weight) AS k, count(*) OVER (PARTITION BY method) AS n, ((count(*) OVER (PARTITION BY method) + 1) // 2 + 1) / 2 AS dp FROM edges), h AS (SELECT method, (max(v) FILTER (k = floor(dp)) + max(v) FILTER (k = ceil(dp))) / 2 AS q1, (max(v) FILTER (k = floor((n + 1) / 2)) + max(v) FILTER (k = ceil((n + 1) / 2))) / 2 AS md, (max(v) FILTER (k = floor(n + 1 - dp)) + max(v) FILTER (k = ceil(n + 1 - dp))) / 2 AS q3 FROM o GROUP BY method) "


@query(_H + "SELECT method, " + r6(q1="q1", median="md", q3="q3", low="min(v)", high="max(v)") + " FROM o JOIN h USING (method) WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY method, q1, md, q3")
def weight_boxes(s, d):
    return B.box_stats(_methods(s, d), "method", "weight")


@query("SELECT sha256(string_agg(id, chr(10) ORDER BY id)) AS digest FROM (SELECT DISTINCT 'P' || num AS id FROM brands WHERE num % 11 <> 0)")
def id_digest(s, d):
    return B.id_digest(V.ids(s, d), "id")


# ---- runs over time -------------------------------------------------------------------------------------------------------

_CS = "WITH cs AS (SELECT series, t - min(t) OVER (PARTITION BY series) AS sec, CASE WHEN t - lag(t) OVER o > 0 AND cpu_usec - lag(cpu_usec) OVER o >= 0 THEN (cpu_usec - lag(cpu_usec) OVER o) / ((t - lag(t) OVER o) * 1e6) END AS cores, mem_bytes / 1073741824.0 AS gib FROM smp WINDOW o AS (PARTITION BY series ORDER BY t)) "


@query(_CS + "SELECT series, " + r6(sec="sec", cores="cores", gib="gib") + " FROM cs")
def run_series(s, d):
    return B.cpu_series(V.samples(s, d))


_TM = "tt AS (SELECT series, gib AS v, sec - lag(sec) OVER o AS dt, (sec - lag(sec) OVER o) * (gib + lag(gib) OVER o) / 2 AS ar FROM cs WINDOW o AS (PARTITION BY series ORDER BY sec)), tm AS (SELECT series, sum(ar) / nullif(sum(dt), 0) AS mean, max(v) AS most FROM tt GROUP BY series) "


@query(_CS + ", " + _TM + "SELECT series, " + r6(mean="mean", most="most") + " FROM tm")
def run_time_means(s, d):
    return B.time_mean(B.cpu_series(V.samples(s, d)), "gib")


@query(_CS + ", " + _TM + "SELECT CASE WHEN series % 2 = 0 THEN 'even' ELSE 'odd' END AS method, count(*) AS n, " + r6(mean="avg(mean)", sd="stddev_samp(mean)", most="max(most)") + " FROM tm GROUP BY 1")
def run_summary(s, d):
    x = V.samples(s, d)
    g = x.select("series", F.when(F.col("series") % 2 == 0, "even").otherwise("odd").alias("method")).distinct()
    return B.summary(B.time_mean(B.cpu_series(x), "gib"), g)


@query("WITH sg AS (SELECT series, min(t) + k * 432000.0 AS st, CAST(k AS INTEGER) AS segment FROM smp, range(0, 4) r(k) GROUP BY series, k) SELECT s.series, segment, count(*) AS n, " + r6(gib="avg(mem_bytes) / 1073741824.0") + " FROM smp s ASOF JOIN sg ON s.series = sg.series AND s.t >= sg.st GROUP BY ALL")
def run_segments(s, d):
    x = V.samples(s, d)
    starts = x.groupBy("series").agg(F.min("t").alias("t0")).select("series", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("segment"), "t0").select("series", (F.col("t0") + F.col("segment") * 432000.0).alias("start"), "segment")
    return B.segments(x, starts).groupBy("series", "segment").agg(F.count("*").alias("n"), (F.avg("mem_bytes") / 1073741824.0).alias("gib"))


@query(
    _CS + ", sp AS (SELECT series, sec, gib, lead(sec) OVER o AS nx, lead(gib) OVER o AS g2 FROM cs WINDOW o AS (PARTITION BY series ORDER BY sec)), gr AS (SELECT series, unnest(range(0, CAST(floor(max(sec) / 86400) AS BIGINT) + 1)) * 86400.0 AS pos FROM cs GROUP BY series) SELECT gr.series, pos AS grid, " + r6(gib="coalesce(gib + (pos - sec) / (nx - sec) * (g2 - gib), gib)") + " FROM gr ASOF JOIN sp ON gr.series = sp.series AND gr.pos >= sp.sec"
)
def run_resampled(s, d):
    return B.resample(B.cpu_series(V.samples(s, d)), 86400, "gib")
