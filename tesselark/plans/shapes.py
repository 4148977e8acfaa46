"""Queries on curves, knees, partitions, lattices of hexagons, and the tables behind plots."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselark.operators import association as A
from tesselark.operators import benchmark as B
from tesselark.operators import community as M
from tesselark.operators import curves as R
from tesselark.operators import graph as K
from tesselark.operators import grid as G
from tesselark.operators import regression as L
from tesselark.operators import weights as W
from tesselark.plans import catalog as C
from tesselark.plans import views as V
from tesselark.plans.catalog import query, r6

_PLACES = [round(-0.3 + 0.05 * k, 2) for k in range(13)]
_POINTS = C._DELTA + ", pt AS (SELECT a, b, round(r, 6) AS x, round(l, 6) AS y FROM dl), "
_FIT = (
    _POINTS + "pl AS (SELECT CAST(v AS DOUBLE) AS x0 FROM (VALUES " + ", ".join(f"({v})" for v in _PLACES) + ") t(v)), "
    "nn AS (SELECT x0, x - x0 AS d, y FROM pl CROSS JOIN pt QUALIFY row_number() OVER (PARTITION BY x0 ORDER BY abs(x - x0)) <= greatest(2, ceil(0.45 * (SELECT count(*) FROM pt)))), "
    "ww AS (SELECT x0, d, y, pow(greatest(0, 1 - pow(abs(d) / max(abs(d)) OVER (PARTITION BY x0), 3)), 3) AS w FROM nn), "
    "ss AS (SELECT x0, sum(w) AS s0, sum(w*d) AS s1, sum(w*d*d) AS s2, sum(w*y) AS t0, sum(w*d*y) AS t1 FROM ww GROUP BY x0) "
)


@query(_FIT + "SELECT " + r6(x="x0", fit="(t0 - (s0*t1 - s1*t0) / (s0*s2 - s1*s1) * s1) / s0") + " FROM ss")
def loess_curve(s, d):
    return L.loess(C._delta(s, d), _PLACES)


@query(_FIT + "SELECT " + r6(x="x0", fit="t0 / s0") + " FROM ss")
def loess_flat_curve(s, d):
    return L.loess(C._delta(s, d), _PLACES, degree=0)


@query()
def loess_band(s, d):
    return L.loess_band(C._delta(s, d), places=200, draws=200)


@query()
def loess_band_widened(s, d):
    pairs = C._delta(s, d)
    return L.widen(L.loess_band(pairs, places=100, draws=100, kind="bc"), pairs, least=0.05)


@query(
    _POINTS + "nn AS (SELECT p.a, p.b, p.y AS y0, q.x - p.x AS d, q.y FROM pt p CROSS JOIN pt q QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY abs(q.x - p.x)) <= greatest(2, ceil(0.45 * (SELECT count(*) FROM pt)))), "
    "ww AS (SELECT a, b, y0, d, y, pow(greatest(0, 1 - pow(abs(d) / max(abs(d)) OVER (PARTITION BY a, b), 3)), 3) AS w FROM nn), "
    "ss AS (SELECT a, b, y0, sum(w) AS s0, sum(w*d) AS s1, sum(w*d*d) AS s2, sum(w*y) AS t0, sum(w*d*y) AS t1 FROM ww GROUP BY a, b, y0), "
    "rs AS (SELECT y0 - (t0 - (s0*t1 - s1*t0) / (s0*s2 - s1*s1) * s1) / s0 AS res, 1 / s0 AS own FROM ss), f AS (SELECT count(*) AS n, sum(own) AS edf, sum(res*res) AS q FROM rs) "
    "SELECT n, " + r6(edf="edf", sigma2="q / (n - 1)", sigma2_edf="q / (n - edf)", mad="(SELECT 1.4826 * median(abs(res - (SELECT median(res) FROM rs))) FROM rs)") + " FROM f"
)
def loess_facts(s, d):
    return L.loess_facts(C._delta(s, d))


@query()
def delta_outside_band(s, d):
    pairs = C._delta(s, d)
    return A.outside_curve(pairs, L.loess_band(pairs, places=200, draws=200, kind="basic").select("r", "lo", "hi"))


@query(_POINTS + "br AS (SELECT DISTINCT unnest(quantile_cont(x, [0.0, 0.25, 0.5, 0.75, 1.0])) AS q FROM pt), st AS (SELECT a, b, x, greatest(1, (SELECT count(*) FROM br WHERE q < x)) AS stratum FROM pt) SELECT CAST(stratum AS INTEGER) AS stratum, count(*) AS n FROM st GROUP BY 1")
def pair_strata(s, d):
    return R.strata(C._delta(s, d), n=4).groupBy("stratum").agg(F.count("*").alias("n"))


@query(C._DELTA + "SELECT a, b, " + r6(fold="greatest(p.n, q.n) / greatest(1, least(p.n, q.n))") + " FROM dl JOIN (SELECT feature, sum(n) AS n FROM cnt GROUP BY 1) p ON p.feature = a JOIN (SELECT feature, sum(n) AS n FROM cnt GROUP BY 1) q ON q.feature = b")
def plot_fold_ratios(s, d):
    t = V.bin_counts(s, d).groupBy("feature").agg(F.sum("n").alias("n"))
    e = C._delta(s, d).join(t.toDF("a", "na"), "a").join(t.toDF("b", "nb"), "b")
    return e.select("a", "b", (F.greatest("na", "nb") / F.greatest(F.lit(1), F.least("na", "nb"))).alias("fold"))


@query("SELECT CAST(floor(round(l, 6) / 0.05) AS BIGINT) AS bin, count(*) AS n FROM assoc WHERE a < b GROUP BY 1")
def plot_association_histogram(s, d):
    return C.rounded(C._assoc(s, d)).where("a < b").groupBy(F.floor(F.col("l") / 0.05).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT gx, gy, floor(xmin/50)*50 + (gx - 1)*50 AS x0, floor(xmin/50)*50 + gx*50 AS x1, floor(ymin/50)*50 + (gy - 1)*50 AS y0, floor(ymin/50)*50 + gy*50 AS y1 FROM lat, lim")
def plot_tiles(s, d):
    g = G.lattice(G.bounds(V.kept(s, d)), 50)
    return g.select("gx", "gy", (F.col("cx") - 25).alias("x0"), (F.col("cx") + 25).alias("x1"), (F.col("cy") - 25).alias("y0"), (F.col("cy") + 25).alias("y1"))


@query("SELECT feature, 'run' || run AS method, label FROM runlabels WHERE run < 3 AND label > 0")
def plot_cluster_comparison(s, d):
    wide = V.labels(s, d).where("run < 3").groupBy("feature").pivot("run", [0, 1, 2]).agg(F.max(F.when(F.col("label") > 0, F.col("label"))))
    wide = wide.toDF("feature", "run0", "run1", "run2").where("coalesce(run0, run1, run2) IS NOT NULL")
    return wide.unpivot(["feature"], ["run0", "run1", "run2"], "method", "label").where("label IS NOT NULL")


_IDELTA = "SELECT feature, CASE WHEN sum(n) >= 2 THEN CAST((SELECT count(*) FROM bins) AS DOUBLE) * sum(n * (n - 1)) / (CAST(sum(n) AS DOUBLE) * (sum(n) - 1)) END AS idelta FROM cnt GROUP BY feature"


def _dispersion(s, d):
    c = V.bins(s, d)
    return A.dispersion(c, c.select("gx", "gy").distinct().agg(F.count("*").alias("q")))


@query("SELECT module, feature, " + r6(idelta="idelta") + f" FROM ({_IDELTA}) JOIN mods USING (feature) QUALIFY rank() OVER (PARTITION BY module ORDER BY round(idelta, 6) DESC) <= 2 AND count(*) OVER (PARTITION BY module) >= 2")
def plot_dispersion_by_module(s, d):
    e = C.rounded(_dispersion(s, d).select("feature", "idelta")).join(V.modules(s, d).where("module >= 0"), "feature")
    w = Window.partitionBy("module")
    return e.withColumns({"k": F.rank().over(w.orderBy(F.desc("idelta"))), "n": F.count("*").over(w)}).where("k <= 2 AND n >= 2").select("module", "feature", "idelta")


@query("WITH dg AS (SELECT f AS feature, count(*) AS degree FROM (SELECT unnest([a, b]) AS f FROM medges WHERE round(l9, 9) >= 0.1) GROUP BY 1) SELECT feature, degree, degree > 1.1 * (SELECT median(degree) FROM dg) AS hub FROM dg".replace("l9", "weight"))
def plot_hubs(s, d):
    deg = K.threshold_graph(C._assoc(s, d), 0.1).select(F.explode(F.array("a", "b")).alias("feature")).groupBy("feature").agg(F.count("*").alias("degree"))
    mid = deg.agg((F.percentile("degree", 0.5) * 1.1).alias("m"))
    return deg.crossJoin(F.broadcast(mid)).select("feature", "degree", (F.col("degree") > F.col("m")).alias("hub"))


# ---- knees ---------------------------------------------------------------------------------------------------------

_SIZES = [20, 25, 30, 40, 50, 60, 80, 100]
_SIZED = (
    "WITH sb AS (SELECT CAST(size AS DOUBLE) AS size, floor((x - floor(xmin/size)*size)/size) AS gx, floor((y - floor(ymin/size)*size)/size) AS gy, feature, count(*) AS n FROM kept, lim, (VALUES "
    + ", ".join(f"({v}.0)" for v in _SIZES) + ") t(size) GROUP BY ALL), "
    "sv AS (SELECT feature, size, (SELECT count(*) FROM (SELECT DISTINCT size, gx, gy FROM sb) q WHERE q.size = sb.size) * CAST(sum(n*(n-1)) AS DOUBLE) / (CAST(sum(n) AS DOUBLE) * (sum(n) - 1)) AS v FROM sb GROUP BY feature, size HAVING sum(n) >= 2), "
    "qq AS (SELECT feature, quantile_cont(v, 0.1) AS ql, quantile_cont(v, 0.9) AS qu FROM sv GROUP BY feature), "
    "ki AS (SELECT feature, size, v FROM sv JOIN qq USING (feature) WHERE v BETWEEN ql - 1.5*(qu - ql) AND qu + 1.5*(qu - ql)), "
    "ks AS (SELECT *, lead(size) OVER f AS s2, lead(v) OVER f AS v2 FROM ki WINDOW f AS (PARTITION BY feature ORDER BY size)), "
    "gr AS (SELECT feature, CAST(g AS DOUBLE) AS size, CASE WHEN s2 IS NULL THEN v ELSE v + (v2 - v) * (g - size) / (s2 - size) END AS v FROM ks JOIN range(20, 105, 5) t(g) ON g >= size AND (g < s2 OR s2 IS NULL AND g = size)), "
)
_BEND = "bd AS (SELECT {by} size, round(abs(lead(v) OVER f - 2*v + lag(v) OVER f) / pow(1 + pow((lead(v) OVER f - lag(v) OVER f)/2, 2), 1.5), 9) AS c FROM {src} WINDOW f AS ({part} ORDER BY size)) "


def _sized(s, d):
    p = V.kept(s, d)
    c = G.count_sizes(p, G.bounds(p), _SIZES)
    q = c.select("size", "gx", "gy").distinct().groupBy("size").agg(F.count("*").alias("q"))
    n = c.groupBy("feature", "size").agg(F.sum("n").cast("double").alias("t"), F.sum(F.col("n") * (F.col("n") - 1)).cast("double").alias("p")).where("t >= 2")
    v = n.join(F.broadcast(q), "size").select("feature", F.col("size").cast("double").alias("size"), (F.col("q") * F.col("p") / (F.col("t") * (F.col("t") - 1))).alias("v"))
    i = R.knee_input(v).select(F.col("feature").alias("series"), F.col("size").alias("sec"), "v")
    return B.resample(i, 5.0, "v").select(F.col("series").alias("feature"), F.col("grid").cast("double").alias("size"), "v")


@query(_SIZED + _BEND.format(by="feature,", src="gr", part="PARTITION BY feature") + "SELECT feature, CASE WHEN count(*) >= 6 THEN arg_min(size, size) FILTER (WHERE c = m) END AS knee FROM (SELECT *, max(c) OVER (PARTITION BY feature) AS m FROM bd) GROUP BY feature")
def feature_knees(s, d):
    return R.knees(_sized(s, d), ["feature"])


@query(_SIZED + "mc AS (SELECT size, avg(v) AS v FROM gr GROUP BY size), " + _BEND.format(by="", src="mc", part="") + "SELECT min(size) AS knee FROM bd WHERE c = (SELECT max(c) FROM bd)")
def overall_knee(s, d):
    mean = _sized(s, d).groupBy("size").agg(F.avg("v").alias("v"))
    return R.knees(mean.withColumn("one", F.lit(1)), ["one"]).select("knee")


# ---- partitions ----------------------------------------------------------------------------------------------------


def _graph(s, d):
    return C._edges(s, d).select("a", "b", F.log1p(F.round("weight", 9)).alias("weight"))


@query()
def partition_restarts(s, d):
    return M.restarts(_graph(s, d), 20)


@query()
def partition_final(s, d):
    runs = V.once(s, "runs", lambda: M.restarts(_graph(s, d), 20))
    return M.final_partition(K.consensus(runs, 0.5), runs)


@query()
def partition_cpm(s, d):
    return M.partition(_graph(s, d), resolution=0.05, objective="cpm")


@query()
def partition_hierarchical(s, d):
    return M.hierarchical(C._edges(s, d), 6, 2)


@query()
def partition_second_stage(s, d):
    return M.repartitioned(_graph(s, d), V.modules(s, d).where("module >= 0"), 10, 0.5)


@query()
def rewired_null(s, d):
    return M.rewired(K.threshold_graph(C._assoc(s, d), 0.05).select("a", "b", "weight"), 5)


# ---- hexagons ------------------------------------------------------------------------------------------------------

#: Customers as hexagons, twenty a row, even rows shifted.
_HEX = "SELECT c_custkey % 20 + 1 AS gx, c_custkey // 20 + 1 AS gy, c_custkey % 20 + 1 + CASE WHEN (c_custkey // 20 + 1) % 2 = 0 THEN 0.5 ELSE 0 END AS cx, (c_custkey // 20 + 1) * 0.8660254 AS cy FROM customer"


def _hexes(s, d):
    k = F.col("c_custkey")
    at = V.table(s, d, "customer").select((k % 20 + 1).cast("int").alias("gx"), (F.floor(k / 20) + 1).cast("int").alias("gy"))
    return at.select("gx", "gy", (F.col("gx") + F.when(F.col("gy") % 2 == 0, 0.5).otherwise(0.0)).alias("cx"), (F.col("gy") * 0.8660254).alias("cy"))


@query(
    f"WITH hx AS ({_HEX}), e AS (SELECT dx, dy, abs(degrees(atan2(q.cy - p.cy, q.cx - p.cx))) AS t, sqrt(pow(q.cy - p.cy, 2) + pow(q.cx - p.cx, 2)) AS far FROM hx p JOIN hx q ON true JOIN (VALUES (0, 1), (1, 0), (1, 1), (1, -1)) s(dx, dy) ON q.gx = p.gx + dx AND q.gy = p.gy + dy), "
    "m AS (SELECT avg(CAST(least(t, 180 - t) <= 10 AS INT)) AS horizontal, avg(CAST(abs(t - 90) <= 10 AS INT)) AS vertical, avg(CAST(abs(t - 60) <= 10 OR abs(t - 120) <= 10 AS INT)) AS sl, median(far) FILTER (dx = 1 AND dy = 1) / median(far) FILTER (dx + dy = 1 AND dx * dy = 0) AS ratio FROM e) "
    "SELECT sl >= 0.4 AND greatest(horizontal, vertical) < 0.8 AND abs(ratio - 1) <= 0.2 AS hex, " + r6(horizontal="horizontal", vertical="vertical", ratio="ratio") + " FROM m"
)
def lattice_hex_like(s, d):
    return W.hex_like(_hexes(s, d))


@query(
    f"WITH hx AS ({_HEX}), st AS (SELECT median(step) AS step FROM (SELECT cx - lag(cx) OVER (PARTITION BY gy ORDER BY cx) AS step FROM hx)), fi AS (SELECT gy, min(cx) AS ax FROM hx GROUP BY gy), "
    "sh AS (SELECT gy, 2 * abs(q - round_even(q, 0)) AS shift FROM (SELECT gy, (ax - (SELECT min(ax) FROM fi)) / (SELECT step FROM st) AS q FROM fi)) "
    "SELECT CASE WHEN avg(shift) FILTER (gy % 2 = 0) > avg(shift) FILTER (gy % 2 = 1) THEN 'evenr' ELSE 'oddr' END AS kind FROM sh"
)
def lattice_hex_parity(s, d):
    return W.hex_parity(_hexes(s, d))


@query(f"WITH hx AS ({_HEX}) SELECT a.gx, a.gy, count(b.gx) AS n FROM hx a JOIN hx b ON abs(a.cx - b.cx) < 1.01 AND abs(a.cy - b.cy) < 0.9 AND NOT (a.gx = b.gx AND a.gy = b.gy) AND sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) < 1.01 GROUP BY ALL")
def weights_by_topology(s, d):
    """Spots' neighbourhoods are hexagons; which rows are shifted is told from the centres."""
    at = _hexes(s, d)
    return W.neighbours(at, W.topology(at, platform="visium")).groupBy("gx", "gy").agg(F.count("*").alias("n"))
