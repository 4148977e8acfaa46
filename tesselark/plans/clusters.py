"""Queries on the modules' second stage, their quality, scoring of edges, and further lattices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselark.functions import testing
from tesselark.operators import assembly as Y
from tesselark.operators import association as A
from tesselark.operators import benchmark as B
from tesselark.operators import graph as K
from tesselark.operators import grid as G
from tesselark.operators import quality as Q
from tesselark.operators import weights as W
from tesselark.plans import catalog as C
from tesselark.plans import views as V
from tesselark.plans.catalog import ALL_DRAWS, query, r6


def _two_sided(z: str) -> str:
    """Two-sided normal p in SQL: the error function's series of positive terms; under 1e-15 beyond 8."""
    x = f"(abs({z}) / sqrt(2))"
    terms = f"list_sum(list_transform(range(0, 220), lambda n: exp((2*n + 1) * ln(greatest({x}, 1e-300)) + 2*n * ln(2) + lgamma(n + 1) - lgamma(2*n + 2))))"
    return f"CASE WHEN abs({z}) > 8 THEN 0 ELSE greatest(0, 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * {terms}) END"


def _bh(p: str, m: str = "m", r: str = "r") -> str:
    return f"least(1.0, min({p} * {m} / {r}) OVER (ORDER BY {p} DESC RANGE UNBOUNDED PRECEDING))"


_R = "count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r"

# ---- adjusted p-values with a normal tail ----------------------------------------------------------------------------

C.SQL["association_fdr"] = V.sql(
    "WITH zz AS (SELECT a, b, l, (l + 1.0/(n-1)) / sqrt(CAST(n AS DOUBLE)*n*(n-2) / ((n-1.0)*(n-1)*(n-3)*s0)) AS zscore FROM assoc, k), pp AS (SELECT *, " + _two_sided("zscore") + " AS p FROM zz), "
    f"rk AS (SELECT *, {_R} FROM pp), ad AS (SELECT *, {_bh('p')} AS bh FROM rk), pi AS (SELECT least(1.0, list_min([" + ", ".join(f"avg(CASE WHEN p > {c / 100} THEN 1.0 ELSE 0.0 END) / (1 - {c / 100})" for c in range(50, 100, 5)) + "])) AS e FROM pp) "
    "SELECT a, b, " + r6(l="l", zscore="zscore", p="p", bh="bh", storey="least(1.0, bh * CASE WHEN e > 0 THEN e ELSE 1 END)") + " FROM ad, pi"
)


@query("WITH pv AS (SELECT a, b, round(abs(l), 6) AS p FROM assoc WHERE a < b), rk AS (SELECT a, b, p, " + _R + " FROM pv) SELECT a, b, " + r6(p="p", fdr=_bh("p", "m * list_sum(list_transform(range(1, m + 1), lambda i: 1.0 / i))"), error="sqrt(p * (1 - p) / 1000)") + " FROM rk")
def adjusted_by(s, d):
    p = C._assoc(s, d).where("a < b").select("a", "b", F.round(F.abs("l"), 6).alias("p"))
    return testing.adjust(p, "p", "fdr", "by").withColumn("error", F.sqrt(F.col("p") * (1 - F.col("p")) / 1000))


# ---- association -----------------------------------------------------------------------------------------------------


@query("SELECT a, b, " + r6(l="l") + " FROM assoc JOIN mods ON feature = a WHERE module = 1")
def association_subset(s, d):
    v = G.row_normalise(V.bins(s, d))
    return A.association_of(v, W.neighbours(V.bins(s, d)), V.modules(s, d).where("module = 1"))


@query()
def delta_permuted(s, d):
    z, w = C._z_w(s, d)
    pairs = C._delta(s, d).where("a < b")
    return A.permutation_counts(z, w, pairs, ALL_DRAWS).select("a", "b", "exceed", testing.smoothed_p(F.col("exceed"), ALL_DRAWS).alias("p"))


# Tiles of 8 x 8 bins keep their inner order.
_TILED = f"""br AS (SELECT gx, gy, row_number() OVER (ORDER BY gy, gx) AS rank, dense_rank() OVER (ORDER BY (gy - 1) // 8, (gx - 1) // 8) AS tile FROM bins),
src AS (SELECT draw, gx, gy, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('|', 1, draw, tile)), tile, rank) AS rank FROM br, range(1, {C.TILE_DRAWS + 1}) t(draw)),
pz AS (SELECT draw, br.gx, br.gy, feature, z FROM src JOIN br ON br.rank = src.rank JOIN z ON z.gx = src.gx AND z.gy = src.gy),
plag AS (SELECT draw, w.gx, w.gy, feature, sum(w*z) AS wz FROM w JOIN pz ON pz.gx = hx AND pz.gy = hy GROUP BY ALL),
pn AS (SELECT a.feature AS a, b.feature AS b, draw, sum(a.z*b.wz) AS num FROM pz a JOIN plag b USING (draw, gx, gy) WHERE a.feature < b.feature GROUP BY ALL),
st AS (SELECT pn.a, pn.b, CASE WHEN p.norm * q.norm = 0 THEN 0 ELSE n / s0 * num / (p.norm * q.norm) END AS star FROM pn JOIN norms p ON p.feature = a JOIN norms q ON q.feature = b, k)
"""


def _tiled(pairs: str, centre: str) -> str:
    return f"{pairs}, {_TILED}, ex AS (SELECT a, b, CAST(sum(CASE WHEN round(abs(star - {centre}), 9) >= round(abs(l - {centre}), 9) THEN 1 ELSE 0 END) AS BIGINT) AS exceed FROM st JOIN se USING (a, b) GROUP BY a, b) SELECT a, b, exceed, " + r6(p=f"(exceed + 1) / {C.TILE_DRAWS + 1}.0") + " FROM ex"


def _tile_counts(s, d, pairs):
    z, w = C._z_w(s, d)
    return A.permutation_counts(z, w, pairs, C.TILE_DRAWS, side=8).select("a", "b", "exceed", testing.smoothed_p(F.col("exceed"), C.TILE_DRAWS).alias("p"))


@query(_tiled("WITH se AS (SELECT a, b, l FROM assoc WHERE a < b)", "0"))
def association_permuted_tiles(s, d):
    return _tile_counts(s, d, C._assoc(s, d).where("a < b"))


@query(_tiled(C._DELTA + ", se AS (SELECT a, b, l, r FROM dl)", "r"))
def delta_permuted_tiles(s, d):
    return _tile_counts(s, d, C._delta(s, d))


_U = "CAST(CAST('0x' || substr(md5(concat_ws('|', 1, a, b)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296"


@query(C._PERM + "SELECT a, b, " + r6(p_disc=f"(exceed + 1) / {C.DRAWS + 1}.0", p_beta=f"(exceed + 1) / {C.DRAWS + 2}.0", p_mid=f"(exceed + 0.5) / {C.DRAWS + 1}.0", p_uniform=f"(exceed + {_U}) / {C.DRAWS + 1}.0") + " FROM ex")
def association_p_modes(s, d):
    z, w = C._z_w(s, d)
    chosen = C._assoc(s, d).where((F.col("a") < F.col("b")) & F.col("a").isin(C.FEATURES))
    modes = [testing.smoothed_p(F.col("exceed"), C.DRAWS, m, testing.hashed_uniform(1, "a", "b")).alias(f"p_{m}") for m in ("disc", "beta", "mid", "uniform")]
    return A.permutation_counts(z, w, chosen, C.DRAWS).select("a", "b", *modes)


_LAYERS = """WITH dn AS (SELECT gx, gy, module, coalesce(n, 0) / 2500.0 AS v FROM lat CROSS JOIN (SELECT DISTINCT module FROM mods) LEFT JOIN (SELECT gx, gy, module, sum(n) AS n FROM cnt JOIN mods USING (feature) GROUP BY ALL) USING (gx, gy, module)),
zz AS (SELECT gx, gy, module AS f, CASE WHEN stddev_samp(v) OVER g > 1e-12 THEN (v - avg(v) OVER g) / stddev_samp(v) OVER g ELSE 0 END AS v FROM dn WINDOW g AS (PARTITION BY module)),
sz AS (SELECT f, count(*) AS k FROM zz WHERE round(v, 9) > 0 GROUP BY f HAVING count(*) >= 5),
ka AS (SELECT zz.*, rank() OVER (PARTITION BY f ORDER BY v) + (count(*) OVER (PARTITION BY f, v) - 1) / 2.0 AS r FROM zz SEMI JOIN sz USING (f)),
pq AS (SELECT p.f AS a, q.f AS b, count(*) FILTER (round(p.v, 9) > 0 AND round(q.v, 9) > 0) AS c, corr(p.v, q.v) AS pearson, corr(p.r, q.r) AS spearman, sum(p.v*q.v) / sqrt(sum(p.v*p.v) * sum(q.v*q.v)) AS cosine FROM ka p JOIN ka q USING (gx, gy) WHERE p.f < q.f GROUP BY ALL),
al AS (SELECT a, b, c / (x.k + y.k - c) AS jaccard, pearson, spearman, cosine FROM pq JOIN sz x ON x.f = a JOIN sz y ON y.f = b) """


@query(_LAYERS + " UNION ALL ".join(f"SELECT '{m}' AS method, a, b, round({m}, 6) + 0.0 AS value FROM al" for m in ("jaccard", "pearson", "spearman", "cosine")))
def module_density_similarity(s, d):
    lattice = V.once(s, "lattice", lambda: G.lattice(G.bounds(V.kept(s, d)), 50))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    n = V.bins(s, d).join(V.modules(s, d).where("module >= 0"), "feature").groupBy("gx", "gy", F.col("module").alias("feature")).agg(F.sum("n").alias("n"))
    layers = V.once(s, "layers", lambda: lattice.join(n, ["gx", "gy"]).select("gx", "gy", "feature", (F.col("n") / area).alias("v")))
    found = [A.layer_similarity(layers, lattice, m).select(F.lit(m).alias("method"), "a", "b", "value") for m in ("jaccard", "pearson", "spearman", "cosine")]
    return found[0].union(found[1]).union(found[2]).union(found[3])


_SIGN = "CASE WHEN substr(md5(concat_ws('|', 1, {})), 1, 1) IN ('1','3','5','7','9','b','d','f') THEN 1.0 ELSE -1.0 END"
_LSH = "WITH sd AS (SELECT feature, t, k, CASE WHEN round(sum(z * " + _SIGN.format("t, k, gx, gy") + "), 9) >= 0 THEN 1 ELSE 0 END AS side FROM z, range(0, 4) a(t), range(0, 8) b(k) GROUP BY ALL), sg AS (SELECT feature, CAST(t AS INTEGER) AS \"table\", CAST(sum(side * (1 << k)) AS BIGINT) AS signature FROM sd GROUP BY feature, t) "


@query(_LSH + "SELECT * FROM sg")
def hyperplane_signatures(s, d):
    return Q.signatures(V.z(s, d))


@query(_LSH + "SELECT x.a, x.b, " + r6(l="l") + ", CAST(row_number() OVER (PARTITION BY x.a ORDER BY round(l, 9) DESC, x.b) AS INTEGER) AS k FROM assoc x SEMI JOIN (SELECT p.feature AS a, q.feature AS b FROM sg p JOIN sg q USING (\"table\", signature) WHERE p.feature <> q.feature) c ON c.a = x.a AND c.b = x.b QUALIFY k <= 3")
def nearest_candidates(s, d):
    return Q.candidates(Q.signatures(V.z(s, d)), C._assoc(s, d), "l", 3)


_CHAO = "WITH o AS (SELECT feature, CAST(sum(n) AS DOUBLE) AS t, CAST(sum(n*n) AS DOUBLE) AS q, count(*) FILTER (n = 2) AS f2 FROM cnt GROUP BY 1), u AS (SELECT feature, t, q/(t*t) AS l, greatest(0, (q - t*(t-1)*(1 - coalesce(2*f2/nullif(t*(t-1), 0), 0)))/(t*t)) AS c FROM o), ab AS (SELECT x.feature AS a, y.feature AS b, CAST(sum(x.n*y.n) AS DOUBLE) AS ab FROM cnt x JOIN cnt y USING (gx, gy) WHERE x.feature < y.feature GROUP BY ALL), mh AS (SELECT a, b, CASE WHEN p.t * r.t > 0 THEN 2 * coalesce(ab, 0) / ((CASE WHEN p.c + r.c > 0 THEN p.c + r.c ELSE p.l + r.l END) * p.t * r.t) ELSE 0 END AS mh FROM medges e LEFT JOIN ab USING (a, b) JOIN u p ON p.feature = a JOIN u r ON r.feature = b) "


@query(_CHAO + "SELECT a, b, " + r6(mh="mh * CASE WHEN top < 0.001 THEN 1000 WHEN top < 0.01 THEN 100 WHEN top < 0.1 THEN 10 ELSE 1 END") + " FROM mh, (SELECT max(mh) AS top FROM mh)")
def overlap_chao_of_edges(s, d):
    return A.auto_scaled(A.morisita_horn(V.bins(s, d), C._edges(s, d), chao=True))


# ---- the second stage --------------------------------------------------------------------------------------------------


@query("SELECT x.feature AS a, y.feature AS b, x.module FROM mods x JOIN mods y ON x.module = y.module AND x.feature < y.feature")
def co_membership(s, d):
    return Y.co_membership(V.modules(s, d))


@query(C._DELTA + "SELECT a, b, " + r6(weight="l") + " FROM dl WHERE l > 0 AND round(l, 6) > round(CASE WHEN r <= -0.3 THEN -0.05 WHEN r < 0 THEN r / 6 WHEN r < 0.3 THEN r * 0.4 ELSE 0.12 END, 6)")
def stage_above_band(s, d):
    curve = s.createDataFrame([(-0.3, -0.05), (0.0, 0.0), (0.3, 0.12)], "r double, hi double")
    x = C._delta(s, d)
    return Y.above_band(x.where("l > 0").select("a", "b", F.col("l").alias("weight")), x, curve)


@query("SELECT a, b, " + r6(weight="weight * coalesce(j, md)") + " FROM medges LEFT JOIN (SELECT * FROM jac WHERE j >= 0.9) USING (a, b), (SELECT quantile_cont(j, 0.5) AS md FROM jac WHERE j >= 0.9)")
def stage_overlap_weighted(s, d):
    j = A.jaccard(V.bins(s, d), 1, 1000).where("a < b AND jaccard >= 0.9").withColumnRenamed("jaccard", "value")
    return Y.overlap_weighted(C._edges(s, d), j)


@query()
def stage_backbone(s, d):
    return Y.with_backbone(C._edges(s, d).where("weight >= 0.1"), C._edges(s, d), V.modules(s, d))


@query("WITH e AS (SELECT a, b, ln(1 + weight) AS w FROM medges), q AS (SELECT quantile_cont(w, 0.05) AS lo, quantile_cont(w, 0.95) AS hi FROM e) SELECT a, b, " + r6(weight="sqrt((least(greatest(w, lo), hi) - lo) / (greatest(hi - lo, 1e-8) + 1e-12))") + " FROM e, q")
def stage_smoothed(s, d):
    return Y.smoothed(C._edges(s, d))


_WIN = "WITH en AS (SELECT a AS feature, weight FROM mends WHERE ins UNION ALL SELECT b, weight FROM mends WHERE ins), wi AS (SELECT feature, module, coalesce(sum(weight), 0) AS w_in, count(weight) AS degree_in FROM mods LEFT JOIN en USING (feature) GROUP BY ALL) "


@query(_WIN + "SELECT feature, module, degree_in, " + r6(w_in="w_in") + " FROM wi")
def member_weights(s, d):
    return Y.inner_weights(C._edges(s, d), V.modules(s, d))


@query(
    _WIN + ", co AS (SELECT x.feature AS feature, y.feature AS other, count(*) / 10.0 AS share FROM runlabels x JOIN runlabels y ON x.run = y.run AND x.label = y.label AND x.feature <> y.feature GROUP BY 1, 2), fm AS (SELECT m.feature, m.module, o.module AS om, sum(coalesce(share, 0)) / count(*) AS p FROM mods m JOIN mods o ON o.feature <> m.feature LEFT JOIN co ON co.feature = m.feature AND co.other = o.feature GROUP BY ALL), gm AS (SELECT feature, max(p) FILTER (om = module) AS p_in, max(p) FILTER (om <> module) AS p_out FROM fm GROUP BY feature), "
    "wk AS (SELECT feature FROM gm JOIN wi USING (feature) WHERE round(p_in, 9) < 0.5 AND round(p_out, 9) > 0.3 AND w_in <= (SELECT quantile_cont(w_in, 0.5) FROM wi)) SELECT feature, CASE WHEN wk.feature IS NULL THEN module END AS module FROM modules LEFT JOIN wk USING (feature)".replace("CASE WHEN wk.feature IS NULL", "CASE WHEN feature NOT IN (SELECT feature FROM wk)")
)
def modules_without_weak(s, d):
    m = V.modules(s, d)
    g = K.gene_metrics(K.consensus(V.labels(s, d), 0.01), m).join(Y.inner_weights(C._edges(s, d), m).select("feature", "w_in"), "feature")
    g = g.withColumns({"p_in": F.round("p_in", 9), "p_best_out": F.round("p_best_out", 9)})
    return Y.without_weak(m, g, 0.5, 0.3, 0.5)


_CONS = "co AS (SELECT x.feature AS a, y.feature AS b, count(*) / 10.0 AS share FROM runlabels x JOIN runlabels y ON x.run = y.run AND x.label = y.label AND x.feature < y.feature GROUP BY 1, 2)"


@query(
    C._MS + ", " + _CONS + ", wc AS (SELECT x.module, count(*) AS pairs, coalesce(sum(share), 0) / count(*) AS wcons FROM mods x JOIN mods y ON x.module = y.module AND x.feature < y.feature LEFT JOIN co ON co.a = x.feature AND co.b = y.feature GROUP BY 1), sz AS (SELECT module, count(*) AS size FROM mods GROUP BY 1), pt AS (SELECT m.feature, module, num % 2 AS part FROM mods m JOIN brands USING (feature)), "
    "ps AS (SELECT x.module, x.part, coalesce(sum(share), 0) / count(*) AS w FROM pt x JOIN pt y ON x.module = y.module AND x.part = y.part AND x.feature < y.feature LEFT JOIN co ON co.a = x.feature AND co.b = y.feature GROUP BY ALL), pk AS (SELECT module, part, count(*) AS k FROM pt GROUP BY ALL), "
    "ok AS (SELECT module FROM pk LEFT JOIN ps USING (module, part) JOIN sz USING (module) JOIN wc USING (module) JOIN ms USING (module) GROUP BY module, size, wcons, ws, bs HAVING size >= 4 AND round(wcons, 9) < 0.5 AND bs / nullif(ws + bs, 0) > 0.6 AND count(*) BETWEEN 2 AND 3 AND min(k) >= 2 AND round(sum(coalesce(w, 0) * k) / sum(k), 9) >= round(wcons + 0.07, 9)), "
    "nw AS (SELECT module, part, row_number() OVER (ORDER BY module, part) + (SELECT max(module) FROM modules) AS nw FROM pk SEMI JOIN ok USING (module)) SELECT feature, CAST(coalesce(nw, m.module) AS INTEGER) AS module FROM modules m LEFT JOIN (SELECT feature, nw FROM pt JOIN nw USING (module, part)) USING (feature)"
)
def modules_split(s, d):
    m, cons, edges = V.modules(s, d), K.consensus(V.labels(s, d), 0.01), C._edges(s, d)
    inside = cons.join(Y.co_membership(m), ["a", "b"]).groupBy("module").agg(F.sum("share").alias("share"))
    size = m.where("module >= 0").groupBy("module").agg(F.count("*").alias("size")).join(inside, "module", "left")
    within = F.round(F.coalesce("share", F.lit(0.0)) / (F.col("size") * (F.col("size") - 1) / 2), 9)
    metrics = size.join(K.module_sums(edges, m).select("module", "conductance"), "module").select("module", "size", within.alias("within"), "conductance")
    parts = m.where("module >= 0").join(V.brands(s, d), "feature").select("feature", "module", (F.col("num") % 2).alias("part"))
    return Y.split(m, parts, cons, metrics, least_size=4, least_part=2, gain=0.0699999)


@query(
    "WITH " + _CONS + ", it AS (SELECT a, b, weight FROM medges SEMI JOIN co USING (a, b)), cr AS (SELECT a, b, weight FROM mends WHERE NOT ins AND round(weight, 9) >= 0.05) SELECT a, b, " + r6(weight="ln(1 + weight)") + ", CASE WHEN bool_or(w) THEN 'within' ELSE 'between' END AS kind, 'pos' AS sign FROM (SELECT *, true AS w FROM it UNION ALL SELECT *, false FROM cr) GROUP BY a, b, weight"
)
def modules_assembled(s, d):
    return Y.assembled(K.consensus(V.labels(s, d), 0.01), C._edges(s, d), V.modules(s, d), 0.05)


@query(
    "WITH RECURSIVE e AS (SELECT a, b FROM assoc WHERE a < b AND round(abs(l), 9) >= 0.05), bt AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e), f AS (SELECT DISTINCT feature FROM cnt), dg AS (SELECT feature, count(y) AS g FROM f LEFT JOIN bt ON x = feature GROUP BY 1), rc AS (SELECT feature AS x, feature AS r FROM f UNION SELECT y, r FROM rc JOIN bt USING (x)), "
    "h AS (SELECT unnest([p.module, q.module]) AS module, CASE WHEN p.module = q.module THEN 0.5 ELSE 0 END AS i FROM e JOIN modules p ON p.feature = a JOIN modules q ON q.feature = b), pm AS (SELECT module, count(*) * 0.5 AS t, sum(i) AS i FROM h GROUP BY 1) "
    "SELECT (SELECT count(DISTINCT r) FROM (SELECT min(r) AS r FROM rc GROUP BY x)) AS components, " + r6(density="avg(g) / (count(*) - 1)", mean_degree="avg(g)", sd_degree="stddev_samp(g)", hub_ratio="avg(CASE WHEN g > 2 * md THEN 1.0 ELSE 0.0 END)", modularity="any_value(mq)") + " FROM dg, (SELECT median(g) AS md FROM dg), (SELECT sum(i / m - (t / m) * (t / m)) AS mq FROM pm, (SELECT count(*) AS m FROM e))"
)
def association_graph_quality(s, d):
    return Y.graph_quality(C._assoc(s, d), V.bins(s, d), V.modules(s, d), 0.05)


# ---- quality of modules ------------------------------------------------------------------------------------------------


@query("SELECT a, b, " + r6(score="abs(l)") + " FROM assoc WHERE a <> b")
def edge_scores(s, d):
    return Q.edge_table(C._assoc(s, d), "l")


_NULL = (
    f"WITH pl AS (SELECT feature, module, row_number() OVER (ORDER BY feature) AS k FROM mods), dl AS (SELECT draw, feature, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('|', 1, draw, feature)), feature) AS k FROM mods, range(1, {ALL_DRAWS + 1}) t(draw)), "
    "lb AS (SELECT draw, dl.feature, module FROM dl JOIN pl USING (k)), en AS (SELECT x.draw, weight, x.module = y.module AS ins, unnest([a, b]) AS feature, unnest([x.module, y.module]) AS module FROM medges JOIN lb x ON x.feature = a JOIN lb y ON y.feature = b AND y.draw = x.draw), "
)
_MARGIN = "mg AS (SELECT draw, feature, coalesce(avg(weight) FILTER (ins), 0) - coalesce(avg(weight) FILTER (NOT ins), 0) AS v FROM en GROUP BY ALL), nl AS (SELECT feature, avg(v) AS mean, stddev_samp(v) AS sd FROM mg GROUP BY 1), ob AS (SELECT feature, coalesce(avg(weight) FILTER (ins), 0) - coalesce(avg(weight) FILTER (NOT ins), 0) AS margin FROM (SELECT unnest([a, b]) AS feature, weight, ins FROM mends) GROUP BY 1), pp AS (SELECT feature, margin, mean, sd, (margin - mean) / nullif(sd, 0) AS z FROM ob LEFT JOIN nl USING (feature)), "


@query(_NULL + _MARGIN + "qq AS (SELECT *, " + _two_sided("z") + f" AS p FROM pp), rk AS (SELECT *, {_R} FROM qq) SELECT feature, " + r6(margin="margin", null_mean="mean", null_sd="sd", z="z", p="p", bh=_bh("p")) + " FROM rk")
def member_margins_against_null(s, d):
    edges, m = C._edges(s, d), V.modules(s, d)
    scores = K.member_scores(edges, m).select("feature", "margin")
    return Q.against_null(scores, Q.member_null(edges, m, ALL_DRAWS), "feature", "margin").select("feature", "margin", "null_mean", "null_sd", "z", "p", "bh")


@query(_NULL + "pm AS (SELECT draw, module, avg(weight) FILTER (NOT ins) AS s, coalesce(sum(weight) FILTER (NOT ins), 0) / nullif(coalesce(sum(weight) FILTER (NOT ins), 0) + coalesce(sum(weight) FILTER (ins), 0) / 2, 0) AS c FROM en GROUP BY ALL) SELECT module, " + r6(separation_mean="avg(s)", separation_sd="stddev_samp(s)", conductance_mean="avg(c)", conductance_sd="stddev_samp(c)") + " FROM pm GROUP BY module")
def module_quality_null(s, d):
    return Q.module_null(C._edges(s, d), V.modules(s, d), ALL_DRAWS)


@query(
    "WITH en AS (SELECT weight, ins, a AS feature, ma AS module FROM mends UNION ALL SELECT weight, ins, b, mb FROM mends), ag AS (SELECT feature, module, round(coalesce(avg(weight) FILTER (ins), 0) - coalesce(avg(weight) FILTER (NOT ins), 0), 9) AS mg FROM en GROUP BY ALL), rk AS (SELECT feature, module, row_number() OVER (PARTITION BY module ORDER BY mg DESC, feature) AS k FROM ag) SELECT module, count(*) AS size, string_agg(feature, ',' ORDER BY k) FILTER (k <= 5) AS members FROM rk GROUP BY module"
)
def module_top_members(s, d):
    return Q.top_members(K.member_scores(C._edges(s, d), V.modules(s, d)))


@query("WITH e AS (SELECT score, x.module AS ma, y.module AS mb FROM inter JOIN mods x ON x.feature = p JOIN mods y ON y.feature = q), en AS (SELECT score, ma = mb AS ins, unnest(CASE WHEN ma = mb THEN [ma] ELSE [ma, mb] END) AS module FROM e) SELECT module, size, " + r6(within="avg(score) FILTER (ins)", between="avg(score) FILTER (NOT ins)", delta="avg(score) FILTER (ins) - avg(score) FILTER (NOT ins)") + " FROM (SELECT module, count(*) AS size FROM mods GROUP BY 1) LEFT JOIN en USING (module) GROUP BY module, size")
def module_reference_scores(s, d):
    return Q.reference_within_between(V.interactions(s, d).select(F.col("p").alias("a"), F.col("q").alias("b"), "score"), V.modules(s, d))


_WB = "WITH e AS (SELECT feature AS a, l, m.module AS ma, o.module AS mb FROM (SELECT a AS feature, b AS other, l FROM assoc WHERE a <> b) JOIN mods m USING (feature) JOIN mods o ON o.feature = other), df AS (SELECT a AS feature, avg(l) FILTER (ma = mb) - avg(l) FILTER (ma <> mb) AS d FROM e GROUP BY 1), dd AS (SELECT feature, round(d, 9) AS d FROM df WHERE d IS NOT NULL) "


def _differences(s, d):
    return A.within_between(C._assoc(s, d).where("a < b"), V.modules(s, d).where("module >= 0"), "l")


@query(_WB + ", rk AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM dd WHERE d <> 0), ag AS (SELECT coalesce(sum(r) FILTER (d > 0), 0) AS v, CAST(count(*) AS DOUBLE) AS n, sum(t * t - 1) AS ties FROM rk), zz AS (SELECT v, n, (v - n*(n+1)/4 - 0.5) / sqrt(n*(n+1)*(2*n+1)/24 - ties/48) AS z FROM ag), pp AS (SELECT *, " + _two_sided("z") + " / 2 AS h FROM zz) SELECT CAST(n AS BIGINT) AS n, " + r6(v="v", z="z", p="CASE WHEN z >= 0 THEN h ELSE 1 - h END") + " FROM pp")
def within_between_signed_rank(s, d):
    return Q.signed_rank(_differences(s, d))


@query(_WB + f", dr AS (SELECT draw, avg(d * {_SIGN.format('draw, feature')}) AS v FROM (SELECT feature, d FROM df WHERE d IS NOT NULL), range(1, {ALL_DRAWS + 1}) t(draw) GROUP BY draw) SELECT " + r6(mean="any_value(m)", p="(count(*) FILTER (round(v, 9) >= round(m, 9)) + 1) / (count(*) + 1)") + " FROM dr, (SELECT avg(d) AS m FROM df)")
def within_between_sign_flips(s, d):
    return Q.sign_flips(_differences(s, d), ALL_DRAWS)


# ---- scoring -------------------------------------------------------------------------------------------------------------


_NULLS = ("mean", "strong")
_ENRICHED = f"""WITH mm AS (SELECT 'm1' AS method, module, feature FROM mods UNION ALL SELECT 'm2', label, feature FROM runlabels WHERE run = 1 UNION ALL SELECT 'm3', 0, 'Brand#11'),
wt AS (SELECT x.method, x.module, count(*) AS pairs, avg(coalesce(score, 0)) AS mean, avg(CASE WHEN score >= 700 THEN 1.0 ELSE 0.0 END) AS strong FROM mm x JOIN mm y ON x.method = y.method AND x.module = y.module AND x.feature < y.feature LEFT JOIN inter ON p = x.feature AND q = y.feature GROUP BY ALL),
os AS (SELECT mm.method, mm.module, mm.feature, g.feature AS other FROM mm, brands g WHERE NOT EXISTS (SELECT 1 FROM mm o WHERE o.method = mm.method AND o.module = mm.module AND o.feature = g.feature)),
rm AS (SELECT method, module, count(*) AS room FROM os GROUP BY ALL),
fa AS (SELECT method, module, coalesce(pairs, 0) AS pairs, mean, strong, CASE WHEN pairs IS NULL THEN 'n_pairs_total_zero' WHEN coalesce(room, 0) < pairs THEN 'cross_edge_space_too_small' END AS status_reason FROM (SELECT DISTINCT method, module FROM mm) LEFT JOIN wt USING (method, module) LEFT JOIN rm USING (method, module)),
dr AS (SELECT os.*, draw, row_number() OVER (PARTITION BY method, module, draw ORDER BY md5(concat_ws('|', 1, draw, method, module, feature, other)), feature, other) AS k FROM os, range(1, {C.TILE_DRAWS + 1}) t(draw)),
nl AS (SELECT dr.method, dr.module, draw, avg(coalesce(score, 0)) AS v_mean, avg(CASE WHEN score >= 700 THEN 1.0 ELSE 0.0 END) AS v_strong FROM dr JOIN fa ON fa.method = dr.method AND fa.module = dr.module AND fa.status_reason IS NULL AND k <= fa.pairs LEFT JOIN inter ON p = least(feature, other) AND q = greatest(feature, other) GROUP BY ALL),
st AS (SELECT method, module, """ + ", ".join(f"(count(*) FILTER (round(v_{c}, 9) >= round({c}, 9)) + 1) / (count(*) + 1) AS p_{c}, avg(v_{c}) AS null_{c}, stddev_samp(v_{c}) AS sd_{c}" for c in _NULLS) + """ FROM nl JOIN fa USING (method, module) GROUP BY method, module),
al AS (SELECT *, """ + ", ".join(f"count(p_{c}) OVER (PARTITION BY method) AS m_{c}, count(p_{c}) OVER (PARTITION BY method ORDER BY p_{c}) AS r_{c}" for c in _NULLS) + """ FROM fa LEFT JOIN st USING (method, module))
SELECT method, CAST(module AS INTEGER) AS module, pairs, status_reason, CASE WHEN status_reason IS NULL THEN 'ok' WHEN status_reason = 'n_pairs_total_zero' THEN 'skipped' ELSE 'null_insufficient' END AS status, """ + r6(
    **{c: c for c in _NULLS}, **{f"{x}_{c}": f"{x}_{c}" for x in ("p", "null", "sd") for c in _NULLS}, **{f"delta_{c}": f"{c} - null_{c}" for c in _NULLS},
    **{f"q_{c}": f"CASE WHEN p_{c} IS NOT NULL THEN least(1.0, min(p_{c} * m_{c} / r_{c}) OVER (PARTITION BY method ORDER BY p_{c} DESC RANGE UNBOUNDED PRECEDING)) END" for c in _NULLS}
) + " FROM al"


@query(_ENRICHED)
def module_enrichment(s, d):
    one = V.modules(s, d).where("module >= 0").select(F.lit("m1").alias("method"), "module", "feature")
    two = V.labels(s, d).where("run = 1").select(F.lit("m2").alias("method"), F.col("label").alias("module"), "feature")
    all_of = one.union(two).union(s.createDataFrame([("m3", 0, "Brand#11")], "method string, module int, feature string"))
    return B.module_enrichment(all_of, V.brands(s, d), V.interactions(s, d), C.TILE_DRAWS)


@query("WITH f AS (SELECT method, a, b, weight, score, row_number() OVER (PARTITION BY method ORDER BY weight DESC, a, b) AS k FROM lab), g AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY weight DESC, a, b) AS j FROM f WHERE k <= 160 AND score IS NOT NULL QUALIFY j <= 80), h AS (SELECT *, 80 - count(*) OVER (PARTITION BY method) AS lack FROM g) SELECT method, a, b, score, CAST(lack AS BIGINT) AS shortfall, CASE WHEN lack = 0 THEN 'ok' ELSE 'insufficient_mappable_edges' END AS status, " + r6(weight="weight") + " FROM h")
def edges_refilled(s, d):
    return B.refill(C._labelled(s, d), 80, 2).select("method", "a", "b", "weight", "score", "shortfall", "status")


_IDS = "pr AS (SELECT score AS s FROM inter JOIN brands x ON x.feature = p JOIN brands y ON y.feature = q WHERE x.num % 11 <> 0 AND y.num % 11 <> 0), nn AS (SELECT count(*) AS genes FROM brands WHERE num % 11 <> 0)"


@query("WITH " + _IDS + " SELECT CAST(level AS DOUBLE) AS level, genes, genes * (genes - 1) // 2 AS pairs, count(s) FILTER (s >= level) AS positives FROM (VALUES (150.0), (400.0), (700.0)) t(level), nn LEFT JOIN pr ON true GROUP BY level, genes")
def reference_background(s, d):
    return B.background(V.ids(s, d), V.reference(s, d), [150, 400, 700])


def _payload(drop: bool) -> str:
    label = "score >= 700" if drop else "coalesce(score >= 700, false)"
    return (
        "WITH " + _IDS + f", e AS (SELECT method, a, b, weight, score, {label} AS y FROM lab), bg AS (SELECT genes * (genes - 1) / 2 AS pairs, count(s) FILTER (s >= 700) AS positives FROM nn, pr GROUP BY genes), kn AS (SELECT *, row_number() OVER o AS k, sum(CAST(y AS INT)) OVER (PARTITION BY method ORDER BY weight DESC, a, b ROWS UNBOUNDED PRECEDING) AS tp, sum(CAST(y AS INT)) OVER (PARTITION BY method) AS pos, rank() OVER (PARTITION BY method ORDER BY weight) + (count(*) OVER (PARTITION BY method, weight) - 1) / 2 AS rk FROM e WHERE y IS NOT NULL WINDOW o AS (PARTITION BY method ORDER BY weight DESC, a, b)), "
        "ar AS (SELECT method, sum(CASE WHEN y THEN tp / k / pos ELSE 0 END) AS ap, (sum(rk) FILTER (y) - any_value(pos) * (any_value(pos) + 1) / 2) / (any_value(pos) * (count(*) - any_value(pos))) AS ro FROM kn GROUP BY method), "
        "ft AS (SELECT method, count(*) AS n_edges, count(y) AS n_comparable, count(score) / count(*) AS coverage, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM e GROUP BY method) "
        "SELECT method, n_edges, n_comparable, CASE WHEN n_comparable = 0 THEN 'no_comparable_edges' WHEN pos = 0 THEN 'no_positive_labels' WHEN neg = 0 THEN 'no_negative_labels' ELSE 'ok' END AS reason, " + r6(coverage="coverage", positive_rate="pos / nullif(n_comparable, 0)", auprc="CASE WHEN pos > 0 AND neg > 0 THEN ap END", auroc="CASE WHEN pos > 0 AND neg > 0 THEN ro END", enrichment="pos / nullif(n_comparable, 0) / nullif(positives / pairs, 0)") + " FROM ft LEFT JOIN ar USING (method), bg"
    )


@query(_payload(False))
def edge_scores_unmapped_negative(s, d):
    return B.payload(C._labelled(s, d), B.background(V.ids(s, d), V.reference(s, d), [700]))


@query(_payload(True))
def edge_scores_unmapped_dropped(s, d):
    return B.payload(C._labelled(s, d), B.background(V.ids(s, d), V.reference(s, d), [700]), unmapped="drop")


C.SQL["quantile_normalised"] = V.sql(
    "WITH rk AS (SELECT method, a, b, weight, row_number() OVER (PARTITION BY method ORDER BY weight) AS k, count(*) OVER (PARTITION BY method) AS n, (rank() OVER (PARTITION BY method ORDER BY weight) + (count(*) OVER (PARTITION BY method, weight) - 1) / 2 - 0.5) / count(*) OVER (PARTITION BY method) * 999 AS pos FROM edges), "
    "sp AS (SELECT method, i, n, (n + 1.0/3) * i / 999 + 1.0/3 AS h FROM (SELECT method, max(n) AS n FROM rk GROUP BY 1), range(0, 1000) t(i)), lv AS (SELECT i, avg(x.weight + (h - floor(h)) * (y.weight - x.weight)) AS v FROM sp JOIN rk x ON x.method = sp.method AND x.k = greatest(1, least(sp.n, floor(h))) JOIN rk y ON y.method = sp.method AND y.k = greatest(1, least(sp.n, floor(h) + 1)) GROUP BY i) "
    "SELECT method, a, b, " + r6(weight="weight", norm="p.v + (pos - p.i) * (coalesce(q.v, p.v) - p.v)") + " FROM rk JOIN lv p ON p.i = floor(pos) LEFT JOIN lv q ON q.i = floor(pos) + 1"
)


@query("SELECT least(l_suppkey, l_partkey) AS x, greatest(l_suppkey, l_partkey) AS y, arg_min(CAST(l_linenumber AS INTEGER), (l_orderkey, l_linenumber)) AS first FROM lineitem GROUP BY 1, 2")
def first_of_pairs(s, d):
    i = V.table(s, d, "lineitem").select(F.col("l_suppkey").alias("p"), F.col("l_partkey").alias("q"), "l_orderkey", F.col("l_linenumber").cast("int").alias("first"))
    return B.first_of_pair(i, ["l_orderkey", "first"]).select("x", "y", "first")


@query("SELECT s_nationkey AS nation, 'even' AS name, round(coalesce(max(s_acctbal) FILTER (s_suppkey % 4 = 2), max(s_acctbal) FILTER (s_suppkey % 4 = 0)), 6) AS v FROM supplier GROUP BY 1 HAVING v IS NOT NULL UNION ALL SELECT s_nationkey, 'odd', round(max(s_acctbal) FILTER (s_suppkey % 4 = 1), 6) AS v FROM supplier GROUP BY 1 HAVING v IS NOT NULL")
def long_last_repeat(s, d):
    at = lambda k: F.max(F.when(F.col("s_suppkey") % 4 == k, F.col("s_acctbal")))
    wide = V.table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(at(0).alias("even_rep1"), at(2).alias("even_rep2"), at(1).alias("odd_rep1"))
    return B.long_form(wide, "nation", r"(\w+)_rep(\d+)")


# ---- lattices --------------------------------------------------------------------------------------------------------------

_HEX = "WITH hx AS (SELECT gx, gy, gx + ((gy - 1) % 2) / 2 AS x FROM bins), pr AS (SELECT a.gx, a.gy, b.gx AS hx, b.gy AS hy, greatest(abs(b.x - a.x - (b.gy - a.gy) / 2), abs(b.gy - a.gy), abs(b.x - a.x + (b.gy - a.gy) / 2)) AS s FROM hx a JOIN hx b ON abs(a.gy - b.gy) <= 2 AND abs(a.gx - b.gx) <= 4), "


@query(_HEX + "wt AS (SELECT *, exp(-s * s / 2) AS e FROM pr WHERE s BETWEEN 1 AND 2) SELECT gx, gy, hx, hy, " + r6(w="e / sum(e) OVER (PARTITION BY gx, gy)") + " FROM wt")
def weights_hex_kernel(s, d):
    return W.hex_kernel(V.bins(s, d))


@query("SELECT a.gx, a.gy, b.gx AS hx, b.gy AS hy FROM bins a JOIN bins b ON abs(a.gx - b.gx) + abs(a.gy - b.gy) IN (1, 2)")
def weights_grown(s, d):
    b = V.bins(s, d)
    return W.grown(W.neighbours(b, "rook"), b, 6)


_SEG = "WITH vt AS (SELECT gx, gy, sum(n) AS v FROM cnt GROUP BY 1, 2), gd AS (SELECT gx, gy FROM vt WHERE v >= 250) "


@query(_SEG + "SELECT gx, gy, feature, n FROM cnt WHERE (gx, gy) IN (SELECT (gx, gy) FROM gd) OR NOT EXISTS (SELECT 1 FROM gd)")
def bins_segmented(s, d):
    b = V.bins(s, d)
    return G.keep_segmented(b, b.groupBy("gx", "gy").agg(F.sum("n").alias("vertices")), 250)


@query("SELECT gx, gy FROM lat")
def bins_with_empty_ones(s, d):
    points = V.kept(s, d)
    return G.bins_used(V.bins(s, d), G.lattice(G.bounds(points), 50), keep_zero=True)


@query("SELECT gx, gy, feature, n FROM cnt SEMI JOIN (SELECT feature FROM modules WHERE module = 2) USING (feature)")
def counts_of_module(s, d):
    return G.of_features(V.bins(s, d), modules=V.modules(s, d), module=2)


@query("WITH pl AS (SELECT CAST(floor((x - xmin) / 50) AS INTEGER) AS gx, CAST(floor((y - ymin) / 50) AS INTEGER) AS gy, feature, x, y FROM kept, lim), ce AS (SELECT gx, gy, avg(x) AS cx, avg(y) AS cy FROM pl GROUP BY 1, 2), ct AS (SELECT gx, gy, feature, count(*) AS n FROM pl GROUP BY ALL), vr AS (SELECT feature FROM ct GROUP BY 1 HAVING min(n) < max(n) OR count(*) < (SELECT count(*) FROM ce)) SELECT gx, gy, feature, n, " + r6(cx="cx", cy="cy") + " FROM ct SEMI JOIN vr USING (feature) JOIN ce USING (gx, gy)")
def comparator_bins(s, d):
    return G.plain_bins(V.kept(s, d), 50)


@query("SELECT a, b, " + r6(l="l") + " FROM assoc WHERE a < b AND round(l, 9) <= -0.02")
def pairs_at_most(s, d):
    return K.where_value(C._assoc(s, d), "le", -0.02)
