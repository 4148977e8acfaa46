"""Queries on polygons of a table, and on forests of feature graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.functions import ranks
from tesselark.operators import association as A
from tesselark.operators import benchmark as B
from tesselark.operators import dendrogram as D
from tesselark.operators import graph as K
from tesselark.operators import grid as G
from tesselark.operators import polygons as P
from tesselark.operators import trees as T
from tesselark.plans import catalog as C
from tesselark.plans import shapes as S
from tesselark.plans import views as V
from tesselark.plans.catalog import query, r6

#: Corners of a polygon around its centre, in units of its radius; those of every fourth polygon's hole.
_CORNERS = [(-1.0, -0.3), (0.2, -1.0), (1.0, 0.1), (0.3, 0.9), (-0.7, 0.8)]
_HOLE = [(-0.3, -0.1), (0.1, -0.3), (0.2, 0.3)]


def outlines(s, d) -> DataFrame:
    """Customers as polygons of five corners, some with a triangular hole."""
    c = V.table(s, d, "customer").select(F.col("c_custkey").alias("polygon"), (F.col("c_custkey") * 37 % 503).cast("double").alias("cx"), (F.col("c_custkey") * 91 % 509).cast("double").alias("cy"), (4.5 + F.col("c_custkey") % 13).alias("size"))
    corner = lambda ring, k, u, v: F.struct(F.lit(ring).alias("ring"), F.lit(k).alias("k"), (F.col("cx") + F.col("size") * u).alias("x"), (F.col("cy") + F.col("size") * v).alias("y"))
    outer = c.select("polygon", F.inline(F.array(*[corner(0, k, u, v) for k, (u, v) in enumerate(_CORNERS)])))
    inner = c.where("polygon % 4 = 0").select("polygon", F.inline(F.array(*[corner(1, k, u, v) for k, (u, v) in enumerate(_HOLE)])))
    return outer.union(inner)


def _ring(number: int, corners: list, where: str = "") -> str:
    ends = list(zip(corners, [*corners[1:], corners[0]]))
    return " UNION ALL ".join(f"SELECT polygon, cx + size*{u0} AS x0, cy + size*{v0} AS y0, cx + size*{u1} AS x1, cy + size*{v1} AS y1 FROM cu {where}" for (u0, v0), (u1, v1) in ends)


_SIDES = "WITH cu AS (SELECT c_custkey AS polygon, CAST(c_custkey * 37 % 503 AS DOUBLE) AS cx, CAST(c_custkey * 91 % 509 AS DOUBLE) AS cy, CAST(4.5 + c_custkey % 13 AS DOUBLE) AS size FROM customer), sd AS (" + _ring(0, _CORNERS) + " UNION ALL " + _ring(1, _HOLE, "WHERE polygon % 4 = 0") + "), pl AS (SELECT x, y, feature, count(*) AS n FROM kept GROUP BY ALL), xy AS (SELECT DISTINCT x, y FROM pl), hit AS (SELECT x, y, polygon FROM xy JOIN sd ON (y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 GROUP BY ALL HAVING count(*) % 2 = 1) "


@query(_SIDES + "SELECT feature, CAST(sum(n) AS BIGINT) AS n, " + r6(x="sum(x * n) / sum(n)", y="sum(y * n) / sum(n)") + " FROM pl SEMI JOIN hit USING (x, y) GROUP BY feature")
def points_in_polygon_table(s, d):
    p = P.inside_any(V.kept(s, d), outlines(s, d), "ring")
    return p.groupBy("feature").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


@query(_SIDES + "SELECT polygon, feature, CAST(sum(n) AS BIGINT) AS n FROM pl JOIN hit USING (x, y) GROUP BY polygon, feature")
def points_by_polygon(s, d):
    return P.counts_by_polygon(V.kept(s, d), outlines(s, d), ["feature"], "ring")


# ---- forests ---------------------------------------------------------------------------------------------------------

_G = "WITH RECURSIVE g AS (SELECT a, b, round(ln(1 + round(weight, 9)), 6) AS weight FROM medges), "
#: An edge is in the forest if its ends can't be joined by edges that come before it.
_FOREST = "o AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY weight DESC, a, b) AS k FROM {e}), reach AS (SELECT module, k, a AS v FROM o UNION SELECT r.module, r.k, CASE WHEN x.a = r.v THEN x.b ELSE x.a END FROM reach r JOIN o x ON x.module = r.module AND x.k < r.k AND (x.a = r.v OR x.b = r.v)), forest AS (SELECT module, a, b, weight FROM o WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.module = o.module AND r.k = o.k AND r.v = o.b)) "


def _graph(s, d):
    return V.once(s, "graph", lambda: C.rounded(S._graph(s, d)))


@query(_G + "e0 AS (SELECT 0 AS module, * FROM g), " + _FOREST.format(e="e0") + "SELECT * FROM forest")
def spanning_forest(s, d):
    return T.spanning_forest(_graph(s, d))


@query(_G + "e0 AS (SELECT x.module, a, b, weight FROM g JOIN mods x ON x.feature = a JOIN mods y ON y.feature = b WHERE x.module = y.module), " + _FOREST.format(e="e0") + "SELECT * FROM forest")
def spanning_forest_by_module(s, d):
    return T.spanning_forest(_graph(s, d), V.modules(s, d).where("module >= 0"))


@query(
    _G + "br AS (SELECT least(x.module, y.module) AS p, greatest(x.module, y.module) AS q, a, b, weight FROM g JOIN mods x ON x.feature = a JOIN mods y ON y.feature = b WHERE x.module <> y.module QUALIFY row_number() OVER (PARTITION BY p, q ORDER BY weight DESC, a, b) = 1), "
    "e0 AS (SELECT 0 AS module, p AS a, q AS b, weight FROM br), " + _FOREST.format(e="e0") + "SELECT br.a, br.b, br.weight, p AS ma, q AS mb FROM br JOIN forest f ON f.a = p AND f.b = q"
)
def module_bridges(s, d):
    return T.bridges(_graph(s, d), V.modules(s, d).where("module >= 0"))


# ---- dendrograms -----------------------------------------------------------------------------------------------------

#: Of all pairs in a tree, the last edge on their path; the two sides of each merge, the tighter first.
_MERGES = (
    _G + "e0 AS (SELECT 0 AS module, * FROM g), " + _FOREST.format(e="e0")
    + ", fk AS (SELECT a, b, weight, row_number() OVER (ORDER BY weight DESC, a, b) AS j FROM forest), bi AS (SELECT a AS x, b AS y, j FROM fk UNION ALL SELECT b, a, j FROM fk), "
    "tp AS (SELECT DISTINCT x AS u, x AS v, x AS prev, CAST(0 AS BIGINT) AS m FROM bi UNION ALL SELECT u, y, v, greatest(m, j) FROM tp JOIN bi ON x = v WHERE y <> prev), "
    "mem AS (SELECT j, u AS side, v, m FROM fk JOIN tp ON (u = a OR u = b) AND m < j), "
    "sd AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY last, side) AS place FROM (SELECT j, side, count(*) AS size, max(m) AS last FROM mem GROUP BY j, side)), "
    "sh AS (SELECT r.j, r.side, l.size AS shift FROM sd r JOIN sd l ON l.j = r.j AND l.place = 1 AND r.place = 2), "
    "lv AS (SELECT u AS feature, min(v) AS tree, 1 + coalesce((SELECT sum(shift) FROM mem JOIN sh USING (j, side) WHERE v = tp.u), 0) AS position FROM tp GROUP BY u) "
)


def _arranged(s, d):
    return D.arranged(D.merge_tree(T.spanning_forest(_graph(s, d))))


@query(_MERGES + "SELECT feature, tree, CAST(position AS BIGINT) AS position FROM lv")
def dendrogram_leaf_order(s, d):
    return D.leaf_order(_arranged(s, d))


@query(
    _MERGES + ", lo AS (SELECT min(weight) AS low, max(weight) AS high FROM fk) SELECT a, b, " + r6(weight="weight", height="1.2 * -ln(CASE WHEN weight > low THEN greatest((weight - low) / greatest(1e-12, high - low), 1e-9) ELSE 1e-6 END)")
    + ", (SELECT CAST(sum(size) AS BIGINT) FROM sd WHERE sd.j = fk.j) AS size, (SELECT CAST(min(position) AS BIGINT) FROM mem JOIN lv ON feature = v WHERE mem.j = fk.j) AS start, "
    "(SELECT a FROM fk p WHERE p.j = up) AS above_a, (SELECT b FROM fk p WHERE p.j = up) AS above_b FROM (SELECT *, (SELECT min(j) FROM mem WHERE v = f.a AND mem.j > f.j) AS up FROM fk f) fk, lo"
)
def dendrogram_merges(s, d):
    forest = V.once(s, "forest", lambda: T.spanning_forest(_graph(s, d)).select("a", "b", "weight"))
    found = D.merges(D.arranged(D.merge_tree(forest)))
    return found.join(D.lengths(forest).select("a", "b", F.col("length").alias("height")), ["a", "b"])


#: Five picks are more than a module of these tables has room for.
_PICKS = 5


def _branch_sql() -> str:
    out = (
        _G + "mo AS (SELECT feature, num % 3 AS module FROM brands), e0 AS (SELECT x.module, a, b, weight FROM g JOIN mo x ON x.feature = a JOIN mo y ON y.feature = b WHERE x.module = y.module), " + _FOREST.format(e="e0")
        + ", bi AS (SELECT module, a AS x, b AS y FROM forest UNION ALL SELECT module, b, a FROM forest), "
        "cp AS (SELECT module, x AS r, y AS t, y AS v, x AS prev FROM bi UNION ALL SELECT cp.module, r, t, y, v FROM cp JOIN bi ON x = v WHERE y <> prev), "
        "q1 AS (SELECT module, r, t, list_append(list(v), r) AS part, count(*) AS size FROM cp WHERE (SELECT count(*) FROM bi WHERE x = r) > 1 GROUP BY module, r, t HAVING count(*) >= 3)"
    )
    for k in range(1, _PICKS + 1):
        out += f", p{k} AS (SELECT module, {k} AS pick, part FROM q{k} QUALIFY row_number() OVER (PARTITION BY module ORDER BY size DESC, r, t) = 1), q{k + 1} AS (SELECT q{k}.* FROM q{k} JOIN p{k} USING (module) WHERE NOT list_has_any(q{k}.part, p{k}.part))"
    every = " UNION ALL ".join(f"SELECT module, pick, unnest(part) AS f FROM p{k}" for k in range(1, _PICKS + 1))
    return out + f", hit AS ({every}) SELECT x AS feature, CAST(module AS INTEGER) AS module, module || '_sub' || pick AS branch FROM (SELECT DISTINCT module, x FROM bi) LEFT JOIN (SELECT f AS x, pick FROM hit) USING (x)"


@query(_branch_sql())
def dendrogram_branches(s, d):
    groups = V.brands(s, d).select("feature", (F.col("num") % 3).cast("int").alias("module"))
    return D.branches(T.spanning_forest(_graph(s, d), groups))


# ---- paths -----------------------------------------------------------------------------------------------------------

#: All simple paths of the graph's strongest fifth, from every feature.
_PATHS = "WITH RECURSIVE st AS (SELECT a, b FROM medges WHERE round(weight, 6) >= (SELECT quantile_cont(round(weight, 6), 0.8) FROM medges)), bo AS (SELECT a, b FROM st UNION SELECT b, a FROM st), pa AS (SELECT [a, b] AS p FROM bo UNION ALL SELECT list_append(p, b) FROM pa JOIN bo ON bo.a = p[-1] WHERE NOT list_contains(p, b) AND len(p) <= 8), hub AS (SELECT a AS f FROM bo GROUP BY a ORDER BY count(*) DESC, a LIMIT 2) "


def _strongest(s, d):
    e = V.once(s, "edges", lambda: C.rounded(C._edges(s, d)))
    cut = ranks.quantiles(e, "weight", [0.8])[0]
    kept = e.where(F.col("weight") >= cut).select("a", "b")
    hubs = kept.select(F.explode(F.array("a", "b")).alias("f")).groupBy("f").count().orderBy(F.desc("count"), "f").limit(2).collect()
    return kept, [h.f for h in hubs]


@query(_PATHS + "SELECT array_to_string(p, '->') AS path, CAST(len(p) AS INTEGER) AS length FROM pa WHERE p[1] < p[-1] AND list_contains(p, (SELECT f FROM hub LIMIT 1))")
def paths_through_feature(s, d):
    kept, hubs = _strongest(s, d)
    return K.paths_through(kept, hubs[0]).select(F.array_join("path", "->").alias("path"), "length")


@query(_PATHS + "SELECT array_to_string(p, '->') AS path, CAST(len(p) AS INTEGER) AS length FROM pa WHERE p[1] < p[-1] AND (SELECT count(*) FROM hub WHERE list_contains(p, f)) = 2")
def paths_through_two(s, d):
    kept, hubs = _strongest(s, d)
    return K.paths_through(kept, *hubs).select(F.array_join("path", "->").alias("path"), "length")


# ---- walks, sets of first edges, repeats -----------------------------------------------------------------------------

_PREFER = (
    "WITH bt AS (SELECT a AS src, b AS dst, round(weight, 6) AS weight FROM medges UNION ALL SELECT b, a, round(weight, 6) FROM medges), sh AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM bt), "
    "va AS (SELECT feature, count(*) * 1.0 / (SELECT count(*) FROM bins) AS v FROM cnt WHERE feature IN (SELECT src FROM bt) GROUP BY feature), qs AS (SELECT quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM va), "
    "ex AS (SELECT feature, exp(greatest(lo, least(hi, v)) - hi) AS e FROM va, qs), r0 AS (SELECT feature AS f, e / (SELECT sum(e) FROM ex) AS share, e / (SELECT sum(e) FROM ex) AS pr FROM ex)"
    + "".join(f", r{i} AS (SELECT r0.f, r0.share, 0.15 * r0.share + 0.85 * pin AS pr FROM r0 JOIN (SELECT dst, sum(p * pr) AS pin FROM sh JOIN r{i - 1} ON f = src GROUP BY dst) ON dst = r0.f)" for i in range(1, 7))
    + " "
)


def _walk(s, d):
    e = V.once(s, "edges", lambda: C.rounded(C._edges(s, d)))
    bins = V.bins(s, d)
    share = G.coverage(bins).select("feature", (F.col("pct") / 100).alias("value"))
    return e, K.pagerank(e, rounds=6, prefer=K.preference(share, K.degrees(e)))


@query(_PREFER + "SELECT f AS feature, " + r6(pr="pr") + " FROM r6")
def node_pagerank_preferring(s, d):
    return _walk(s, d)[1]


@query(_PREFER + "SELECT a, b, " + r6(weight="CASE WHEN w > 0.005 THEN w ELSE 0 END") + " FROM (SELECT a, b, round(weight, 6) * (x.pr + y.pr) / 2 AS w FROM medges JOIN r6 x ON x.f = a JOIN r6 y ON y.f = b)")
def edges_reweighted(s, d):
    e, rank = _walk(s, d)
    return K.reweighted(e, rank, 0.005)


_CHOOSE = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"


@query(
    "WITH st AS (SELECT DISTINCT method, n, pos FROM cur), ts AS (SELECT method, n, pos, 'n' || s AS top, CAST(s AS BIGINT) AS size FROM st, (VALUES (10), (30), (50), (100)) t(s) UNION ALL SELECT method, n, pos, 'share' || CAST(s AS DOUBLE), CAST(greatest(1, ceil(s * n - 1e-9)) AS BIGINT) FROM st, (VALUES (0.01), (0.05), (0.1)) t(s)), "
    "hit AS (SELECT ts.*, tp FROM ts JOIN cur ON cur.method = ts.method AND k = size) SELECT method, top, CAST(tp AS BIGINT) AS positives, "
    + r6(precision="tp / size", enrichment="tp / size / nullif(pos / n, 0)", p="least(1.0, list_sum(list_transform(range(CAST(tp AS BIGINT), CAST(least(size, pos) AS BIGINT) + 1), lambda x: CASE WHEN size - x <= n - pos THEN exp(" + _CHOOSE.format("pos", "x") + " + " + _CHOOSE.format("(n - pos)", "(size - x)") + " - " + _CHOOSE.format("n", "size") + ") ELSE 0 END)))")
    + " FROM hit"
)
def enrichment_of_first(s, d):
    return B.enrichment_sets(C._labelled(s, d), [10, 30, 50, 100], [0.01, 0.05, 0.1])


@query("SELECT method, CAST(k AS INTEGER) AS top, (SELECT count(*) FROM inter WHERE score >= 700) AS universe, " + r6(recall="tp / nullif((SELECT count(*) FROM inter WHERE score >= 700), 0)") + " FROM cur WHERE k IN (10, 30, 50, 100)")
def recall_over_universe(s, d):
    return B.recall_of_universe(C._labelled(s, d), V.interactions(s, d), [10, 30, 50, 100])


@query("SELECT grid, count(gib) AS n, " + r6(mean="avg(gib)", sd="stddev_samp(gib)") + " FROM (" + C.SQL["run_resampled"] + ") GROUP BY grid")
def run_mean_of_repeats(s, d):
    return B.mean_of_repeats(B.resample(B.cpu_series(V.samples(s, d)), 86400, "gib"), "gib")


# ---- selected pairs, permuted ids, tables of density plots -------------------------------------------------------------


#: A narrow band around a line, and its segments in SQL.
_BAND = [(r, lo / 5, hi / 5) for r, lo, hi in C._CURVE]
_SEGMENTS = C._DELTA + ", bs AS (SELECT dl.*, lo + (r - x0) / (x1 - x0) * (l2 - lo) AS bl, hi + (r - x0) / (x1 - x0) * (h2 - hi) AS bh FROM dl JOIN (VALUES " + ", ".join("(" + ", ".join(f"CAST({v} AS DOUBLE)" for v in (a, b, *p, *q)) + ")" for (a, *p), (b, *q) in zip(_BAND, _BAND[1:])) + ") t(x0, x1, lo, hi, l2, h2) ON r >= x0 AND r < x1) SELECT a, b, " + r6(l="l", r="r", delta="delta") + " FROM bs "


@query(_SEGMENTS + "WHERE NOT (l >= bl AND l <= bh) AND r BETWEEN -0.4 AND 0.1 AND l BETWEEN -0.5 AND 0.4 QUALIFY rank() OVER (ORDER BY delta DESC) <= 12")
def delta_selected(s, d):
    return A.top_pairs(C._delta(s, d), 12, "largest", s.createDataFrame(_BAND, "r double, lo double, hi double"), r_range=(-0.4, 0.1), l_range=(-0.5, 0.4))


@query(_SEGMENTS + "WHERE l >= bl AND l <= bh QUALIFY rank() OVER (ORDER BY delta DESC) <= 7 OR rank() OVER (ORDER BY delta) <= 7")
def delta_selected_inside(s, d):
    return A.top_pairs(C._delta(s, d), 7, "both", s.createDataFrame(_BAND, "r double, lo double, hi double"), "remove_outside")


@query(
    "WITH fe AS (SELECT feature, CASE WHEN num % 11 <> 0 THEN feature END AS id, row_number() OVER (ORDER BY feature) AS i FROM brands), "
    "dr AS (SELECT d, feature, row_number() OVER (PARTITION BY d ORDER BY md5('1|' || d || '|' || feature), feature) AS i FROM fe, range(1, 201) t(d)), "
    "mp AS (SELECT d, dr.feature, fe.id FROM dr JOIN fe USING (i) UNION ALL SELECT 0, feature, id FROM fe), "
    "kn AS (SELECT x.d, least(x.id, y.id) AS p, greatest(x.id, y.id) AS q, row_number() OVER (PARTITION BY x.d ORDER BY round(weight, 6) DESC, a, b) AS r FROM medges JOIN mp x ON x.feature = a JOIN mp y ON y.feature = b AND y.d = x.d WHERE x.id IS NOT NULL AND y.id IS NOT NULL), "
    "pr AS (SELECT top, d, avg(CAST(coalesce(score, 0) >= 700 AS INT)) AS v FROM kn LEFT JOIN inter USING (p, q), (VALUES (10), (30), (50)) t(top) WHERE r <= top GROUP BY top, d), "
    "ob AS (SELECT top, v AS o FROM pr WHERE d = 0) SELECT top, " + r6(observed="o", null_mean="avg(v)", null_sd="stddev_samp(v)", z="(o - avg(v)) / nullif(stddev_samp(v), 0)", p="(1 + count(*) FILTER (v >= o)) / (1 + count(*))", enrichment="o / 0.25", null_enrichment="avg(v) / 0.25")
    + " FROM pr JOIN ob USING (top) WHERE d > 0 GROUP BY top, o"
)
def reference_label_null(s, d):
    e = V.once(s, "edges", lambda: C.rounded(C._edges(s, d)))
    return B.label_null(e, V.ids(s, d), V.reference(s, d), [10, 30, 50], 200, rate=0.25)


@query("WITH de AS (SELECT gx, gy, floor(xmin/50)*50 + (gx - 0.5)*50 AS cx, floor(ymin/50)*50 + (gy - 0.5)*50 AS cy, coalesce(v, 0) / 2500.0 AS density FROM lim, lat LEFT JOIN (SELECT gx, gy, sum(n) AS v FROM cnt WHERE feature IN ('Brand#11', 'Brand#23', 'Brand#4') GROUP BY ALL) USING (gx, gy)) SELECT gx, gy, " + r6(cx="cx", cy="cy", density="least(density, 0.6 * (SELECT max(density) FROM de))", cut="0.6 * (SELECT max(density) FROM de)") + " FROM de")
def plot_density(s, d):
    tiles = G.lattice(G.bounds(V.kept(s, d)), 50)
    dense = G.density(V.bins(s, d), tiles, C.FEATURES, "none")
    return G.clipped(tiles.select("gx", "gy", "cx", "cy").join(dense, ["gx", "gy"], "left"), "density", 0.6).select("gx", "gy", "cx", "cy", "density", "cut")


@query(
    "WITH ctr AS (SELECT c_custkey AS cell, c_custkey % 20 + 1 + CASE WHEN (c_custkey // 20 + 1) % 2 = 0 THEN 0.5 ELSE 0 END AS x, (c_custkey // 20 + 1) * 0.8660254 AS y FROM customer) "
    "SELECT feature, cell, " + r6(x="CAST(x AS DOUBLE)", y="CAST(y AS DOUBLE)", e="CAST(least(n, most * CASE feature WHEN 'Brand#11' THEN 0.5 ELSE 1 END) AS DOUBLE)") + " FROM (SELECT *, max(n) OVER (PARTITION BY feature) AS most FROM cellcnt) JOIN ctr USING (cell) WHERE feature IN ('Brand#11', 'Brand#23')"
)
def plot_density_centroids(s, d):
    k = F.col("c_custkey")
    row = F.floor(k / 20) + 1
    at = V.table(s, d, "customer").select(k.alias("cell"), (k % 20 + 1 + F.when(row % 2 == 0, 0.5).otherwise(0.0)).alias("x"), (row * 0.8660254).alias("y"))
    return G.expression_points(V.cells(s, d), at, {"Brand#11": 0.5, "Brand#23": 1.0})
