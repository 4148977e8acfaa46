"""Queries that write the tables as the files an instrument or a method gives, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselark.operators import association as A
from tesselark.operators import grid as G
from tesselark.plans import catalog as C
from tesselark.plans import views as V
from tesselark.plans.catalog import query, r6
from tesselark.sources import readers, sinks
from tesselark.sources.files import matching, scratch
from tesselark.streaming import counts


@query("SELECT a, b, " + r6(weight="round(l, 6)") + ", CAST(NULL AS DOUBLE) AS fdr FROM assoc WHERE a < b AND l > 0")
def file_edges(s, d):
    path = scratch(s, "edges")
    e = C.rounded(C._edges(s, d)).select(F.col("a").alias("gene_a"), F.concat(F.lit(" "), F.col("b")).alias("gene_b"), "weight", F.lit("pos").alias("edge_type"))
    # Rows that a reader has to drop: a loop, a blank end, a weight that is no number, a blank type.
    odd = s.createDataFrame([("x", "x", "1", "pos"), ("x", "", "1", "pos"), ("x", "y", "NaN", "pos"), ("x", "y", "1", " ")], "gene_a string, gene_b string, weight string, edge_type string")
    sinks.write_tsv(e.withColumn("weight", F.col("weight").cast("string")).union(odd), path, compressed=True)
    return readers.edges(s, path)


@query("SELECT CAST(module AS VARCHAR) AS module, feature FROM modules WHERE module >= 0")
def file_modules(s, d):
    path = scratch(s, "modules")
    sinks.write_tsv(V.modules(s, d).select(F.col("feature").alias("gene"), F.col("module").alias("module_id")), path)
    return readers.modules(s, path)


@query("SELECT DISTINCT feature FROM modules")
def file_background(s, d):
    path = scratch(s, "modules")
    sinks.write_tsv(V.modules(s, d).select(F.col("feature").alias("gene"), F.col("module").alias("module_id")), path)
    return readers.background(s, path)


@query("SELECT p, q, score FROM inter JOIN brands x ON x.feature = p JOIN brands y ON y.feature = q WHERE x.num % 3 <> 0 AND y.num % 3 <> 0")
def file_interactions(s, d):
    path = scratch(s, "interactions")
    V.interactions(s, d).select(F.col("p").alias("protein1"), F.col("q").alias("protein2"), F.col("score").alias("combined_score")).write.csv(path, sep=" ", header=True)
    return readers.interactions(s, path, V.brands(s, d).where("num % 3 <> 0").select(F.col("feature").alias("id")))


@query("SELECT CAST(cell AS VARCHAR) AS barcode, feature, CAST(n AS DOUBLE) AS n FROM cellcnt")
def file_matrix_market(s, d):
    path = scratch(s, "matrix")
    sinks.write_matrix_market(V.cells(s, d).select(F.col("cell").cast("string").alias("barcode"), "feature", "n"), path)
    return readers.matrix_market(s, path)


@query("SELECT CAST(cell AS VARCHAR) AS barcode, feature, CAST(n AS DOUBLE) AS n FROM cellcnt")
def file_coordinates(s, d):
    path = scratch(s, "coordinates")
    cells = V.cells(s, d)
    # The wrong way round, with rows that say nothing.
    rows = cells.select(F.col("cell").cast("string").alias("Row"), F.col("feature").alias("col"), F.col("n").cast("double").alias("value"))
    rows.union(s.createDataFrame([("1", None, 2.0), (None, "Brand#11", 2.0), ("1", "none", 0.0)], rows.schema)).write.parquet(path)
    return readers.coordinates(s, path, V.table(s, d, "orders").select(F.col("o_custkey").alias("barcode")))


@query("SELECT CAST(cell % 7 AS VARCHAR) || '_' || CAST(cell // 7 AS VARCHAR) AS cell, feature, CAST(n AS DOUBLE) AS n FROM cellcnt")
def file_wide_counts(s, d):
    path = scratch(s, "wide")
    cells = V.once(s, "cells", lambda: V.cells(s, d))
    ids = {"fov": F.floor(F.col("cell") / 7).cast("int"), "cell_ID": F.col("cell") % 7}
    names = [r.feature for r in cells.select("feature").where("feature IS NOT NULL").distinct().orderBy("feature").collect()]  # columns of the file
    at = lambda v: F.sum(F.when(F.col("feature") == v, F.col("n"))).alias(v)
    wide = cells.select(*[c.alias(k) for k, c in ids.items()], "feature", "n").groupBy(*ids).agg(*map(at, names))
    wide.write.csv(path, header=True, compression="gzip")
    known = cells.select(F.concat_ws("_", ids["cell_ID"].cast("string"), ids["fov"].cast("string")).alias("cell"))
    return readers.resolve_cells(readers.expression(s, path), known)


@query("SELECT CAST(c_custkey AS VARCHAR) AS label, CAST(4 AS INTEGER) AS corners, " + r6(x="c_custkey % 100 - 5") + " FROM customer WHERE c_custkey % 5 <> 0")
def file_segmentation(s, d):
    path = scratch(s, "segmentation")
    k = F.col("c_custkey")
    corner = F.when(k % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    rows = V.table(s, d, "customer").select(k.alias("cell_id"), F.explode(corner).alias("v"))
    sides = [(-5, -5), (5, -5), (5, 5)]
    pick = lambda i: F.element_at(F.array(*[F.lit(float(p[i])) for p in sides]), F.col("v") + 1)
    rows.select("cell_id", (F.col("cell_id") % 100 + pick(0)).alias("vertex_x"), (F.col("cell_id") % 90 + pick(1)).alias("vertex_y")).write.parquet(path)
    p = readers.polygons(readers.segmentation(s, path))
    return p.select("label", F.size("ring").alias("corners"), F.col("ring")[0]["x"].alias("x"))


@query(f"SELECT feature, count(*) AS n FROM kept WHERE ({C._SIDES}) % 2 = 1 GROUP BY feature")
def file_outline(s, d):
    path = scratch(s, "outline")
    lines = ["# drawn by hand", "X,Y"] + [f"{x},{y}" for x, y in V.ROI for _ in (0, 1)]
    s.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    ring = readers.outline(s, matching(s, f"{path}/part-*")[0])
    return G.in_polygon(V.kept(s, d), ring[:-1]).groupBy("feature").agg(F.count("*").alias("n"))


@query("SELECT " + r6(t="t", cpu_usec="cpu_usec", mem_bytes="mem_bytes") + " FROM smp")
def file_samples(s, d):
    path = scratch(s, "samples")
    e = V.samples(s, d)
    e.select(F.col("t").alias("epoch"), F.lit("x").alias("iso_time"), F.col("cpu_usec").alias("cpu_usage_usec"), F.col("mem_bytes").alias("mem_current_bytes")).write.csv(path, sep="\t", header=True)
    return readers.samples(s, path).select("t", "cpu_usec", "mem_bytes")


@query("SELECT CAST(user_id AS INTEGER) AS repeat, CAST(floor(min(epoch_us(ts) / 1000000)) AS BIGINT) AS t FROM events GROUP BY user_id")
def file_log_starts(s, d):
    path = scratch(s, "log")
    when = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    V.table(s, d, "events").select(F.concat(F.lit("["), when, F.lit("Z] start repeat_idx="), F.col("user_id")).alias("value")).write.text(path)
    return readers.log_starts(s, path)


@query("SELECT feature, count(*) AS n, " + r6(x="avg(x)", y="avg(y)") + " FROM kept GROUP BY feature")
def file_molecules(s, d):
    path = scratch(s, "molecules")
    V.molecules(s, d).select(F.col("x").alias("x_location"), F.col("y").alias("y_location"), F.col("feature").alias("feature_name"), "qv", "nucleus_distance").write.parquet(path)
    return G.filter_points(readers.molecules(s, path)).groupBy("feature").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


@query("SELECT feature, count(*) AS n, " + r6(x="avg(x) * 0.120280945") + " FROM mol GROUP BY feature")
def file_field_molecules(s, d):
    """Without names in the header: columns by their places."""
    path = scratch(s, "fields")
    places = [F.lit(0).alias(f"p{k}") for k in range(5)] + ["x", "y", "nucleus_distance", "feature", "qv"]
    V.molecules(s, d).select(*places).write.csv(path, header=False)
    t = readers.field_molecules(s, path)
    return t.groupBy("feature").agg(F.count("*").alias("n"), F.avg("x").alias("x"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS barcode, CAST(s_suppkey % 10 AS INTEGER) AS array_row, CAST(s_suppkey // 10 AS INTEGER) AS array_col, " + r6(x="s_suppkey * 2 * 0.5", y="s_suppkey * 3 * 0.5") + " FROM supplier WHERE s_suppkey % 4 <> 0")
def file_spots(s, d):
    path, scale = scratch(s, "spots"), scratch(s, "scale")
    k = F.col("s_suppkey")
    rows = V.table(s, d, "supplier").select(k.alias("barcode"), (k % 4 != 0).cast("int").alias("in_tissue"), (k % 10).alias("row"), F.floor(k / 10).alias("col"), (k * 3).alias("imagerow"), (k * 2).alias("imagecol"))
    rows.write.csv(path, header=True)
    sinks.write_meta(s, scale, spot_diameter_fullres=110.0)
    return readers.spots(s, path, readers.spot_scale(s, scale))


# Suppliers as spots: rows of ten, odd rows from an odd column; their line items are counts.
_SPOTS = """WITH sp AS (SELECT s_suppkey AS k, CAST(s_suppkey % 10 AS INTEGER) AS r, CAST(2 * (s_suppkey // 10) + s_suppkey % 2 AS INTEGER) AS c FROM supplier WHERE s_suppkey % 7 <> 0),
ct AS (SELECT r, c, p_brand AS feature, CAST(count(*) AS DOUBLE) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN sp ON k = l_suppkey GROUP BY ALL),
ub AS (SELECT DISTINCT r, c FROM ct), nu AS (SELECT count(*) AS n FROM ub),
kp AS (SELECT feature FROM ct GROUP BY feature HAVING count(*) >= 0.1 * (SELECT n FROM nu) - 1e-9 ORDER BY sum(n) DESC, feature LIMIT 20),
dn AS (SELECT r, c, feature, coalesce(v, 0) AS v FROM ub CROSS JOIN kp LEFT JOIN (SELECT r, c, feature, n / sum(n) OVER (PARTITION BY r, c) AS v FROM ct) USING (r, c, feature)),
zz AS (SELECT r, c, feature, CASE WHEN stddev_samp(v) OVER f <= 1e-12 THEN 0 ELSE (v - avg(v) OVER f) / stddev_samp(v) OVER f END AS z FROM dn WINDOW f AS (PARTITION BY feature)),
hw AS (SELECT a.r, a.c, b.r AS hr, b.c AS hc FROM ub a JOIN ub b ON (a.r = b.r AND abs(a.c - b.c) = 2) OR (abs(a.r - b.r) = 1 AND abs(a.c - b.c) = 1)),
lg AS (SELECT hw.r, hw.c, feature, sum(z) AS wz FROM hw JOIN zz ON zz.r = hr AND zz.c = hc GROUP BY ALL),
nm AS (SELECT feature, sqrt(sum(z*z)) AS norm FROM zz GROUP BY 1),
pr AS (SELECT zz.feature AS a, lg.feature AS b, sum(z * wz) AS num FROM zz JOIN lg USING (r, c) GROUP BY ALL) """


def _spot_sample(s, d):
    """Written as an instrument's folder, and read back."""
    folder = scratch(s, "sample")
    k = F.col("s_suppkey")
    rows = V.table(s, d, "supplier").select(k.alias("barcode"), (k % 7 != 0).cast("int").alias("in_tissue"), (k % 10).alias("array_row"), (2 * F.floor(k / 10) + k % 2).alias("array_col"), (k * 3).alias("pxl_row_in_fullres"), (k * 2).alias("pxl_col_in_fullres"))
    rows.write.csv(f"{folder}/spatial/tissue_positions.csv", header=True)
    sinks.write_meta(s, f"{folder}/spatial/scalefactors_json.json", spot_diameter_fullres=110.0)
    items = V.table(s, d, "lineitem").join(V.table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = items.groupBy(F.col("l_suppkey").cast("string").alias("barcode"), F.col("p_brand").alias("feature")).agg(F.count("*").alias("n"))
    sinks.write_matrix_market(counts, f"{folder}/filtered_feature_bc_matrix")
    return readers.spot_folder(s, folder)


@query(_SPOTS + "SELECT p.feature AS a, q.feature AS b, " + r6(l="CASE WHEN p.norm * q.norm = 0 THEN 0 ELSE (SELECT n FROM nu) / (SELECT count(*) FROM hw) * coalesce(num, 0) / (p.norm * q.norm) END") + " FROM nm p CROSS JOIN nm q LEFT JOIN pr ON pr.a = p.feature AND pr.b = q.feature")
def spots_association(s, d):
    sample = _spot_sample(s, d)
    return A.association_of_spots(sample.counts, sample.weights, most=20)


@query(_SPOTS + "SELECT gx, gy, feature, " + r6(v="least(v, cap)") + " FROM (SELECT c // 2 + 1 AS gx, r + 1 AS gy, feature, ln(1 + n * 10000.0 / sum(n) OVER (PARTITION BY r, c)) AS v FROM ct) JOIN (SELECT feature, quantile_cont(coalesce(v, 0), 0.95) AS cap FROM ub CROSS JOIN (SELECT DISTINCT feature FROM ct) LEFT JOIN (SELECT r, c, feature, ln(1 + n * 10000.0 / sum(n) OVER (PARTITION BY r, c)) AS v FROM ct) USING (r, c, feature) GROUP BY feature) USING (feature)")
def spots_winsorised(s, d):
    counts = _spot_sample(s, d).counts
    lib = counts.withColumn("spot", F.struct("gx", "gy"))
    units = counts.select("gx", "gy").distinct().count()
    return G.winsorise_sparse(G.log_cpm(lib, "spot"), units).select("gx", "gy", "feature", "v")


@query("SELECT p, q, score FROM inter")
def file_cache(s, d):
    folder = scratch(s, "cache")
    ids = V.brands(s, d).select(F.col("feature").alias("id"))
    readers.cached(s, folder, ids, lambda: V.interactions(s, d))
    return readers.cached(s, folder, ids.orderBy(F.desc("id")), lambda: V.interactions(s, d).limit(0))


@query("SELECT gx, gy, feature, count(*) AS n FROM binned GROUP BY ALL")
def stream_bin_counts(s, d):
    at = scratch(s, "stream")
    V.molecules(s, d).write.parquet(f"{at}/in")
    stream = s.readStream.schema(s.read.parquet(f"{at}/in").schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/in")
    counts.run_once(counts.bin_counts(stream, (10, 10, 500, 500), 50), f"{at}/out", f"{at}/state")
    return counts.final_state(s.read.parquet(f"{at}/out"))


@query("SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS start, event_type AS series, count(*) AS n, " + r6(mean="avg(value)", max="max(value)") + " FROM events GROUP BY ALL")
def stream_sample_windows(s, d):
    at = scratch(s, "stream")
    V.table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("series"), F.col("value").alias("v")).coalesce(1).write.parquet(f"{at}/in")
    stream = s.readStream.schema(s.read.parquet(f"{at}/in").schema).parquet(f"{at}/in")
    counts.run_once(counts.sample_windows(stream), f"{at}/out", f"{at}/state")
    return counts.final_state(s.read.parquet(f"{at}/out")).withColumn("start", F.unix_timestamp("start"))


# ---- cells and images --------------------------------------------------------------------------------------------------

_CENTRES = "SELECT (c_custkey % 9)::VARCHAR || '_' || (c_custkey // 9)::VARCHAR AS cell, CAST(c_custkey * 37 % 503 AS DOUBLE) AS x, CAST(c_custkey * 91 % 509 AS DOUBLE) / 2 AS y FROM customer"


def _centre_file(s, d) -> str:
    path = scratch(s, "centroids")
    k = F.col("c_custkey")
    V.table(s, d, "customer").select(
        (k % 9).alias("cell_id"), F.floor(k / 9).alias("fov"), (k * 37 % 503).cast("double").alias("x_centroid"), ((k * 91 % 509) / 2).alias("y_centroid"), F.lit("other").alias("cell")
    ).write.parquet(path)
    return path


@query(_CENTRES)
def file_centroids(s, d):
    return readers.centroids(s, _centre_file(s, d))


@query(f"WITH ce AS ({_CENTRES}), co AS (SELECT (cell % 9)::VARCHAR || '_' || (cell // 9)::VARCHAR AS cell, feature, n FROM cellcnt) SELECT cell, " + r6(x="x", y="y") + ", CAST(sum(n) AS BIGINT) AS n, count(*) AS features FROM co JOIN ce USING (cell) WHERE feature NOT LIKE 'Brand#1%' GROUP BY cell, x, y")
def file_single_cells(s, d):
    """Cells of a centroid file with their totals; the counts name cells by number within a field, and some features go by name."""
    at = readers.centroids(s, _centre_file(s, d))
    c = F.col("cell")
    counts = V.cells(s, d).withColumn("cell", F.concat_ws("_", (c % 9).cast("string"), F.floor(c / 9).cast("string")))
    kept = readers.cell_counts(counts, at, exclude="^Brand#1")
    return kept.groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("features")).join(at, "cell").select("cell", "x", "y", "n", "features")


@query(
    "SELECT (c_custkey % 9)::VARCHAR || '_' || (c_custkey // 9)::VARCHAR AS cell, " + r6(x=f"avg(c_custkey * 37 % 503 + dx) * {readers.FIELD_PIXEL}", y=f"avg(c_custkey * 91 % 509 + dy) * {readers.FIELD_PIXEL}")
    + " FROM customer, (VALUES (-3, -2), (4, -1), (1, 5), (0, 7)) t(dx, dy) GROUP BY c_custkey"
)
def field_cell_centres(s, d):
    k = F.col("c_custkey")
    corner = lambda dx, dy: F.struct((k * 37 % 503 + dx).cast("double").alias("x_px"), (k * 91 % 509 + dy).cast("double").alias("y_px"))
    corners = V.table(s, d, "customer").select((k % 9).alias("cell_id"), F.floor(k / 9).alias("fov"), F.inline(F.array(corner(-3, -2), corner(4, -1), corner(1, 5), corner(0, 7))))
    return readers.field_centroids(corners)


@query("WITH px AS (SELECT x, y, feature, x / 1.25 - 40 AS px, 300 - (y / 1.25 - 25) AS py FROM kept) SELECT feature, count(*) AS n, " + r6(px="avg(px)", py="avg(py)") + " FROM px WHERE px BETWEEN 0 AND 260 AND py BETWEEN 0 AND 300 GROUP BY feature")
def image_pixels(s, d):
    """Points on a crop of a histology image whose rows are counted from below."""
    on = readers.image_window(V.kept(s, d), 260, 300, 1.25, 40, 25, from_top=False)
    return on.groupBy("feature").agg(F.count("*").alias("n"), F.avg("px").alias("px"), F.avg("py").alias("py"))
