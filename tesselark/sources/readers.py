"""Readers: each gives the long tables that the operators take. Nothing is read before a result is asked for,
but for headers and, where a docstring says so, files of bounded size."""

from __future__ import annotations

from dataclasses import dataclass

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Micrometres a pixel of the fields' camera; diameter of a spot in micrometres.
FIELD_PIXEL, SPOT = 0.120280945, 55.0
# Names under which tables carry the same column.
POSITION_NAMES = {
    "barcode": ["barcode"], "in_tissue": ["in_tissue"], "array_row": ["array_row", "row"], "array_col": ["array_col", "col"],
    "pxl_row": ["pxl_row_in_fullres", "pxl_row", "imagerow"], "pxl_col": ["pxl_col_in_fullres", "pxl_col", "imagecol"],
}
EDGE_NAMES = {"a": ["gene_a", "Gene_a", "from", "source", "gene1"], "b": ["gene_b", "Gene_b", "to", "target", "gene2"], "weight": ["weight", "score", "correlation", "value"], "fdr": ["fdr", "FDR", "q_value", "padj"]}
SAMPLE_NAMES = {
    "t": ["epoch", "t_sec", "time", "timestamp"], "cpu_usec": ["cpu_usage_usec", "cpu_usec"], "mem_bytes": ["mem_current_bytes", "mem_bytes", "memory_bytes"],
}


def renamed(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns under their first known name, letter case aside; those without one become null strings."""
    have = {c.lower(): c for c in reversed(df.columns)}
    pick = {new: next((have[o.lower()] for o in [new, *old] if o.lower() in have), None) for new, old in names.items()}
    return df.select(*[(F.col(f"`{old}`") if old else F.lit(None).cast("string")).alias(new) for new, old in pick.items()])


def number(c: str | Column) -> Column:
    """A finite double, else null."""
    v = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def molecules(spark: SparkSession, path: str) -> DataFrame:
    """Points (x, y, feature, qv, nucleus_distance) of a Parquet table; filters on them reach the scan."""
    t = spark.read.parquet(path)
    far = F.col("nucleus_distance") if "nucleus_distance" in t.columns else F.lit(0.0)
    return t.select(F.col("x_location").alias("x"), F.col("y_location").alias("y"), F.col("feature_name").cast("string").alias("feature"), "qv", far.alias("nucleus_distance"))


def _key(df: DataFrame) -> Column:
    return F.concat_ws("_", F.col("cell_id").cast("string"), F.col("fov").cast("string")) if "fov" in df.columns else F.col("cell_id").cast("string")


def centroids(spark: SparkSession, path: str) -> DataFrame:
    """Cells (cell, x, y); the key holds the field where there is one."""
    t = spark.read.parquet(path)
    return t.select(_key(t).alias("cell"), F.col("x_centroid").alias("x"), F.col("y_centroid").alias("y"))


def segmentation(spark: SparkSession, path: str) -> DataFrame:
    """Corners (cell, label, vertex, x, y) in the table's order of each label; rows without numbers go."""
    t = spark.read.parquet(path).withColumn("_o", F.monotonically_increasing_id())
    label = F.col("label_id") if "label_id" in t.columns else _key(t)
    rows = t.select(_key(t).alias("cell"), label.cast("string").alias("label"), "_o", number("vertex_x").alias("x"), number("vertex_y").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return rows.select("cell", "label", F.row_number().over(Window.partitionBy("label").orderBy("_o")).alias("vertex"), "x", "y")


def polygons(corners: DataFrame, fewest: int = 3) -> DataFrame:
    """Closed rings (label, ring of (x, y)), from at least so many corners; a label's corners are few, so they fit one row."""
    ring = corners.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("vertex", "x", "y"))).alias("v")).where(F.size("v") >= fewest)
    xy = F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    closed = F.when(F.element_at("r", 1) == F.element_at("r", -1), F.col("r")).otherwise(F.concat("r", F.slice("r", 1, 1)))
    return ring.select("label", xy.alias("r")).select("label", closed.alias("ring"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (i from 0, line) of one file, read in blocks by all tasks: a line's number is that in its block, and the lines of the blocks before."""
    lines = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", r"\r$", "").alias("line"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("block").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    # Blocks are few: one for each split of a file.
    before = F.coalesce(F.sum("k").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("block", (before - F.col("first")).alias("shift"))
    return lines.join(F.broadcast(starts), "block").select((F.col("at") + F.col("shift")).alias("i"), "line")


def outline(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    """A region's closed outline from a small CSV or TSV of X and Y: lines with # and without numbers go, as do repeats in a row.

    Fewer than three corners are an error.
    """
    parts = F.split(F.trim("line"), r"[,\t;]|\s+")
    rows = numbered_lines(spark, path).where(~F.col("line").startswith("#")).select("i", parts.alias("p")).where("size(p) >= 2")
    xy = rows.select("i", number(F.regexp_replace(F.col("p")[0], '"', "")).alias("x"), number(F.regexp_replace(F.col("p")[1], '"', "")).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    found = [(r.x, r.y) for r in xy.orderBy("i").collect()]
    ring = [p for k, p in enumerate(found) if not k or p != found[k - 1]]
    if len(set(ring)) < 3:
        raise ValueError(f"{path}: an outline needs three corners")
    return ring if ring[0] == ring[-1] else [*ring, ring[0]]


def long_counts(wide: DataFrame, ids: list[str], exclude: str = r"(?i)^(fov|cell_?id|cell|x|y|.*_px|.*_um|area.*|unassigned)$") -> DataFrame:
    """A table with one column for each feature as (ids, feature, n): null and zero go, as do columns that name no feature."""
    features = [c for c in wide.columns if c not in ids and not re.match(exclude, c)]
    cast = wide.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    return cast.unpivot(ids, [F.col(f"`{c}`") for c in features], "feature", "n").where("n <> 0 AND NOT isnan(n)")


def expression(spark: SparkSession, path: str) -> DataFrame:
    """Counts (fov, cell_ID, feature, n) of a wide CSV, compressed or not."""
    wide = spark.read.csv(path, header=True)
    ids = [c for c in wide.columns if c.lower() in ("fov", "cell_id")]
    return long_counts(wide, ids).toDF(*[c.lower() for c in ids], "feature", "n")


def resolve_cells(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Counts keyed as the cells are: of four ways to write a key the one that meets most cells; ties go to the first."""
    ways = {
        "cell_fov": F.concat_ws("_", "cell_id", "fov"), "fov_cell": F.concat_ws("_", "fov", "cell_id"),
        "cell": F.col("cell_id").cast("string"), "c_fov_cell": F.concat(F.lit("c_"), F.concat_ws("_", "fov", "cell_id")),
    }
    tried = counts.select("fov", "cell_id").distinct().select(F.explode(F.array(*[F.struct(F.lit(k).alias("i"), w.alias("cell")) for k, w in enumerate(ways.values())])).alias("t")).select("t.*").distinct()
    met = tried.join(cells.select("cell").distinct(), "cell").groupBy("i").count()
    best = met.orderBy(F.desc("count"), "i").first()
    if best is None:
        raise ValueError("no way to write the counts' cells meets a cell")
    return counts.select(list(ways.values())[best.i].alias("cell"), "feature", "n")


def field_molecules(spark: SparkSession, path: str, pixel: float = FIELD_PIXEL) -> DataFrame:
    """Points in micrometres from a fields' CSV: by name, or where the header has no names, by place."""
    t = spark.read.csv(path, header=True)
    names = {c.lower(): c for c in t.columns}
    named = {"x_global_px", "y_global_px", "target"} <= set(names)
    if not named:
        t = spark.read.csv(path, header=False)
    at = lambda name, place: F.col(f"`{names[name]}`") if named and name in names else F.col(f"_c{place - 1}") if not named and len(t.columns) >= place else None
    qv, far = at("qv", 10), at("nucleus_distance", 8)
    return t.select(
        (number(at("x_global_px", 6)) * pixel).alias("x"), (number(at("y_global_px", 7)) * pixel).alias("y"), at("target", 9).alias("feature"),
        (F.coalesce(qv.try_cast("double"), F.lit(float("inf"))) if qv is not None else F.lit(float("inf"))).alias("qv"),
        (F.coalesce(far.try_cast("double"), F.lit(0.0)) if far is not None else F.lit(0.0)).alias("nucleus_distance"),
    ).where("x IS NOT NULL AND y IS NOT NULL AND feature IS NOT NULL")


def field_centroids(corners: DataFrame, pixel: float = FIELD_PIXEL) -> DataFrame:
    """Cells (cell, x, y) in micrometres: means of the corners (cell_id, fov, x_px, y_px)."""
    return corners.groupBy(F.concat_ws("_", F.col("cell_id").cast("string"), F.col("fov").cast("string")).alias("cell")).agg((F.avg("x_px") * pixel).alias("x"), (F.avg("y_px") * pixel).alias("y"))


def spot_scale(spark: SparkSession, path: str, spot: float = SPOT) -> float:
    """Micrometres a pixel of the full image, from the small JSON of scale factors."""
    r = spark.read.json(path, multiLine=True)
    value = lambda c: number(F.col(c)) if c in r.columns else F.lit(None).cast("double")
    found = r.select(F.coalesce(value("microns_per_pixel"), F.lit(spot) / value("spot_diameter_fullres")).alias("um")).first()
    if found is None or not found.um or found.um <= 0:
        raise ValueError(f"{path}: no scale")
    return found.um


def spots(spark: SparkSession, path: str, um: float = 1.0, in_tissue: bool = True) -> DataFrame:
    """Spots (barcode, array_row, array_col, x, y) in micrometres; the table may lack its header."""
    t = spark.read.csv(path, header=True)
    if "barcode" not in [c.lower() for c in t.columns]:
        t = spark.read.csv(path, header=False).toDF("barcode", "in_tissue", "array_row", "array_col", "pxl_row_in_fullres", "pxl_col_in_fullres")
    t = renamed(t, POSITION_NAMES)
    rows = t.where(F.col("in_tissue").cast("int") == 1) if in_tissue else t
    return rows.select("barcode", F.col("array_row").cast("int"), F.col("array_col").cast("int"), (F.col("pxl_col").cast("double") * um).alias("x"), (F.col("pxl_row").cast("double") * um).alias("y"))


def matrix_market(spark: SparkSession, folder: str, spots: DataFrame | None = None) -> DataFrame:
    """Counts (barcode, feature, n) of matrix.mtx with its features.tsv and barcodes.tsv (.gz or not).

    Only barcodes of ``spots`` are kept if these are given; features without a count are in no row.
    """
    from .files import matching

    def part(*names: str) -> str:
        found = [p for n in names for p in matching(spark, f"{folder}/{n}*")]
        if not found:
            raise FileNotFoundError(f"{folder}: {names[0]}")
        return found[0]

    named = lambda path, k: numbered_lines(spark, path).select((F.col("i") + 1).cast("long").alias(k), F.split("line", "\t").alias("f"))
    features = named(part("features.tsv", "genes.tsv"), "row").select("row", F.coalesce(F.get("f", F.lit(1)), F.col("f")[0]).alias("feature"))
    barcodes = named(part("barcodes.tsv"), "col").select("col", F.col("f")[0].alias("barcode"))
    if spots is not None:
        barcodes = barcodes.join(spots.select("barcode").distinct(), "barcode", "left_semi")
    # The line of sizes follows the comments and comes before all counts: the only one that names more than the last row or column.
    size = spark.read.text(part("matrix.mtx")).where(~F.col("value").startswith("%")).limit(1)
    head = [int(v) for v in size.first().value.split()]
    body = spark.read.text(part("matrix.mtx")).where(~F.col("value").startswith("%")).select(F.split(F.trim("value"), r"\s+").alias("v"))
    cells = body.select(F.col("v")[0].cast("long").alias("row"), F.col("v")[1].cast("long").alias("col"), F.col("v")[2].cast("double").alias("n"))
    first = (F.col("row") == head[0]) & (F.col("col") == head[1]) & (F.col("n") == head[2])
    corner = cells.where(first).count()
    kept = cells.where(~first)
    if corner > 1:  # the last corner's count may equal the number of counts
        kept = kept.union(spark.createDataFrame([(head[0], head[1], float(head[2]))], kept.schema))
    return kept.where("n <> 0").join(features, "row").join(barcodes, "col").groupBy("barcode", "feature").agg(F.sum("n").alias("n"))


@dataclass
class SpotSample:
    """A sample of spots as tables: spots (barcode, gx, gy, x, y), counts (gx, gy, feature, n), weights of adjacent spots, and micrometres a pixel."""

    um: float
    spots: DataFrame
    counts: DataFrame
    weights: DataFrame


def spot_sample(spark: SparkSession, matrix: str, positions: str, scalefactors: str, in_tissue: bool = True) -> SpotSample:
    """The sample of a folder of counts, a table of positions and a file of scale factors.

    Columns of the array advance by two within a row, odd rows starting at an odd one, so half of the column (rounded down) and the row number hexagons
    whose odd rows are shifted. Spots off the tissue are left out unless asked for; counts of other barcodes are too. The counts are written to the shared folder.
    """
    from tesselark.operators.weights import neighbours
    from tesselark.sources.files import materialised

    um = spot_scale(spark, scalefactors)
    at = spots(spark, positions, um, in_tissue)
    at = at.select("barcode", (F.floor(F.col("array_col") / 2) + 1).cast("int").alias("gx"), (F.col("array_row") + 1).alias("gy"), "x", "y")
    counts = matrix_market(spark, matrix, at).join(at.select("barcode", "gx", "gy"), "barcode").groupBy("gx", "gy", "feature").agg(F.sum("n").alias("n"))
    counts = materialised(counts, "spot_counts")  # the weights and whatever is made of the counts read them again
    return SpotSample(um, at, counts, neighbours(counts, "oddr"))


def spot_folder(spark: SparkSession, folder: str, in_tissue: bool = True) -> SpotSample:
    """The sample of a folder in an instrument's layout."""
    from tesselark.sources.files import platform

    found = platform(spark, folder)
    if found["platform"] != "visium" or not found["positions"] or not found["scalefactors"]:
        raise ValueError(f"{folder}: no spots with positions and scale factors")
    return spot_sample(spark, found["matrix"], found["positions"], found["scalefactors"], in_tissue)


# Names that columns of coordinate tables go by.
COORDINATE_NAMES = {"feature": ["gene", "feature_name", "row", "i"], "barcode": ["cell", "cell_id", "column", "col", "j"], "n": ["count", "value", "data", "x"]}


def coordinates(spark: SparkSession, path: str, cells: DataFrame | None = None) -> DataFrame:
    """Counts (barcode, feature, n) of a matrix as Parquet rows of row, column and value, under any of their known names.

    With known ``cells`` (barcode), the matrix is turned where more of them are among its rows than among its columns, and only theirs are
    kept. Null names or values and zeros are left out; values of one place are added.
    """
    t = renamed(spark.read.parquet(path), COORDINATE_NAMES)
    t = t.select(F.col("barcode").cast("string"), F.col("feature").cast("string"), number("n").alias("n"))
    if cells is not None:
        known = cells.select(F.col("barcode").cast("string")).distinct()
        across, down = (t.select(F.col(c).alias("barcode")).distinct().join(known, "barcode", "left_semi").count() for c in ("barcode", "feature"))
        if down > across:
            t = t.select(F.col("feature").alias("barcode"), F.col("barcode").alias("feature"), "n")
        t = t.join(known, "barcode", "left_semi")
    return t.where("barcode IS NOT NULL AND feature IS NOT NULL AND n <> 0").groupBy("barcode", "feature").agg(F.sum("n").alias("n"))


def cell_counts(counts: DataFrame, cells: DataFrame, keep: list[str] | None = None, exclude: str | None = None) -> DataFrame:
    """Counts of known cells, of listed features, without those whose name fits a pattern."""
    out = counts.join(cells.select("cell").distinct(), "cell", "left_semi")
    if keep:
        out = out.where(F.col("feature").isin(keep))
    return out.where(~F.col("feature").rlike(exclude)) if exclude else out


def _table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def edges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Edges (a, b, weight, fdr) of a TSV with columns under any known name; blank ends, loops and weights that are no finite numbers go.

    Where there is an edge_type, blank ones go too. A missing fdr is null.
    """
    t = _table(spark, path)
    kept = t.where(F.trim("edge_type") != "") if "edge_type" in t.columns else t
    e = renamed(kept, EDGE_NAMES).select(F.trim("a").alias("a"), F.trim("b").alias("b"), number("weight").alias("weight"), number("fdr").alias("fdr"))
    return e.where("a <> '' AND b <> '' AND a <> b AND weight IS NOT NULL")


def module_number(name: str) -> Column:
    """An id that is a whole number, else the digits at its end."""
    c = F.trim(F.col(name))
    return F.when(c.rlike(r"^-?[0-9]+$"), c.try_cast("int")).otherwise(F.nullif(F.regexp_extract(c, r"([0-9]+)$", 1), F.lit("")).try_cast("int"))


def modules(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Members (module, feature), distinct; blank and unassigned (-1) ones go."""
    t = renamed(_table(spark, path), {"module": ["module_id", "cluster"], "feature": ["gene", "Gene"]})
    return t.select(F.trim("module").alias("module"), F.trim("feature").alias("feature")).where("feature <> '' AND module <> '' AND module <> '-1'").distinct()


def background(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All features of a table of modules, unassigned ones too."""
    return renamed(_table(spark, path), {"feature": ["gene", "Gene"]}).select(F.trim("feature").alias("feature")).where("feature <> ''").distinct()


def interactions(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Links (p, q, score) of a flat file between known ids; the filter is two semi-joins, which Spark broadcasts while ids are few."""
    t = spark.read.csv(path, sep=" ", header=True)
    known = ids.select("id").where("id IS NOT NULL").distinct()
    links = t.select(F.col("protein1").alias("p"), F.col("protein2").alias("q"), F.col("combined_score").cast("int").alias("score"))
    return links.join(known.toDF("p"), "p", "left_semi").join(known.toDF("q"), "q", "left_semi").select("p", "q", "score")


def cached(spark: SparkSession, folder: str, ids: DataFrame, make) -> DataFrame:
    """``make()``'s table, kept under the digest of the sorted ids; a second call with equal ids reads it."""
    from .files import matching

    # Ids are names of features, of a bounded vocabulary; each is hashed first, so that one row of digests is collected.
    name = ids.select(F.sha2("id", 256).alias("h")).distinct().agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h")).first().h
    path = f"{folder}/{name}.parquet"
    if not matching(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def samples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Samples (file, t, cpu_usec, mem_bytes) of a monitor's TSV under any known names."""
    t = _table(spark, path)
    return renamed(t.withColumn("file", F.input_file_name()), {"file": []} | SAMPLE_NAMES).select("file", *[number(c).alias(c) for c in ("t", "cpu_usec", "mem_bytes")]).where("t IS NOT NULL")


def log_starts(spark: SparkSession, path: str) -> DataFrame:
    """Starts (repeat, t in seconds) from lines with an ISO time and repeat_idx=N; the first of a repeat counts."""
    line = spark.read.text(path)
    stamp = F.regexp_extract("value", r"(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d)", 1)
    which = F.regexp_extract("value", r"repeat_idx\s*[=:]\s*(\d+)", 1)
    rows = line.select(which.try_cast("int").alias("repeat"), F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(stamp, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))).alias("t"))
    return rows.where("repeat IS NOT NULL AND t IS NOT NULL").groupBy("repeat").agg(F.min("t").alias("t"))


def image_headers(spark: SparkSession, pattern: str) -> DataFrame:
    """PNG files (path, width, height) by their first bytes; others go."""
    files = spark.read.format("binaryFile").load(pattern)
    at = lambda k: F.conv(F.hex(F.substring("content", k, 4)), 16, 10).cast("int")
    return files.where(F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A").select("path", at(17).alias("width"), at(21).alias("height"))


def image_window(points: DataFrame, width: int, height: int, um: float, x0: float = 0, y0: float = 0, from_top: bool = True) -> DataFrame:
    """Points with their pixel (px, py) on an image cropped at (x0, y0); those outside go."""
    px, py = (F.col("x") / um - x0), (F.col("y") / um - y0)
    out = points.withColumns({"px": px, "py": py if from_top else F.lit(height) - py})
    return out.where(F.col("px").between(0, width) & F.col("py").between(0, height))
