"""Points to lattice bins: filters, binning, normalisation, density."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def filter_points(points: DataFrame, features: list[str] | None = None, min_qv: float = 20, max_distance: float = 25, exclude: str | None = None) -> DataFrame:
    """Allowed features, quality, distance and name filters; all but the pattern reach the scan."""
    kept = points.where((F.col("qv") >= min_qv) & (F.col("nucleus_distance") <= max_distance))
    if features is not None:
        kept = kept.where(F.col("feature").isin(features))
    return kept if exclude is None else kept.where(~F.col("feature").rlike(exclude))


def bounds(points: DataFrame) -> DataFrame:
    """One row: xmin, xmax, ymin, ymax."""
    return points.agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))


def flip_y(points: DataFrame, limits: DataFrame) -> DataFrame:
    return points.crossJoin(F.broadcast(limits.select("ymax"))).withColumn("y", F.col("ymax") - F.col("y")).drop("ymax")


def _origin(low: str, size: float) -> Column:
    return F.floor(F.col(low) / size) * F.lit(float(size))


def bin_points(points: DataFrame, limits: DataFrame, size: float) -> DataFrame:
    """Adds gx, gy (from 1) for bins of side ``size``; ``limits`` has one row."""
    placed = points.crossJoin(F.broadcast(limits))
    g = lambda v, low: (F.floor((F.col(v) - _origin(low, size)) / size) + 1).cast("int")
    return placed.withColumn("gx", g("x", "xmin")).withColumn("gy", g("y", "ymin")).drop("xmin", "xmax", "ymin", "ymax")


def count_bins(binned: DataFrame) -> DataFrame:
    return binned.groupBy("gx", "gy", "feature").agg(F.count("*").alias("n"))


def count_sizes(points: DataFrame, limits: DataFrame, sizes: list[float]) -> DataFrame:
    """Counts for several bin sides in one pass over the points."""
    many = points.withColumn("size", F.explode(F.array([F.lit(float(s)) for s in sizes]))).crossJoin(F.broadcast(limits))
    g = lambda v, low: (F.floor((F.col(v) - F.floor(F.col(low) / F.col("size")) * F.col("size")) / F.col("size")) + 1).cast("int")
    return many.withColumn("gx", g("x", "xmin")).withColumn("gy", g("y", "ymin")).groupBy("size", "gx", "gy", "feature").agg(F.count("*").alias("n"))


def lattice(limits: DataFrame, size: float, partial: bool = False) -> DataFrame:
    """All bins between the limits with edges and centres; partial ones at the far side only on request."""

    def cells(low: str, high: str) -> Column:
        return F.greatest(F.ceil((F.col(high) - _origin(low, size)) / size), F.lit(1)).cast("int")

    grid = limits.select("*", F.explode(F.sequence(F.lit(1), cells("xmin", "xmax"))).alias("gx")).select("*", F.explode(F.sequence(F.lit(1), cells("ymin", "ymax"))).alias("gy"))
    edge = lambda g, low, k: _origin(low, size) + (F.col(g) - 1 + k) * F.lit(float(size))
    out = grid.select(
        "gx", "gy", F.concat(F.lit("g"), "gx", F.lit("_"), "gy").alias("grid_id"),
        edge("gx", "xmin", 0).alias("x0"), F.least(edge("gx", "xmin", 1), F.col("xmax")).alias("x1"), edge("gy", "ymin", 0).alias("y0"), F.least(edge("gy", "ymin", 1), F.col("ymax")).alias("y1"),
    )
    out = out.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})
    return out if partial else out.where((F.abs(F.col("x1") - F.col("x0") - size) < 1e-6) & (F.abs(F.col("y1") - F.col("y0") - size) < 1e-6))


def keep_bins(counts: DataFrame, fewest: int = 1, most: int | None = None) -> DataFrame:
    """Bins with a number of distinct features in the range."""
    kinds = counts.groupBy("gx", "gy").agg(F.countDistinct("feature").alias("k"))
    kinds = kinds.where(F.col("k") >= fewest) if most is None else kinds.where(F.col("k").between(fewest, most))
    return counts.join(kinds, ["gx", "gy"], "left_semi")


def keep_segmented(counts: DataFrame, vertices: DataFrame, least: int) -> DataFrame:
    """Bins with at least so many outline vertices (gx, gy, vertices); all bins where none has as many."""
    good = vertices.where(F.col("vertices") >= least).select("gx", "gy").distinct()
    some = good.agg((F.count("*") > 0).alias("_some"))
    marked = counts.join(good.withColumn("_good", F.lit(True)), ["gx", "gy"], "left").crossJoin(F.broadcast(some))
    return marked.where("_good OR NOT _some").drop("_good", "_some")


def bins_used(counts: DataFrame, grid: DataFrame, keep_zero: bool = False) -> DataFrame:
    """The bins that statistics run over: those with counts, or all of the lattice."""
    return (grid if keep_zero else counts).select("gx", "gy").distinct()


def of_features(values: DataFrame, features: list[str] | None = None, modules: DataFrame | None = None, module: int | None = None) -> DataFrame:
    """Rows of the given features; else of a module's members; else all."""
    if features is not None:
        return values.where(F.col("feature").isin(features))
    if module is not None:
        return values.join(modules.where(F.col("module") == module).select("feature").distinct(), "feature", "left_semi")
    return values


def plain_bins(points: DataFrame, size: float) -> DataFrame:
    """Counts and mean positions of bins counted from 0 at the least coordinates, of features whose counts vary over the bins (as comparators want them)."""
    low = points.agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
    at = lambda v, o: F.floor((F.col(v) - F.col(o)) / size).cast("int")
    placed = points.crossJoin(F.broadcast(low)).select(at("x", "_x").alias("gx"), at("y", "_y").alias("gy"), "feature", "x", "y")
    centres = placed.groupBy("gx", "gy").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    counts = placed.groupBy("gx", "gy", "feature").agg(F.count("*").alias("n"))
    bins = centres.agg(F.count("*").alias("bins"))
    # A feature is constant if it has the same count in every bin.
    vary = counts.groupBy("feature").agg(F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi")).crossJoin(F.broadcast(bins)).where("lo < hi OR k < bins")
    return counts.join(vary, "feature", "left_semi").join(centres, ["gx", "gy"])


def on_lattice(counts: DataFrame, grid: DataFrame) -> DataFrame:
    return counts.join(grid.select("gx", "gy"), ["gx", "gy"], "left_semi")


def row_normalise(counts: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("gx", "gy"))
    return counts.withColumn("v", F.col("n") / F.when(total == 0, 1).otherwise(total))


def z_scores(values: DataFrame) -> DataFrame:
    """Per feature over all bins with any count, absent ones as zeros; sample deviation; constant features give 0."""
    bins = values.select("gx", "gy").distinct()
    n = bins.agg(F.count("*").alias("bins"))
    moments = values.groupBy("feature").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).crossJoin(F.broadcast(n))
    mean = F.col("s") / F.col("bins")
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("bins") * mean * mean) / (F.col("bins") - 1)))
    moments = moments.select("feature", mean.alias("mean"), sd.alias("sd"))
    dense = bins.crossJoin(F.broadcast(moments)).join(values.select("gx", "gy", "feature", "v"), ["gx", "gy", "feature"], "left")
    z = F.when(F.col("sd") <= 1e-12, F.lit(0.0)).otherwise((F.coalesce("v", F.lit(0.0)) - F.col("mean")) / F.col("sd"))
    return dense.select("gx", "gy", "feature", z.alias("z"))


def log_cpm(counts: DataFrame, cell: str = "cell", scale: float = 1e4) -> DataFrame:
    lib = F.sum("n").over(Window.partitionBy(cell))
    return counts.withColumn("v", F.log1p(F.col("n") * scale / F.when(lib == 0, 1).otherwise(lib)))


def winsorise(values: DataFrame, by: str, value: str, q: float = 0.95) -> DataFrame:
    """Values above their group's quantile are set to it (linear interpolation)."""
    cap = values.groupBy(by).agg(F.percentile(value, F.lit(q)).alias("cap"))
    return values.join(cap, by).withColumn(value, F.least(value, "cap")).drop("cap")


def winsorise_sparse(values: DataFrame, units: int, value: str = "v", q: float = 0.95) -> DataFrame:
    """Values above their feature's quantile over all ``units`` are set to it; absent ones are zeros, which are counted and never made.

    Values are not negative, so a feature's zeros come first: its quantile lies between the stored values whose ranks follow from their number.
    """
    from pyspark.sql.window import Window

    of = Window.partitionBy("feature")
    ranked = values.where(F.col(value) > 0).withColumn("rank", F.row_number().over(of.orderBy(value))).withColumn("zeros", F.lit(units) - F.count("*").over(of))
    at = q * (units - 1)
    pick = lambda p: F.coalesce(F.max(F.when(F.col("zeros") + F.col("rank") - 1 == int(p), F.col(value))), F.lit(0.0))
    low, high = pick(math.floor(at)), pick(math.ceil(at))
    cap = ranked.groupBy("feature").agg((low + (at - math.floor(at)) * (high - low)).alias("cap"))
    return values.join(cap, "feature", "left").withColumn(value, F.least(value, F.coalesce("cap", F.lit(0.0)))).drop("cap")


def density(counts: DataFrame, grid: DataFrame, features: list[str], normalise: str = "none") -> DataFrame:
    """Chosen features per area of every lattice bin; counts as they are, by bin total or by feature total."""
    over = {"none": None, "bin": Window.partitionBy("gx", "gy"), "feature": Window.partitionBy("feature")}[normalise]
    share = F.col("n").cast("double") if over is None else F.col("n") / F.sum("n").over(over)
    some = counts.select("gx", "gy", "feature", share.alias("v")).where(F.col("feature").isin(features)).groupBy("gx", "gy").agg(F.sum("v").alias("v"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return grid.join(some, ["gx", "gy"], "left").select("gx", "gy", (F.coalesce("v", F.lit(0.0)) / area).alias("density"))


def coverage(counts: DataFrame) -> DataFrame:
    """Percentage of the bins in which a feature is present."""
    bins = counts.select("gx", "gy").distinct().agg(F.count("*").alias("bins"))
    return counts.where("n > 0").groupBy("feature").agg(F.count("*").alias("k")).crossJoin(F.broadcast(bins)).select("feature", (F.col("k") * 100.0 / F.col("bins")).alias("pct"))


def in_polygon(points: DataFrame, vertices: list[tuple[float, float]]) -> DataFrame:
    """Points for which a ray crosses the closed polygon's sides an odd number of times; a polygon is a literal, not a table."""
    x, y = F.col("x"), F.col("y")
    odd = F.lit(False)
    for (x0, y0), (x1, y1) in zip(vertices, [*vertices[1:], vertices[0]]):
        if y0 != y1:
            crosses = ((F.lit(float(y0)) > y) != (F.lit(float(y1)) > y)) & (x < (x1 - x0) * (y - y0) / float(y1 - y0) + x0)
            odd = odd != crosses
    return points.where(odd)


def top_features(counts: DataFrame, n: int, by: str = "mean", seed: int = 1) -> DataFrame:
    """The n features (feature, value) of the largest mean, variance or share of bins present ("presence"), over all bins with any count; or n by a
    hash of seed and name ("random"). Ties by name."""
    bins = counts.select("gx", "gy").distinct().agg(F.count("*").alias("bins"))
    one = counts.groupBy("feature").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.count(F.when(F.col("n") > 0, 1)).alias("k")).crossJoin(F.broadcast(bins))
    mean = F.col("s") / F.col("bins")
    values = {"mean": mean, "variance": F.col("q") / F.col("bins") - mean * mean, "presence": F.col("k") / F.col("bins")}
    value = values[by] if by != "random" else F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "feature")), 1, 8), 16, 10).cast("double")
    return one.select("feature", value.alias("value")).orderBy(F.round("value", 9).desc(), "feature").limit(n)


def clipped(values: DataFrame, value: str, share: float = 1.0) -> DataFrame:
    """A column held below ``share`` of its greatest value, which comes as ``cut``: the colours of a plot of densities; nulls are 0."""
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    cut = values.agg((F.max(v) * share).alias("cut"))
    return values.crossJoin(F.broadcast(cut)).withColumn(value, F.least(v, F.col("cut")))  # one row


def expression_points(counts: DataFrame, centroids: DataFrame, features: dict[str, float]) -> DataFrame:
    """Points (feature, cell, x, y, e) of cells that express one of some features, each held below its share of the greatest count.

    Counts (cell, feature, n), repeated ones summed; cells without a centroid (cell, x, y) have no point.
    """
    share = F.create_map(*[F.lit(v) for pair in features.items() for v in pair])
    n = counts.where(F.col("feature").isin(list(features))).groupBy("cell", "feature").agg(F.sum("n").cast("double").alias("e"))
    cut = n.groupBy("feature").agg(F.max("e").alias("most"))
    e = n.join(F.broadcast(cut), "feature").withColumn("e", F.least("e", F.col("most") * share[F.col("feature")])).where("e > 0")  # a row a feature named
    return e.join(centroids.select("cell", "x", "y"), "cell").select("feature", "cell", "x", "y", "e")
