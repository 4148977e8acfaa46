"""Statistics of feature pairs: spatial association, correlation, dispersion and overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselark.operators.weights import tiles


def spatial_lag(z: DataFrame, w: DataFrame) -> DataFrame:
    """W z: (gx, gy, feature, wz)."""
    there = z.select(F.col("gx").alias("hx"), F.col("gy").alias("hy"), "feature", "z")
    return w.join(there, ["hx", "hy"]).groupBy("gx", "gy", "feature").agg(F.sum(F.col("w") * F.col("z")).alias("wz"))


def _scale(z: DataFrame, w: DataFrame, formula: str) -> DataFrame:
    """One row: n over S0 = sum of weights, or over S2 = sum of squared row sums; and the number of bins."""
    n = z.select("gx", "gy").distinct().agg(F.count("*").alias("n"))
    if formula == "s0":
        s = w.agg(F.sum("w").alias("s"))
    else:
        s = w.groupBy("gx", "gy").agg(F.sum("w").alias("r")).agg(F.sum(F.col("r") * F.col("r")).alias("s"))
    return n.crossJoin(s).select("n", "s", F.coalesce(F.col("n") / F.nullif("s", F.lit(0.0)), F.lit(0.0)).alias("k"))


def association(z: DataFrame, w: DataFrame, formula: str = "s0", engine: str = "gram") -> DataFrame:
    """L of all ordered feature pairs (a, b): k z_a' W z_b / (|z_a| |z_b|); with s2 both sides are lagged. Zero norms give 0.

    engine "sql" joins the long tables (n bins times pairs of features); "gram" sums outer products within a task.
    """
    norms = z.groupBy("feature").agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("norm"))
    lag = spatial_lag(z, w)
    left = z.select("gx", "gy", "feature", F.col("z").alias("u")) if formula == "s0" else lag.withColumnRenamed("wz", "u")
    if engine == "sql":
        right = lag.select("gx", "gy", F.col("feature").alias("b"), "wz")
        sums = left.withColumnRenamed("feature", "a").join(right, ["gx", "gy"]).groupBy("a", "b").agg(F.sum(F.col("u") * F.col("wz")).alias("num"))
    else:
        sums = gram(left, lag.withColumnRenamed("wz", "v"), ["gx", "gy"])
    pairs = norms.select(F.col("feature").alias("a"), F.col("norm").alias("na")).crossJoin(norms.select(F.col("feature").alias("b"), F.col("norm").alias("nb")))
    full = pairs.join(sums, ["a", "b"], "left").crossJoin(F.broadcast(_scale(z, w, formula)))
    den = F.nullif(F.col("na") * F.col("nb"), F.lit(0.0))
    return full.select("a", "b", F.coalesce(F.col("k") * F.coalesce("num", F.lit(0.0)) / den, F.lit(0.0)).alias("l"))


#: Features of a block: each task sums products in squares of this side. The driver names at most MOST_FEATURES features.
BLOCK, MOST_FEATURES = 2048, 50_000


def _summed(batches: Iterator[pa.RecordBatch], side: int, block: int) -> Iterator[pa.RecordBatch]:
    """Over rows (i, k, id, u, other, v) in order of the blocks i and k: the non-zero sums of u v for each of the blocks' pairs."""
    now, total = None, np.zeros((side, side))

    def made() -> Iterator[pa.RecordBatch]:
        for begin in range(0, side, 256):
            a, b = np.nonzero(total[begin : begin + 256])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array((a + begin + now[0] * block).astype(np.int32)), pa.array((b + now[1] * block).astype(np.int32)), pa.array(total[begin : begin + 256][a, b])], names=["i", "k", "num"])

    for batch in batches:
        blocks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)], axis=1)
        turns = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]).any(axis=1)]) if len(blocks) else []
        for start, stop in zip(turns, [*turns[1:], len(blocks)]):
            if now != tuple(blocks[start]):
                if now is not None:
                    yield from made()
                    total[:] = 0
                now = tuple(blocks[start])
            for begin in range(start, stop, 1024):
                part = batch.slice(begin, min(1024, stop - begin))
                x, y = np.zeros((part.num_rows, side)), np.zeros((part.num_rows, side))
                for dense, ids, values in ((x, part.column(2), part.column(3)), (y, part.column(4), part.column(5))):
                    at = np.repeat(np.arange(part.num_rows), ids.value_lengths().to_numpy())
                    np.add.at(dense, (at, ids.flatten().to_numpy()), values.flatten().to_numpy())
                total += x.T @ y
    if now is not None:
        yield from made()


def gram(left: DataFrame, right: DataFrame, unit: list[str]) -> DataFrame:
    """Sums of u v over the units for all pairs (a, b, num) of left's features (unit, feature, u) and right's (unit, feature, v).

    Absent values are zeros and need not be made. A unit's values meet in one row for each two blocks of features; each task sums outer products of its
    rows block by block, so only tasks times pairs of features are shuffled. With one block, rows stay where their units are.
    """
    names = left.select("feature").union(right.select("feature")).distinct().orderBy("feature").limit(MOST_FEATURES + 1).toPandas()["feature"].to_list()
    if len(names) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features; their names don't fit the driver")
    ids = F.broadcast(left.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "feature string, id int"))
    n, number = len(names), -(-len(names) // BLOCK)
    keys = [f"_unit{k}" for k in range(len(unit))]
    at = lambda df, value, *to: df.select(*[F.col(c).alias(k) for c, k in zip(unit, keys)], "feature", F.col(value).cast("double").alias("x")).where("x <> 0").join(ids, "feature").groupBy(*keys, F.floor(F.col("id") / BLOCK).cast("int").alias(to[0])).agg(F.collect_list(F.col("id") % BLOCK).alias(to[1]), F.collect_list("x").alias(value))
    rows = at(left, "u", "i", "id").join(at(right, "v", "k", "other"), keys)
    if number > 1:
        # Each two blocks go to some of the tasks, by their units.
        tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salt = F.pmod(F.xxhash64(*keys), F.lit(-(-tasks // number**2)))
        rows = rows.repartition(tasks, "i", "k", salt).sortWithinPartitions("i", "k")
    side, block = min(n, BLOCK), BLOCK
    sums = rows.select("i", "k", "id", "u", "other", "v").mapInArrow(lambda batches: _summed(batches, side, block), "i int, k int, num double").groupBy("i", "k").agg(F.sum("num").alias("num"))
    return sums.join(ids.toDF("a", "i"), "i").join(ids.toDF("b", "k"), "k").select("a", "b", "num")


def association_of(values: DataFrame, w: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """L of all ordered feature pairs as ``association`` gives it for the z-scores of ``values`` (gx, gy, feature, v; absent ones zero).

    With ``only`` (feature), a is one of these; products of the others are not made.

    Z-scores are never made: with means m and deviations s, z_a' W z_b is v_a' W v_b less the means' terms, over s_a s_b, so only
    bins where a feature or a neighbour's is present count.
    """
    v = values.select("gx", "gy", "feature", F.col("v").cast("double").alias("v"))
    out = w.groupBy("gx", "gy").agg(F.sum("w").alias("r"))
    into = w.groupBy(F.col("hx").alias("gx"), F.col("hy").alias("gy")).agg(F.sum("w").alias("c"))
    facts = v.select("gx", "gy").distinct().agg(F.count("*").alias("n")).crossJoin(w.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("s0")))
    one = v.join(out, ["gx", "gy"], "left").join(into, ["gx", "gy"], "left").groupBy("feature").agg(
        F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.coalesce(F.sum(F.col("v") * F.col("r")), F.lit(0.0)).alias("r"), F.coalesce(F.sum(F.col("v") * F.col("c")), F.lit(0.0)).alias("c"))
    one = one.crossJoin(F.broadcast(facts)).withColumn("m", F.col("s") / F.col("n"))
    one = one.withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("n") * F.col("m") * F.col("m")) / (F.col("n") - 1))))
    lag = w.join(v.select(F.col("gx").alias("hx"), F.col("gy").alias("hy"), "feature", "v"), ["hx", "hy"]).groupBy("gx", "gy", "feature").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    chosen = v if only is None else v.join(F.broadcast(only.select("feature").distinct()), "feature", "left_semi")
    cross = gram(chosen.select("gx", "gy", "feature", F.col("v").alias("u")), lag, ["gx", "gy"])
    a, b = (one.select("feature", "m", "sd", k, *(["n", "s0"] if x == "a" else [])).toDF(x, f"m{x}", f"sd{x}", k, *(["n", "s0"] if x == "a" else [])) for x, k in (("a", "r"), ("b", "c")))
    if only is not None:
        a = a.join(F.broadcast(only.select(F.col("feature").alias("a")).distinct()), "a", "left_semi")
    full = a.crossJoin(F.broadcast(b)).join(cross, ["a", "b"], "left")
    num = F.coalesce("num", F.lit(0.0)) - F.col("ma") * F.col("c") - F.col("mb") * F.col("r") + F.col("ma") * F.col("mb") * F.col("s0")
    value = F.col("n") / F.col("s0") * num / (F.col("sda") * F.col("sdb")) / (F.col("n") - 1)
    return full.select("a", "b", F.when((F.least("sda", "sdb") <= 1e-12) | (F.col("s0") == 0), F.lit(0.0)).otherwise(value).alias("l"))


def analytic_z(pairs: DataFrame, z: DataFrame, w: DataFrame) -> DataFrame:
    """Z of L under randomisation: mean -1 / (n - 1), variance n^2 (n - 2) / ((n - 1)^2 (n - 3) S0)."""
    full = pairs.crossJoin(F.broadcast(_scale(z, w, "s0")))
    n = F.col("n").cast("double")
    var = n * n * (n - 2) / ((n - 1) * (n - 1) * (n - 3) * F.col("s"))
    return full.select("a", "b", "l", ((F.col("l") + 1 / (n - 1)) / F.sqrt(var)).alias("zscore"))


def _numbered(bins: DataFrame) -> DataFrame:
    """Adds rank, from 1 by gy, then gx: rows of the lattice are counted and their sums run, so that no window holds more than a row."""
    before = bins.groupBy("gy").agg(F.count("*").alias("k")).select("gy", (F.sum("k").over(Window.orderBy("gy")) - F.col("k")).alias("before"))
    return bins.join(F.broadcast(before), "gy").select("gx", "gy", (F.col("before") + F.row_number().over(Window.partitionBy("gy").orderBy("gx"))).alias("rank"))


def permuted(z: DataFrame, draws: int, seed: int, side: int | None = None) -> DataFrame:
    """(draw, gx, gy, feature, z): all features moved together by a permutation of the bins from a hash of draw and bin.

    With ``side``, tiles of side x side bins are dealt anew, each with its bins in their order, and laid on the bins in order; only a draw's
    tiles are ordered, not its bins. Null hashes can't occur; no bins give no rows.
    """
    draw = z.sparkSession.range(1, draws + 1).withColumnRenamed("id", "draw")
    bins = _numbered(z.select("gx", "gy").distinct())
    if side is None:
        h = F.md5(F.concat_ws("|", F.lit(seed), "draw", "gx", "gy"))
        target = bins.crossJoin(draw).select("draw", F.col("gx").alias("tx"), F.col("gy").alias("ty"), F.row_number().over(Window.partitionBy("draw").orderBy(h, "gy", "gx")).alias("rank"))
        moved = target.join(bins, "rank").select("draw", "tx", "ty", "gx", "gy")
    else:
        tiled = bins.join(tiles(bins, side), ["gx", "gy"]).withColumn("k", F.row_number().over(Window.partitionBy("tile").orderBy("rank")))
        h = F.md5(F.concat_ws("|", F.lit(seed), "draw", "tile"))
        dealt = tiled.groupBy("tile").agg(F.count("*").alias("n")).crossJoin(draw)
        dealt = dealt.select("draw", "tile", (F.sum("n").over(Window.partitionBy("draw").orderBy(h, "tile").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
        source = tiled.join(dealt, "tile").select("draw", "gx", "gy", (F.col("before") + F.col("k")).alias("rank"))
        moved = source.join(bins.toDF("tx", "ty", "rank"), "rank").select("draw", "tx", "ty", "gx", "gy")
    return moved.join(z, ["gx", "gy"]).select("draw", F.col("tx").alias("gx"), F.col("ty").alias("gy"), "feature", "z")


def permutation_counts(z: DataFrame, w: DataFrame, pairs: DataFrame, draws: int, seed: int = 1, side: int | None = None) -> DataFrame:
    """For pairs (a, b, l): how many draws have |L*| >= |L| (compared at 9 digits); with ``side``, draws move whole tiles.

    With a column r, the correlation, which moving all features together leaves as it is: how many have |L* - r| >= |L - r|.
    """
    chosen = pairs.select("a", "b", "l", F.col("r") if "r" in pairs.columns else F.lit(0.0).alias("r"))
    moved = permuted(z, draws, seed, side)
    there = moved.select("draw", F.col("gx").alias("hx"), F.col("gy").alias("hy"), "feature", "z")
    lag = w.join(there, ["hx", "hy"]).groupBy("draw", "gx", "gy", "feature").agg(F.sum(F.col("w") * F.col("z")).alias("wz"))
    left = moved.join(chosen, F.col("feature") == F.col("a")).select("draw", "gx", "gy", "a", "b", "l", "r", "z")
    num = left.join(lag.withColumnRenamed("feature", "b"), ["draw", "gx", "gy", "b"]).groupBy("a", "b", "l", "r", "draw").agg(F.sum(F.col("z") * F.col("wz")).alias("num"))
    norms = z.groupBy("feature").agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("norm"))
    num = num.join(norms.select(F.col("feature").alias("a"), F.col("norm").alias("na")), "a").join(norms.select(F.col("feature").alias("b"), F.col("norm").alias("nb")), "b")
    num = num.crossJoin(F.broadcast(_scale(z, w, "s0")))
    star = F.coalesce(F.col("k") * F.col("num") / F.nullif(F.col("na") * F.col("nb"), F.lit(0.0)), F.lit(0.0))
    return num.groupBy("a", "b").agg(F.sum((F.round(F.abs(star - F.col("r")), 9) >= F.round(F.abs(F.col("l") - F.col("r")), 9)).cast("long")).alias("exceed"))


def gradients(z: DataFrame) -> DataFrame:
    """Slopes of z on the bins' gx and gy by least squares with an intercept."""
    c = lambda a, b: F.covar_pop(a, b)
    s = z.groupBy("feature").agg(c("gx", "gx").alias("xx"), c("gy", "gy").alias("yy"), c("gx", "gy").alias("xy"), c("gx", "z").alias("xz"), c("gy", "z").alias("yz"))
    det = F.nullif(F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"), F.lit(0.0))
    return s.select("feature", ((F.col("yy") * F.col("xz") - F.col("xy") * F.col("yz")) / det).alias("slope_x"), ((F.col("xx") * F.col("yz") - F.col("xy") * F.col("xz")) / det).alias("slope_y"))


def pearson(values: DataFrame, unit: list[str], feature: str = "feature", value: str = "v") -> DataFrame:
    """Correlations of features a < b over all units with implicit zeros; products of features that are present together are summed within tasks."""
    n = values.select(*unit).distinct().agg(F.count("*").cast("double").alias("n"))
    v = values.select(*unit, F.col(feature).alias("f"), F.col(value).cast("double").alias("v"))
    one = v.groupBy("f").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    cross = gram(v.select(*unit, F.col("f").alias("feature"), F.col("v").alias("u")), v.select(*unit, F.col("f").alias("feature"), "v"), unit).where("a < b").withColumnRenamed("num", "ab")
    a, b = (one.select(F.col("f").alias(x), F.col("s").alias(f"s{x}"), F.col("q").alias(f"q{x}")) for x in "ab")
    full = a.join(b, F.col("a") < F.col("b")).join(cross, ["a", "b"], "left").crossJoin(F.broadcast(n))
    cov = F.col("n") * F.coalesce("ab", F.lit(0.0)) - F.col("sa") * F.col("sb")
    var = (F.col("n") * F.col("qa") - F.col("sa") * F.col("sa")) * (F.col("n") * F.col("qb") - F.col("sb") * F.col("sb"))
    return full.select("a", "b", F.when(var <= 1e-12, F.lit(0.0)).otherwise(cov / F.sqrt(var)).alias("r"), F.col("n").cast("long").alias("n"))


def spearman(values: DataFrame, unit: list[str], units: DataFrame) -> DataFrame:
    """Rank correlations (average ranks) of features over given units, absent values as zeros: an extension."""
    dense = units.crossJoin(values.select("feature").distinct()).join(values, [*unit, "feature"], "left").select(*unit, "feature", F.coalesce("v", F.lit(0.0)).alias("v"))
    w = Window.partitionBy("feature").orderBy("v")
    ranked = dense.withColumn("v", F.rank().over(w) + (F.count("*").over(Window.partitionBy("feature", "v")) - 1) / 2)
    return pearson(ranked, unit)


def dispersion(counts: DataFrame, bins: int | Column | DataFrame) -> DataFrame:
    """I-delta: q sum n (n - 1) / (N (N - 1)) over q bins, empty ones included; null for N < 2."""
    sums = counts.groupBy("feature").agg(F.sum("n").alias("total"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))
    q = F.lit(bins) if isinstance(bins, int) else F.col("q")
    if isinstance(bins, DataFrame):
        sums = sums.crossJoin(F.broadcast(bins))
    return sums.select("feature", F.when(F.col("total") >= 2, q * F.col("pairs") / (F.col("total") * (F.col("total") - 1))).alias("idelta"))


def morisita_horn(counts: DataFrame, edges: DataFrame, chao: bool = False) -> DataFrame:
    """Overlap 2 sum ab / ((la + lb) Na Nb) for edges (a, b), with l = sum n^2 / N^2; 0 where that has no sense.

    With ``chao``, l is lowered by the share U = 2 f2 / (N (N - 1)) of doubletons: (sum n^2 - N (N - 1) (1 - U)) / N^2, at least 0; where
    that leaves both features nothing, the plain l stay.
    """
    n = F.col("n")
    one = counts.groupBy("feature").agg(F.sum(n).cast("double").alias("t"), F.sum(n * n).cast("double").alias("q"), F.sum((n == 2).cast("double")).alias("f2"))
    more = F.col("t") * (F.col("t") - 1)
    less = F.greatest(F.lit(0.0), (F.col("q") - more * (1 - F.coalesce(2 * F.col("f2") / F.nullif(more, F.lit(0.0)), F.lit(0.0)))) / (F.col("t") * F.col("t")))
    one = one.withColumn("l", F.col("q") / (F.col("t") * F.col("t"))).withColumn("c", less)
    p = counts.select("gx", "gy", F.col("feature").alias("a"), n.alias("u"))
    r = counts.select("gx", "gy", F.col("feature").alias("b"), n.alias("v"))
    cross = edges.select("a", "b").join(p, "a").join(r, ["gx", "gy", "b"]).groupBy("a", "b").agg(F.sum(F.col("u") * F.col("v")).cast("double").alias("ab"))
    a, b = (one.select(F.col("feature").alias(x), *(F.col(c).alias(c + x) for c in "tlc")) for x in "ab")
    plain, lowered = F.col("la") + F.col("lb"), F.col("ca") + F.col("cb")
    den = (F.when(lowered > 0, lowered).otherwise(plain) if chao else plain) * F.col("ta") * F.col("tb")
    full = edges.select("a", "b").join(cross, ["a", "b"], "left").join(a, "a", "left").join(b, "b", "left")
    return full.select("a", "b", F.when(den > 0, 2 * F.coalesce("ab", F.lit(0.0)) / den).otherwise(0.0).alias("mh"))


def auto_scaled(values: DataFrame, value: str = "mh") -> DataFrame:
    """Values times 1000, 100 or 10 where the greatest is under 0.001, 0.01 or 0.1."""
    top = values.agg(F.max(value).alias("_top"))
    by = F.when(F.col("_top") < 0.001, 1000.0).when(F.col("_top") < 0.01, 100.0).when(F.col("_top") < 0.1, 10.0).otherwise(1.0)
    return values.crossJoin(F.broadcast(top)).withColumn(value, F.col(value) * by).drop("_top")


def jaccard(counts: DataFrame, fewest: int = 8, most: int = 60) -> DataFrame:
    """Overlap of the bins of features a <= b; features present in enough bins, the most present ones (a report's limit)."""
    here = counts.where("n > 0").select("gx", "gy", "feature")
    size = here.groupBy("feature").agg(F.count("*").alias("k")).where(F.col("k") >= fewest).orderBy(F.desc("k"), "feature").limit(most)
    some = here.join(F.broadcast(size), "feature")
    p, q = some.select("gx", "gy", F.col("feature").alias("a"), F.col("k").alias("ka")), some.select("gx", "gy", F.col("feature").alias("b"), F.col("k").alias("kb"))
    both = p.join(q, ["gx", "gy"]).where("a <= b").groupBy("a", "b", "ka", "kb").agg(F.count("*").alias("c"))
    pairs = size.select(F.col("feature").alias("a"), F.col("k").alias("ka")).join(size.select(F.col("feature").alias("b"), F.col("k").alias("kb")), F.col("a") <= F.col("b"))
    return pairs.join(both, ["a", "b", "ka", "kb"], "left").select("a", "b", (F.coalesce("c", F.lit(0)) / (F.col("ka") + F.col("kb") - F.coalesce("c", F.lit(0)))).alias("jaccard"))


def cosine(values: DataFrame, unit: str) -> DataFrame:
    """Cosines of columns a < b of a long matrix (unit, feature, v)."""
    v = values.select(unit, "feature", "v")
    norm = v.groupBy("feature").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dot = v.join(v.select(unit, F.col("feature").alias("g"), F.col("v").alias("u")), unit).where("feature < g").groupBy(F.col("feature").alias("a"), F.col("g").alias("b")).agg(F.sum(F.col("v") * F.col("u")).alias("dot"))
    a, b = (norm.select(F.col("feature").alias(x), F.col("norm").alias(f"n{x}")) for x in "ab")
    return dot.join(a, "a").join(b, "b").select("a", "b", (F.col("dot") / F.nullif(F.col("na") * F.col("nb"), F.lit(0.0))).alias("cosine"))


def layer_similarity(values: DataFrame, bins: DataFrame, method: str, threshold: float = 0.0, scaled: bool = True, fewest: int = 5, most: int | None = None) -> DataFrame:
    """Likeness (a, b, value) of layers a < b, say densities of modules, given as (gx, gy, feature, v) over all of ``bins``; null and absent values are zeros.

    Layers are z-scored first unless ``scaled`` is false; a constant one is then zero throughout. Only layers above ``threshold`` in at least
    ``fewest`` bins count, and of them at most ``most``, the most present ones (a report's limit; ties by name). "jaccard" compares the bins
    above the threshold; "pearson", "spearman" and "cosine" the values.
    """
    names = values.select("feature").distinct()
    v = bins.select("gx", "gy").distinct().crossJoin(names).join(values.select("gx", "gy", "feature", "v"), ["gx", "gy", "feature"], "left")
    v = v.select("gx", "gy", "feature", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"))
    if scaled:
        m = v.groupBy("feature").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"))
        v = v.join(F.broadcast(m), "feature").select("gx", "gy", "feature", F.when(F.col("sd") > 1e-12, (F.col("v") - F.col("m")) / F.col("sd")).otherwise(0.0).alias("v"))
    above = v.where(F.round("v", 9) > threshold)
    size = above.groupBy("feature").agg(F.count("*").alias("k")).where(F.col("k") >= fewest)
    if most is not None:
        size = size.orderBy(F.desc("k"), "feature").limit(most)
    v, above = (x.join(size, "feature", "left_semi") for x in (v, above))
    if method == "jaccard":
        both = above.select("gx", "gy", F.col("feature").alias("a")).join(above.select("gx", "gy", F.col("feature").alias("b")), ["gx", "gy"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
        pairs = size.toDF("a", "ka").join(size.toDF("b", "kb"), F.col("a") < F.col("b")).join(both, ["a", "b"], "left")
        c = F.coalesce("c", F.lit(0))
        return pairs.select("a", "b", (c / (F.col("ka") + F.col("kb") - c)).alias("value"))
    if method == "cosine":
        return cosine(v.withColumn("unit", F.struct("gx", "gy")), "unit").withColumnRenamed("cosine", "value")
    return (pearson(v, ["gx", "gy"]) if method == "pearson" else spearman(v, ["gx", "gy"], bins.select("gx", "gy").distinct())).select("a", "b", F.col("r").alias("value"))


def within_between(pairs: DataFrame, modules: DataFrame, value: str) -> DataFrame:
    """Per feature: mean of a pair value with its own module's members and with others, and the difference."""
    ends = pairs.select("a", "b", value).union(pairs.select("b", "a", value)).toDF("feature", "other", "v")
    own = ends.join(modules.withColumnRenamed("module", "m"), "feature").join(modules.select(F.col("feature").alias("other"), F.col("module").alias("k")), "other")
    inside, outside = F.avg(F.when(F.col("m") == F.col("k"), F.col("v"))), F.avg(F.when(F.col("m") != F.col("k"), F.col("v")))
    return own.groupBy("feature", F.col("m").alias("module")).agg(inside.alias("within"), outside.alias("between"), (inside - outside).alias("diff"))


def delta(l: DataFrame, r: DataFrame) -> DataFrame:
    """L minus r of pairs a < b."""
    return l.where("a < b").join(r, ["a", "b"]).select("a", "b", "l", "r", (F.col("l") - F.col("r")).alias("delta"))


def extremes(pairs: DataFrame, value: str, n: int, direction: str = "both") -> DataFrame:
    """The n largest and the n smallest (or one of these: ``largest``, ``smallest``), all ties included, each pair once."""
    # The n-th values are found by a bounded sort; everything at or beyond them stays, ties included.
    kept = pairs.where(F.col(value).isNotNull())
    high = kept.orderBy(F.desc(value)).limit(n).agg(F.min(value).alias("_high"))
    low = kept.orderBy(value).limit(n).agg(F.max(value).alias("_low"))
    beyond = {"largest": F.col(value) >= F.col("_high"), "smallest": F.col(value) <= F.col("_low")}
    wanted = beyond["largest"] | beyond["smallest"] if direction == "both" else beyond[direction]
    return kept.crossJoin(F.broadcast(high)).crossJoin(F.broadcast(low)).where(wanted).drop("_high", "_low")


def top_pairs(
    pairs: DataFrame, n: int, direction: str = "largest", curve: DataFrame | None = None, rule: str = "remove_within", r_range: tuple[float, float] = (-1.0, 1.0), l_range: tuple[float, float] = (-1.0, 1.0)
) -> DataFrame:
    """The pairs (a, b, l, r, delta) of the most extreme delta, ties included, among those that the band and the ranges (ends included) leave.

    ``rule`` drops pairs within the curve's band, those outside it (``remove_outside``), or none; the first two need a curve, and asking for them without
    one is an error. Pairs without a value are outside of every range. Where nothing is left the result is empty.
    """
    if rule not in ("remove_within", "remove_outside", "none"):
        raise ValueError(f"unknown rule {rule}")
    if direction not in ("largest", "smallest", "both"):
        raise ValueError(f"unknown direction {direction}")
    if rule != "none" and curve is None:
        raise ValueError(f"rule {rule} needs a curve")
    kept = pairs.where(F.col("r").between(*r_range) & F.col("l").between(*l_range))
    if rule != "none":
        outside = outside_curve(kept, curve)
        kept = outside if rule == "remove_within" else kept.join(outside.select("a", "b"), ["a", "b"], "left_anti")
    return extremes(kept, "delta", n, direction)


def outside_curve(pairs: DataFrame, curve: DataFrame) -> DataFrame:
    """Pairs whose L is outside the curve's band (r, lo, hi) at their r, interpolated between its points, level beyond its ends."""
    w = Window.orderBy("at")
    # A curve is a report of some hundred points; its segments are broadcast.
    seg = curve.select(F.col("r").alias("at"), "lo", "hi").select("at", "lo", "hi", F.lead("at").over(w).alias("next"), F.lead("lo").over(w).alias("lo2"), F.lead("hi").over(w).alias("hi2"))
    ends = curve.agg(F.min("r").alias("first"), F.max("r").alias("last"))
    p = pairs.crossJoin(F.broadcast(ends)).withColumn("x", F.greatest("first", F.least("last", "r")))
    hit = p.join(F.broadcast(seg), (F.col("x") >= F.col("at")) & ((F.col("x") < F.col("next")) | F.col("next").isNull()), "left")
    t = F.coalesce((F.col("x") - F.col("at")) / (F.col("next") - F.col("at")), F.lit(0.0))
    lo = F.col("lo") + t * (F.coalesce("lo2", "lo") - F.col("lo"))
    hi = F.col("hi") + t * (F.coalesce("hi2", "hi") - F.col("hi"))
    inside = F.coalesce((F.col("l") >= lo) & (F.col("l") <= hi), F.lit(False))
    return hit.where(~inside).select(*pairs.columns)


def detected(counts: DataFrame, units: int, least: float = 0.1, most: int = 8000) -> DataFrame:
    """Features (feature) present in at least a share ``least`` of the units, of these the ``most`` of the largest totals, ties by name."""
    one = counts.where("n > 0").groupBy("feature").agg(F.count("*").alias("k"), F.sum("n").alias("total"))
    return one.where(F.col("k") >= least * units - 1e-9).orderBy(F.desc("total"), "feature").limit(most).select("feature")


def association_of_spots(counts: DataFrame, w: DataFrame, least: float = 0.1, most: int = 8000) -> DataFrame:
    """L of all ordered pairs of the detected features of spots (gx, gy, feature, n): shares of a spot's total, over the spots with any count."""
    from tesselark.operators.grid import row_normalise

    kept = detected(counts, counts.select("gx", "gy").distinct().count(), least, most)
    found = association_of(row_normalise(counts), w, kept)
    return found.join(kept.withColumnRenamed("feature", "b"), "b", "left_semi").select("a", "b", "l")
