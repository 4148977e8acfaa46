"""Scoring of edge lists and modules against a reference, and of runs over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselark.functions import testing


def key_pair(a: str, b: str):
    return F.least(a, b), F.greatest(a, b)


def label_edges(edges: DataFrame, ids: DataFrame, reference: DataFrame, least: float = 700) -> DataFrame:
    """Adds score (0 for pairs the reference lacks, null for unmapped features) and label of edges (a, b, weight).

    ids (feature, id); reference (p, q, score) in any order, the largest score of a pair counts.
    """
    m = ids.select("feature", "id")
    e = edges.join(m.toDF("a", "ia"), "a", "left").join(m.toDF("b", "ib"), "b", "left")
    x, y = key_pair("p", "q")
    best = reference.groupBy(x.alias("x"), y.alias("y")).agg(F.max("score").alias("s"))
    u, v = key_pair("ia", "ib")
    mapped = F.col("ia").isNotNull() & F.col("ib").isNotNull()
    e = e.withColumn("x", F.when(mapped, u)).withColumn("y", F.when(mapped, v)).join(best, ["x", "y"], "left")
    score = F.when(mapped, F.coalesce("s", F.lit(0)))
    return e.select("a", "b", "weight", score.alias("score"), (score >= least).alias("label"))


def significant(edges: DataFrame, fdr: float) -> DataFrame:
    """Finite positive weights below an FDR; a threshold outside (0, 1) filters nothing by FDR."""
    kept = edges.where((F.col("weight") > 0) & ~F.isnan("weight") & (F.col("weight") < float("inf")))
    return kept.where(F.col("fdr") < fdr) if 0 < fdr < 1 else kept


def common_pool(edges: DataFrame) -> DataFrame:
    """The first edges of every method, by (fdr, a, b), as many as the smallest method has."""
    least = edges.groupBy("method").count().agg(F.min("count").alias("n"))
    rank = F.row_number().over(Window.partitionBy("method").orderBy("fdr", "a", "b"))
    return edges.withColumn("_k", rank).crossJoin(F.broadcast(least)).where("_k <= n").drop("_k", "n")


def curve(edges: DataFrame) -> DataFrame:
    """Running precision, recall and false-positive rate of labelled edges by weight, descending, ties by name."""
    order = Window.partitionBy("method").orderBy(F.desc("weight"), "a", "b")
    every = Window.partitionBy("method")
    tp = F.sum(F.col("label").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    k = F.row_number().over(order)
    pos, n = F.sum(F.col("label").cast("long")).over(every), F.count("*").over(every)
    ranked = edges.where("label IS NOT NULL").select("method", "a", "b", "weight", "label", k.alias("k"), tp.alias("tp"), pos.alias("pos"), n.alias("n"))
    zero = F.lit(0).cast("long")
    return ranked.withColumns({"precision": F.col("tp") / F.col("k"), "recall": F.col("tp") / F.nullif("pos", zero), "fpr": (F.col("k") - F.col("tp")) / F.nullif(F.col("n") - F.col("pos"), zero)})


def auprc(edges: DataFrame) -> DataFrame:
    """Area under precision and recall; null without both classes."""
    c = curve(edges)
    area = F.sum(F.when(F.col("label"), F.col("precision") / F.col("pos")).otherwise(0.0))
    return c.groupBy("method").agg(F.when((F.max("pos") > 0) & (F.max("pos") < F.max("n")), area).alias("auprc"))


def auroc(edges: DataFrame) -> DataFrame:
    """Area under the ROC curve from average ranks."""
    known = edges.where("label IS NOT NULL")
    up = Window.partitionBy("method").orderBy("weight")
    rank = F.rank().over(up) + (F.count("*").over(Window.partitionBy("method", "weight")) - 1) / 2
    s = known.withColumn("r", rank).groupBy("method").agg(F.sum(F.when(F.col("label"), F.col("r"))).alias("r"), F.sum(F.col("label").cast("long")).alias("p"), F.count("*").alias("n"))
    return s.select("method", F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auroc"))


def precision_at(edges: DataFrame, sizes: list[int]) -> DataFrame:
    """Precision and recall of the first n edges, for each n in a list that the method has."""
    c = curve(edges)
    wanted = F.explode(F.array([F.lit(n) for n in sizes])).alias("top")
    tops = edges.select("method").distinct().select("method", wanted)
    return c.join(F.broadcast(tops), (c.method == tops.method) & (c.k == tops.top)).select(c.method, "top", "precision", "recall")


def enrichment(edges: DataFrame, n: int) -> DataFrame:
    """Share of positives among the first n edges over that among all."""
    c = curve(edges)
    return c.groupBy("method").agg((F.sum(F.when((F.col("k") <= n) & F.col("label"), 1.0).otherwise(0.0)) / F.sum(F.when(F.col("k") <= n, 1.0)) / (F.max("pos") / F.max("n"))).alias("enrichment"))


def enrichment_sets(edges: DataFrame, sizes: list[int], shares: list[float]) -> DataFrame:
    """Sets of the first edges of each method, by number or by share of them: (method, top, positives, precision, enrichment over all edges, Fisher's p).

    A method has the sets that are not larger than its edges; a share of n edges is rounded up, and has one at least.
    """
    from tesselark.functions.testing import fisher_greater

    c = curve(edges)
    name = lambda v, kind: F.struct(F.lit(f"{kind}{v}").alias("top"), (F.lit(v).cast("long") if kind == "n" else F.greatest(F.lit(1), F.ceil(F.lit(v) * F.col("n") - 1e-9)).cast("long")).alias("size"))
    sets = c.select("method", "n", "pos").distinct().select("method", F.inline(F.array(*[name(v, "n") for v in sizes], *[name(v, "share") for v in shares])))
    at = c.join(F.broadcast(sets), "method").where(F.col("k") == F.col("size"))
    a, b, n = F.col("tp"), F.col("k") - F.col("tp"), F.col("n")
    rest = F.col("pos") - a
    return at.select("method", "top", F.col("tp").alias("positives"), F.col("precision"), (F.col("precision") / F.nullif(F.col("pos") / n, F.lit(0.0))).alias("enrichment"), fisher_greater(a, b, rest, n - F.col("k") - rest).alias("p"))


def recall_of_universe(edges: DataFrame, reference: DataFrame, sizes: list[int], least: float = 700) -> DataFrame:
    """Recall of the first n labelled edges of each method over all positive pairs (p, q, score) of the reference, listed by the method or not."""
    x, y = key_pair("p", "q")
    positive = reference.where(F.col("score") >= least).select(x.alias("p"), y.alias("q")).where("p <> q").distinct().agg(F.count("*").alias("universe"))
    c = curve(edges).where(F.col("k").isin(sizes)).crossJoin(F.broadcast(positive))
    return c.select("method", F.col("k").cast("int").alias("top"), "universe", (F.col("tp") / F.nullif("universe", F.lit(0).cast("long"))).alias("recall"))


def mean_of_repeats(resampled: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation and number of the repeats at each place of their common grid (and of each group)."""
    return resampled.groupBy(*(by or []), "grid").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def module_pairs(modules: DataFrame, reference: DataFrame, least: float = 700) -> DataFrame:
    """Per module: pairs, pairs with a score, their sum, pairs at or above the threshold, and means over all pairs."""
    m = modules.where("module >= 0")
    x, y = key_pair("p", "q")
    best = reference.groupBy(x.alias("a"), y.alias("b")).agg(F.max("score").alias("s"))
    pairs = m.toDF("a", "module").join(m.toDF("b", "module"), "module").where("a < b").join(best, ["a", "b"], "left")
    out = pairs.groupBy("module").agg(
        F.count("*").alias("pairs"), F.count("s").alias("mapped"), F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("total"), F.sum(F.coalesce((F.col("s") >= least).cast("long"), F.lit(0))).alias("strong")
    )
    return out.withColumns({"mean": F.col("total") / F.col("pairs"), "strong_share": F.col("strong") / F.col("pairs")})


def module_null(modules: DataFrame, background: DataFrame, reference: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """Per module: observed mean score of its pairs, and of as many member-background pairs in each draw; p, mean and deviation.

    A draw's pairs are those of the least hashes, so draws are the same in every engine.
    """
    m = modules.where("module >= 0")
    x, y = key_pair("p", "q")
    best = reference.groupBy(x.alias("a"), y.alias("b")).agg(F.max("score").alias("s"))
    size = m.groupBy("module").agg(F.count("*").alias("k")).select("module", (F.col("k") * (F.col("k") - 1) / 2).cast("long").alias("need")).where("need > 0")
    outside = m.crossJoin(background.select(F.col("feature").alias("other"))).join(m.select(F.col("feature").alias("other"), F.col("module").alias("om")), "other", "left").where("om IS NULL OR om <> module")
    many = outside.crossJoin(modules.sparkSession.range(1, draws + 1).withColumnRenamed("id", "draw"))
    rank = F.row_number().over(Window.partitionBy("module", "draw").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "draw", "feature", "other")), "feature", "other"))
    u, v = key_pair("feature", "other")
    drawn = many.withColumn("k", rank).join(size, "module").where("k <= need").withColumn("a", u).withColumn("b", v).join(best, ["a", "b"], "left")
    null = drawn.groupBy("module", "draw").agg(F.avg(F.coalesce("s", F.lit(0)).cast("double")).alias("v"))
    obs = module_pairs(modules, reference).select("module", F.col("mean").alias("obs"))
    j = null.join(obs, "module")
    return j.groupBy("module", "obs").agg(((F.sum((F.round("v", 9) >= F.round("obs", 9)).cast("long")) + 1) / (F.count("*") + 1)).alias("p"), F.avg("v").alias("null_mean"), F.stddev_samp("v").alias("null_sd"))


# Fixed values.
STATUS = {
    "n_pairs_total_zero": "skipped",
    "n_random_nonpositive": "null_insufficient",
    "cross_edge_space_too_small": "null_insufficient",
    "valid_null_draws_lt_min": "null_insufficient",
}


def module_enrichment(modules: DataFrame, background: DataFrame, reference: DataFrame, draws: int, least: float = 700, fewest: int | None = None, seed: int = 1) -> DataFrame:
    """Per method and module (method, module, feature; negative modules are none): pairs, mean score and strong share of its pairs, and both
    against draws of as many pairs of a member with a background feature outside: null mean and deviation, delta, p, and q (BH within a method).

    Unscored pairs count as 0. Modules without pairs are "skipped"; with no draws, fewer than ``fewest`` (four fifths of ``draws``) or fewer pairs
    outward than inward they are "null_insufficient", without p; status_reason says why. Ties of hashes go by names.
    """
    key = ["method", "module"]
    fewest = draws * 4 // 5 if fewest is None else fewest
    m = modules.where("module >= 0 AND feature IS NOT NULL").select(*key, "feature").distinct()
    x, y = key_pair("p", "q")
    best = reference.groupBy(x.alias("a"), y.alias("b")).agg(F.max("score").cast("double").alias("s"))
    means = [F.avg(F.coalesce("s", F.lit(0.0))).alias("mean"), F.avg(F.when(F.col("s") >= least, 1.0).otherwise(0.0)).alias("strong")]
    inside = m.withColumnRenamed("feature", "a").join(m.withColumnRenamed("feature", "b"), key).where("a < b").join(best, ["a", "b"], "left").groupBy(*key).agg(F.count("*").alias("pairs"), *means)
    # What is outside is a number, so no pair is made to count it.
    known = background.select(F.col("feature").alias("other")).where("other IS NOT NULL").distinct()
    own = m.join(known.withColumnRenamed("other", "feature"), "feature", "left_semi").groupBy(*key).agg(F.count("*").alias("own"))
    size = m.groupBy(*key).agg(F.count("*").alias("k")).join(own, key, "left").crossJoin(F.broadcast(known.agg(F.count("*").alias("all"))))
    facts = size.join(inside, key, "left").withColumn("pairs", F.coalesce("pairs", F.lit(0).cast("long")))
    room = F.col("k") * (F.col("all") - F.coalesce("own", F.lit(0)))
    reason = F.when(F.col("pairs") == 0, "n_pairs_total_zero").when(F.lit(draws <= 0), "n_random_nonpositive")
    reason = reason.when(room < F.col("pairs"), "cross_edge_space_too_small").when(F.lit(draws < fewest), "valid_null_draws_lt_min")
    facts = facts.withColumn("status_reason", reason).select(*key, "pairs", "mean", "strong", "status_reason")
    good = facts.where("status_reason IS NULL").select(*key, "pairs", "mean", "strong")
    outside = m.join(good.select(*key, "pairs"), key).crossJoin(known).join(m.withColumnRenamed("feature", "other"), [*key, "other"], "left_anti")
    many = outside.crossJoin(modules.sparkSession.range(1, max(draws, 0) + 1).withColumnRenamed("id", "draw"))
    rank = F.row_number().over(Window.partitionBy(*key, "draw").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "draw", *key, "feature", "other")), "feature", "other"))
    u, v = key_pair("feature", "other")
    drawn = many.withColumn("k", rank).where("k <= pairs").withColumn("a", u).withColumn("b", v).join(best, ["a", "b"], "left")
    null = drawn.groupBy(*key, "draw").agg(*means).toDF(*key, "draw", "v_mean", "v_strong").join(good, key)
    stats = []
    for c in ("mean", "strong"):
        v = F.col(f"v_{c}")
        exceed = F.sum((F.round(v, 9) >= F.round(c, 9)).cast("long"))
        stats += [((exceed + 1) / (F.count("*") + 1)).alias(f"p_{c}"), F.avg(v).alias(f"null_{c}"), F.stddev_samp(v).alias(f"sd_{c}")]
    full = facts.join(null.groupBy(*key).agg(*stats), key, "left")
    for c in ("mean", "strong"):
        full = testing.adjust(full.withColumn(f"delta_{c}", F.col(c) - F.col(f"null_{c}")), f"p_{c}", f"q_{c}", by=["method"])
    status = F.coalesce(*[F.when(F.col("status_reason") == r, s) for r, s in STATUS.items()], F.lit("ok"))
    return full.withColumn("status", status)


def quantile_normalise(edges: DataFrame, places: int = 1000) -> DataFrame:
    """Weights of methods brought to one distribution: the mean over methods of their quantiles at evenly spaced probabilities.

    Quantiles are of Hyndman and Fan's type 8; a row's average rank finds its place among them, linearly between two.
    """
    by = Window.partitionBy("method")
    n, last = F.count("*").over(by), places - 1
    r = F.rank().over(by.orderBy("weight")) + (F.count("*").over(Window.partitionBy("method", "weight")) - 1) / 2
    ranked = edges.select("method", "a", "b", "weight", F.row_number().over(by.orderBy("weight")).alias("k"), n.alias("n"), ((r - 0.5) / n * last).alias("at"))
    h = (F.col("n") + 1 / 3) * F.col("i") / last + 1 / 3
    spots = ranked.groupBy("method").agg(F.max("n").alias("n")).crossJoin(edges.sparkSession.range(places).withColumnRenamed("id", "i")).withColumn("h", h)
    inside = lambda k: F.least(F.greatest(k, F.lit(1)), F.col("n"))
    spots = spots.select("method", "i", (F.col("h") - F.floor("h")).alias("t"), inside(F.floor("h")).alias("lo"), inside(F.floor("h") + 1).alias("hi"))
    value = lambda k, name: ranked.select("method", F.col("k").cast("long").alias(k), F.col("weight").alias(name))
    q = spots.join(value("lo", "x"), ["method", "lo"]).join(value("hi", "y"), ["method", "hi"])
    levels = q.groupBy("i").agg(F.avg(F.col("x") + F.col("t") * (F.col("y") - F.col("x"))).alias("v"))
    here, there = levels.toDF("i", "v0"), levels.select((F.col("i") - 1).alias("i"), F.col("v").alias("v1"))
    grid = here.join(there, "i", "left")  # as many rows as places
    found = ranked.withColumn("i", F.floor("at")).join(F.broadcast(grid), "i")
    return found.select("method", "a", "b", "weight", (F.col("v0") + (F.col("at") - F.col("i")) * (F.coalesce("v1", "v0") - F.col("v0"))).alias("norm"))


def refill(edges: DataFrame, top: int, multiplier: int = 5) -> DataFrame:
    """The first ``top`` edges with a score of each method, sought among ``multiplier`` times as many by weight (ties by name); with a status and how many lack."""
    order = lambda: Window.partitionBy("method").orderBy(F.desc("weight"), "a", "b")
    first = edges.withColumn("_k", F.row_number().over(order())).where(F.col("_k") <= top * multiplier).where("score IS NOT NULL").drop("_k")
    held = first.withColumn("_k", F.row_number().over(order())).where(F.col("_k") <= top)
    have = F.count("*").over(Window.partitionBy("method"))
    return held.withColumn("shortfall", (F.lit(top) - have).cast("long")).withColumn("status", F.when(F.col("shortfall") == 0, "ok").otherwise("insufficient_mappable_edges")).drop("_k")


def permuted_ids(ids: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """(draw, feature, id): the features' ids (missing ones too) dealt anew by hashes of seed, draw and feature; draw 0 is as given."""
    # Features are at most some ten thousands, so the one window over their names is small.
    placed = ids.select("feature", "id", F.row_number().over(Window.orderBy("feature")).alias("k"))
    many = placed.select("feature", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    order = F.md5(F.concat_ws("|", F.lit(seed), "draw", "feature"))
    dealt = many.withColumn("k", F.row_number().over(Window.partitionBy("draw").orderBy(order, "feature"))).join(placed.select("k", "id"), "k")
    return dealt.select("draw", "feature", "id").union(placed.select(F.lit(0), "feature", "id"))


def label_null(edges: DataFrame, ids: DataFrame, reference: DataFrame, sizes: list[int], draws: int, rate: float | None = None, least: float = 700, seed: int = 1) -> DataFrame:
    """Per size k: the precision of the first k edges (a, b, weight) with two ids, and of as many under each of ``draws`` permuted mappings of
    features to ids: (top, observed, null_mean, null_sd, z, p), and where an expected ``rate`` of positives is given, the enrichments.

    Ties of weight go by a, then b. Draws of fewer than k such edges count over those they have; p is (1 + draws not below) / (1 + draws). Only the first
    edges of each draw (partial top-k before the shuffle) meet the reference.
    """
    m = permuted_ids(ids, draws, seed).where("id IS NOT NULL")
    one, two = (m.select("draw", F.col("feature").alias(x), F.col("id").alias(f"i{x}")) for x in "ab")
    e = edges.where("weight IS NOT NULL").select("a", "b", "weight").join(one, "a").join(two, ["draw", "b"])
    rank = F.row_number().over(Window.partitionBy("draw").orderBy(F.desc("weight"), "a", "b"))
    first = e.withColumn("k", rank).where(F.col("k") <= max(sizes))
    x, y = key_pair("p", "q")
    known = reference.groupBy(x.alias("x"), y.alias("y")).agg(F.max("score").alias("s")).where(F.col("s") >= least)
    u, v = key_pair("ia", "ib")
    hit = first.select("draw", "k", u.alias("x"), v.alias("y")).join(known, ["x", "y"], "left").select("draw", "k", F.col("s").isNotNull().cast("double").alias("yes"))
    top = hit.select("draw", "k", "yes", F.explode(F.array(*map(F.lit, sizes))).alias("top")).where("k <= top")
    found = top.groupBy("top", "draw").agg(F.avg("yes").alias("v"))
    null = F.when(F.col("draw") > 0, F.col("v"))
    seen = found.withColumn("observed", F.max(F.when(F.col("draw") == 0, F.col("v"))).over(Window.partitionBy("top")))
    out = seen.groupBy("top", "observed").agg(F.avg(null).alias("null_mean"), F.stddev_samp(null).alias("null_sd"), ((1 + F.count(F.when(null >= F.col("observed"), 1))) / (1 + F.count(null))).alias("p"))
    out = out.withColumn("z", (F.col("observed") - F.col("null_mean")) / F.nullif("null_sd", F.lit(0.0)))
    columns = ["top", "observed", "null_mean", "null_sd", "z", F.when(F.col("observed").isNotNull(), F.col("p")).alias("p")]
    if rate:
        columns += [(F.col("observed") / rate).alias("enrichment"), (F.col("null_mean") / rate).alias("null_enrichment")]
    return out.select(*columns)


def background(ids: DataFrame, reference: DataFrame, levels: list[float]) -> DataFrame:
    """Per level: mapped ids, their pairs, and the distinct pairs of mapped ids with a score at or above the level."""
    known = ids.where("id IS NOT NULL").select("id").distinct()
    x, y = key_pair("p", "q")
    best = reference.join(known.toDF("p"), "p", "left_semi").join(known.toDF("q"), "q", "left_semi").where("p <> q").groupBy(x.alias("x"), y.alias("y")).agg(F.max("score").alias("s"))
    n = known.agg(F.count("*").alias("genes"))
    # One pass, a sum for each level; levels are a few literals.
    strong = best.agg(*(F.coalesce(F.sum((F.col("s") >= v).cast("long")), F.lit(0)).alias(f"_{i}") for i, v in enumerate(levels)))
    rows = F.explode(F.array(*(F.struct(F.lit(float(v)).alias("level"), F.col(f"_{i}").alias("positives")) for i, v in enumerate(levels)))).alias("r")
    return strong.select(rows).crossJoin(n).select("r.level", "genes", (F.col("genes") * (F.col("genes") - 1) / 2).cast("long").alias("pairs"), "r.positives")


def payload(edges: DataFrame, back: DataFrame, least: float = 700, unmapped: str = "negative") -> DataFrame:
    """One row per method of edges (method, a, b, weight, score): numbers, coverage, rate of positives, areas with the reason where undefined, enrichment.

    Edges without a score count as negatives, or with ``unmapped="drop"`` only in the coverage. ``back`` has one row (pairs, positives).
    """
    known = F.col("score") >= least
    e = edges.withColumn("label", F.coalesce(known, F.lit(False)) if unmapped == "negative" else known)
    yes, no = F.sum(F.col("label").cast("long")), F.sum((~F.col("label")).cast("long"))
    facts = e.groupBy("method").agg(
        F.count("*").alias("n_edges"), F.count("label").alias("n_comparable"), (F.count("score") / F.count("*")).alias("coverage"), F.coalesce(yes, F.lit(0)).alias("pos"), F.coalesce(no, F.lit(0)).alias("neg")
    )
    reason = F.when(F.col("n_comparable") == 0, "no_comparable_edges").when(F.col("pos") == 0, "no_positive_labels").when(F.col("neg") == 0, "no_negative_labels").otherwise("ok")
    facts = facts.join(auprc(e), "method", "left").join(auroc(e), "method", "left").crossJoin(F.broadcast(back.select("pairs", "positives")))
    rate = F.col("pos") / F.nullif(F.col("n_comparable"), F.lit(0).cast("long"))
    return facts.select("method", "n_edges", "n_comparable", "coverage", rate.alias("positive_rate"), reason.alias("reason"), "auprc", "auroc", (rate / F.nullif(F.col("positives") / F.col("pairs"), F.lit(0.0))).alias("enrichment"))


def first_of_pair(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row of each unordered pair (p, q), the first by an order, with its ends in order (x, y)."""
    x, y = key_pair("p", "q")
    keyed = rows.withColumn("x", x).withColumn("y", y)
    return keyed.withColumn("_k", F.row_number().over(Window.partitionBy("x", "y").orderBy(*order))).where("_k = 1").drop("_k", "p", "q")


def long_form(wide: DataFrame, key: str, pattern: str) -> DataFrame:
    """(key, name, v) of the columns whose names fit a pattern of two groups, a name and a repeat; of a name's repeats the last with a value counts."""
    import re

    fits = [(m[1], int(m[2]), c) for c in wide.columns if (m := re.fullmatch(pattern, c))]
    cells = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(rep).alias("rep"), F.col(c).cast("double").alias("v")) for name, rep, c in fits))
    return wide.select(key, F.explode(cells).alias("c")).where("c.v IS NOT NULL").groupBy(key, "c.name").agg(F.max_by("c.v", "c.rep").alias("v"))


def box_stats(values: DataFrame, by: str, value: str) -> DataFrame:
    """Median, Tukey's hinges and whiskers (furthest values within 1.5 box lengths)."""
    w = Window.partitionBy(by)
    r = values.select(by, F.col(value).alias("v"), F.row_number().over(w.orderBy(value)).alias("k"), F.count("*").over(w).alias("n"))
    depth = (F.floor((F.col("n") + 1) / 2) + 1) / 2
    at = lambda d: (F.max(F.when(F.col("k") == F.floor(d), F.col("v"))) + F.max(F.when(F.col("k") == F.ceil(d), F.col("v")))) / 2
    h = r.groupBy(by).agg(at(depth).alias("q1"), at((F.col("n") + 1) / 2).alias("median"), at(F.col("n") + 1 - depth).alias("q3"))
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = r.join(F.broadcast(h), by).where((F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach))
    return inside.groupBy(by, "q1", "median", "q3").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def cpu_series(samples: DataFrame) -> DataFrame:
    """Samples (series, t, cpu_usec cumulative, mem_bytes) to seconds since the first, cores busy (null unless both grow) and GiB."""
    w = Window.partitionBy("series").orderBy("t")
    dt, dc = F.col("t") - F.lag("t").over(w), F.col("cpu_usec") - F.lag("cpu_usec").over(w)
    first = F.min("t").over(Window.partitionBy("series"))
    return samples.select("series", (F.col("t") - first).alias("sec"), F.when((dt > 0) & (dc >= 0), dc / (dt * 1e6)).alias("cores"), (F.col("mem_bytes") / float(1 << 30)).alias("gib"))


def segments(samples: DataFrame, starts: DataFrame) -> DataFrame:
    """Samples with the latest start (series, start, segment) at or before them: one pass over the union, no range join."""
    kind = dict(starts.dtypes)["segment"]
    marks = starts.select("series", F.col("start").alias("t"), F.lit(0).alias("o"), "segment")
    rest = [c for c in samples.columns if c not in ("series", "t")]
    both = samples.select("*", F.lit(1).alias("o"), F.lit(None).cast(kind).alias("segment")).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("series").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("segment", F.last("segment", ignorenulls=True).over(w)).where("o = 1 AND segment IS NOT NULL").select("series", "t", *rest, "segment")


def resample(samples: DataFrame, step: float, value: str) -> DataFrame:
    """Linear interpolation of a series at multiples of a step between its first and last sample."""
    s = samples.where(F.col(value).isNotNull()).groupBy("series", "sec").agg(F.avg(value).alias("v"))
    w = Window.partitionBy("series").orderBy("sec")
    span = s.select("series", "sec", "v", F.lead("sec").over(w).alias("next"), F.lead("v").over(w).alias("v2"))
    # Each sample makes the grid points from itself up to the next sample; the last only its own.
    k0, k1 = F.ceil(F.col("sec") / step), F.coalesce(F.ceil(F.col("next") / step) - 1, F.floor(F.col("sec") / step))
    made = span.where(k0 <= k1).select("*", F.explode(F.sequence(k0, k1)).alias("k"))
    at = F.col("k") * F.lit(float(step))
    return made.select("series", at.alias("grid"), F.coalesce(F.col("v") + (at - F.col("sec")) / (F.col("next") - F.col("sec")) * (F.col("v2") - F.col("v")), F.col("v")).alias(value))


def time_mean(samples: DataFrame, value: str) -> DataFrame:
    """Mean over time by trapezoids, and the maximum, per series; samples of one time are averaged."""
    s = samples.where(F.col(value).isNotNull()).groupBy("series", "sec").agg(F.avg(value).alias("v"))
    w = Window.partitionBy("series").orderBy("sec")
    dt = F.col("sec") - F.lag("sec").over(w)
    area = s.select("series", "v", dt.alias("dt"), (dt * (F.col("v") + F.lag("v").over(w)) / 2).alias("area"))
    return area.groupBy("series").agg((F.sum("area") / F.nullif(F.sum("dt"), F.lit(0.0))).alias("mean"), F.max("v").alias("most"))


def summary(per_series: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean, deviation and maximum over the series of a method."""
    j = per_series.join(groups, "series")
    return j.groupBy("method").agg(F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("sd"), F.max("most").alias("most"), F.count("*").alias("n"))


def id_digest(rows: DataFrame, column: str) -> DataFrame:
    """SHA-256 of the sorted distinct ids, one a line."""
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_set(column)), "\n"), 256).alias("digest"))
