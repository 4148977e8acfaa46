"""The tables as spatial data: DataFrames, and the same views as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.operators import grid
from tesselark.sources.files import materialised

ROI = [(63, 61), (417, 93), (452, 404), (243, 467), (56, 298)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points of features: positions from quantity and order, quality from tax, distance from discount."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return items.select(
        (F.col("l_quantity") * 10).alias("x"), ((F.col("l_orderkey") % 50 + 1) * F.lit(10.0)).alias("y"), F.col("p_brand").alias("feature"),
        F.round(F.col("l_tax") * 500).alias("qv"), F.round(F.col("l_discount") * 300).alias("nucleus_distance"),
    )


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.filter_points(molecules(spark, sf_dir))


def bin_counts(spark: SparkSession, sf_dir: str, size: float = 50) -> DataFrame:
    """Counts on complete tiles."""
    points = kept(spark, sf_dir)
    limits = grid.bounds(points)
    return grid.on_lattice(grid.count_bins(grid.bin_points(points, limits, size)), grid.lattice(limits, size))


_scope: ContextVar[dict | None] = ContextVar("scope", default=None)


@contextmanager
def one_query():
    """Within it, tables that a query uses several times are made and written once."""
    token = _scope.set({})
    try:
        yield
    finally:
        _scope.reset(token)


def once(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of that name, written to the shared folder when it is first asked for in a query."""
    held = _scope.get()
    if held is None:
        return make()
    if name not in held:
        held[name] = materialised(make(), name)
    return held[name]


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts, for queries that need them several times: points are read and binned once."""
    return once(spark, "bins", lambda: bin_counts(spark, sf_dir))


def z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.z_scores(grid.row_normalise(bins(spark, sf_dir)))


def brand_number(column: str):
    return F.regexp_extract(column, "([0-9]+)$", 1).cast("int")


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature")).distinct().withColumn("num", brand_number("feature"))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands(spark, sf_dir).select("feature", F.when(F.col("num") % 6 == 0, -1).otherwise(F.col("num") % 5).cast("int").alias("module"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = brands(spark, sf_dir).select("feature", "num", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("run"))
    return runs.select("run", "feature", F.floor((F.col("num") * (F.col("run") + 3)) % 7 / 2).cast("int").alias("label"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of brands with a score from the number of orders they share; made once in a query."""
    return once(spark, "interactions", lambda: _interactions(spark, sf_dir))


def _interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    # An order's brands are one sorted row, so pairs need no join of the orders with themselves and are counted before they travel.
    sets = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("p_brand")).alias("brands"))
    firsts = sets.select("brands", F.posexplode("brands").alias("i", "p"))
    both = firsts.select("p", F.explode(F.slice("brands", F.col("i") + 2, F.size("brands"))).alias("q")).groupBy("p", "q").agg(F.count("*").alias("c"))
    return both.where((brand_number("p") + brand_number("q")) % 4 != 0).select("p", "q", (F.col("c") * 37 % 1000).cast("int").alias("score"))


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands(spark, sf_dir).select("feature", F.when(F.col("num") % 11 != 0, F.concat(F.lit("P"), "num")).alias("id"))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interactions with ids in place of brands."""
    i = interactions(spark, sf_dir)
    return i.select(F.concat(F.lit("P"), brand_number("p")).alias("p"), F.concat(F.lit("P"), brand_number("q")).alias("q"), "score")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of brands by customer."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return items.groupBy(F.col("o_custkey").alias("cell"), F.col("p_brand").alias("feature")).agg(F.count("*").alias("n"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cumulative CPU time (whole microseconds) and memory of their users."""
    from pyspark.sql.window import Window

    running = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("series"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.sum(F.round(F.col("value") * 1e6).cast("long")).over(running).alias("cpu_usec"), (F.col("value") * 1048576).alias("mem_bytes"))


# The views in SQL, written apart from the code above.
SQL = {
    "mol": "SELECT l_quantity*10 AS x, CAST(l_orderkey % 50 + 1 AS DOUBLE)*10 AS y, p_brand AS feature, round(l_tax*500) AS qv, round(l_discount*300) AS nd FROM lineitem JOIN part ON l_partkey = p_partkey",
    "kept": "SELECT x, y, feature FROM mol WHERE qv >= 20 AND nd <= 25",
    "lim": "SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM kept",
    "binned": "SELECT CAST(floor((x - floor(xmin/50)*50)/50) + 1 AS INTEGER) AS gx, CAST(floor((y - floor(ymin/50)*50)/50) + 1 AS INTEGER) AS gy, feature FROM kept, lim",
    "lat": "SELECT CAST(i AS INTEGER) AS gx, CAST(j AS INTEGER) AS gy FROM lim, range(1, 1000) a(i), range(1, 1000) b(j) WHERE floor(xmin/50)*50 + i*50 <= xmax AND floor(ymin/50)*50 + j*50 <= ymax",
    "cnt": "SELECT gx, gy, feature, count(*) AS n FROM binned JOIN lat USING (gx, gy) GROUP BY ALL",
    "rown": "SELECT gx, gy, feature, n / sum(n) OVER (PARTITION BY gx, gy) AS v FROM cnt",
    "bins": "SELECT DISTINCT gx, gy FROM cnt",
    "dense": "SELECT gx, gy, feature, coalesce(v, 0) AS v FROM bins CROSS JOIN (SELECT DISTINCT feature FROM cnt) LEFT JOIN rown USING (gx, gy, feature)",
    "z": "SELECT gx, gy, feature, CASE WHEN stddev_samp(v) OVER f <= 1e-12 THEN 0 ELSE (v - avg(v) OVER f) / stddev_samp(v) OVER f END AS z FROM dense WINDOW f AS (PARTITION BY feature)",
    "w": "SELECT a.gx, a.gy, b.gx AS hx, b.gy AS hy, CAST(1 AS DOUBLE) AS w FROM bins a JOIN bins b ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND NOT (a.gx = b.gx AND a.gy = b.gy)",
    "lag": "SELECT w.gx, w.gy, feature, sum(w * z) AS wz FROM w JOIN z ON z.gx = hx AND z.gy = hy GROUP BY ALL",
    "norms": "SELECT feature, sqrt(sum(z*z)) AS norm FROM z GROUP BY 1",
    "k": "SELECT (SELECT count(*) FROM bins) AS n, (SELECT sum(w) FROM w) AS s0",
    "num": "SELECT z.feature AS a, lag.feature AS b, sum(z * wz) AS num FROM z JOIN lag USING (gx, gy) GROUP BY ALL",
    "assoc": "SELECT p.feature AS a, q.feature AS b, CASE WHEN p.norm * q.norm = 0 THEN 0 ELSE n / s0 * coalesce(num, 0) / (p.norm * q.norm) END AS l FROM norms p CROSS JOIN norms q CROSS JOIN k LEFT JOIN num ON num.a = p.feature AND num.b = q.feature",
    "brands": "SELECT DISTINCT p_brand AS feature, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS num FROM part",
    "modules": "SELECT feature, CAST(CASE WHEN num % 6 = 0 THEN -1 ELSE num % 5 END AS INTEGER) AS module FROM brands",
    "mods": "SELECT * FROM modules WHERE module >= 0",
    "runlabels": "SELECT CAST(r AS INTEGER) AS run, feature, CAST(floor((num * (r + 3)) % 7 / 2) AS INTEGER) AS label FROM brands, range(0, 10) t(r)",
    "ordersets": "SELECT DISTINCT l_orderkey, p_brand AS p FROM lineitem JOIN part ON l_partkey = p_partkey",
    "inter": "SELECT x.p AS p, y.p AS q, CAST(count(*) * 37 % 1000 AS INTEGER) AS score FROM ordersets x JOIN ordersets y ON x.l_orderkey = y.l_orderkey AND x.p < y.p JOIN brands bx ON bx.feature = x.p JOIN brands bq ON bq.feature = y.p WHERE (bx.num + bq.num) % 4 <> 0 GROUP BY 1, 2",
    "cellcnt": "SELECT o_custkey AS cell, p_brand AS feature, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "smp": "SELECT user_id AS series, epoch_us(ts)/1e6 AS t, CAST(sum(CAST(round(value*1e6) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cpu_usec, value*1048576 AS mem_bytes FROM events",
    # Scored edges: association of pairs a < b as one method, overlap of bins as another.
    "jac": "SELECT a.feature AS a, b.feature AS b, coalesce(c, 0) / (a.k + b.k - coalesce(c, 0)) AS j FROM (SELECT feature, count(*) AS k FROM cnt GROUP BY 1) a JOIN (SELECT feature, count(*) AS k FROM cnt GROUP BY 1) b ON a.feature < b.feature LEFT JOIN (SELECT x.feature AS fa, y.feature AS fb, count(*) AS c FROM cnt x JOIN cnt y USING (gx, gy) GROUP BY ALL) ON fa = a.feature AND fb = b.feature",
    "edges": "SELECT 'm1' AS method, a, b, round(l, 6) AS weight FROM assoc WHERE a < b UNION ALL SELECT 'm2', a, b, round(j, 6) FROM jac",
    "lab": "SELECT method, a, b, weight, CASE WHEN x.num % 11 <> 0 AND y.num % 11 <> 0 THEN coalesce(score, 0) END AS score FROM edges JOIN brands x ON x.feature = a JOIN brands y ON y.feature = b LEFT JOIN inter ON p = a AND q = b",
    "cur": "SELECT method, a, b, weight, score >= 700 AS label, row_number() OVER o AS k, sum(CAST(score >= 700 AS INT)) OVER (PARTITION BY method ORDER BY weight DESC, a, b ROWS UNBOUNDED PRECEDING) AS tp, sum(CAST(score >= 700 AS INT)) OVER m AS pos, count(*) OVER m AS n FROM lab WHERE score IS NOT NULL WINDOW o AS (PARTITION BY method ORDER BY weight DESC, a, b), m AS (PARTITION BY method)",
    "medges": "SELECT a, b, l AS weight FROM assoc WHERE a < b AND l > 0",
    "mends": "SELECT weight, x.module = y.module AS ins, a, b, x.module AS ma, y.module AS mb FROM medges JOIN mods x ON x.feature = a JOIN mods y ON y.feature = b",
}
NEEDS = list(SQL)


def sql(select: str) -> str:
    """``select`` after those views, in order, that it or another of its views names."""
    import re

    if select.startswith("WITH"):
        select = f"SELECT * FROM ({select})"
    found: set[str] = set()
    todo = [select]
    while todo:
        text = todo.pop()
        for name in NEEDS:
            if name not in found and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                found.add(name)
                todo.append(SQL[name])
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in NEEDS if n in found) + "\n" + select if found else select
