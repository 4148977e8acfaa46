"""Queries that put pair statistics into a layer store and look them up again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselark.operators import association as A
from tesselark.operators import benchmark as B
from tesselark.operators import grid as G
from tesselark.plans import catalog as C
from tesselark.plans import views as V
from tesselark.plans.catalog import query, r6
from tesselark.sources.files import scratch
from tesselark.sources.layers import LayerStore


def _store(s, d) -> LayerStore:
    store = LayerStore(s, scratch(s, "layers"))
    store.put(C._assoc(s, d).where("a < b"), "grid", "association", "l")
    store.put(A.pearson(G.row_normalise(V.bins(s, d)), ["gx", "gy"]), "grid", "correlation", "r")
    store.put(A.pearson(V.cells(s, d).withColumn("v", F.lit(0.0) + F.col("n")), ["cell"]), "cell", "correlation", "r")
    # Written again: only this partition is replaced.
    store.put(A.pearson(G.log_cpm(V.cells(s, d)), ["cell"]), "cell", "correlation", "r")
    return store


@query(
    "SELECT 'cell' AS level, 'correlation' AS layer, a, b, r AS value FROM (" + C.SQL["cell_correlation"] + ") UNION ALL SELECT 'grid', 'correlation', a, b, " + r6(value="r")
    + " FROM (SELECT p.feature AS a, q.feature AS b, corr(p.v, q.v) AS r FROM dense p JOIN dense q USING (gx, gy) WHERE p.feature < q.feature GROUP BY ALL)"
)
def layers_looked_up(s, d):
    wanted = s.createDataFrame([("cell", "correlation"), ("grid", "correlation"), ("grid", "absent")], "level string, layer string")
    return _store(s, d).lookup(wanted).select("level", "layer", "a", "b", "value")


@query("SELECT a, b, " + r6(weight="l", association="l", cell_r="r", score="score") + " FROM (SELECT a, b, l, CAST(score AS DOUBLE) AS score FROM assoc LEFT JOIN inter ON p = a AND q = b WHERE a < b AND l > 0) LEFT JOIN (SELECT a, b, r FROM (" + C.SQL["cell_correlation"] + ")) USING (a, b)")
def edges_with_layers(s, d):
    """Edges take values of layers, the reference's scores being put back as one of them."""
    store = _store(s, d)
    edges = C._edges(s, d).select("a", "b", "weight")
    scored = B.label_edges(edges, V.brands(s, d).select("feature", F.col("feature").alias("id")), V.interactions(s, d)).where("score > 0")
    store.put(scored, "reference", "score", "score")
    out = store.pairs(edges, "grid", "lee", "association").withColumnRenamed("value", "association")
    out = store.pairs(out, "cell", "correlation").withColumnRenamed("value", "cell_r")
    return store.pairs(out, "reference", "score").withColumnRenamed("value", "score").select("a", "b", "weight", "association", "cell_r", "score")
