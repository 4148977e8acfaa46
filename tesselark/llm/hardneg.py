"""Hard negatives for anchors: rows of another label whose inner product lies just under that of a positive.

Rows are dealt to cells by the nearest of some pivots, and each part of a cell holds a ball tree: a node is a range of rows with a
centre and a radius, so the inner product of an anchor with any of its rows lies within |anchor| * radius of that with the centre. Nodes
are split between labels first, by their widest dimension then. A search walks the tree for many anchors at once: it first
goes down to one leaf to learn a k-th score, then drops every node whose upper bound is under the score window or strictly under the
k-th score, or whose lower bound is over the window, and opens what is left by the best upper bound first. Rounding is allowed for
by a margin on the bounds; scores themselves are whole numbers.

Equal vectors of one label are indexed once, with the smallest of their ids (no more could be among the results), and searched for once
for a block of anchors; so a vector that a third of the rows share costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stored
from .vectors import matrix, whole

#: Rows of a leaf, of a cell (as long as there are at most MOST_CELLS), and of a part of a cell that a task works on.
LEAF, CELL_ROWS, PART_ROWS = 32, 2048, 8192
#: Pivots of the cells; every task gets them all.
MOST_CELLS = 4096
#: Anchors that a task works on together, and that share one search if their vectors are equal.
BLOCK = 1024
#: Anchors and leaves that are compared at once.
PAIRS = 2048
NONE = -(1 << 62)


class BallTree:
    """Rows in order of the leaves; nodes with their balls and the range of their labels."""

    def __init__(self, x: np.ndarray, label: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.argsort(label, kind="stable")
        f = x.astype(float)
        begin, end, child, centre, radius, low, high = [], [], [], [], [], [], []

        def node(b: int, e: int) -> int:
            at = self.order[b:e]
            part = f[at]
            m = part.mean(axis=0)
            begin.append(b), end.append(e), child.append((-1, -1)), centre.append(m), low.append(label[at].min()), high.append(label[at].max())
            radius.append(float(np.sqrt(((part - m) ** 2).sum(axis=1).max())))
            return len(begin) - 1

        todo = [node(0, len(x))]
        while todo:
            n = todo.pop()
            b, e = begin[n], end[n]
            if e - b <= leaf:
                continue
            at = self.order[b:e]
            turns = np.flatnonzero(np.diff(label[at])) + 1  # rows of a node stand in order of their labels
            if len(turns):
                half = int(turns[np.argmin(np.abs(turns - (e - b) // 2))])
            else:
                part, half = f[at], (e - b) // 2
                axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                self.order[b:e] = at[np.argpartition(part[:, axis], half)]
            child[n] = (node(b, b + half), node(b + half, e))
            todo += child[n]
        self.begin, self.end, self.child = np.array(begin), np.array(end), np.array(child)
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.low, self.high = np.array(low), np.array(high)
        self.x, self.label = x[self.order], label[self.order]

    def bounds(self, q: np.ndarray, norm: np.ndarray, who: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest inner product that rows of the nodes may have, with room for rounding."""
        dot = np.einsum("ij,ij->i", q[who], self.centre[node])
        swing = norm[who] * self.radius[node]
        room = 1e-9 * (np.abs(dot) + norm[who] * np.sqrt((self.centre[node] ** 2).sum(axis=1)) + swing) + 0.5
        return dot - swing - room, dot + swing + room

    def search(self, q: np.ndarray, label: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """For each query and each of its windows (low..high, by column) the k rows of the greatest scores within it, ties by ids: rows, scores
        (NONE where there are fewer), and how many rows were scored. Rows are places in the order that the tree was given."""
        ids = ids[self.order]
        f = q.astype(float)
        norm = np.sqrt((f**2).sum(axis=1))
        windows = low.shape[1]
        best = np.full((len(q), windows, k), NONE, np.int64)
        rows = np.full((len(q), windows, k), -1, np.int64)
        scored = 0

        def open_(who: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Whether a node may hold a result, and its upper bound."""
            inside = (self.low[node] <= label[who]) & (label[who] <= self.high[node])
            fits = inside if same else ~(inside & (self.low[node] == self.high[node]))
            down, up = self.bounds(f, norm, who, node)
            some = (up[:, None] >= np.maximum(low[who], best[who, :, -1])) & (down[:, None] <= high[who])
            return fits & some.any(axis=1), up

        def compare(who: np.ndarray, leaf: np.ndarray) -> None:
            """Each query once with one leaf."""
            nonlocal scored
            for b in range(0, len(who), PAIRS):
                w, n = who[b : b + PAIRS], leaf[b : b + PAIRS]
                at = self.begin[n][:, None] + np.arange(int((self.end[n] - self.begin[n]).max()))
                there = at < self.end[n][:, None]
                at = np.where(there, at, 0)
                there &= (self.label[at] == label[w][:, None]) == same
                scored += int(there.sum())
                s = np.einsum("ij,ikj->ik", q[w], self.x[at])
                s = np.rint(s).astype(np.int64) if s.dtype == float else s
                for j in range(windows):
                    ok = there & (s >= np.maximum(low[w, j], best[w, j, -1])[:, None]) & (s <= high[w, j][:, None])
                    hit = np.flatnonzero(ok.any(axis=1))
                    if not len(hit):
                        continue
                    v = w[hit]
                    both = np.concatenate([best[v, j], np.where(ok[hit], s[hit], NONE)], axis=1)
                    where = np.concatenate([rows[v, j], np.where(ok[hit], at[hit], -1)], axis=1)
                    top = np.lexsort((ids[where], -both), axis=1)[:, :k]
                    best[v, j], rows[v, j] = np.take_along_axis(both, top, axis=1), np.take_along_axis(where, top, axis=1)

        # One leaf for each query: the child of the better upper bound each time.
        who, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        first = np.full(len(q), -1)
        while len(who):
            inner = self.child[node, 0] >= 0
            first[who[~inner]] = node[~inner]
            who, node = who[inner], node[inner]
            a, b = self.child[node, 0], self.child[node, 1]
            (fa, ua), (fb, ub) = open_(who, a), open_(who, b)
            node = np.where((fa & (ua >= ub)) | ~fb, a, b)
        compare(np.arange(len(q)), first)
        # All nodes that may still hold something, down to the leaves.
        who, node, leaves = np.arange(len(q)), np.zeros(len(q), np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        while len(who):
            keep, up = open_(who, node)
            who, node, up = who[keep], node[keep], up[keep]
            end = self.child[node, 0] < 0
            new = end & (node != first[who])
            leaves.append((who[new], node[new], up[new]))
            who, node = who[~end], node[~end]
            who, node = np.repeat(who, 2), self.child[node].reshape(-1)
        who, node, up = (np.concatenate(c) for c in zip(*leaves))
        order = np.lexsort((-up, who))
        who, node = who[order], node[order]
        turn = np.arange(len(who)) - np.searchsorted(who, who)
        for t in range(int(turn.max()) + 1 if len(turn) else 0):
            w, n = who[turn == t], node[turn == t]
            keep, _ = open_(w, n)
            compare(w[keep], n[keep])
        return np.where(rows >= 0, self.order[rows], -1), best, scored


def _frame(v: pd.Series, exact: bool) -> np.ndarray:
    """Whole numbers as doubles where those hold every score exactly."""
    x = np.stack(v.to_list())
    return x if not exact else x.astype(float)


_INDEX = "cell int, part int, label {kind}, v array<long>, ids array<long>"
_QUERY = "cell int, qid long, label {kind}, v array<long>, low array<long>, high array<long>, window array<long>"
_FOUND = "qid long, window long, vec_id long, score long"


class _Index:
    """Classes of equal vectors of a label, dealt to cells, in the shared folder; and the search of queries in it."""

    def __init__(self, rows: DataFrame, keep: int, counter: Accumulator | None) -> None:
        self.spark, self.kind, self.counter = rows.sparkSession, rows.schema["label"].dataType.simpleString(), counter
        # Spark limits each task's rows of a class before it shuffles them.
        ranked = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("label", "v").orderBy("id"))).where(F.col("r") <= keep)
        classes = stored(ranked.groupBy("label", "v").agg(F.array_sort(F.collect_set("id")).alias("ids")), "classes")
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        n, most = classes.agg(F.count("*"), F.max(norm)).first()
        self.empty = n == 0
        if self.empty:
            return
        if most >= 2.0**55:
            raise ValueError("components are too large for scores in 64 bits")
        self.exact = exact = most < 2.0**52  # whether doubles hold every partial sum of a score
        number = max(1, min(MOST_CELLS, -(-n // CELL_ROWS)))
        # Which vectors are pivots only decides who shares a cell.
        chosen = classes.select("v").distinct().orderBy(F.xxhash64("v", F.lit(7)), "v").limit(number).collect()
        self.pivots = pivots = np.array([r.v for r in chosen], float).reshape(len(chosen), -1)
        width = pivots.shape[1]

        def dealt(batches):
            square = (pivots**2).sum(axis=1)
            for batch in batches:
                x = matrix(batch.column("v"), width).astype(float)
                d = square - 2 * x @ pivots.T
                cell = d.argmin(axis=1)
                far = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
                yield _arrow(batch, cell, far)

        placed = stored(classes.mapInArrow(dealt, f"cell int, far double, label {self.kind}, v array<long>, ids array<long>"), "dealt")
        discard(classes)
        sides = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # at most MOST_CELLS rows
        self.radius = np.full(len(pivots), -np.inf)
        for s in sides:
            self.radius[s.cell] = s.far
        self.parts = F.broadcast(self.spark.createDataFrame([(s.cell, -(-s.n // PART_ROWS)) for s in sides], "cell int, parts int"))
        part = F.pmod(F.xxhash64("v", "label"), F.col("parts")).cast("int")
        self.rows = stored(placed.join(self.parts, "cell").select("cell", part.alias("part"), "label", "v", "ids"), "cells")
        discard(placed)

    def search(self, queries: DataFrame, same: bool, k: int, home: bool | None) -> DataFrame:
        """Rows (qid, window, vec_id, score): up to k ids of each query's windows from every part that may hold any.

        home: only the nearest pivot's cell (True), all others (False) or all cells (None).
        """
        pivots, radius, kind, exact, counter = self.pivots, self.radius, self.kind, self.exact, self.counter

        def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            square, size = (pivots**2).sum(axis=1), np.sqrt((pivots**2).sum(axis=1))
            for f in batches:
                q = np.stack(f["v"].to_list()).astype(float)
                dot = q @ pivots.T
                own = (square - 2 * dot).argmin(axis=1)
                norm = np.sqrt((q**2).sum(axis=1))[:, None]
                swing = norm * radius
                room = 1e-9 * (np.abs(dot) + norm * size + np.abs(swing)) + 0.5
                least = np.array([min(v) if len(v) else np.inf for v in f["low"]])[:, None]
                most = np.array([max(v) if len(v) else -np.inf for v in f["high"]])[:, None]
                go = (dot + swing + room >= least) & (dot - swing - room <= most) & np.isfinite(radius)
                mine = np.arange(len(pivots)) == own[:, None]
                go &= mine if home is True else ~mine if home is False else True
                who, cell = np.nonzero(go)
                yield f.iloc[who].assign(cell=cell.astype(np.int32))[["cell", "qid", "label", "v", "low", "high", "window"]]

        def found(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(q):
                return pd.DataFrame({"qid": np.empty(0, np.int64), "window": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})
            codes = pd.factorize(pd.concat([x["label"], q["label"]], ignore_index=True))[0]
            xl, ql = codes[: len(x)], codes[len(x) :]
            ids = x["ids"].to_list()
            tree = BallTree(_frame(x["v"], exact), xl)
            windows = max(map(len, q["low"]))
            pad = lambda name, v: np.array([[*w, *[v] * (windows - len(w))] for w in q[name]], np.int64)
            rows, scores, scored = tree.search(_frame(q["v"], exact), ql, same, pad("low", 1), pad("high", 0), np.array([i[0] for i in ids]), k)  # 1..0 holds nothing
            if counter is not None:
                counter.add(scored)
            who, window, _ = at = np.nonzero(rows >= 0)
            hit, score = rows[at], scores[at]
            names = q["window"].to_list()
            many = np.array([len(ids[h]) for h in hit], int)
            rep = np.repeat(np.arange(len(hit)), many)
            out = pd.DataFrame({
                "qid": q["qid"].to_numpy()[who[rep]], "window": np.array([names[i][j] for i, j in zip(who, window)], np.int64)[rep],
                "vec_id": np.concatenate([ids[h] for h in hit]) if len(hit) else np.empty(0, np.int64), "score": score[rep],
            })
            out = out.sort_values(["qid", "window", "score", "vec_id"], ascending=[True, True, False, True])
            return out.groupby(["qid", "window"], sort=False).head(k)

        sent = stored(queries.mapInPandas(routed, _QUERY.format(kind=kind)), "sent")
        # Queries of a cell are dealt to chunks; each part of the cell meets each chunk.
        chunks = sent.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
        spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = self.rows.join(chunks, "cell").withColumn("chunk", spread(F.col("chunks"))).drop("chunks")
        right = sent.join(chunks, "cell").withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int")).drop("chunks").join(self.parts, "cell").withColumn("part", spread(F.col("parts"))).drop("parts")
        pairs = left.groupBy("cell", "part", "chunk").cogroup(right.groupBy("cell", "part", "chunk")).applyInPandas(found, _FOUND)
        best = Window.partitionBy("qid", "window").orderBy(F.desc("score"), "vec_id")
        out = stored(pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"), "hits")
        discard(sent)
        return out


def _arrow(batch, cell: np.ndarray, far: np.ndarray):
    import pyarrow as pa

    cols = [pa.array(cell.astype(np.int32)), pa.array(far), batch.column("label"), batch.column("v"), batch.column("ids")]
    return pa.RecordBatch.from_arrays(cols, names=["cell", "far", "label", "v", "ids"])


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100, share: tuple[int, int] = (80, 100), counter: Accumulator | None = None) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score), from rows (id, label, v) of whole numbers.

    Anchors are the rows whose id is divisible by ``every``; an anchor's positives the first rows of its label by score (ties by id), its
    negatives the first rows of other labels with share[0] * positive <= share[1] * negative <= share[1] * positive. Rows of an
    anchor's own id are no partners of it. Rows with a null id, label or vector take no part; repeated rows count once. An anchor without positives or
    a positive without negatives gives no row. An empty table gives an empty result. Vectors whose squared norms reach 2**55 raise
    ValueError. ``counter`` is given the number of scores computed.
    """
    spark = rows.sparkSession
    rows = stored(rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").select("id", "label", "v"), "rows")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    k = max(positives, negatives) + 1  # one may be the anchor itself
    index = _Index(rows, k, counter)
    if index.empty:
        return spark.createDataFrame([], schema)
    anchors = rows.where(F.col("id") % every == 0)
    # Anchors of equal vectors and labels are one query, in blocks so that none grows with the table.
    blocks = max(1, -(-anchors.count() // BLOCK))
    grouped = anchors.groupBy("label", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_set("id").alias("anchors"))
    asked = stored(grouped.select(F.monotonically_increasing_id().alias("qid"), "label", "v", "anchors"), "asked")
    discard(rows)
    one = lambda v: F.array(F.lit(v).cast("long"))
    first = index.search(asked.select("qid", "label", "v", one(NONE + 1).alias("low"), one(-NONE).alias("high"), one(0).alias("window")), True, positives + 1, True)
    kth = first.groupBy("qid").agg(F.when(F.count("*") > positives, F.min("score")).alias("least"))
    known = asked.join(kth, "qid", "left")
    rest = index.search(known.select("qid", "label", "v", F.array(F.coalesce("least", F.lit(NONE + 1))).alias("low"), one(-NONE).alias("high"), one(0).alias("window")), True, positives + 1, False)
    by_score = lambda p, n: F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("score"), F.col("vec_id").alias("id"))))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    near = first.union(rest).withColumn("r", F.row_number().over(best)).where(F.col("r") <= positives + 1)
    ranked = stored(near.groupBy("qid").agg(by_score("score", "vec_id").alias("p")), "positives")
    discard(first), discard(rest)
    a, b = share
    scores = F.array_distinct(F.transform("p", lambda p: -p["score"]))
    # The least score of a window: a * positive / b, rounded up.
    windows = asked.join(ranked, "qid").select("qid", "label", "v", F.transform(scores, lambda s: F.ceil(s * a / F.lit(b).cast("decimal(20,0)")).cast("long")).alias("low"), scores.alias("high"), scores.alias("window"))
    hard = index.search(windows, False, negatives + 1, None)
    discard(index.rows)
    lists = hard.groupBy("qid", "window").agg(by_score("score", "vec_id").alias("n"))
    both = asked.join(ranked, "qid").select("qid", F.explode("anchors").alias("anchor_id"), "p")
    own = both.select("qid", "anchor_id", F.explode(F.slice(F.filter("p", lambda p: p["id"] != F.col("anchor_id")), 1, positives)).alias("p"))
    pairs = own.select("qid", "anchor_id", F.col("p.id").alias("positive_id"), (-F.col("p.score")).alias("window")).join(lists, ["qid", "window"])
    out = pairs.select("anchor_id", "positive_id", F.col("window").alias("positive_score"), F.posexplode(F.slice(F.filter("n", lambda n: n["id"] != F.col("anchor_id")), 1, negatives)).alias("rank", "n"))
    return out.select("anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.score")).alias("negative_score"))


def from_table(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """Rows (id, label, v) for ``mine``: components floored after scaling. Rows without a finite vector, or of another length than most, go."""
    return whole(df, key, vector, label, scale)


ORACLE_SQL = """WITH kept AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""
