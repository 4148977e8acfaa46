"""Approximate nearest neighbours by inner product: stable projections in a kd-tree, stopped by a chi-square test.

Vectors get one more component that makes all norms equal, so that the largest inner product is
the least Euclidean distance. A Gaussian (2-stable) projection to PROJECTED dimensions turns a squared
distance into itself times a chi-square variable. A kd-tree over the projections of all vectors is made once:
its upper part from a bounded sample (nothing but the choice of the cuts depends on it), the lower part within each of its
cells. A query takes the vectors in order of their projected distance, nearest first, and verifies them on
the original vectors, until the next one's projected distance is so far beyond the k-th verified
distance that a vector as near as that would lie there with a chance under 1 - SURE only.

The search goes by rounds: the query's own cell, then the cells whose boxes the test doesn't exclude, nearest first and
ever more at once. Only those cells get the query, so the work grows with what the test leaves, not with queries times vectors.

Equal vectors are indexed once, with the smallest of their ids (more could not be among the results).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, discard, stored

PROJECTED = 16
SURE = 0.95
SEED = 11
#: Vectors of a leaf, of a cell (as long as there are at most MOST_CELLS), and of a part of a cell that a task works on.
LEAF, CELL_ROWS, PART_ROWS = 64, 4096, 8192
#: Cells of the shared upper tree, which every task gets: their boxes take 256 bytes each.
MOST_CELLS = 16384
#: The upper tree's cuts come from at most so many projections.
SAMPLE_ROWS = 131_072
#: Queries that a task works on together.
QUERY_ROWS = 2048
#: Cells of a query's rounds, by nearness; the last round takes all that are left.
ROUNDS = (1, 4, 16, None)
#: Vectors verified in a first step; steps double.
STEP = 64
#: Vectors verified beyond k before the exact ranking, against rounding.
SPARE = 8


def chi_square_quantile(p: float, m: int) -> float:
    """The p-quantile of the chi-square distribution of an even number m of degrees of freedom."""

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 10.0 * m + 100
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


LIMIT = chi_square_quantile(SURE, PROJECTED)


def usable(v: Column) -> Column:
    """A vector without null or non-finite components that is not zero."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(v, lambda x: x != 0), F.lit(False))


def kd_leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of the leaves of a kd-tree, from left to right: halves along the widest dimension."""
    todo, out = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        part = points[at]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        half = np.argpartition(part[:, axis], len(at) // 2)
        todo += [at[half[len(at) // 2 :]], at[half[: len(at) // 2]]]
    return out


class Cells:
    """The upper tree: inner nodes cut a dimension, leaves are cells; every node has the box of its cells' vectors."""

    def __init__(self, points: np.ndarray, number: int) -> None:
        self.axis, self.cut, self.child = [], [], []
        size = max(1, len(points) // number)

        def node(at: np.ndarray, left: int) -> int:
            me = len(self.axis)
            self.axis.append(-1)
            self.cut.append(0.0)
            self.child.append([-1, -1])
            if left > 1 and len(at) > size:
                part = points[at]
                axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                cut = float(np.median(part[:, axis]))
                low = part[:, axis] < cut
                if low.any() and not low.all():
                    self.axis[me], self.cut[me] = axis, cut
                    self.child[me] = [node(at[low], left // 2), node(at[~low], left // 2)]
            return me

        node(np.arange(len(points)), 1 << max(0, math.ceil(math.log2(max(1, number)))))
        self.low = np.full((len(self.axis), PROJECTED), np.inf)
        self.high = np.full((len(self.axis), PROJECTED), -np.inf)

    def home(self, p: np.ndarray) -> np.ndarray:
        """The cell that each projection lies in, by the cuts."""
        out = np.zeros(len(p), np.int64)
        todo = [(0, np.arange(len(p)))]
        while todo:
            n, at = todo.pop()
            if self.axis[n] < 0:
                out[at] = n
                continue
            right = p[at, self.axis[n]] >= self.cut[n]
            todo += [(self.child[n][s], at[right == bool(s)]) for s in (0, 1) if (right == bool(s)).any()]
        return out

    def bound(self, cells: list[tuple[int, list[float], list[float]]]) -> None:
        """Sets the boxes from those of the cells."""
        for n, low, high in cells:
            self.low[n], self.high[n] = low, high
        for n in range(len(self.axis) - 1, -1, -1):  # children come after their parent
            for c in self.child[n]:
                if c >= 0:
                    self.low[n], self.high[n] = np.minimum(self.low[n], self.low[c]), np.maximum(self.high[n], self.high[c])

    def near(self, p: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells whose box has a squared distance up to ``within`` from each projection: query, cell, distance. A walk from the root."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        todo = [(0, np.arange(len(p)))]
        while todo:
            n, at = todo.pop()
            off = np.maximum(self.low[n] - p[at], 0) + np.maximum(p[at] - self.high[n], 0)
            gap = (off * off).sum(axis=1)
            keep = gap <= within[at]
            at, gap = at[keep], gap[keep]
            if not len(at):
                continue
            if self.axis[n] < 0:
                found.append((at, np.full(len(at), n), gap))
            else:
                todo += [(c, at) for c in self.child[n]]
        return tuple(np.concatenate(f) for f in zip(*found))


def projection(width: int) -> np.ndarray:
    """Gaussian numbers, one row for each component and one for the component that makes norms equal."""
    return np.random.default_rng(SEED).standard_normal((width + 1, PROJECTED))


def project(x: np.ndarray, most: float) -> np.ndarray:
    """Projections of vectors lifted to the squared norm ``most``."""
    a = projection(x.shape[1])
    return x @ a[:-1] + np.sqrt(np.maximum(most - np.einsum("ij,ij->i", x, x), 0))[:, None] * a[-1]


def search(x: np.ndarray, px: np.ndarray, leaves: np.ndarray, q: np.ndarray, far: np.ndarray, k: int, most: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of x (in order of leaves, which begin at ``leaves``) with the largest inner products for each q, and these products; how many were verified.

    ``far`` is the k-th squared distance that each query knows so far. Leaves that the test excludes are not opened; vectors of the
    others are taken in order of their projected distance.
    """
    k = min(k, len(x))
    pq = q @ projection(x.shape[1])[:-1]
    norms = np.einsum("ij,ij->i", q, q) + most
    low, high = np.minimum.reduceat(px, leaves), np.maximum.reduceat(px, leaves)
    owner = np.repeat(np.arange(len(leaves)), np.diff(np.r_[leaves, len(x)]))
    best, rows = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
    square = np.einsum("ij,ij->i", px, px)
    verified = 0
    for begin in range(0, len(q), 128):
        who = np.arange(begin, min(begin + 128, len(q)))
        gap = np.zeros((len(who), len(leaves)))
        for d in range(PROJECTED):
            off = np.maximum(low[:, d] - pq[who, d : d + 1], 0) + np.maximum(pq[who, d : d + 1] - high[:, d], 0)
            gap += off * off
        shut = gap > LIMIT * far[who, None]
        at = np.flatnonzero(~shut.all(axis=0)[owner])
        if not len(at):
            continue
        distance = np.maximum(square[at] + np.einsum("ij,ij->i", pq[who], pq[who])[:, None] - 2 * pq[who] @ px[at].T, 0)
        distance[shut[:, owner[at]]] = np.inf
        order = np.argsort(distance, axis=1)
        distance = np.take_along_axis(distance, order, axis=1)
        done, step = 0, STEP
        while len(who) and done < len(at):
            # The stopping test: the next projected distance against the k-th distance so far.
            kth = np.minimum(far[who], norms[who] - 2 * best[who].min(axis=1))
            limit = LIMIT * kth
            go = (distance[:, done] <= limit) & (distance[:, done] < np.inf)
            who, order, distance, limit = who[go], order[go], distance[go], limit[go]
            if not len(who):
                break
            part = at[order[:, done : done + step]]
            ok = (distance[:, done : done + step] <= limit[:, None]) & (distance[:, done : done + step] < np.inf)
            s = np.full(part.shape, -np.inf)
            i, j = np.nonzero(ok)
            verified += len(i)
            for b in range(0, len(i), 1 << 16):
                e = slice(b, b + (1 << 16))
                s[i[e], j[e]] = np.einsum("ij,ij->i", q[who[i[e]]], x[part[i[e], j[e]]])
            both = np.concatenate([best[who], s], axis=1)
            ids = np.concatenate([rows[who], np.where(ok, part, -1)], axis=1)
            top = np.argpartition(-both, k - 1, axis=1)[:, :k]
            best[who], rows[who] = np.take_along_axis(both, top, axis=1), np.take_along_axis(ids, top, axis=1)
            done += step
            step = min(2 * step, 1024)
    return rows, best, verified


_PLACES = "cell long, part int, leaf int, ids array<long>, v array<double>"
_FOUND = "query_id long, vec_id long, score double"


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_list()).astype(float)


def nearest(df: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", counter: Accumulator | None = None) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row whose key is divisible by ``every``, its k nearest found.

    Nearest is the largest inner product in double precision, ties to the smaller key; a row is no neighbour of its own
    key. Vectors that are null, zero, hold null or non-finite components, or have another length than
    most, and rows with a null key take no part. Repeated rows count once. With k or fewer candidates all are returned.
    Other columns are not read; an empty table gives an empty result. ``counter`` is given the number of verified vectors.
    """
    spark = df.sparkSession
    v = F.transform(col(vector), lambda x: x.cast("double"))
    rows = df.select(col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == size.n)
    # Equal vectors: the k + 1 smallest ids; Spark limits each task's rows of a vector before it shuffles them.
    ranked = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = stored(ranked.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")), "classes")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    most, n = classes.agg(F.max(norm), F.count("*")).first()
    most *= 1 + 1e-9
    number = max(1, min(MOST_CELLS, -(-n // CELL_ROWS)))
    # The sample: a share by hash.
    share = min(1.0, min(SAMPLE_ROWS, 64 * number) / n) if number > 1 else 0.0
    sample = classes.where(F.xxhash64("v", F.lit(SEED)) < F.lit(int(share * (1 << 64)) - (1 << 63))).limit(SAMPLE_ROWS).select("v").toPandas() if share else None
    tree = Cells(project(_matrix(sample["v"]), most) if share and len(sample) else np.zeros((0, PROJECTED)), number)

    def dealt(batches):
        for batch in batches:
            p = project(_matrix(batch["v"]), most)
            yield batch.assign(cell=tree.home(p))[["cell", "ids", "v"]]

    def built(rows: pd.DataFrame) -> pd.DataFrame:
        p = project(_matrix(rows["v"]), most)
        leaves = kd_leaves(p, LEAF)
        out = rows.iloc[np.concatenate(leaves)].assign(leaf=np.repeat(np.arange(len(leaves)), [len(at) for at in leaves]).astype(np.int32))
        return out[["cell", "part", "leaf", "ids", "v"]]

    placed = stored(classes.mapInPandas(dealt, "cell long, ids array<long>, v array<double>"), "placed")
    discard(classes)
    # A cell of more vectors than its share is worked on in parts, each a tree of its own.
    held = placed.groupBy("cell").count().withColumn("parts", F.ceil(F.col("count") / PART_ROWS).cast("int")).select("cell", "parts")
    parts = placed.join(held, "cell").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).select("cell", "part", "ids", "v")
    index = stored(parts.groupBy("cell", "part").applyInPandas(built, _PLACES), "index")

    def boxes(batches):
        for batch in batches:
            p = project(_matrix(batch["v"]), most)
            cells, at = np.unique(batch["cell"].to_numpy(), return_inverse=True)
            low, high = np.full((len(cells), PROJECTED), np.inf), np.full((len(cells), PROJECTED), -np.inf)
            np.minimum.at(low, at, p)
            np.maximum.at(high, at, p)
            yield pd.DataFrame({"cell": cells, "low": list(low), "high": list(high)})

    sides = placed.mapInPandas(boxes, "cell long, low array<double>, high array<double>")
    edge = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(PROJECTED)])
    tree.bound([tuple(r) for r in sides.groupBy("cell").agg(edge(F.min, "low"), edge(F.max, "high")).collect()])  # at most MOST_CELLS rows
    held = stored(held, "held")
    discard(placed)

    # A query: its id, vector, the k-th squared distance so far and how many cells it has seen.
    asked = stored(rows.where(F.col("id") % every == 0).select("id", "v").distinct().select("id", "v", F.lit(float("inf")).alias("far"), F.lit(0).alias("seen")), "asked")
    found = spark.createDataFrame([], _FOUND)

    def routed(most_cells: int | None):
        def run(batches):
            a = projection(size.n)[:-1]
            for batch in batches:
                q, far, seen = _matrix(batch["v"]), batch["far"].to_numpy(), batch["seen"].to_numpy()
                who, cell, gap = tree.near(q @ a, LIMIT * far) if (seen > 0).any() else (np.arange(len(q)), tree.home(q @ a), np.zeros(len(q)))
                if (seen > 0).any():  # all but the first round, which saw the own cell: the nearest others that the query has not seen
                    other = cell != tree.home(q @ a)[who]
                    who, cell, gap = who[other], cell[other], gap[other]
                    order = np.lexsort((cell, gap, who))
                    who, cell = who[order], cell[order]
                    place = np.arange(len(who)) - np.searchsorted(who, np.arange(len(q)))[who] + 1
                    keep = (place >= seen[who]) & (place < (seen[who] + most_cells if most_cells else len(tree.axis)))
                    who, cell = who[keep], cell[keep]
                yield pd.DataFrame({"cell": cell, "id": batch["id"].to_numpy()[who], "v": batch["v"].to_numpy()[who], "far": far[who]})

        return run

    def verified(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        x = x.sort_values("leaf", kind="stable")
        xs, qs, leaf = _matrix(x["v"]), _matrix(q["v"]), x["leaf"].to_numpy()
        at, _, n_verified = search(xs, project(xs, most), np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]), qs, q["far"].to_numpy(), k + 1 + SPARE, most)
        if counter is not None:
            counter.add(n_verified)
        who, place = np.nonzero(at >= 0)
        hit = at[who, place]
        score = np.einsum("ij,ij->i", qs[who], xs[hit])
        ids = x["ids"].to_list()
        counts = np.array([len(i) for i in ids])
        flat, first = np.concatenate(ids), np.r_[0, np.cumsum(counts)[:-1]]
        many = counts[hit]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out = pd.DataFrame({"who": np.repeat(who, many), "vec_id": flat[np.repeat(first[hit], many) + inner], "score": np.repeat(score, many)})
        out["query_id"] = q["id"].to_numpy()[out["who"]]
        out = out[out["query_id"] != out["vec_id"]].sort_values(["who", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        return out.groupby("who", sort=False).head(k)[["query_id", "vec_id", "score"]]

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda rows: rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    seen = 0
    for most_cells in ROUNDS[: 1 if number == 1 else len(ROUNDS)]:
        sent = stored(asked.mapInPandas(routed(most_cells), "cell long, id long, v array<double>, far double"), "routed")
        # Queries of a cell are dealt to chunks; each part of the cell meets each chunk.
        chunks = sent.groupBy("cell").count().select("cell", F.ceil(F.col("count") / QUERY_ROWS).cast("int").alias("chunks"))
        spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = index.join(chunks, "cell").withColumn("chunk", spread(F.col("chunks"))).drop("chunks")
        right = sent.join(chunks, "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks").join(held, "cell").withColumn("part", spread(F.col("parts"))).drop("parts")
        pairs = left.groupBy("cell", "part", "chunk").cogroup(right.groupBy("cell", "part", "chunk")).applyInPandas(verified, _FOUND)
        before, found = found, stored(top(found.union(pairs)).select("query_id", "vec_id", "score"), "found")
        if seen:
            discard(before)
        discard(sent)
        seen += most_cells or 0
        if most_cells is None or number == 1:
            break
        # The distance of the k-th: |q|^2 + most - 2 score. A query that has fewer knows none yet.
        kth = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
        norm_q = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        known = asked.join(kth, asked.id == kth.query_id, "left")
        far = F.coalesce(F.greatest(norm_q + most - 2 * F.col("least"), F.lit(0.0)), F.lit(float("inf")))
        before, asked = asked, stored(known.select("id", "v", far.alias("far"), F.lit(seen).alias("seen")), "asked")
        discard(before)
    return top(found).select("query_id", "rank", "vec_id", "score")
