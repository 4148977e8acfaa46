"""Partitions of feature graphs by local moving in rounds of joins, hierarchical clusters, rewired nulls.

Only Ward's clusters collect a graph, of at most MOST_FEATURES features; more raise an error.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselark.operators.trees import components
from tesselark.sources.files import materialised

MOST_EDGES = 5_000_000
#: Dense similarities are worked on for at most so many features.
MOST_FEATURES = 5000
#: Edges of a slot of a rewiring, on average.
SLOT = 16


def _local(edges: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    e = edges.select("a", "b", "weight").where("a <> b AND weight > 0").limit(MOST_EDGES + 1).toPandas()
    if len(e) > MOST_EDGES:
        raise ValueError(f"the graph has more than {MOST_EDGES} edges; filter it first")
    names = sorted(set(e.a) | set(e.b))
    at = {n: i for i, n in enumerate(names)}
    lo, hi = np.array([at[v] for v in e.a], int), np.array([at[v] for v in e.b], int)
    order = np.lexsort((hi, lo))
    return names, lo[order], hi[order], e.weight.to_numpy(float)[order]


def _best(adjacent: DataFrame, state: DataFrame) -> DataFrame:
    """For every node its group of the greatest gain among its neighbours' and its own: (part, node, to, gains)."""
    keys = ["part", "node"]
    near = adjacent.join(state.select("part", F.col("node").alias("other"), "group"), ["part", "other"]).groupBy("part", "node", "group").agg(F.sum("weight").alias("w"))
    held = state.groupBy("part", "group").agg(F.sum("mass").alias("held"), F.count("*").alias("size"))
    options = near.union(state.select("part", "node", "group", F.lit(0.0))).groupBy("part", "node", "group").agg(F.sum("w").alias("w"))
    gains = options.join(state.select("part", "node", F.col("group").alias("own"), "mass", "rate"), keys).join(held, ["part", "group"])
    away = F.col("group") != F.col("own")
    rest = F.col("held") - F.when(away, 0.0).otherwise(F.col("mass"))
    gains = gains.withColumn("gain", F.round(F.col("w") - F.col("rate") * F.col("mass") * rest, 12))
    best = F.min(F.struct((-F.col("gain")).alias("n"), away.alias("away"), F.col("group").alias("to"), "size")).alias("b")
    stay = F.max(F.when(~away, F.struct("gain", F.col("size").alias("size"), F.col("group").alias("own")))).alias("s")
    # Of two nodes that are groups by themselves only the one of the greater name goes to the other, else they would trade places.
    trade = (F.col("b.size") == 1) & (F.col("s.size") == 1) & (F.col("b.to") > F.col("s.own"))
    return gains.groupBy("part", "node").agg(best, stay).select("part", "node", F.col("b.to").alias("to"), ((-F.col("b.n") > F.col("s.gain") + 1e-12) & ~trade).alias("gains"))


def _moved(adjacent: DataFrame, state: DataFrame, seed: int, most: int, loose: int = 8) -> DataFrame:
    """Local moving: nodes take the group of the greatest gain, round by round, until none gains.

    adjacent: (part, node, other, weight) both ways; state: (part, node, group, mass, rate). In the first ``loose`` rounds a half of the nodes,
    by hash, moves at once. Then, of neighbours that would both move, only that of the greater hash does, so that no two neighbours move in a round.
    It ends after ``most`` rounds, should nodes still gain then.
    """
    keys = ["part", "node"]
    for step in range(most):
        turn = F.xxhash64("part", "node", F.lit(step), F.lit(seed))
        best = materialised(_best(adjacent, state).where("gains").select("part", "node", "to", turn.alias("turn")), "movers")
        if not best.limit(1).count():
            break
        if step < loose:
            go = best.where(F.col("turn") % 2 == 0)
        else:
            rival = best.select("part", F.col("node").alias("other"), F.col("turn").alias("theirs"))
            late = adjacent.join(best.select("part", "node", "turn"), keys).join(rival, ["part", "other"]).where("theirs > turn").select("part", "node").distinct()
            go = best.join(late, keys, "left_anti")
        state = state.join(go.select("part", "node", "to"), keys, "left").select("part", "node", F.coalesce("to", "group").alias("group"), "mass", "rate")
        state = materialised(state, "state")
    return state


def partitions(edges: DataFrame, resolution: float = 1.0, objective: str = "modularity", seed: int = 1, rounds: int = 16, levels: int = 10) -> DataFrame:
    """Labels (part, feature, label) of the partition of each part's graph, edges (part, a, b, weight); labels count from 1 in order of a group's first feature.

    objective: modularity, or cpm (by numbers of nodes). Nodes move (``_moved``), groups become nodes, and so on while anything moves; then nodes move once
    more from the groups found. Last, a group whose members its own edges don't hold together is split into its connected pieces, which can only raise
    either objective. Edges, nodes and groups stay distributed; the driver only asks whether anything has moved. Loops and edges without a positive weight are
    left out; repeated edges add up. Features without edges get no label.
    """
    e = edges.where("a <> b AND weight > 0").select("part", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("weight").cast("double").alias("weight"))
    e = e.groupBy("part", "a", "b").agg(F.sum("weight").alias("weight"))
    both = materialised(e.select("part", F.col("a").alias("node"), F.col("b").alias("other"), "weight").union(e.select("part", "b", "a", "weight")), "adjacent")
    total = both.groupBy("part").agg((F.lit(float(resolution)) / F.sum("weight")).alias("rate"))  # both ways: twice the weight
    nodes = both.groupBy("part", "node").agg(F.sum("weight").alias("mass")).join(total, "part")
    if objective != "modularity":
        nodes = nodes.select("part", "node", F.lit(1.0).alias("mass"), F.lit(float(resolution)).alias("rate"))
    nodes = materialised(nodes.select("part", "node", "mass", "rate"), "nodes")
    alone = nodes.select("part", "node", F.col("node").alias("group"), "mass", "rate")
    adjacent, state, label = both, alone, nodes.select("part", "node", F.col("node").alias("group"))
    for level in range(levels):
        state = _moved(adjacent, state, seed * 1_000_003 + level, rounds)
        if not state.where("group <> node").limit(1).count():
            break
        to = state.select("part", F.col("node").alias("group"), F.col("group").alias("to"))
        label = materialised(label.join(to, ["part", "group"]).select("part", "node", F.col("to").alias("group")), "label")
        ends = adjacent.join(to.toDF("part", "node", "u"), ["part", "node"]).join(to.toDF("part", "other", "v"), ["part", "other"]).where("u <> v")
        adjacent = materialised(ends.groupBy("part", F.col("u").alias("node"), F.col("v").alias("other")).agg(F.sum("weight").alias("weight")), "adjacent")
        state = materialised(state.groupBy("part", F.col("group").alias("node"), "rate").agg(F.sum("mass").alias("mass")).select("part", "node", F.col("node").alias("group"), "mass", "rate"), "state")
    found = _moved(both, materialised(nodes.join(label, ["part", "node"]).select("part", "node", "group", "mass", "rate"), "state"), seed * 1_000_003 + levels, rounds)
    group = found.select("part", "node", "group")
    inside = both.where("node < other").join(group, ["part", "node"]).join(group.toDF("part", "other", "theirs"), ["part", "other"]).where("group = theirs")
    key = lambda c: F.struct("part", F.col(c).alias("node"))
    pieces = components(inside.select(key("node").alias("a"), key("other").alias("b")))
    pieces = pieces.select("node.part", "node.node", F.col("root.node").alias("piece"))
    split = group.join(pieces, ["part", "node"], "left").select("part", "node", F.coalesce("piece", "node").alias("group"))
    # A piece is named by its least feature, so names are in the order of labels.
    number = split.select("part", "group").distinct().withColumn("label", F.row_number().over(Window.partitionBy("part").orderBy("group")))
    return split.join(number, ["part", "group"]).select("part", F.col("node").alias("feature"), F.col("label").cast("int").alias("label"))


def restarts(edges: DataFrame, runs: int, resolution: float = 1.0, objective: str = "modularity", seed: int = 1) -> DataFrame:
    """Labels (run, feature, label) of so many partitions, made side by side; none for an empty graph. log1p of weights first, as the pipeline wants it, is the caller's."""
    all_runs = edges.select(F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("part"), "a", "b", "weight")
    return partitions(all_runs, resolution, objective, seed).withColumnRenamed("part", "run")


def partition(edges: DataFrame, resolution: float = 1.0, objective: str = "modularity", seed: int = 1) -> DataFrame:
    """One partition (feature, module)."""
    return restarts(edges, 1, resolution, objective, seed).select("feature", F.col("label").alias("module"))


def final_partition(consensus: DataFrame, runs: DataFrame, resolution: float = 1.0, objective: str = "modularity", seed: int = 1) -> DataFrame:
    """The partition (feature, module) of the consensus edges (a, b, share); where there are none, the first run's labels. Features of the runs without a consensus edge get null."""
    made = partition(consensus.select("a", "b", F.col("share").alias("weight")), resolution, objective, seed)
    if not consensus.limit(1).count():
        made = runs.where("run = 0").select("feature", F.col("label").alias("module"))
    return runs.select("feature").distinct().join(made, "feature", "left")


def repartitioned(edges: DataFrame, modules: DataFrame, runs: int = 10, least: float = 0.95, resolution: float = 1.0, seed: int = 1) -> DataFrame:
    """Second stage: every module is partitioned again by restarts and their consensus, all modules and runs side by side; (feature, module, part).

    Features without a consensus partner have no part.
    """
    inside = edges.join(modules.toDF("a", "ma"), "a").join(modules.toDF("b", "mb"), "b").where("ma = mb").select(F.col("ma").alias("module"), "a", "b", "weight")
    of = inside.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).select(F.struct("module", "run").alias("part"), "a", "b", "weight")
    labels = partitions(of, resolution, seed=seed).select("part.module", "part.run", "feature", "label")
    x, y = labels.withColumnRenamed("feature", "a"), labels.select("module", "run", "label", F.col("feature").alias("b"))
    agreed = x.join(y, ["module", "run", "label"]).where("a < b").groupBy("module", "a", "b").count().where(F.col("count") >= F.lit(ceil(least * runs - 1e-12)))
    parts = partitions(agreed.select(F.col("module").alias("part"), "a", "b", F.col("count").alias("weight")), resolution, seed=seed)
    return modules.toDF("feature", "module").join(parts.select(F.col("part").alias("module"), "feature", F.col("label").alias("part")), ["feature", "module"], "left")


def _ward(distance: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges (height, member, member) by chains of nearest neighbours under Ward's criterion on squared distances."""
    d = distance**2
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, alive, out, chain = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            i = chain[-1]
            row = np.where(alive, d[i], np.inf)
            j = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                j = chain[-2]
                break
            chain.append(j)
        del chain[-2:]
        out.append((float(np.sqrt(d[i, j])), i, j))
        s = size[i] + size[j] + size
        new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / s
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        alive[j], size[i] = False, size[i] + size[j]
    return out


def hierarchical(edges: DataFrame, k: int, fewest: int = 1) -> DataFrame:
    """Clusters (feature, module): Ward's trees on 1 - log1p weights over the greatest, cut into k; those of fewer
    than ``fewest`` members join the cluster most similar on average. For at most MOST_FEATURES features."""
    names, a, b, w = _local(edges)
    n = len(names)
    if n > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features; dense clustering is not for them")
    s = np.zeros((n, n))
    s[a, b] = s[b, a] = np.log1p(w)
    s = s / (s.max() if n and s.max() > 0 else 1)
    np.fill_diagonal(s, 1)
    group = np.arange(n)
    for _, i, j in sorted(_ward(1 - s), key=lambda m: m[0])[: max(0, n - max(1, min(k, n)))]:
        group[group == group[j]] = group[i]
    small = True
    while small:
        small = False
        ids, count = np.unique(group, return_counts=True)
        for g in ids[np.argsort(count, kind="stable")]:
            mine, rest = np.flatnonzero(group == g), [h for h in np.unique(group) if h != g]
            if len(mine) and len(mine) < fewest and rest:
                group[mine] = max(rest, key=lambda h: s[np.ix_(mine, group == h)].mean())
                small = True
    first = {g: r for r, g in enumerate(dict.fromkeys(group.tolist()), 1)}
    return edges.sparkSession.createDataFrame([(v, first[g]) for v, g in zip(names, group.tolist())], "feature string, module int")


def _hashed(*columns, seed: int):
    return F.xxhash64(*columns, F.lit(seed))


def rewired(edges: DataFrame, draws: int, swaps: int = 10, seed: int = 1) -> DataFrame:
    """Graphs (draw, a, b, weight) with every feature's number of edges kept: random pairs of edges of a draw swap ends; weights stay with their edges' places.

    Rounds for all draws at once: a draw's edges are dealt to slots of some SLOT edges by a hash, and each slot's edges, in the order of another, try swaps two
    by two, turned by a bit of a third. A swap that would make a loop, an edge that is there, or an edge that another swap of the round makes too, is left
    out (by a semi-join and a count). There are as many rounds as ``swaps`` tries for each edge take.
    Repeated edges, loops and edges with nulls are left out first.
    """
    one = edges.where("a <> b AND weight IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").groupBy("a", "b").agg(F.max("weight").alias("weight"))
    now = one.select(F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), F.xxhash64("a", "b").alias("place"), "a", "b", "weight")
    now = materialised(now, "rewired")
    n = now.where("draw = 0").count()
    for step in range(ceil(2 * swaps * SLOT / (SLOT - 1)) if n > 1 else 0):
        h = _hashed("draw", "place", F.lit(step), seed=seed)
        dealt = now.select("draw", F.pmod(h, F.lit(max(1, n // SLOT))).alias("slot"), F.struct(_hashed("draw", "place", F.lit(step), seed=seed + 1).alias("turn"), "place", "a", "b", "weight").alias("e"))
        listed = dealt.groupBy("draw", "slot").agg(F.sort_array(F.collect_list("e")).alias("l")).where(F.size("l") > 1)
        tried = listed.select("draw", "l", F.explode(F.sequence(F.lit(0), F.floor(F.size("l") / 2).cast("int") - 1)).alias("i"), "slot")
        tried = tried.select("draw", F.struct("slot", "i").alias("slot"), F.col("l")[2 * F.col("i")].alias("e"), F.col("l")[2 * F.col("i") + 1].alias("g"))
        turned = F.pmod(F.col("e.turn"), F.lit(2)) == 1
        r, s = F.when(turned, F.col("g.a")).otherwise(F.col("g.b")), F.when(turned, F.col("g.b")).otherwise(F.col("g.a"))
        made = tried.withColumn("r", r).withColumn("s", s).where((F.col("e.a") != F.col("s")) & (F.col("r") != F.col("e.b")) & (F.col("e.a") != F.col("r")) & (F.col("e.b") != F.col("s")))
        ends = lambda u, v: (F.least(u, v).alias("a"), F.greatest(u, v).alias("b"))
        new = made.select("draw", "slot", F.inline(F.array(F.struct(F.col("e.place").alias("place"), *ends(F.col("e.a"), F.col("s")), F.col("e.weight").alias("weight")), F.struct(F.col("g.place").alias("place"), *ends(F.col("r"), F.col("e.b")), F.col("g.weight").alias("weight")))))
        new = materialised(new, "tried")
        there = new.join(now.select("draw", "a", "b"), ["draw", "a", "b"], "left_semi").select("draw", "slot")
        twice = new.groupBy("draw", "a", "b").agg(F.count("*").alias("k"), F.collect_set("slot").alias("slots")).where("k > 1").select("draw", F.explode("slots").alias("slot"))
        good = new.join(there.union(twice).distinct(), ["draw", "slot"], "left_anti").select("draw", "place", F.col("a").alias("na"), F.col("b").alias("nb"))
        now = materialised(now.join(good, ["draw", "place"], "left").select("draw", "place", F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"), "weight"), "rewired")
    return now.select(F.col("draw").cast("int").alias("draw"), "a", "b", "weight")
