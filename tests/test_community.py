"""Partitions against plain local moving, and rewired graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselark.operators import community as M
from tesselark.operators import graph as K


def edges(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, weight double")


def cliques(spark):
    rows = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "xy" for i in range(5) for j in range(i + 1, 5)]
    return edges(spark, rows + [("x0", "y0", 0.1)])


def louvain(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, seed: int, resolution: float = 1.0, objective: str = "modularity") -> np.ndarray:
    """Labels of n nodes: nodes move while that raises the objective (modularity, or cpm by node numbers), then groups become nodes."""
    rng = np.random.default_rng(seed)
    label, size = np.arange(n), np.ones(n)
    links: list[dict[int, float]] = [{} for _ in range(n)]
    loops = np.zeros(n)
    for i, j, x in zip(a.tolist(), b.tolist(), w.tolist()):
        links[i][j] = links[i].get(j, 0.0) + x
        links[j][i] = links[j].get(i, 0.0) + x
    total = float(w.sum())
    while total > 0:
        m = len(links)
        degree = np.array([sum(v.values()) for v in links]) + 2 * loops
        mass, rate = (degree, resolution / (2 * total)) if objective == "modularity" else (size, resolution)
        group, held = np.arange(m), mass.copy()
        moved, active = False, True
        while active:
            active = False
            for i in rng.permutation(m).tolist():
                near: dict[int, float] = {}
                for j, x in links[i].items():
                    near[group[j]] = near.get(group[j], 0.0) + x
                own = group[i]
                held[own] -= mass[i]
                gain = lambda g: near.get(g, 0.0) - rate * mass[i] * held[g]  # noqa: E731, B023
                best, most = own, gain(own)
                for g in sorted(near):
                    if gain(g) > most + 1e-12:
                        best, most = g, gain(g)
                held[best] += mass[i]
                if best != own:
                    group[i], active, moved = best, True, True
        if not moved:
            break
        _, dense = np.unique(group, return_inverse=True)
        label = dense[label]
        k = dense.max() + 1
        merged: list[dict[int, float]] = [{} for _ in range(k)]
        inner = np.zeros(k)
        np.add.at(inner, dense, loops)
        for i, v in enumerate(links):
            for j, x in v.items():
                if dense[i] == dense[j]:
                    inner[dense[i]] += x / 2
                else:
                    merged[dense[i]][dense[j]] = merged[dense[i]].get(dense[j], 0.0) + x
        size = np.bincount(dense, size, k)
        links, loops = merged, inner
    # Labels from 1, in the order of their first members.
    first = {g: r for r, g in enumerate(dict.fromkeys(label.tolist()), 1)}
    return np.array([first[g] for g in label.tolist()], int)



def modularity(a, b, w, label, n):
    m, d = w.sum(), np.bincount(a, w, n) + np.bincount(b, w, n)
    return w[label[a] == label[b]].sum() / m - sum((d[label == c].sum() / (2 * m)) ** 2 for c in np.unique(label))


def grouped(rows, by, of):
    out = {}
    for r in rows:
        out.setdefault(r[by], set()).add(r[of])
    return sorted(out.values(), key=min)


def test_partitions_find_cliques(spark):
    g = cliques(spark)
    want = [{f"{c}{i}" for i in range(5)} for c in "xy"]
    for made in (M.partition(g), M.partition(g, 0.3, "cpm"), M.hierarchical(g, 2)):
        assert grouped(made.collect(), "module", "feature") == want
    assert M.restarts(g.limit(0), 2).count() == 0


def test_partitions_are_as_good_as_plain_ones(spark):
    r = np.random.default_rng(5)
    graphs, rows = {}, []
    for part, (n, k, p, out) in enumerate([(40, 4, 0.5, 0.05), (50, 10, 0.9, 0.02)]):
        e = [(i, j, float(round(r.random() + 0.1, 2))) for i in range(n) for j in range(i + 1, n) if r.random() < (p if i % k == j % k else out)]
        graphs[part] = (n, *map(np.array, zip(*e)))
        rows += [((part, run), f"f{i:02}", f"f{j:02}", w) for i, j, w in e for run in range(6)]
    df = spark.createDataFrame(rows, "part struct<graph int, run int>, a string, b string, weight double")
    got = {}
    for x in M.partitions(df).collect():
        got.setdefault((x.part.graph, x.part.run), {})[x.feature] = x.label
    for part, (n, a, b, w) in graphs.items():
        mine = [modularity(a, b, w, np.array([got[part, run].get(f"f{i:02}", -1 - i) for i in range(n)]), n) for run in range(6)]
        plain = [modularity(a, b, w, louvain(n, a, b, w, seed), n) for seed in range(6)]
        assert max(mine) >= max(plain) - 0.01 and np.mean(mine) >= np.mean(plain) - 0.01
        for run in range(6):  # labels from 1 in order of first members; groups hold together
            label = got[part, run]
            assert [label[f] for f in sorted(label)][0] == 1 and set(label.values()) == set(range(1, max(label.values()) + 1))
            for g in set(label.values()):
                members = {f for f in label if label[f] == g}
                seen, todo = set(), [min(members)]
                while todo:
                    v = todo.pop()
                    seen.add(v)
                    todo += [f"f{q:02}" for p, q in [*zip(a, b), *zip(b, a)] if f"f{p:02}" == v and f"f{q:02}" in members - seen]
                assert seen == members


def test_groups_that_nothing_holds_together_are_split(spark, monkeypatch):
    # A hub that has left two cliques in one group: the moves are taken away, so the group is as given.
    g = cliques(spark).where("NOT (a = 'x0' AND b = 'y0')")
    monkeypatch.setattr(M, "_moved", lambda adjacent, state, seed, most: state.withColumn("group", F.lit("x0")))
    assert grouped(M.partition(g).collect(), "module", "feature") == [{f"{c}{i}" for i in range(5)} for c in "xy"]


def test_final_labels_fall_back_to_the_first_run(spark):
    runs = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "a", 1), (1, "b", 1)], "run int, feature string, label int")
    got = {r.feature: r.module for r in M.final_partition(K.consensus(runs, 0.95), runs).collect()}
    assert got == {"a": 1, "b": 2}
    assert {r.feature: r.module for r in M.final_partition(K.consensus(runs, 0.5), runs).collect()} == {"a": 1, "b": 1}


def test_small_clusters_are_merged(spark):
    g = cliques(spark).union(edges(spark, [("x0", "z", 0.2)]))
    got = {r.feature: r.module for r in M.hierarchical(g, 3, 2).collect()}
    assert got["z"] == got["x1"] != got["y1"]


def test_second_stage_parts(spark):
    modules = spark.createDataFrame([(f"{c}{i}", 1) for c in "xy" for i in range(5)] + [("alone", 2)], "feature string, module int")
    got = {r.feature: r.part for r in M.repartitioned(cliques(spark), modules, 5).collect()}
    assert got["x1"] == got["x4"] != got["y1"] and got["alone"] is None


def test_rewiring_keeps_degrees(spark):
    r = np.random.default_rng(3)
    rows = sorted({(f"n{min(p):02}", f"n{max(p):02}") for p in r.integers(0, 25, (90, 2)).tolist() if p[0] != p[1]})
    g = edges(spark, [(a, b, float(i)) for i, (a, b) in enumerate(rows)] + [("n01", "n01", 1.0), ("n01", None, 1.0)])
    degree = lambda pairs: sorted((v, sum(v in p for p in pairs)) for v in {e for p in pairs for e in p})
    got = M.rewired(g, 3, swaps=4).collect()
    for k in range(3):
        mine = [(x.a, x.b) for x in got if x.draw == k]
        assert degree(mine) == degree(rows) and len(set(mine)) == len(mine) == len(rows) and all(a < b for a, b in mine)
        assert len(set(mine) & set(rows)) < 0.6 * len(rows) and sorted(x.weight for x in got if x.draw == k) == [float(i) for i in range(len(rows))]
    assert len({tuple(sorted((x.a, x.b) for x in got if x.draw == k)) for k in range(3)}) == 3
    assert M.rewired(g.limit(0), 2).count() == 0
