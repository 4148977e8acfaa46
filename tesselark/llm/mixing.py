"""Mixing sources to target weights by a minimum-cost flow over membership patterns.

A document belongs to one or more sources; the set of its sources is its pattern. Words
are summed by pattern (the only thing that leaves the cluster), and a flow routes the
patterns' words to the sources' quotas. Words of a pattern may be taken up to
``MAX_REPEATS`` times; each repetition costs more than the one before, so that flow
spreads before it repeats. Then whole documents are selected by a seeded hash so that
each pattern's taken words come near its flow; a few exchanges bring them nearer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_RE, col, fresh, stored

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Cost of a word's first, second and third use: convex.
REPEAT_COST = (0, 1, 3)
#: The flow is solved on one machine; more patterns than this are refused.
MAX_PATTERNS = 20_000
#: Bits of the hash that each of two levels of the selection looks at.
LEVEL_BITS = 10
#: Documents of each power of two of sizes that may fill what is left of a pattern's flow after the selection by hash.
FILLS = 4
#: Exchanges of two documents that bring a pattern's words nearer to its flow, at most.
EXCHANGES = 4


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> dict[str | None, float]:
    """Targets of sources: weights repeat in order of code points (null last), shares of all sizes, none over ``most`` times its size.

    What a source can't take is shared again by weight among those that can.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(sizes)
    out: dict[str | None, float] = {}
    free, left = set(size), float(sum(size.values()))
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > most * size[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in full:
            out[s] = float(most * size[s])
            free.discard(s)
        left = float(sum(size.values())) - sum(out.values())
    return out


def min_cost_flow(supply: dict[tuple, int], quota: dict[str | None, int]) -> dict[tuple[tuple, str | None], int]:
    """Words that each pattern gives to each of its sources: a cheapest of the largest flows.

    Arcs lead start -> pattern (one for each repetition, dearer each time) -> source -> end. All costs lie on the
    first arcs, and a shortest path never comes back to the start, so the cost of a path is that of its first arc:
    successive shortest paths take all paths of the cheapest repetition first, then of the next. Within one repetition
    that is a largest flow, found by layers (breadth first, then blocking flows).
    """
    patterns, sources = sorted(supply, key=repr), sorted(quota, key=lambda s: (s is None, s or ""))
    name = {s: i for i, s in enumerate(sources)}
    gives = [[name[s] for s in p if s in name] for p in patterns]  # a pattern's sources
    flow: list[dict[int, int]] = [dict.fromkeys(g, 0) for g in gives]
    back: list[dict[int, None]] = [{} for _ in sources]  # patterns that give a source something
    room = [quota[s] for s in sources]
    for _ in sorted(REPEAT_COST):
        left = [supply[p] for p in patterns]
        # Words that can't reach a source with room now never can: layers that begin with them are not built again.
        live = [i for i, n in enumerate(left) if n and gives[i]]
        while live:
            # Layers: patterns with words left, sources they may give to, patterns that may take back from those, and so on.
            depth, seen = dict.fromkeys(live, 0), {}
            layer, found, level = live, False, 0
            while layer and not found:
                level += 1
                reached = [s for s in dict.fromkeys(s for i in layer for s in gives[i]) if s not in seen]
                seen.update(dict.fromkeys(reached, level))
                found = any(room[s] for s in reached)
                level += 1
                layer = [i for i in dict.fromkeys(i for s in reached for i in back[s]) if i not in depth]
                depth.update(dict.fromkeys(layer, level))
            if not found:
                break
            # Blocking flow: each arc is looked at once, a dead end never again.
            turn_p = {i: iter(gives[i]) for i in depth}
            turn_s = {s: iter(list(back[s])) for s in seen}
            now_p: dict[int, int] = {}
            now_s: dict[int, int] = {}
            for i in live:
                while left[i]:
                    path, ends = [i], None  # patterns and sources by turns
                    while path:
                        u = path[-1]
                        if len(path) % 2:  # a pattern: on to a source one layer further
                            s = now_p[u] if u in now_p else next((s for s in turn_p[u] if seen.get(s) == depth[u] + 1), None)
                            if s is None:
                                path.pop()
                                if path:
                                    now_s.pop(path[-1], None)
                                continue
                            now_p[u] = s
                            path.append(s)
                            if room[s] and seen[s] == level - 1:
                                ends = s
                                break
                        else:  # a source without room: on to a pattern that gives it something
                            j = now_s[u] if u in now_s and flow[now_s[u]].get(u) else next((j for j in turn_s[u] if depth.get(j) == seen[u] + 1 and flow[j].get(u)), None)
                            if j is None:
                                path.pop()
                                now_p.pop(path[-1], None)
                                continue
                            now_s[u] = j
                            path.append(j)
                    if ends is None:
                        break
                    push = min([left[i], room[ends]] + [flow[path[x + 1]][path[x]] for x in range(1, len(path) - 1, 2)])
                    left[i] -= push
                    room[ends] -= push
                    for x in range(0, len(path), 2):
                        u, s = path[x], path[x + 1]
                        flow[u][s] += push
                        back[s][u] = None
                        if x:
                            taken = path[x - 1]
                            flow[u][taken] -= push
                            if not flow[u][taken]:
                                back[taken].pop(u, None)
                    if not room[ends]:
                        now_p.pop(path[-2], None)
            live = [i for i in live if left[i]]
    return {(p, sources[s]): n for p, f in zip(patterns, flow) for s, n in f.items() if n}


@dataclass
class Plan:
    """What the driver keeps of a mix: numbers by pattern and by source."""

    supply: dict[tuple, int]
    size: dict[str | None, int]
    target: dict[str | None, float]
    flow: dict[tuple[tuple, str | None], int]

    def taken(self) -> dict[tuple, int]:
        """Words to take of each pattern."""
        out = dict.fromkeys(self.supply, 0)
        for (p, _), n in self.flow.items():
            out[p] += n
        return out


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> Plan:
    """The flow for rows with ``sources`` (array of strings, sorted and distinct) and ``size``."""
    rows = docs.groupBy("sources").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; the flow is solved on one machine")
    supply = {tuple(r[0]): int(r[1]) for r in rows}
    size: dict[str | None, int] = {}
    for p, n in supply.items():
        for s in p:
            size[s] = size.get(s, 0) + n
    # A word of an overlapping document counts once in the whole, though it adds to each of its sources' size.
    goal = targets(list(size.items()), weights)
    scale = sum(supply.values()) / max(1, sum(size.values()))
    goal = {s: t * scale for s, t in goal.items()}
    return Plan(supply, size, goal, min_cost_flow(supply, {s: round(t) for s, t in goal.items()}))


def mix(df: DataFrame, sources: Column, key: str = "doc_id", text: str = "text", weights: tuple[int, ...] = WEIGHTS, seed: int = 1) -> DataFrame:
    """One row per row of ``df``: key, size, source_size, target, copies, taken (= copies times size).

    ``sources`` is an array of a row's sources; null among them is a source of its own, and a null
    or empty array is that source alone. Documents without words (null or empty texts too) have size 0 and are taken once
    (they cost nothing). source_size and target are of the first of a row's sources.
    Whole documents are taken, at most MAX_REPEATS times each; a pattern's taken words differ from its flow
    by less than the smallest document that is taken once less than others.
    Reruns agree; rows of one key share their fate (a null key is one key); an empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    some = F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, F.array_sort(F.array_distinct(sources))).otherwise(F.array(F.lit(None).cast("string")))
    docs = df.select(col(key).alias("key"), n_words(col(text)).alias("size"), some.alias("sources"))
    # Hashes are compared as signed numbers.
    docs = stored(docs.withColumn("h", F.xxhash64(F.lit(seed), F.col("key"))), "sizes")  # rows without their texts
    plan = plan_mix(docs, weights)
    patterns, goal = sorted(plan.supply, key=repr), plan.taken()
    whole = {p: (goal[p] // plan.supply[p] if plan.supply[p] else 1) for p in patterns}
    rest = {i: goal[p] - whole[p] * plan.supply[p] for i, p in enumerate(patterns) if plan.supply[p] and goal[p] > whole[p] * plan.supply[p]}

    def frame(rows: list, schema: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(rows, schema))  # some rows for each of at most MAX_PATTERNS patterns

    pid = frame([(list(p), i) for i, p in enumerate(patterns)], "sources array<string>, p int")
    # An array with a null doesn't equal itself under =, so patterns are joined null-safely.
    docs = docs.join(pid, docs.sources.eqNullSafe(pid.sources)).select("key", "size", "h", "p")
    live = docs.where("size > 0").join(frame(list(rest.items()), "p int, rest long").select("p"), "p")
    # In order of hashes, documents are taken once more until the rest is reached. Two levels of buckets narrow the cut down to
    # a bucket of some millionth of a pattern, whose documents are summed one by one.
    b1, b2 = F.shiftright("h", 64 - LEVEL_BITS), F.shiftright("h", 64 - 2 * LEVEL_BITS)
    cut1 = _crossing(live.groupBy("p", b1.alias("b")).agg(F.sum("size").alias("size")), frame(list(rest.items()), "p int, room long"))
    inside = live.withColumn("b1", b1).join(frame([(i, b) for i, (b, _) in cut1.items()], "p int, b1 long"), ["p", "b1"])
    cut2 = _crossing(inside.groupBy("p", b2.alias("b")).agg(F.sum("size").alias("size")), frame([(i, room) for i, (_, room) in cut1.items()], "p int, room long"))
    last = inside.withColumn("b2", b2).join(frame([(i, b) for i, (b, _) in cut2.items()], "p int, b2 long"), ["p", "b2"])
    cut3 = _crossing(last.groupBy("p", F.col("h").alias("b")).agg(F.sum("size").alias("size")), frame([(i, room) for i, (_, room) in cut2.items()], "p int, room long"))
    # From this hash on, a pattern's documents are not taken once more; patterns without a cut are taken as a whole.
    bound = {i: cut3[i][0] if i in cut3 else (1 << 63) - 1 for i in rest}
    gap = {i: room for i, (_, room) in cut3.items() if room > 0}
    limits = frame([(i, whole[p], bound.get(i)) for i, p in enumerate(patterns)], "p int, base long, bound long")
    chosen = docs.join(limits, "p").withColumn("more", F.coalesce((F.col("h") < F.col("bound")) & (F.col("size") > 0), F.lit(False)))
    # What is left of a rest is made up for by a few documents more, less or in exchange: the first, by hash, of each power of two of sizes.
    units = chosen.where("size > 0").join(frame(list(gap.items()), "p int, gap long"), "p").groupBy("p", "more", "h").agg(F.sum("size").alias("size"))
    first = Window.partitionBy("p", "more", "power").orderBy("h")
    units = units.withColumn("power", F.floor(F.log2("size"))).withColumn("k", F.row_number().over(first)).where(F.col("k") <= FILLS).select("p", "more", "size", "h")
    sides: dict[int, tuple[dict[int, int], dict[int, int]]] = {}
    for r in units.collect() if gap else []:  # at most 2 * FILLS rows for each pattern and power of two
        sides.setdefault(r.p, ({}, {}))[r.more][r.h] = r["size"]
    changes = [(i, h, more) for i, (out, taken) in sides.items() for h, more in _nearer(gap[i], out, taken).items()]
    filled = frame(changes, "p int, h long, fill boolean")
    facts = frame([(i, plan.size[p[0]], float(plan.target[p[0]])) for i, p in enumerate(patterns)], "p int, source_size long, target double")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("base") + F.coalesce("fill", "more").cast("long")).cast("long")
    return (
        chosen.join(filled, ["p", "h"], "left")
        .join(facts, "p")
        .select(F.col("key").alias(key), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    )


def _nearer(gap: int, out: dict[int, int], taken: dict[int, int]) -> dict[int, bool]:
    """Documents (hash and size) to take (true) or to leave (false) so that ``gap`` words more are taken, as near as a few exchanges come.

    The largest that fit come first; then single documents and exchanges of two, as long as they bring the sum nearer.
    """
    change: dict[int, bool] = {}
    for h, n in sorted(out.items(), key=lambda x: (-x[1], x[0])):
        if n <= gap:
            gap -= n
            change[h] = True
    for _ in range(EXCHANGES):
        if not gap:
            break
        add = [(0, None), *sorted((n, h) for h, n in out.items() if h not in change)]
        drop = [(0, None), *sorted((n, h) for h, n in taken.items() if h not in change)]
        left = np.abs(gap - np.array([n for n, _ in add])[:, None] + np.array([n for n, _ in drop]))
        i, k = np.unravel_index(left.argmin(), left.shape)
        if left[i, k] >= abs(gap):
            break
        gap += drop[k][0] - add[i][0]
        change |= {h: more for (_, h), more in ((add[i], True), (drop[k], False)) if h is not None}
    return change


def _crossing(sums: DataFrame, rooms: DataFrame) -> dict[int, tuple[int, int]]:
    """By pattern (at most MAX_PATTERNS rows leave the cluster): the bucket in which the running sum passes the room, and the room left before it.

    ``sums``: rows (p, b, size), at most 2 ** LEVEL_BITS or the documents of a last bucket for each pattern.
    """
    before = F.sum("size").over(Window.partitionBy("p").orderBy("b")) - F.col("size")
    rows = sums.join(rooms, "p").withColumn("left", F.col("room") - before).where("left >= 0 AND size > left")
    return {r.p: (r.b, r.left) for r in rows.select("p", "b", "left").collect()}


def take(df: DataFrame, sources: Column, key: str = "doc_id", **options) -> DataFrame:
    """The mixed rows of ``df`` with its columns: each as often as the mix takes it, rows it doesn't take left out."""
    # Rows of one key share their fate, so a key's copies agree; a null key is one key here. Rows without words are taken once.
    plan = mix(df, sources, key, **options).groupBy(key).agg(F.max("copies").alias("copies"))
    name, copies, copy = fresh(df, "mixed_key"), fresh(df, "mixed_copies"), fresh(df, "mixed_copy")
    plan = plan.select(col(key).alias(name), F.col("copies").alias(copies)).where(F.col(copies) > 0)
    out = df.join(plan, col(key).eqNullSafe(F.col(name)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*map(col, df.columns))
