"""Dendrograms of forests that stay in Spark: merges, leaf order, and the branches of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselark.operators import trees as T
from tesselark.sources.files import materialised


def lengths(forest: DataFrame, mode: str = "neg_log", normalise: bool = True, clip: tuple[float, float] | None = None, power: float = 1.0, scale: float = 1.2) -> DataFrame:
    """The forest's edges with a ``length`` that falls as the weight grows: ``neg_log``, ``inverse`` or ``inverse_sqrt``.

    Weights are first brought to 0..1 and kept within the cut points ``clip``, and no weight is under 1e-6.
    """
    w = F.col("weight")
    out = forest
    if normalise:
        ends = forest.agg(F.min("weight").alias("low"), F.max("weight").alias("high"))
        out = out.crossJoin(F.broadcast(ends))  # one row
        w = (w - F.col("low")) / F.greatest(F.lit(1e-12), F.col("high") - F.col("low"))
    if clip:
        w = F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), w))
    w = F.when(w > 0, F.greatest(w, F.lit(1e-9))).otherwise(1e-6)
    length = {"neg_log": -F.log(w), "inverse": 1 / w, "inverse_sqrt": 1 / F.sqrt(w)}[mode]
    return out.select(*forest.columns, (F.pow(length, F.lit(power)) * scale).alias("length"))


def merge_tree(forest: DataFrame) -> DataFrame:
    """Single linkage of a forest (a, b, weight): each edge is the merge of the groups at its ends, heavier edges first, ties by a, then b.

    Rows (node, parent, key): a feature is the node (feature, feature) without a key, a merge the node (a, b); roots have no parent. Distances along
    a tree have that tree as their own least spanning tree, so this is also their single linkage.

    Rounds that at least halve the groups: each group's first edge outward joins it to another. An edge within a group lies below the group's
    first edge outward, if it comes before that; else it waits for the next round's larger group. The edges that lie below one and the same first
    edge of a group make a chain in their order.
    """
    e = forest.where("a <> b AND weight IS NOT NULL").select(F.struct((-F.col("weight")).alias("n"), "a", "b").alias("key"), F.col("a").alias("ca"), F.col("b").alias("cb"))
    live = materialised(e, "live")
    waiting = live.limit(0).select("key", F.col("ca").alias("home"))
    leaves = live.limit(0).select(F.col("ca").alias("node"), "key")
    placed = None
    step = 0
    while live.limit(1).count():
        ends = live.select("key", "ca", "cb", F.explode(F.array("ca", "cb")).alias("node"))
        first = materialised(ends.groupBy("node").agg(F.min(F.struct("key", "ca", "cb")).alias("f")), "first")
        if not step:
            leaves = first.select("node", "f.key")
        out = first.select(F.col("node").alias("home"), F.col("f.key").alias("up"))
        held = materialised(waiting.join(out, "home", "left").withColumn("here", F.col("up").isNull() | (F.col("key") < F.col("up"))), "held")
        here = held.where("here").select("key", F.lit(step).alias("step"), "home", "up")
        placed = here if placed is None else placed.union(here)
        root = T.hooked(first)
        chosen = first.select("f.key", F.col("f.ca").alias("home")).distinct()
        inner = held.where("NOT here").select("key", "home").union(chosen)
        waiting = materialised(inner.join(root.toDF("home", "to"), "home").select("key", F.col("to").alias("home")), "waiting")
        moved = live.join(root.toDF("ca", "ra"), "ca").join(root.toDF("cb", "rb"), "cb").where("ra <> rb")
        live = materialised(moved.select("key", F.col("ra").alias("ca"), F.col("rb").alias("cb")), "live")
        step += 1
    last = waiting.select("key", F.lit(step).alias("step"), "home", F.lit(None).cast(waiting.schema["key"].dataType).alias("up"))
    placed = last if placed is None else placed.union(last)
    chain = Window.partitionBy("step", "home").orderBy("key")
    merges = placed.select("key", F.coalesce(F.lead("key").over(chain), "up").alias("above"))
    node = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.a").alias("a"), F.col(f"{c}.b").alias("b")))
    low = leaves.select(F.struct(F.col("node").alias("a"), F.col("node").alias("b")).alias("node"), node("key").alias("parent"), F.lit(None).cast(leaves.schema["key"].dataType).alias("key"))
    return materialised(low.union(merges.select(node("key").alias("node"), node("above").alias("parent"), "key")), "merges")


def _sizes(tree: DataFrame) -> DataFrame:
    """Rows (node, size): the leaves under each node. In round k each node hands what lies less than 2^k below it to the node 2^k above."""
    now = tree.select("node", F.col("parent").alias("up"), F.when(F.col("key").isNull(), 1).otherwise(0).cast("long").alias("size"))
    while now.where("up IS NOT NULL").limit(1).count():
        given = now.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        higher = now.select(F.col("node").alias("up"), F.col("up").alias("then"))
        now = now.join(given, "node", "left").join(higher, "up", "left")
        now = materialised(now.select("node", F.col("then").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "sizes")
    return now.select("node", "size")


def arranged(tree: DataFrame) -> DataFrame:
    """A merge tree's nodes with ``size`` (leaves), ``start`` (the first one's place in its tree, from 1) and ``top`` (the tree's last merge).

    Of two children the tighter comes first: a feature before a group (two features by name), the group of the earlier last merge before the other.
    """
    sized = tree.join(_sizes(tree), "node")
    rank = F.struct(F.col("key").isNotNull().alias("group"), F.coalesce("key.n", F.lit(0.0)).alias("n"), "node", "size")
    left = sized.where("parent IS NOT NULL").groupBy("parent").agg(F.min(rank).alias("left"))
    shift = F.when(F.col("left.node") != F.col("node"), F.col("left.size")).otherwise(0).cast("long")
    now = materialised(sized.join(left, "parent", "left").select("node", "parent", "key", "size", F.col("parent").alias("up"), F.coalesce("parent", "node").alias("top"), F.coalesce(shift, F.lit(0)).alias("start")), "placed")
    while now.where("up IS NOT NULL").limit(1).count():
        higher = now.select(F.col("node").alias("up"), F.col("up").alias("then"), F.col("top").alias("far"), F.col("start").alias("more"))
        moved = now.join(higher, "up", "left")
        now = materialised(moved.select("node", "parent", "key", "size", F.col("then").alias("up"), F.coalesce("far", "top").alias("top"), (F.col("start") + F.coalesce("more", F.lit(0))).alias("start")), "placed")
    return now.select("node", "parent", "key", "size", (F.col("start") + 1).alias("start"), "top")


def leaf_order(places: DataFrame) -> DataFrame:
    """Rows (feature, tree, position) of an arranged merge tree; a tree is named by its least feature. Features without an edge have no row."""
    leaves = places.where("key IS NULL")
    names = leaves.groupBy("top").agg(F.min("node.a").alias("tree"))
    return leaves.join(names, "top").select(F.col("node.a").alias("feature"), "tree", F.col("start").alias("position"))


def merges(places: DataFrame) -> DataFrame:
    """Rows (a, b, weight, size, start, above_a, above_b) of the merges; the leaves of a merge are those at start .. start + size - 1."""
    return places.where("key IS NOT NULL").select("node.a", "node.b", (-F.col("key.n")).alias("weight"), "size", "start", F.col("parent.a").alias("above_a"), F.col("parent.b").alias("above_b"))


def rooted(forest: DataFrame) -> DataFrame:
    """Rows (node, parent, tree, enter, leave, size) of a forest whose trees hang from their least node; under a node are those that enter between
    its ``enter`` and ``leave``.

    A tour passes each edge twice; its steps are ranked by pointers that double in each round.
    """
    e = materialised(forest.where("a <> b").select("a", "b"), "ties")
    arcs = e.union(e.select("b", "a")).toDF("u", "v")
    around = Window.partitionBy("u").orderBy("v")
    turn = arcs.withColumns({"onward": F.lead("v").over(around), "again": F.first("v").over(around)}).join(T.components(e).toDF("u", "tree"), "u")
    step = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    then = F.when(F.col("onward").isNotNull(), step("u", "onward")).when(F.col("u") != F.col("tree"), step("u", "again"))
    now = materialised(turn.select(step("v", "u").alias("arc"), then.alias("next"), F.lit(1).cast("long").alias("left"), "tree"), "tour")
    while now.where("next IS NOT NULL").limit(1).count():
        further = now.select(F.col("arc").alias("next"), F.col("next").alias("then"), F.col("left").alias("more"))
        now = materialised(now.join(further, "next", "left").select("arc", F.col("then").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"), "tree"), "tour")
    there = now.select(F.col("arc.u").alias("parent"), F.col("arc.v").alias("node"), "tree", (-F.col("left")).alias("enter"))
    back = now.select(F.col("arc.v").alias("parent"), F.col("arc.u").alias("node"), (-F.col("left")).alias("leave"))
    down = there.join(back, ["parent", "node"]).where("enter < leave").select("node", "parent", "tree", "enter", "leave")
    top = now.groupBy("tree").agg((-F.max("left") - 1).alias("enter")).select(F.col("tree").alias("node"), F.lit(None).cast(e.schema["a"].dataType).alias("parent"), "tree", "enter", F.lit(0).cast("long").alias("leave"))
    both = down.union(top)
    return materialised(both.withColumn("size", ((F.col("leave") - F.col("enter") + 1) / 2).cast("long")), "rooted")


def _within(x: str, s: str) -> str:
    """SQL: the node that enters at ``x`` is of the candidate ``s``, its root apart."""
    return f"((({x} BETWEEN {s}.enter AND {s}.leave) AND NOT {s}.above) OR ((NOT {x} BETWEEN {s}.enter AND {s}.leave) AND {s}.above))"


def _meet(with_root: bool) -> str:
    """SQL: the candidates c and p of one tree share a node."""
    cores = (
        "CASE WHEN c.above AND p.above THEN true WHEN NOT c.above AND NOT p.above THEN c.enter <= p.leave AND p.enter <= c.leave "
        "WHEN c.above THEN NOT (c.enter <= p.enter AND p.leave <= c.leave) ELSE NOT (p.enter <= c.enter AND c.leave <= p.leave) END"
    )
    if not with_root:
        return cores
    return f"({cores} OR c.at = p.at OR {_within('c.at', 'p')} OR {_within('p.at', 'c')})"


def branches(forest: DataFrame, most: int = 10, with_root: bool = True) -> DataFrame:
    """Rows (feature, module, branch) of a forest (module, a, b): what falls off a tree where one of its features is taken out.

    A candidate is a part of at least three features that a feature (its root) with two neighbours or more holds to the rest, with that
    root or without. In each module the largest candidates are taken, at most ``most``, that share no feature with one taken before; ties by the root, then by
    the neighbour of the root within the part. Branches are named ``<module>_sub<k>``; other features have none.
    Parts are intervals of a tour, so whether two meet is arithmetic, and a round is a partial aggregate by module and a join with one row of each.
    """
    nodes = rooted(forest).join(forest.select(F.explode(F.array("a", "b")).alias("node"), "module").distinct(), "node")
    nodes = materialised(nodes, "nodes")
    at = nodes.select(F.col("node").alias("parent"), F.col("enter").alias("at"), F.col("parent").alias("beyond"), F.col("size").alias("total"))
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    tops = nodes.where("parent IS NULL").select("tree", F.col("size").alias("whole"))
    below = nodes.where("parent IS NOT NULL AND size >= 3").join(at, "parent").join(kids.withColumnRenamed("node", "parent"), "parent")
    below = below.where("beyond IS NOT NULL OR kids > 1").select("module", "tree", F.col("parent").alias("root"), F.col("node").alias("toward"), "at", "enter", "leave", F.lit(False).alias("above"), "size")
    above = nodes.where("parent IS NOT NULL").join(kids, "node").join(tops, "tree").where("whole - size >= 3")
    above = above.select("module", "tree", F.col("node").alias("root"), F.col("parent").alias("toward"), F.col("enter").alias("at"), "enter", "leave", F.lit(True).alias("above"), (F.col("whole") - F.col("size")).alias("size"))
    left = materialised(below.union(above), "parts")
    taken = None
    for k in range(1, most + 1):
        best = F.min(F.struct((-F.col("size")).alias("n"), "root", "toward", "tree", "at", "enter", "leave", "above")).alias("t")
        pick = materialised(left.groupBy("module").agg(best).select("module", F.lit(k).alias("k"), "t.*"), "pick")
        if not pick.limit(1).count():
            break
        taken = pick if taken is None else taken.union(pick)
        apart = left.alias("c").join(pick.alias("p"), "module").where(f"c.tree <> p.tree OR NOT {_meet(with_root)}")
        left = materialised(apart.select("module", *[f"c.{n}" for n in left.columns[1:]]), "parts")
    if taken is None:
        return nodes.select(F.col("node").alias("feature"), "module", F.lit(None).cast("string").alias("branch"))
    inside = _within("c.enter", "p") + (" OR c.enter = p.at" if with_root else "")
    hit = nodes.alias("c").join(taken.alias("p"), ["module", "tree"]).where(inside).select("c.node", F.concat(F.col("module").cast("string"), F.lit("_sub"), F.col("p.k").cast("string")).alias("branch"))
    return nodes.join(hit, "node", "left").select(F.col("node").alias("feature"), "module", "branch")
