"""Neighbourhoods of lattice bins as sparse weights (gx, gy, hx, hy, w): shifted equi-joins, never distance joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Offsets of the neighbours; those of hexagonal rows depend on whether a row is shifted.
ROOK = [(-1, 0), (1, 0), (0, -1), (0, 1)]
QUEEN = ROOK + [(-1, -1), (-1, 1), (1, -1), (1, 1)]
HEX_PLAIN = [(-1, 0), (1, 0), (-1, -1), (0, -1), (-1, 1), (0, 1)]
HEX_SHIFTED = [(-1, 0), (1, 0), (0, -1), (1, -1), (0, 1), (1, 1)]


def _offsets(pairs: list) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(float(w)).alias("w")) for a, b, w in pairs])


def _joined(bins: DataFrame, offsets: Column) -> DataFrame:
    shifted = bins.select("gx", "gy", F.explode(offsets).alias("o")).select("gx", "gy", (F.col("gx") + F.col("o.dx")).alias("hx"), (F.col("gy") + F.col("o.dy")).alias("hy"), F.col("o.w").alias("w"))
    return shifted.join(bins.select(F.col("gx").alias("hx"), F.col("gy").alias("hy")), ["hx", "hy"], "left_semi").select("gx", "gy", "hx", "hy", "w")


def neighbours(bins: DataFrame, kind: str = "queen") -> DataFrame:
    """Weight 1 between adjacent active bins: rook, queen, or hexagons whose odd or even rows (r) or columns (q) are shifted."""
    active = bins.select("gx", "gy").distinct()
    if kind in ("rook", "queen"):
        return _joined(active, _offsets([(a, b, 1) for a, b in (ROOK if kind == "rook" else QUEEN)]))
    odd, by_row = kind.startswith("odd"), kind.endswith("r")
    turn = (lambda o: o) if by_row else (lambda o: [(b, a) for a, b in o])
    line = (F.col("gy") if by_row else F.col("gx")) - 1
    shifted = F.pmod(line, F.lit(2)) == (1 if odd else 0)
    make = lambda o: _offsets([(a, b, 1) for a, b in turn(o)])
    return _joined(active, F.when(shifted, make(HEX_SHIFTED)).otherwise(make(HEX_PLAIN)))


def row_standardise(w: DataFrame) -> DataFrame:
    return w.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("gx", "gy")))


def kernel(bins: DataFrame, radius: int = 2, sigma: float = 1.0, shape: str = "gaussian", metric: str = "queen") -> DataFrame:
    """Weights within a radius (a square for queen, a diamond for rook), flat or Gaussian, summing to 1 for every bin."""
    around = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if (a or b) and (metric == "queen" or abs(a) + abs(b) <= radius)]
    value = (lambda a, b: math.exp(-(a * a + b * b) / (2 * sigma * sigma))) if shape == "gaussian" else (lambda a, b: 1.0)
    return row_standardise(_joined(bins.select("gx", "gy").distinct(), _offsets([(a, b, value(a, b)) for a, b in around])))


def hex_kernel(bins: DataFrame, radius: int = 2, sigma: float = 1.0, shape: str = "gaussian", kind: str = "oddr") -> DataFrame:
    """Weights of hexagons at most ``radius`` steps away, flat or Gaussian in the steps, summing to 1 for every bin; kinds as in ``neighbours``."""
    odd, by_row = kind.startswith("odd"), kind.endswith("r")

    def around(moved: int) -> Column:
        made = []
        for q in range(-radius, radius + 1):
            for r in range(-radius, radius + 1):
                steps = max(abs(q), abs(r), abs(q + r))
                if 0 < steps <= radius:
                    # A shifted line lies half a bin further; lines an odd number apart are not both shifted.
                    along = (2 * q + r + moved - (moved + r) % 2) // 2
                    made.append((*((along, r) if by_row else (r, along)), math.exp(-steps * steps / (2 * sigma * sigma)) if shape == "gaussian" else 1.0))
        return _offsets(made)

    line = (F.col("gy") if by_row else F.col("gx")) - 1
    return row_standardise(_joined(bins.select("gx", "gy").distinct(), F.when(F.pmod(line, F.lit(2)) == (1 if odd else 0), around(1)).otherwise(around(0))))


def grown(w: DataFrame, bins: DataFrame, least: float, most: int = 4) -> DataFrame:
    """Pairs of bins within as few steps as give ``least`` neighbours on average, at most ``most`` steps."""
    n = bins.select("gx", "gy").distinct().count()
    for order in range(1, most + 1):
        found = within_hops(w, order)
        if order == most or found.count() >= least * n:
            return found


def within_hops(w: DataFrame, order: int) -> DataFrame:
    """Pairs of bins at most ``order`` steps apart."""
    one = w.select("gx", "gy", "hx", "hy").distinct()
    found = one
    for _ in range(order - 1):
        step = one.select(F.col("gx").alias("hx"), F.col("gy").alias("hy"), F.col("hx").alias("kx"), F.col("hy").alias("ky"))
        further = found.join(step, ["hx", "hy"]).select("gx", "gy", F.col("kx").alias("hx"), F.col("ky").alias("hy"))
        found = found.union(further.where("gx <> hx OR gy <> hy")).distinct()
    return found


def diffuse(values: DataFrame, w: DataFrame, alpha: float, steps: int) -> DataFrame:
    """v <- v + alpha W v, clamped to 0..1, several times; values (gx, gy, feature, v) are zero where absent."""
    now = values.select("gx", "gy", "feature", "v")
    for _ in range(steps):
        came = w.join(now.select(F.col("gx").alias("hx"), F.col("gy").alias("hy"), "feature", "v"), ["hx", "hy"]).select("gx", "gy", "feature", (F.col("w") * F.col("v") * alpha).alias("v"))
        now = now.union(came).groupBy("gx", "gy", "feature").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum("v"))).alias("v"))
    return now


def fuzzy_jaccard(values: DataFrame, features: list[str]) -> DataFrame:
    """Sum of minima over sum of maxima of two features' values over bins; null where there are none."""
    chosen = values.where(F.col("feature").isin(features))
    low = chosen.alias("p").join(chosen.alias("q"), ["gx", "gy"]).where("p.feature < q.feature").groupBy(F.col("p.feature").alias("a"), F.col("q.feature").alias("b")).agg(F.sum(F.least("p.v", "q.v")).alias("low"))
    total = chosen.groupBy("feature").agg(F.sum("v").alias("t"))
    # max = a + b - min, so absent bins need not be made.
    pairs = total.select(F.col("feature").alias("a"), F.col("t").alias("ta")).join(total.select(F.col("feature").alias("b"), F.col("t").alias("tb")), F.col("a") < F.col("b"))
    low0 = F.coalesce("low", F.lit(0.0))
    return pairs.join(low, ["a", "b"], "left").select("a", "b", (low0 / F.nullif(F.col("ta") + F.col("tb") - low0, F.lit(0.0))).alias("jaccard"))


def tiles(bins: DataFrame, side: int = 8) -> DataFrame:
    """The square tile of side x side bins that a bin is in, numbered from 1 without gaps."""
    t = bins.select("gx", "gy", F.floor((F.col("gx") - 1) / side).cast("int").alias("tx"), F.floor((F.col("gy") - 1) / side).cast("int").alias("ty"))
    ids = t.select("tx", "ty").distinct().withColumn("tile", F.dense_rank().over(Window.orderBy("ty", "tx")))
    return t.join(F.broadcast(ids), ["tx", "ty"]).select("gx", "gy", "tile")


# Degrees that a direction may be off, the least share of slanted directions, the limit of level or upright ones, and how far
# the ratio of diagonal to straight distances may be off 1.
HEX_DEGREES, HEX_SLANTED, HEX_STRAIGHT, HEX_RATIO = 10, 0.4, 0.8, 0.2


def hex_like(centres: DataFrame) -> DataFrame:
    """One row (hex, horizontal, vertical, ratio) on the directions and distances of adjacent bins (gx, gy, cx, cy).

    Hexagonal: at least 0.4 of the directions near 60 or 120 degrees, below 0.8 level and upright ones, and
    diagonal neighbours about as far (within 0.2) as those along the axes.
    """
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((0, 1), (1, 0), (1, 1), (1, -1))])).alias("s")
    one = centres.select("gx", "gy", "cx", "cy", steps).select((F.col("gx") + F.col("s.dx")).alias("hx"), (F.col("gy") + F.col("s.dy")).alias("hy"), "cx", "cy", (F.abs("s.dx") + F.abs("s.dy")).alias("k"), F.col("s.dy").alias("dy"))
    two = centres.select(F.col("gx").alias("hx"), F.col("gy").alias("hy"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    e = one.join(two, ["hx", "hy"]).select("k", "dy", (F.col("ox") - F.col("cx")).alias("x"), (F.col("oy") - F.col("cy")).alias("y"))
    e = e.withColumn("t", F.abs(F.degrees(F.atan2("y", "x")))).withColumn("far", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    share = lambda c: F.avg(c.cast("double"))
    found = e.agg(
        share(F.least("t", 180 - F.col("t")) <= HEX_DEGREES).alias("horizontal"), share(F.abs(F.col("t") - 90) <= HEX_DEGREES).alias("vertical"),
        share((F.abs(F.col("t") - 60) <= HEX_DEGREES) | (F.abs(F.col("t") - 120) <= HEX_DEGREES)).alias("slanted"),
        (F.percentile(F.when((F.col("k") == 2) & (F.col("dy") == 1), F.col("far")), 0.5) / F.nullif(F.percentile(F.when(F.col("k") == 1, F.col("far")), 0.5), F.lit(0.0))).alias("ratio"),
    )
    is_hex = (F.col("slanted") >= HEX_SLANTED) & (F.greatest("horizontal", "vertical") < HEX_STRAIGHT) & (F.abs(F.col("ratio") - 1) <= HEX_RATIO)
    return found.select(F.coalesce(is_hex, F.lit(False)).alias("hex"), "horizontal", "vertical", "ratio")


def hex_parity(centres: DataFrame, by: str = "r") -> DataFrame:
    """One row (kind): which rows (r) or columns (q) are shifted by half a cell: odd or even ones, for ``neighbours``.

    A line's shift is how far its first centre is from the lattice of the line that begins first, in half cells: 0 on it, 1 in the middle between two
    of its centres. The parity of the greater mean shift is the shifted one; if neither is greater, the odd one.
    """
    line, along = ("gy", "cx") if by == "r" else ("gx", "cy")
    step = centres.select(F.abs(F.col(along) - F.lag(along).over(Window.partitionBy(line).orderBy(along))).alias("step")).agg(F.percentile("step", 0.5).alias("step"))
    first = centres.groupBy(line).agg(F.min(along).alias("at"))
    facts = first.agg(F.min("at").alias("origin")).crossJoin(step)
    cells = (F.col("at") - F.col("origin")) / F.nullif("step", F.lit(0.0))
    shift = 2 * F.abs(cells - F.rint(cells))
    of = lambda parity: F.coalesce(F.avg(F.when(F.pmod(F.col(line), F.lit(2)) == parity, shift)), F.lit(0.0))
    # Compared at nine digits, so that equal shifts are equal.
    even = F.round(of(0), 9) > F.round(of(1), 9)
    return first.crossJoin(F.broadcast(facts)).agg(F.when(even, f"even{by}").otherwise(f"odd{by}").alias("kind"))


def topology(centres: DataFrame, kind: str | None = None, platform: str | None = None) -> str:
    """The kind of neighbourhood: the one asked for, else the platform's, else what the centres look like.

    ``hex_parity`` names shifted lines by their numbers, which begin at 1, ``neighbours`` by how many lines come before; so the names are turned.
    """
    if kind:
        return kind
    if platform in ("xenium", "cosmx"):
        return "queen"
    if platform == "visium" or hex_like(centres).first().hex:
        found = hex_parity(centres).first().kind
        return {"oddr": "evenr", "evenr": "oddr"}[found]
    return "queen"
