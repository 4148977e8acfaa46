"""Points in polygons of a table, by a grid index of the polygons' sides.

A polygon is all rings of its key; a point is inside if a ray to the right crosses the rings' sides an odd number of times (so a ring in another is
a hole). Each polygon is listed in every cell of the grid that its box touches, with those of its sides that a ray from the cell may cross: sides
that reach the cell's row and don't end left of it. Points meet the polygons of their cell only, by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells along the longer side of all polygons, at most.
MOST_CELLS = 1000


def sides(vertices: DataFrame, ring: str | None = None) -> DataFrame:
    """Sides (polygon, x0, y0, x1, y1) of closed rings, from vertices (polygon, k, x, y) in order of k. Rows with nulls or non-finite places are left out;
    level sides are too, as no ray crosses them."""
    ok = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in ("x", "y"))
    v = vertices.where(f"polygon IS NOT NULL AND k IS NOT NULL AND {ok}").select("polygon", *([ring] if ring else []), "k", F.col("x").cast("double"), F.col("y").cast("double"))
    keys = ["polygon", ring] if ring else ["polygon"]
    w = Window.partitionBy(*keys).orderBy("k", "x", "y")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return v.select("polygon", F.col("x").alias("x0"), F.col("y").alias("y0"), end("x").alias("x1"), end("y").alias("y1")).where("y0 <> y1")


def cell_size(lines: DataFrame) -> float:
    """The polygons' mean extent, but not so small that all of them take more than MOST_CELLS cells along a side."""
    low, high = (lambda a: F.least(f"{a}0", f"{a}1")), (lambda a: F.greatest(f"{a}0", f"{a}1"))
    boxes = lines.groupBy("polygon").agg(F.min(low("x")).alias("l"), F.max(high("x")).alias("r"), F.min(low("y")).alias("b"), F.max(high("y")).alias("t"))
    s = boxes.agg(F.avg(F.greatest(F.col("r") - F.col("l"), F.col("t") - F.col("b"))).alias("mean"), F.greatest(F.max("r") - F.min("l"), F.max("t") - F.min("b")).alias("all")).first()
    return max(s["mean"], s["all"] / MOST_CELLS) if s["mean"] else 1.0


def index(lines: DataFrame, cell: float) -> DataFrame:
    """Rows (cx, cy, polygon, sides): for each cell of a polygon's box the sides that a ray from it may cross."""
    at = lambda v: F.floor(v / F.lit(float(cell)))
    x, y = (F.least("x0", "x1"), F.greatest("x0", "x1")), (F.least("y0", "y1"), F.greatest("y0", "y1"))
    left = lines.groupBy("polygon").agg(F.min(x[0]).alias("left"))
    # A side stands for the rows it reaches and for the columns from the polygon's first to its own last.
    rows = lines.join(left, "polygon").select("polygon", "x0", "y0", "x1", "y1", "left", x[1].alias("right"), F.explode(F.sequence(at(y[0]), at(y[1]))).alias("cy"))
    cells = rows.select("polygon", "cy", F.explode(F.sequence(at(F.col("left")), at(F.col("right")))).alias("cx"), F.struct("x0", "y0", "x1", "y1").alias("side"))
    return cells.groupBy("cx", "cy", "polygon").agg(F.collect_list("side").alias("sides"))


def _odd(x: Column, y: Column, lines: Column) -> Column:
    crosses = lambda s: ((s["y0"] > y) != (s["y1"] > y)) & (x < (s["x1"] - s["x0"]) * (y - s["y0"]) / (s["y1"] - s["y0"]) + s["x0"])
    return F.size(F.filter(lines, crosses)) % 2 == 1


def _placed(points: DataFrame, vertices: DataFrame, ring: str | None, cell: float | None) -> tuple[DataFrame, DataFrame, Column]:
    """The points' distinct places, the index, and when a place is inside a polygon of it: points on one place are judged once."""
    from tesselark.sources.files import materialised

    lines = materialised(sides(vertices, ring), "sides")
    cell = cell or cell_size(lines)
    at = lambda c: F.floor(F.col(f"p.{c}") / F.lit(float(cell)))
    p, i = points.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL").distinct().alias("p"), index(lines, cell).alias("i")
    meets = (at("x") == F.col("i.cx")) & (at("y") == F.col("i.cy")) & _odd(F.col("p.x"), F.col("p.y"), F.col("i.sides"))
    return p, i, meets


def inside_any(points: DataFrame, vertices: DataFrame, ring: str | None = None, cell: float | None = None) -> DataFrame:
    """Points (x, y and whatever else) inside the union of the polygons, each once; points without a place are in none."""
    p, i, meets = _placed(points, vertices, ring, cell)
    return points.join(p.join(i, meets, "left_semi"), ["x", "y"], "left_semi").select(points.columns)


def polygons_of(points: DataFrame, vertices: DataFrame, ring: str | None = None, cell: float | None = None) -> DataFrame:
    """A row for each point and polygon around it: the point's columns and ``polygon``."""
    p, i, meets = _placed(points, vertices, ring, cell)
    return points.join(p.join(i, meets).select("p.x", "p.y", "i.polygon"), ["x", "y"]).select(*points.columns, "polygon")


def counts_by_polygon(points: DataFrame, vertices: DataFrame, by: list[str], ring: str | None = None, cell: float | None = None) -> DataFrame:
    """(polygon, by, n): the numbers of points in each polygon, without a row for each point and polygon: points are counted by place first."""
    from tesselark.sources.files import materialised

    counted = materialised(points.groupBy("x", "y", *by).agg(F.count("*").alias("n")), "counted")
    p, i, meets = _placed(counted, vertices, ring, cell)
    around = p.join(i, meets).select("p.x", "p.y", "i.polygon").repartition("polygon")
    return around.join(counted, ["x", "y"]).groupBy("polygon", *by).agg(F.sum("n").alias("n"))
