"""Joins over boxes, intervals and points. Theta joins go through cells of a grid, so that Spark joins on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _cells(lo: str, hi: str, cell: float) -> Column:
    return F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))


def box_pairs(a: DataFrame, b: DataFrame, axes: str = "xy", cell: float = 1.0, slack: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """Pairs of boxes (id, x0, x1, y0, y1 ...) of a and b that come within ``slack`` of one another on all axes: a_id, b_id, and the columns ``by`` that they share.

    Boxes meet in grids of x and y. A box's own grid has cells of ``cell`` doubled until it covers four at most, and it goes to that and to all
    coarser ones in use, so that large boxes don't fill a fine grid; a pair is reported in the grid of its larger box, in the cell of its overlap's lower corner alone.
    """
    by = by or []
    grid = axes[:2]
    # A box without extent has no logarithm, and the finest grid.
    own = F.greatest(F.lit(0), F.coalesce(F.ceil(F.log2(F.nullif(F.greatest(*[F.col(f"{x}1") - F.col(f"{x}0") + slack for x in grid]), F.lit(0)) / cell)).cast("int"), F.lit(0)))
    top = a.select(own.alias("g")).unionByName(b.select(own.alias("g"))).agg(F.max("g").alias("top")).first().top or 0

    def spread(t: DataFrame, p: str) -> DataFrame:
        t = t.select(*[F.col(c).alias(f"{p}_{c}") for c in by], F.col("id").alias(f"{p}_id"), own.alias(f"{p}_own"), *[(F.col(f"{x}{e}") + s).alias(f"{p}_{x}{e}") for x in axes for e, s in (("0", -slack / 2), ("1", slack / 2))])
        t = t.withColumn(f"{p}_grid", F.explode(F.sequence(F.col(f"{p}_own"), F.lit(top)))).withColumn(f"{p}_cell", F.lit(float(cell)) * F.pow(F.lit(2.0), F.col(f"{p}_grid")))
        for x in grid:
            t = t.withColumn(f"{p}_c{x}", F.explode(F.sequence(F.floor(F.col(f"{p}_{x}0") / F.col(f"{p}_cell")), F.floor(F.col(f"{p}_{x}1") / F.col(f"{p}_cell")))))
        return t

    left, right = spread(a, "a"), spread(b, "b")
    same = F.lit(True)
    for c in ["grid", *[f"c{x}" for x in grid], *by]:
        same &= F.col(f"a_{c}") == F.col(f"b_{c}")
    meet = same & (F.greatest("a_own", "b_own") == F.col("a_grid"))
    for x in axes:
        meet &= (F.col(f"a_{x}0") <= F.col(f"b_{x}1")) & (F.col(f"b_{x}0") <= F.col(f"a_{x}1"))
    for x in grid:
        meet &= F.col(f"a_c{x}") == F.floor(F.greatest(f"a_{x}0", f"b_{x}0") / F.col("a_cell"))
    # Merged, not broadcast: the table behind a side may look small before its boxes are spread over cells.
    return left.join(right.hint("merge"), meet).select(*[F.col(f"a_{c}").alias(c) for c in by], "a_id", "b_id")


def self_pairs(boxes: DataFrame, **options) -> DataFrame:
    """box_pairs of a table with itself, each pair once (a_id < b_id)."""
    return box_pairs(boxes, boxes, **options).where(F.col("a_id") < F.col("b_id"))


def interval_lookup(points: DataFrame, intervals: DataFrame, cell: float) -> DataFrame:
    """The first interval (by ord) that holds each point, ends included: points (id, at) with ord, null where none does."""
    # Equal intervals and equal points meet once, so the pairs depend on the values there are, not on the rows.
    first = intervals.groupBy("lo", "hi").agg(F.min("ord").alias("ord"))
    spread = first.select("ord", "lo", "hi", F.explode(_cells("lo", "hi", cell)).alias("cell"))
    places = points.select("at").distinct().withColumn("at_cell", F.floor(F.col("at") / cell))
    held = places.join(spread, (F.col("at_cell") == F.col("cell")) & F.col("at").between(F.col("lo"), F.col("hi"))).groupBy("at").agg(F.min("ord").alias("ord"))
    return points.select("id", "at").distinct().join(held, "at", "left").select("id", "at", "ord")



def nearest(points: DataFrame, others: DataFrame, radius: float, k: int = 1) -> DataFrame:
    """The k others (id, x, y) nearest to each point (id, x, y) within ``radius``, ties to the smaller id: point_id, other_id, distance2, rank."""
    p = points.select(F.col("id").alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    p = p.withColumn("cx", F.explode(F.sequence(F.floor((F.col("px") - radius) / radius), F.floor((F.col("px") + radius) / radius)))).withColumn("cy", F.explode(F.sequence(F.floor((F.col("py") - radius) / radius), F.floor((F.col("py") + radius) / radius))))
    o = others.select(F.col("id").alias("other_id"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.floor(F.col("x") / radius).alias("ocx"), F.floor(F.col("y") / radius).alias("ocy"))
    near = p.join(o, (F.col("cx") == F.col("ocx")) & (F.col("cy") == F.col("ocy"))).withColumn("distance2", F.expr("(px - ox) * (px - ox) + (py - oy) * (py - oy)")).where(F.col("distance2") <= radius * radius)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("point_id").orderBy("distance2", "other_id")))
    return ranked.where(F.col("rank") <= k).select("point_id", "other_id", "distance2", "rank")


def compared(measured: DataFrame, expected: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer comparison by key: state missing, extra or matched, and for matches which columns differ (null-safe)."""
    m = measured.select(F.col(key).alias("m_key"), *[F.col(c).alias(f"m_{c}") for c in columns])
    e = expected.select(F.col(key).alias("e_key"), *[F.col(c).alias(f"e_{c}") for c in columns])
    both = m.join(e, F.col("m_key") == F.col("e_key"), "full_outer")
    state = F.when(F.col("m_key").isNull(), "missing").when(F.col("e_key").isNull(), "extra").otherwise("matched")
    differs = [(F.when(state == "matched", ~F.col(f"m_{c}").eqNullSafe(F.col(f"e_{c}"))).otherwise(F.lit(False))).alias(f"{c}_differs") for c in columns]
    return both.select(F.coalesce("m_key", "e_key").alias(key), state.alias("state"), *differs)


def cells_under(tri: DataFrame, cell: float) -> DataFrame:
    """Grid cells (i, j) whose centres lie in a triangle seen from above, with its height there: tri (id, ax .. cz). Vertical triangles cover none."""
    area2 = "(bx - ax) * (cy - ay) - (by - ay) * (cx - ax)"
    t = tri.withColumn("area2", F.expr(area2)).where(F.abs("area2") > 1e-12)
    span = lambda c: F.sequence(F.ceil(F.least(f"a{c}", f"b{c}", f"c{c}") / cell - 0.5), F.floor(F.greatest(f"a{c}", f"b{c}", f"c{c}") / cell - 0.5))
    some = t.where((F.ceil(F.least("ax", "bx", "cx") / cell - 0.5) <= F.floor(F.greatest("ax", "bx", "cx") / cell - 0.5)) & (F.ceil(F.least("ay", "by", "cy") / cell - 0.5) <= F.floor(F.greatest("ay", "by", "cy") / cell - 0.5)))
    grid = some.withColumn("i", F.explode(span("x"))).withColumn("j", F.explode(span("y")))
    grid = grid.withColumn("px", (F.col("i") + 0.5) * cell).withColumn("py", (F.col("j") + 0.5) * cell)
    grid = grid.withColumn("wb", F.expr("((px - ax) * (cy - ay) - (py - ay) * (cx - ax)) / area2")).withColumn("wc", F.expr("((bx - ax) * (py - ay) - (by - ay) * (px - ax)) / area2"))
    return grid.where("wb >= 0 AND wc >= 0 AND wb + wc <= 1").select("id", "i", "j", F.expr("az + wb * (bz - az) + wc * (cz - az)").alias("z"))


def rectangle_union_area(rects: DataFrame, by: str, cell: float | None = None) -> DataFrame:
    """Area that rectangles (by, x0, x1, y0, y1) cover together, by strips between successive x ends: in each, the merged y intervals of those that span it.

    With ``cell``, rectangles are cut at multiples of it along x first, and strips are those of one cell: then a large group is no single task, nor does each of its strips meet all of its rectangles.
    """
    key = [by]
    if cell is not None:
        rects = rects.withColumn("cell", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.greatest(F.floor(F.col("x0") / cell), F.ceil(F.col("x1") / cell) - 1))))
        rects = rects.withColumns({"x0": F.greatest(F.col("x0"), F.col("cell") * cell), "x1": F.least(F.col("x1"), (F.col("cell") + 1) * cell)})
        key.append("cell")
    xs = rects.select(*key, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    w = Window.partitionBy(*key).orderBy("x")
    strips = xs.withColumn("next", F.lead("x").over(w)).where(F.col("next").isNotNull())
    spanning = strips.join(rects, key).where((F.col("x0") <= F.col("x")) & (F.col("x1") >= F.col("next")))
    inside = Window.partitionBy(*key, "x").orderBy("y0", "y1")
    reach = F.max("y1").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    gained = F.greatest(F.lit(0), F.col("y1") - F.greatest(F.col("y0"), F.coalesce(reach, F.col("y0"))))
    return spanning.withColumn("gained", gained).groupBy(by).agg(F.sum((F.col("next") - F.col("x")) * F.col("gained")).alias("area"))
