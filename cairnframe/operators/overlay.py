"""Set operations on rectilinear polygons, by slabs, and measures of polygons of any kind.

The ordinates of both sides cut the plane into slabs; within one, upright edges cut it into stretches, each inside
or outside either side by parity. What the operation keeps is put together again along x, then
along y. Rings may be in any direction, of any number and nested; edges that are neither upright nor level are an
error of the caller's and are not looked for. Null coordinates take no part; an empty side has no inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnframe.storage import dealt

#: What a stretch must be in to stay.
OPERATIONS = {"union": "a OR b", "intersection": "a AND b", "difference": "a AND NOT b", "either": "a <> b"}


def _edges(rings: DataFrame, by: list[str]) -> DataFrame:
    """Edges of closed rings of points (by, ring, ord, x, y): ax, ay, bx, by_."""
    rings = rings.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    w = Window.partitionBy(*by, "ring").orderBy("ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).cast("double")
    return rings.select(*by, F.col("x").cast("double").alias("ax"), F.col("y").cast("double").alias("ay"), after("x").alias("bx"), after("y").alias("by_"))


def overlaid(a: DataFrame, b: DataFrame, by: str, operation: str) -> DataFrame:
    """Rectangles (by, x0, x1, y0, y1) that make up the union, intersection, difference (a without b) or either (one alone) of rectilinear rings (by, ring, ord, x, y); as wide as can be, then as high."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation: {operation}")
    sides = [_edges(t, [by]).withColumn("side", F.lit(s)) for t, s in ((a, "a"), (b, "b"))]
    upright = sides[0].unionByName(sides[1]).where("ay <> by_").select(by, "side", F.col("ax").alias("x"), F.least("ay", "by_").alias("lo"), F.greatest("ay", "by_").alias("hi"))
    ys = upright.groupBy(F.col(by).alias("of")).agg(F.array_sort(F.array_distinct(F.concat(F.collect_set("lo"), F.collect_set("hi")))).alias("ys"))
    cut = upright.join(ys, F.col(by).eqNullSafe(F.col("of"))).withColumn("ys", F.expr("filter(ys, y -> y >= lo AND y <= hi)"))
    cut = cut.select(by, "side", "x", F.explode(F.expr("filter(zip_with(ys, slice(ys, 2, size(ys)), (p, q) -> struct(p AS y0, q AS y1)), s -> s.y1 IS NOT NULL)")).alias("slab")).select(by, "side", "x", "slab.*")
    steps = cut.groupBy(by, "y0", "y1", "x").agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"))
    w = Window.partitionBy(by, "y0", "y1").orderBy("x")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    stretch = steps.select(by, "y0", "y1", F.col("x").alias("x0"), F.lead("x").over(w).alias("x1"), (F.sum("na").over(upto) % 2 == 1).alias("a"), (F.sum("nb").over(upto) % 2 == 1).alias("b"))
    kept = stretch.where(F.expr(OPERATIONS[operation]) & F.col("x1").isNotNull())
    wide = _joined(kept, [by, "y0", "y1"], "x0", "x1")
    return _joined(wide, [by, "x0", "x1"], "y0", "y1").select(by, "x0", "x1", "y0", "y1")


def _joined(spans: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """Spans of which one starts where the one before ends, as one."""
    w = Window.partitionBy(*by).orderBy(lo)
    fresh = spans.withColumn("new", F.when(F.lag(hi).over(w) == F.col(lo), 0).otherwise(1))
    grouped = fresh.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "g").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("g")


def measures(rings: DataFrame, by: str) -> DataFrame:
    """Area, length of outline and centroid (cx, cy; null without area) of polygons of rings (by, ring, ord, x, y), outlines and holes turning opposite ways."""
    # One shuffle by polygon serves its rings, its corner and its sums.
    e = _edges(dealt(rings, by), [by])
    # About a corner of the polygon, so that far coordinates cost no digits.
    whole = Window.partitionBy(by)
    e = e.withColumns({"ox": F.min("ax").over(whole), "oy": F.min("ay").over(whole)}).withColumns({"px": F.expr("ax - ox"), "py": F.expr("ay - oy"), "qx": F.expr("bx - ox"), "qy": F.expr("by_ - oy")}).withColumn("cross", F.expr("px * qy - qx * py"))
    s = e.groupBy(by, "ox", "oy").agg((F.sum("cross") / 2).alias("signed"), F.sum(F.hypot(F.expr("bx - ax"), F.expr("by_ - ay"))).alias("length"), F.sum(F.expr("(px + qx) * cross")).alias("sx"), F.sum(F.expr("(py + qy) * cross")).alias("sy"))
    centre = lambda o, c: (F.col(o) + F.when(F.abs("signed") > 1e-12, F.try_divide(F.col(c), 6 * F.col("signed")))).alias("c" + o[1])
    return s.select(by, F.abs("signed").alias("area"), "length", centre("ox", "sx"), centre("oy", "sy"))


def containing(points: DataFrame, rings: DataFrame, by: str, cell: float = 1.0, within: list[str] | None = None) -> DataFrame:
    """id and by (and the columns ``within`` that both share, if given) of the polygons (rings: by, ring, ord, x, y) that each point (id, x, y) lies in, by parity; a point on an edge belongs to the polygon on its right or below. They meet by boxes, then by bands across."""
    from .spatial import box_pairs

    within = within or []
    e = _edges(rings, [*within, by])
    box = e.groupBy(*within, F.col(by).alias("id")).agg(F.min("ax").alias("x0"), F.max("ax").alias("x1"), F.min("ay").alias("y0"), F.max("ay").alias("y1"))
    spots = points.select(*within, F.struct("id", "x", "y").alias("id"), F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("y").alias("y0"), F.col("y").alias("y1"))
    near = box_pairs(spots, box, cell=cell, by=within).select(*within, "a_id.id", F.col("a_id.x").alias("x"), F.col("a_id.y").alias("y"), F.col("b_id").alias(by)).withColumn("band", F.floor(F.col("y") / cell))
    bands = e.where("ay <> by_").withColumn("band", F.explode(F.sequence(F.floor(F.least("ay", "by_") / cell), F.floor(F.greatest("ay", "by_") / cell))))
    right: Column = (F.least("ay", "by_") <= F.col("y")) & (F.greatest("ay", "by_") > F.col("y")) & (F.col("ax") + (F.col("y") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by_") - F.col("ay")) > F.col("x"))
    return near.join(bands, [*within, by, "band"]).where(right).groupBy(*within, "id", by).agg(F.count("*").alias("n")).where("n % 2 = 1").select(*within, "id", by)


def arc_by_step(cx: Column, cy: Column, r: Column, a0: Column, a1: Column, step: float = 6.0) -> Column:
    """Points of an arc from a0 to a1 (degrees) in even pieces of ``step`` degrees at most."""
    from cairnframe.functions.measures import arc_points

    return arc_points(cx, cy, r, a0, a1, F.greatest(F.lit(1), F.ceil(F.abs(a1 - a0) / step - 1e-9)))


def sector(cx: Column, cy: Column, r0: Column, r1: Column, a0: Column, a1: Column, step: float = 6.0) -> Column:
    """Corners of a piece of a ring: along its outer arc, and back along its inner one."""
    return F.concat(arc_by_step(cx, cy, r1, a0, a1, step), arc_by_step(cx, cy, r0, a1, a0, step))


def disk(cx: Column, cy: Column, r: Column, corners: int) -> Column:
    """Corners of a regular polygon in a circle."""
    from cairnframe.functions.measures import arc_points

    return F.slice(arc_points(cx, cy, r, F.lit(0.0), F.lit(360.0), F.lit(corners)), 1, corners)


def octagon(x0: Column, y0: Column, x1: Column, y1: Column, c: Column) -> Column:
    """Corners of a rectangle whose own are cut off by c."""
    points = [(x0 + c, y0), (x1 - c, y0), (x1, y0 + c), (x1, y1 - c), (x1 - c, y1), (x0 + c, y1), (x0, y1 - c), (x0, y0 + c)]
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def large_parts(rings: DataFrame, by: str, least: float = 1e-7) -> DataFrame:
    """Rings of the polygons whose area is over ``least``; those without area, or of null points alone, go."""
    fit = measures(rings, by).where(F.col("area") > least).select(F.col(by).alias("fit"))
    return rings.join(fit, F.col(by) == F.col("fit"), "left_semi")
