"""Runs, sweeps, gaps and interval sets along an ordered axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def runs(cells: DataFrame, by: list[str], at: str, least: int = 1) -> DataFrame:
    """Maximal runs of consecutive true cells: lo and hi (inclusive) and length, from cells (by, at: a distinct integer, on: boolean). Null counts as false."""
    w = Window.partitionBy(*by).orderBy(at)
    islands = cells.where("on").withColumn("island", F.col(at) - F.row_number().over(w))
    found = islands.groupBy(*by, "island").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("length"))
    return found.where(F.col("length") >= least).drop("island")


def band_runs(pixels: DataFrame, y: int, band: int, least: int) -> DataFrame:
    """Runs along row y of a mask (img, y, x, on) where all rows within ``band`` are on; hi is exclusive, as in crops."""
    near = pixels.where(F.col("y").between(max(0, y - band), y + band))
    column = near.groupBy("img", "x").agg(F.every(F.coalesce("on", F.lit(False))).alias("on"))
    return runs(column, ["img"], "x", least).withColumn("hi", F.col("hi") + 1)


def edge_points(pixels: DataFrame, step: int = 1) -> DataFrame:
    """First and last set pixel of every ``step``-th column of the mask's extent, columns without any left out."""
    on = pixels.where("on")
    lo = on.groupBy("img").agg(F.min("x").alias("x0"))
    return on.join(lo, "img").where(F.pmod(F.col("x") - F.col("x0"), F.lit(step)) == 0).groupBy("img", "x").agg(F.min("y").alias("first"), F.max("y").alias("last"))


def _depths(intervals: DataFrame, by: str) -> DataFrame:
    """Ends of intervals (by, lo, hi; either may be null, and has no say then) in order, starts first where they meet: z, the depth after each, and whether a solid stretch starts or ends there."""
    ends = intervals.select(by, F.inline(F.array(F.struct(F.col("lo").alias("z"), F.lit(1).alias("s")), F.struct(F.col("hi").alias("z"), F.lit(-1).alias("s"))))).where("z IS NOT NULL")
    w = Window.partitionBy(by).orderBy("z", F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    depth = ends.withColumn("depth", F.sum("s").over(w))
    return depth.withColumns({"start": F.expr("depth - s <= 0 AND depth > 0"), "end": F.expr("depth - s > 0 AND depth <= 0")})


def sweep(intervals: DataFrame, by: str) -> DataFrame:
    """Solid stretches of each column from intervals (by, lo, hi): sorted ends with starts first, the depth running; a stretch lasts while the depth is above 0. Columns in which one does not end are left out, see closure()."""
    turns = _depths(intervals, by).where("start OR end")
    w = Window.partitionBy(by)
    found = turns.withColumns({"hi": F.lead("z").over(w.orderBy("z", F.desc("s"))), "even": F.count("*").over(w) % 2 == 0})
    return found.where("start AND even").select(by, F.col("z").alias("lo"), "hi")


def closure(intervals: DataFrame, by: str) -> DataFrame:
    """One row: unbalanced, columns in which not as many solid stretches end as start, and ending_inside, those whose depth does not come back to 0."""
    per = _depths(intervals, by).groupBy(by).agg((F.count_if("start") != F.count_if("end")).alias("uneven"), F.sum("s").alias("left"))
    return per.agg(F.count_if("uneven").alias("unbalanced"), F.count_if(F.col("left") != 0).alias("ending_inside"))


def merged(intervals: DataFrame, by: str, slack: float = 1e-4) -> DataFrame:
    """Intervals (by, lo, hi) merged where the next starts within ``slack`` of the end reached so far."""
    w = Window.partitionBy(by).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = intervals.withColumn("new", F.when(reach.isNull() | (F.col("lo") > reach + slack), 1).otherwise(0))
    grouped = fresh.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(by, "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("g")


def subtracted(a: DataFrame, b: DataFrame, by: str, slack: float = 1e-9) -> DataFrame:
    """What of intervals a none of b covers, both (by, lo, hi): the ends of both cut the axis into elements, an element stays if a covers it and b doesn't. Pieces no longer than slack go."""
    marks = a.select(by, "lo", "hi", F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(by, "lo", "hi", F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    ends = marks.select(by, F.inline(F.array(F.struct(F.col("lo").alias("z"), F.col("in_a").alias("da"), F.col("in_b").alias("db")), F.struct(F.col("hi").alias("z"), (-F.col("in_a")).alias("da"), (-F.col("in_b")).alias("db")))))
    steps = ends.groupBy(by, "z").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy(by).orderBy("z")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    elements = steps.withColumn("a", F.sum("da").over(upto)).withColumn("b", F.sum("db").over(upto)).withColumn("end", F.lead("z").over(w))
    left = elements.where("a > 0 AND b = 0 AND end IS NOT NULL").select(by, F.col("z").alias("lo"), F.col("end").alias("hi"))
    return merged(left, by, 0.0).where(F.col("hi") - F.col("lo") > slack)


def clusters(values: DataFrame, by: str, at: str, gap: float) -> DataFrame:
    """Sorted values cut where the next is more than ``gap`` away: cluster (from 0), lo, hi, n."""
    w = Window.partitionBy(by).orderBy(at)
    cut = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    marked = values.withColumn("cut", cut).withColumn("cluster", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "cluster").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n"))


def headroom(solids: DataFrame, by: str, height: float) -> DataFrame:
    """Tops of solids (by, lo, hi) with ``height`` or more to the next bottom above, or open sky; and their rank in the column from below."""
    w = Window.partitionBy(by).orderBy("lo", "hi")
    free = F.coalesce(F.lead("lo").over(w), F.lit(float("inf"))) - F.col("hi")
    open_ = solids.withColumn("free", free).where(F.col("free") >= height)
    return open_.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("hi", "lo")) - 1).select(by, F.col("hi").alias("z"), "free", "rank")


def elevations(storeys: DataFrame, by: str, ord: str, wall: str, slab: str) -> DataFrame:
    """Storeys with z, the sum of walls and slabs below."""
    w = Window.partitionBy(by).orderBy(ord).rowsBetween(Window.unboundedPreceding, -1)
    return storeys.withColumn("z", F.coalesce(F.sum(F.col(wall) + F.col(slab)).over(w), F.lit(0)))


def turns(points: DataFrame, by: str, ord: str) -> DataFrame:
    """Signed turn in degrees, from -180 up to 180, at each corner of closed rings of points (by, ord, x, y)."""
    w = Window.partitionBy(by).orderBy(ord)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = lambda c, f, e: F.coalesce(f(c).over(w), e(c).over(whole))
    p = points
    for c in ("x", "y"):
        p = p.withColumn(f"{c}_prev", step(c, F.lag, F.last)).withColumn(f"{c}_next", step(c, F.lead, F.first))
    into, out = F.atan2(F.expr("y - y_prev"), F.expr("x - x_prev")), F.atan2(F.expr("y_next - y"), F.expr("x_next - x"))
    return p.withColumn("turn", F.pmod(F.degrees(out - into) + 180.0, F.lit(360.0)) - 180.0).drop("x_prev", "x_next", "y_prev", "y_next")


def angle_steps(rows: DataFrame, by: str, ord: str, angle: str) -> DataFrame:
    """rows with step, the angle less that before it; null for the first."""
    return rows.withColumn("step", F.col(angle) - F.lag(angle).over(Window.partitionBy(by).orderBy(ord)))
