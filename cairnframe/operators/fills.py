"""Polygons filled to runs of pixels, masks as runs, and filters of any width.

A mask is a table of runs (by, y, lo, hi: first and last pixel), not of pixels, so that its size goes with
outlines, not areas. A pixel belongs to a polygon if its middle does; a middle on an edge belongs to
the polygon on its right or below, so neighbours share no pixel. Empty tables, polygons of two points
or none, and edges without height give no runs; null coordinates take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnframe.storage import dealt


def crossings(rings: DataFrame, by: list[str]) -> DataFrame:
    """by, y, at and turn (1 down, -1 up): where the middles of rows of pixels cross the closed rings of points (by, ring, ord, x, y)."""
    rings = rings.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    w = Window.partitionBy(*by, "ring").orderBy("ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).cast("double")
    e = rings.select(*by, F.col("x").cast("double").alias("ax"), F.col("y").cast("double").alias("ay"), after("x").alias("bx"), after("y").alias("by_"))
    top, end = F.ceil(F.least("ay", "by_") - 0.5), F.ceil(F.greatest("ay", "by_") - 0.5) - 1
    rows = e.where(top <= end).withColumn("y", F.explode(F.sequence(top, end)))
    at = F.col("ax") + (F.col("y") + 0.5 - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by_") - F.col("ay"))
    return rows.select(*by, "y", at.alias("at"), F.when(F.col("by_") > F.col("ay"), 1).otherwise(-1).alias("turn"))


def filled(rings: DataFrame, by: list[str], even_odd: Column | bool = True, width: int | None = None, height: int | None = None) -> DataFrame:
    """Runs (by, y, lo, hi) of the pixels within polygons of rings (by, ring, ord, x, y), by parity, or where not ``even_odd`` (constant in a polygon) by winding; clipped to an image of width x height if given."""
    rule = F.lit(even_odd) if isinstance(even_odd, bool) else even_odd
    kept = dealt(rings.withColumn("rule", rule), *by)
    c = crossings(kept, [*by, "rule"])
    w = Window.partitionBy(*by, "y").orderBy("at", "turn")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    inside = F.when(F.col("rule"), F.row_number().over(w) % 2 == 1).otherwise(F.sum("turn").over(upto) != 0)
    c = c.withColumn("inside", inside)
    c = c.withColumn("was", F.coalesce(F.lag("inside").over(w), F.lit(False))).where(F.col("inside") != F.col("was"))
    spans = c.withColumn("end", F.lead("at").over(w)).where("inside")
    lo, hi = F.ceil(F.col("at") - 0.5), F.ceil(F.col("end") - 0.5) - 1
    if width is not None:
        lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(width - 1))
    out = spans.select(*by, F.col("y").cast("long").alias("y"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).where("lo <= hi")
    # Runs with no middle between them are one.
    return united(out if height is None else out.where(F.col("y").between(0, height - 1)), by)


def united(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs that overlap or touch, of any number of masks, as one: by, y, lo, hi."""
    w = Window.partitionBy(*by, "y").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = runs.withColumn("new", F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0))
    grouped = fresh.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "y", "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("g")


def colour_mask(rings: DataFrame, page: str, rgb: tuple[int, int, int], tol: int = 3, **size) -> DataFrame:
    """The mask (page, y, lo, hi) of a page's paths whose fill is within ``tol`` of a colour in each channel, drawn anew by themselves: rings (page, path, ring, ord, x, y, r, g, b, even_odd; without a fill r is null)."""
    near = F.greatest(*[F.abs(F.col(c).cast("int") - v) for c, v in zip("rgb", rgb, strict=True)]) <= tol
    drawn = filled(rings.where(F.col("r").isNotNull() & near), [page, "path"], F.coalesce(F.col("even_odd"), F.lit(False)), **size)
    return united(drawn, [page])


def compared(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Of masks as runs without overlaps (by, y, lo, hi): shared, only_a, only_b (pixels) and iou, a row for each value of by in either."""
    ends = lambda t, p, q: t.select(by, "y", F.inline(F.array(F.struct(F.col("lo").alias("z"), F.lit(p).alias("da"), F.lit(q).alias("db")), F.struct((F.col("hi") + 1).alias("z"), F.lit(-p).alias("da"), F.lit(-q).alias("db")))))
    steps = ends(a, 1, 0).unionByName(ends(b, 0, 1)).groupBy(by, "y", "z").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy(by, "y").orderBy("z")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    parts = steps.select(by, F.sum("da").over(upto).alias("a"), F.sum("db").over(upto).alias("b"), (F.lead("z").over(w) - F.col("z")).alias("n"))
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    sums = parts.groupBy(by).agg(of(F.expr("a > 0 AND b > 0")).alias("shared"), of(F.expr("a > 0 AND b = 0")).alias("only_a"), of(F.expr("a = 0 AND b > 0")).alias("only_b"))
    return sums.withColumn("iou", F.bround(F.col("shared") / F.greatest(F.lit(1), F.expr("shared + only_a + only_b")), 4))


def dense(pixels: DataFrame, by: str, value: str, width: int, height: int, empty=0) -> DataFrame:
    """Every pixel (by, y, x, value) of images of width x height, ``empty`` where pixels has none."""
    every = pixels.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select(by, "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    return every.join(pixels.select(by, "y", "x", value), [by, "y", "x"], "left").withColumn(value, F.coalesce(value, F.lit(empty)))


def _along(pixels: DataFrame, by: str, line: str, at: str, value: str, size: int, extreme) -> DataFrame:
    """The extreme of ``size`` values about each, along one axis, by running extremes from either end of blocks of that size: a row's work is the same for any size."""
    half = size // 2
    row = Window.partitionBy(by, line)
    whole = row.orderBy(at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = pixels.repartition(F.col(by), F.col(line)).withColumns({"first": F.min(at).over(row), "last": F.max(at).over(row)})
    p = p.withColumn("block", F.floor((F.col(at) - F.col("first")) / size))
    block = Window.partitionBy(by, line, "block")
    p = p.withColumns({"before": extreme(value).over(block.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)), "after": extreme(value).over(block.orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, 0))})
    # Beyond an end there is nothing; what is nearest to it stands for it.
    from_ = F.coalesce(F.first("after").over(row.orderBy(at).rangeBetween(-half, -half)), F.first("after").over(whole))
    until = F.coalesce(F.first("before").over(row.orderBy(at).rangeBetween(half, half)), F.last("before").over(whole))
    lo, hi = F.greatest(F.col(at) - half, F.col("first")), F.least(F.col(at) + half, F.col("last"))
    start = F.floor((lo - F.col("first")) / size)
    p = p.withColumns({"from": from_, "until": until, "one": start == F.floor((hi - F.col("first")) / size), "whole": lo - F.col("first") == start * size})
    both = F.least("from", "until") if extreme is F.min else F.greatest("from", "until")
    return p.select(*pixels.columns[:-1], F.when(F.col("one") & F.col("whole"), F.col("until")).when(F.col("one"), F.col("from")).otherwise(both).alias(value))


def rank_filter(pixels: DataFrame, by: str, value: str, size: int, least: bool) -> DataFrame:
    """The least or greatest value of the size x size pixels about each (by, y, x, value; every pixel of an image, ``size`` odd); beyond an image's edge there is none."""
    if size < 1 or size % 2 == 0:
        raise ValueError("a filter has an odd size")
    extreme = F.min if least else F.max
    p = pixels.select(by, "y", "x", value)
    return _along(_along(p, by, "y", "x", value, size, extreme), by, "x", "y", value, size, extreme)


def opened(pixels: DataFrame, by: str, value: str, size: int) -> DataFrame:
    """What a square of size x size pixels can cover of what is set: the least about each, then the greatest of these; lines and letters thinner than it go."""
    return rank_filter(rank_filter(pixels, by, value, size, True), by, value, size, False)


def plan_match(grey: DataFrame, rings: DataFrame, by: str, shades: tuple[int, int], size: int, width: int, height: int) -> DataFrame:
    """How far the walls of a plan's image (by, y, x, grey: every pixel) and polygons of the model (by, path, ring, ord, x, y, in pixels) agree: shared, only_a (image), only_b (model), iou.

    The image's walls are pixels within ``shades``, opened by ``size``; polygons are united.
    """
    from .sequences import runs

    wall = grey.select(by, "y", "x", F.col("grey").between(*shades).cast("int").alias("on"))
    image = runs(opened(wall, by, "on", size).withColumn("on", F.col("on") == 1), [by, "y"], "x").select(by, F.col("y").cast("long").alias("y"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    return compared(image, united(filled(rings, [by, "path"], True, width, height), [by]), by)
