"""Estimates of scale and alignment from measured evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tolerance by kind of evidence, the anisotropy allowed, pixels by which a length may be off, kinds that are conventions rather than measures, and kinds that are lengths.
TOLERANCE = {"bar": 0.02, "bar_box": 0.02, "dim": 0.03, "area": 0.05, "pt": 0.01, "fixture": 0.15}
ANISOTROPY, PIXELS_OFF = 0.04, 2.0
WEAK = ("fixture",)
LENGTHS = ("bar", "bar_box", "dim", "fixture")


def scale_estimate(items: DataFrame) -> DataFrame:
    """Metres per pixel of each case, from items (case, kind, axis, px, m_per_px, tol or null).

    The scale is the median of the strong items, or of all where none is strong; axes that both have two or more strong items and differ by
    over 4 % make it anisotropic, and an item along one is then held against its axis. An outlier is off by more than its
    tolerance (both to four places). A case passes with no outliers, two strong kinds, and no anisotropy. Items without a
    finite positive m_per_px have no say; an unknown kind is an error. max_deviation is that from the scale itself.
    """
    ok = items.where(F.col("m_per_px").isNotNull() & ~F.isnan("m_per_px") & (F.col("m_per_px") > 0) & (F.col("m_per_px") < float("inf")))
    strong = ~F.col("kind").isin(*WEAK)
    of = lambda c: F.when(c, F.col("m_per_px"))
    on = lambda a: of(strong & (F.col("axis") == a))
    kind = F.when(F.col("kind") == "bar_box", "bar").otherwise(F.col("kind"))
    case = ok.groupBy("case").agg(
        F.coalesce(F.median(of(strong)), F.median("m_per_px")).alias("m_per_px_all"),
        F.median(on("x")).alias("mx"), F.count(on("x")).alias("nx"), F.median(on("y")).alias("my"), F.count(on("y")).alias("ny"),
        F.count_distinct(F.when(strong, kind)).alias("strong_kinds"),
    )
    both = (F.col("nx") >= 2) & (F.col("ny") >= 2)
    case = case.withColumn("x_over_y", F.when(both, F.col("mx") / F.col("my"))).withColumn("anisotropic", both & (F.abs(F.col("mx") / F.col("my") - 1) > ANISOTROPY))
    own = F.when(F.col("anisotropic") & (F.col("axis") == "x"), F.col("mx")).when(F.col("anisotropic") & (F.col("axis") == "y"), F.col("my")).otherwise(F.col("m_per_px_all"))
    judged = ok.join(case, "case").withColumn("deviation", F.bround(F.col("m_per_px") / own - 1, 4)).withColumn("whole", F.abs(F.col("m_per_px") / F.col("m_per_px_all") - 1))
    # What a case has is the same in all its rows, so it is grouped by in the shuffle that brought it there.
    outlier = F.abs("deviation") > tolerance()
    verdict = judged.groupBy("case", "m_per_px_all", "strong_kinds", "x_over_y", "anisotropic").agg(F.count("*").alias("items"), F.count_if(outlier).alias("outliers"), F.bround(F.max("whole"), 4).alias("max_deviation"))
    passed = (F.col("outliers") == 0) & (F.col("strong_kinds") >= 2) & ~F.col("anisotropic")
    return verdict.select("case", "items", F.col("m_per_px_all").alias("m_per_px"), "strong_kinds", "x_over_y", "anisotropic", "outliers", "max_deviation", passed.alias("passed"))


def tolerance() -> Column:
    """Of an item (kind, px, tol): its own, or that of its kind, which for a length is what two pixels make of it at least."""
    by_kind = F.create_map(*[F.lit(x) for kv in TOLERANCE.items() for x in kv])[F.col("kind")]
    by_kind = F.coalesce(by_kind, F.raise_error(F.concat(F.lit("unknown kind of evidence: "), F.coalesce("kind", F.lit("null")))).cast("double"))
    floor = F.when(F.col("kind").isin(*LENGTHS) & (F.col("px") > 0), F.bround(F.greatest(by_kind, PIXELS_OFF / F.col("px")), 4))
    return F.coalesce("tol", floor, by_kind)


def suite(verdicts: DataFrame, expected: DataFrame) -> DataFrame:
    """Cases of expected (case, passed_expected, and the render settings page, dpi, width, height, drop_text, clip of now and, prefixed with was_, of the trace) with ok: the settings are the same and the verdict is the expected one. A case without a verdict is null."""
    same = F.lit(True)
    for c in ("page", "dpi", "width", "height", "drop_text"):
        same &= F.col(c).eqNullSafe(F.col(f"was_{c}"))
    places = lambda c: F.transform(c, lambda x: F.bround(x, 3))
    same &= places("clip").eqNullSafe(places("was_clip"))
    found = expected.join(verdicts.select("case", "passed"), "case", "left")
    return found.select("case", same.alias("same_render"), "passed", (same & (F.col("passed") == F.col("passed_expected"))).alias("ok"))


def alignment(pairs: DataFrame) -> DataFrame:
    """One slope for both axes and an intercept each: a = slope * b + intercept, by least squares, of pairs (case, axis, a, b); residuals' maximum and root mean square. Null without spread in b."""
    centres = pairs.groupBy("case", "axis").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    centred = pairs.join(centres, ["case", "axis"])
    slope = centred.groupBy("case").agg((F.sum((F.col("a") - F.col("ma")) * (F.col("b") - F.col("mb"))) / F.nullif(F.sum((F.col("b") - F.col("mb")) * (F.col("b") - F.col("mb"))), F.lit(0.0))).alias("slope"))
    fitted = centred.join(slope, "case").withColumn("residual", F.col("a") - F.col("ma") - F.col("slope") * (F.col("b") - F.col("mb")))
    per_axis = fitted.groupBy("case", "axis").agg(F.first("slope").alias("slope"), (F.first("ma") - F.first("slope") * F.first("mb")).alias("intercept"), F.max(F.abs("residual")).alias("max_residual"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms"), F.count("*").alias("n"))
    return per_axis


def circle_fit(points: DataFrame) -> DataFrame:
    """Algebraic least-squares circle of points (case, x, y): cx, cy, r, and residuals' maximum and population deviation.

    With coordinates from their mean, x^2 + y^2 = 2 u x + 2 v y + c is linear and its normal equations come apart: u and v solve a 2 x 2 system.
    """
    mean = points.groupBy("case").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"))
    p = points.join(mean, "case").withColumn("u", F.col("x") - F.col("mx")).withColumn("v", F.col("y") - F.col("my")).withColumn("z", F.expr("u * u + v * v"))
    s = p.groupBy("case").agg(*[F.sum(F.expr(e)).alias(n) for n, e in (("suu", "u * u"), ("suv", "u * v"), ("svv", "v * v"), ("suz", "u * z"), ("svz", "v * z"), ("sz", "z"))], F.first("mx").alias("mx"), F.first("my").alias("my"), F.first("n").alias("n"))
    s = s.withColumn("det", F.nullif(F.expr("suu * svv - suv * suv"), F.lit(0.0))).withColumn("a", F.expr("(suz * svv - svz * suv) / det / 2")).withColumn("b", F.expr("(svz * suu - suz * suv) / det / 2"))
    s = s.select("case", (F.col("a") + F.col("mx")).alias("cx"), (F.col("b") + F.col("my")).alias("cy"), F.sqrt(F.expr("sz / n + a * a + b * b")).alias("r"))
    off = points.join(s, "case").withColumn("off", F.sqrt(F.expr("(x - cx) * (x - cx) + (y - cy) * (y - cy)")) - F.col("r"))
    return off.groupBy("case").agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.first("r").alias("r"), F.max(F.abs("off")).alias("max_off"), F.stddev_pop("off").alias("std_off"))


def shoelace(points: DataFrame) -> DataFrame:
    """Area of each polygon of points (case, ord, x, y) in order, closed from the last to the first."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("case").orderBy("ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx = F.coalesce(F.lead("x").over(w), F.first("x").over(whole))
    ny = F.coalesce(F.lead("y").over(w), F.first("y").over(whole))
    return points.withColumn("nx", nx).withColumn("ny", ny).groupBy("case").agg((F.abs(F.sum(F.expr("x * ny - nx * y"))) / 2).alias("area"), F.count("*").alias("n"))
