"""Sections of meshes by many planes at once, island by island, and the footprints of slabs between heights.

Triangles and planes meet by cells of height. A segment runs with the solid on its left, so a section's area is a
sum over its segments, less what cavities take; segments of triangles that share an edge end at the same point to the
bit. A corner on a plane counts as just above it. Triangles without area, and null corners, give no segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .planes import normals

_EPS = 1e-7


def _z(p: str) -> Column:
    """A corner's height; on the plane, a hair above it."""
    return F.when(F.col(f"{p}z") == F.col("z"), F.col("z") + _EPS).otherwise(F.col(f"{p}z"))


def sections(tris: DataFrame, planes: DataFrame, cell: float = 1.0) -> DataFrame:
    """mesh, island, z and x0, y0, x1, y1 of the segments in which planes (mesh, island, z) cut triangles (mesh, island, ax, ay, az .. cz, turning against the clock from outside)."""
    height = [f(*[F.col(f"{p}z") for p in "abc"]) for f in (F.least, F.greatest)]
    t = normals(tris).withColumn("cell", F.explode(F.sequence(F.floor(height[0] / cell), F.floor(height[1] / cell))))
    p = planes.select("mesh", "island", F.col("z").cast("double").alias("z")).distinct().withColumn("cell", F.floor(F.col("z") / cell))
    met = t.join(p, ["mesh", "island", "cell"])

    def cut(a: str, b: str) -> Column:
        """Where the plane meets a side, worked out from its lesser end; null if it does not."""
        ends = [F.struct(F.col(f"{c}x").alias("x"), F.col(f"{c}y").alias("y"), _z(c).alias("z")) for c in (a, b)]
        u, v = F.least(*ends), F.greatest(*ends)
        share = F.try_divide(F.col("z") - u["z"], v["z"] - u["z"])
        return F.when((_z(a) < F.col("z")) != (_z(b) < F.col("z")), F.struct((u["x"] + share * (v["x"] - u["x"])).alias("x"), (u["y"] + share * (v["y"] - u["y"])).alias("y")))

    cuts = F.array_compact(F.array(cut("a", "b"), cut("b", "c"), cut("c", "a")))
    met = met.withColumn("cuts", cuts).where(F.size("cuts") == 2).withColumns({"p": F.get("cuts", F.lit(0)), "q": F.get("cuts", F.lit(1))})
    dx, dy = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")
    way = dy * F.col("nx") - dx * F.col("ny") >= 0
    first, last = F.when(way, F.col("p")).otherwise(F.col("q")), F.when(way, F.col("q")).otherwise(F.col("p"))
    return met.where(F.hypot(dx, dy) >= 1e-9).select("mesh", "island", "z", first["x"].alias("x0"), first["y"].alias("y0"), last["x"].alias("x1"), last["y"].alias("y1"))


def section_areas(segments: DataFrame) -> DataFrame:
    """mesh, island, z, area (what cavities leave; negative of an island that is inside out) and length of the outline of each section."""
    return segments.groupBy("mesh", "island", "z").agg((F.sum(F.expr("x0 * y1 - x1 * y0")) / 2).alias("area"), F.sum(F.hypot(F.expr("x1 - x0"), F.expr("y1 - y0"))).alias("length"))


def slabs(tris: DataFrame, low: float, high: float) -> DataFrame:
    """mesh, island, z0, z1 and z of what lies of each island between low and high: a slab from one height of its corners to the next, and the planes to look at it in, its middle, or three where a face is neither upright nor level."""
    key = ["mesh", "island"]
    upright = F.abs("nz") < 1e-6
    plain = normals(tris).groupBy(*key).agg(F.bool_and(upright | (F.abs("nz") > 1 - 1e-6)).alias("plain"))
    heights = tris.select(*key, F.explode(F.array(*[F.round(F.col(f"{p}z"), 6) for p in "abc"])).alias("h")).distinct()
    s = heights.select(*key, F.col("h").alias("z0"), F.lead("h").over(Window.partitionBy(*key).orderBy("h")).alias("z1")).where("z1 IS NOT NULL")
    s = s.withColumns({"z0": F.greatest("z0", F.lit(float(low))), "z1": F.least("z1", F.lit(float(high)))}).where("z1 - z0 > 1e-6")
    shares = F.when(F.col("plain"), F.array(F.lit(0.5))).otherwise(F.array(*[F.lit(v) for v in (1 / 6, 0.5, 5 / 6)]))
    return s.join(plain, key).select(*key, "z0", "z1", F.explode(shares).alias("share")).withColumn("z", F.expr("z0 + (z1 - z0) * share")).drop("share")


def footprints(tris: DataFrame, low: float, high: float, cell: float = 1.0) -> DataFrame:
    """Edges of what islands cover between low and high, as swing.contacts() takes them: obstacle (mesh, island, z), ax, ay, bx, by_, z0, z1 of the slab that stands for."""
    s = slabs(tris, low, high)
    cut = sections(tris, s, cell).join(s, ["mesh", "island", "z"])
    return cut.select(F.struct("mesh", "island", "z").alias("obstacle"), F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by_"), "z0", "z1")
