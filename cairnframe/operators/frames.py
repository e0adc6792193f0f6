"""Frames of drawings, their scale and storeys, as column functions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def to_reference(p: Column, axis: str) -> Column:
    """A coordinate of a floor's drawing on the reference drawing. The row has a, b<axis> (reference = a p + b), s, t<axis> (p = s reference + t), or nulls for the same drawing."""
    return F.when(F.col("s").isNotNull(), (p - F.col(f"t{axis}")) / F.col("s")).when(F.col("a").isNotNull(), F.col("a") * p + F.col(f"b{axis}")).otherwise(p.cast("double"))


def from_reference(p: Column, axis: str) -> Column:
    """The other way."""
    return F.when(F.col("s").isNotNull(), p * F.col("s") + F.col(f"t{axis}")).when(F.col("a").isNotNull(), (p - F.col(f"b{axis}")) / F.col("a")).otherwise(p.cast("double"))


def length_factor() -> Column:
    """Reference pixels of a pixel."""
    return F.coalesce(1 / F.col("s"), F.col("a"), F.lit(1.0))


def world_x(p: Column, m_per_px: Column, origin: Column) -> Column:
    return (p - origin) * m_per_px


def world_y(p: Column, m_per_px: Column, origin: Column) -> Column:
    """Drawings count downwards."""
    return (origin - p) * m_per_px


def pt_to_px(p: Column, clip: Column, px_per_pt: Column) -> Column:
    return (p - F.coalesce(clip, F.lit(0.0))) * px_per_pt


def px_to_pt(p: Column, clip: Column, px_per_pt: Column) -> Column:
    return p / px_per_pt + F.coalesce(clip, F.lit(0.0))


def page_class(image_cover: Column, drawings: Column) -> Column:
    """What a page is: raster if images cover over a quarter and there are under 200 drawings, mixed if over a twentieth, else vector."""
    return F.when((image_cover > 0.25) & (drawings < 200), "raster").when(image_cover > 0.05, "mixed").otherwise("vector")


def column_heights(columns: DataFrame, floors: DataFrame) -> DataFrame:
    """columns (floor, to or null, through) with z0 and z1: up to the top of the floor they name, through the slab over their floor, or to the wall's top.

    floors: floor, z, wall, slab.
    """
    own = floors.select("floor", "z", "wall", "slab")
    last = floors.select(F.col("floor").alias("to"), (F.col("z") + F.col("wall")).alias("top"))
    both = columns.join(own, "floor").join(last, "to", "left")
    wall_top = F.col("z") + F.col("wall")
    return both.select(*[c for c in columns.columns], F.col("z").alias("z0"), F.when(F.col("to").isNotNull(), F.col("top")).when(F.col("through"), wall_top + F.col("slab")).otherwise(wall_top).alias("z1"))


def crossing(columns: DataFrame, storeys: DataFrame, by: str, slack: float = 1e-3) -> DataFrame:
    """(name, storey) where a column (by, name, z0, z1) crosses a storey (by, storey, lo, hi) by more than ``slack``."""
    return columns.join(storeys, by).where((F.col("z0") < F.col("hi") - slack) & (F.col("z1") > F.col("lo") + slack)).select(by, "name", "storey")


def column_shifts(columns: DataFrame, by: str) -> DataFrame:
    """How far columns (by, floor number k, name, x, y) stand from those of their name on the next floor: dx, dy; names that only one of the two floors has give side below or above, and null shifts."""
    lower = columns.select(by, "k", "name", F.col("x").alias("x_"), F.col("y").alias("y_"))
    upper = columns.select(by, (F.col("k") - 1).alias("k"), "name", "x", "y")
    floors = columns.groupBy(by).agg(F.max("k").alias("top"), F.min("k").alias("bottom"))
    joined = lower.join(upper, [by, "k", "name"], "full").join(floors, by).where((F.col("k") < F.col("top")) & (F.col("k") >= F.col("bottom")))
    side = F.when(F.col("x").isNull(), "below").when(F.col("x_").isNull(), "above").otherwise("both")
    return joined.select(by, "k", "name", side.alias("side"), (F.col("x") - F.col("x_")).alias("dx"), (F.col("y") - F.col("y_")).alias("dy"))


def tiles(images: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Windows of images (img, width, height), tile - overlap apart, the last of a row or column cut at the edge: x0, y0, x1, y1."""
    starts = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(tile - overlap))
    out = images.withColumn("x0", F.explode(starts(F.col("width")))).withColumn("y0", F.explode(starts(F.col("height"))))
    return out.select("img", "x0", "y0", F.least(F.col("x0") + tile, "width").alias("x1"), F.least(F.col("y0") + tile, "height").alias("y1"))


def stair_steps(stairs: DataFrame) -> DataFrame:
    """Treads of stairs (name, z, rise in all, risers, run, first x): number, x0, x1 and top of each, the last being the floor above."""
    steps = stairs.select("*", F.explode(F.sequence(F.lit(1), F.col("risers") - 1)).alias("step"))
    return steps.select("name", "step", (F.col("x") + (F.col("step") - 1) * F.col("run")).alias("x0"), (F.col("x") + F.col("step") * F.col("run")).alias("x1"), (F.col("z") + F.col("step") * F.col("rise") / F.col("risers")).alias("top"))


def u_stair(stairs: DataFrame, landing: float = 0.20) -> DataFrame:
    """Cells of stairs of two flights (name, z, rise, risers of a flight, x, y, run, width, gap, depth of the landing): flight 1 goes up, the landing turns, flight 2 comes back beside it.

    A step of a flight is a riser of rise / (2 * risers); cells are x0, y0, x1, y1, z0 (the stair's foot, or the landing's underside) and z1.
    """
    riser = F.col("rise") / (2 * F.col("risers"))
    step = F.explode(F.sequence(F.lit(1), F.col("risers") - 1)).alias("step")
    cell = lambda flight, x0, x1, y0, z1: (F.lit(flight).alias("part"), F.col("step"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + F.col("width")).alias("y1"), F.col("z").alias("z0"), z1.alias("z1"))
    rows = stairs.select("*", step)
    length = F.col("run") * (F.col("risers") - 1)
    up = rows.select("name", *cell("up", F.col("x") + (F.col("step") - 1) * F.col("run"), F.col("x") + F.col("step") * F.col("run"), F.col("y"), F.col("z") + F.col("step") * riser))
    second = F.col("y") + F.col("width") + F.col("gap")
    back = rows.select("name", *cell("back", F.col("x") + length - F.col("step") * F.col("run"), F.col("x") + length - (F.col("step") - 1) * F.col("run"), second, F.col("z") + (F.col("risers") + F.col("step")) * riser))
    top = F.col("z") + F.col("risers") * riser
    turn = stairs.select("name", F.lit("landing").alias("part"), F.lit(0).alias("step"), (F.col("x") + length).alias("x0"), F.col("y").alias("y0"), (F.col("x") + length + F.col("depth")).alias("x1"), (F.col("y") + 2 * F.col("width") + F.col("gap")).alias("y1"), (top - landing).alias("z0"), top.alias("z1"))
    return up.unionByName(back).unionByName(turn)


def commonest(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The commonest value per group; ties go to the smaller."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), value)
    return counts.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def along_ring(corners: DataFrame, by: str, spacing: float, least: int = 3) -> DataFrame:
    """Points at equal distance along closed rings of corners (by, ord, x, y): max(least, round(length / spacing)) of them, the first at the first corner."""
    w = Window.partitionBy(by).orderBy("ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    side = corners.withColumn("x1", F.coalesce(F.lead("x").over(w), F.first("x").over(whole))).withColumn("y1", F.coalesce(F.lead("y").over(w), F.first("y").over(whole)))
    side = side.withColumn("len", F.hypot(F.col("x1") - F.col("x"), F.col("y1") - F.col("y"))).withColumn("to", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("len").over(Window.partitionBy(by)))
    side = side.withColumn("n", F.greatest(F.lit(least), F.bround(F.col("total") / spacing).cast("int"))).withColumn("gap", F.col("total") / F.col("n"))
    # The points of a side: those whose distance lies in [to - len, to).
    first, last = F.ceil((F.col("to") - F.col("len")) / F.col("gap") - 1e-9), F.ceil(F.col("to") / F.col("gap") - 1e-9) - 1
    side = side.where((F.col("len") > 0) & (last >= first)).withColumn("k", F.explode(F.sequence(first, F.least(last, F.col("n") - 1))))
    t = (F.col("k") * F.col("gap") - (F.col("to") - F.col("len"))) / F.col("len")
    return side.select(by, "k", (F.col("x") + t * (F.col("x1") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y1") - F.col("y"))).alias("y"))
