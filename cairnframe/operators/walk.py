"""Walkability over heights above a grid: cells (i, j) with solid intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .sequences import headroom, sweep


def standing(intervals: DataFrame, height: float) -> DataFrame:
    """Places to stand (i, j, rank, z, free): tops of what solid intervals (i, j, lo, hi) leave ``height`` above."""
    cells = intervals.withColumn("cell", F.struct("i", "j"))
    tops = headroom(sweep(cells.select("cell", "lo", "hi"), "cell"), "cell", height)
    return tops.select("cell.i", "cell.j", "rank", "z", "free")


def steps(places: DataFrame, step: float, height: float) -> DataFrame:
    """Pairs of places in cells that share a side, no further apart than ``step`` in height and with ``height`` free above the higher."""
    a = places.select(*[F.col(c).alias(f"a_{c}") for c in ("i", "j", "rank", "z", "free")])
    b = places.select(*[F.col(c).alias(f"b_{c}") for c in ("i", "j", "rank", "z", "free")])
    to = a.withColumn("to", F.explode(F.array(F.struct((F.col("a_i") + 1).alias("i"), F.col("a_j").alias("j")), F.struct(F.col("a_i").alias("i"), (F.col("a_j") + 1).alias("j")))))
    near = to.join(b, (F.col("to.i") == F.col("b_i")) & (F.col("to.j") == F.col("b_j"))).drop("to")
    room = F.least(F.col("a_z") + F.col("a_free"), F.col("b_z") + F.col("b_free")) - F.greatest("a_z", "b_z")
    return near.where((F.abs(F.col("a_z") - F.col("b_z")) <= step) & (room >= height))


def regions(places: DataFrame, step: float, height: float) -> DataFrame:
    """places with region: the first place (by i, j, rank) that steps lead to."""
    node = lambda p: F.struct(*[F.col(f"{p}{c}").cast("long").alias(c) for c in ("i", "j", "rank")])
    tied = components(steps(places, step, height).select(node("a_").alias("a"), node("b_").alias("b")))
    own = places.withColumn("own", node(""))
    return own.join(tied.withColumnRenamed("node", "of"), F.col("own") == F.col("of"), "left").withColumn("region", F.coalesce("label", "own")).drop("own", "of", "label")


def region_stats(with_region: DataFrame, cell: float) -> DataFrame:
    """Per region: cells, area, extent and height range."""
    return with_region.groupBy("region").agg(F.count("*").alias("cells"), (F.count("*") * cell * cell).alias("area"), *[f(c).alias(f"{c}{n}") for c in ("i", "j", "z") for f, n in ((F.min, "0"), (F.max, "1"))])


def clear(places: DataFrame, blocked: DataFrame, radius: int) -> DataFrame:
    """Places with no blocked cell (i, j) nearer than ``radius`` cells, by an anti join on the disc's offsets."""
    disc = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b < radius * radius]
    if not disc:
        return places
    shadow = blocked.select(F.inline(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a, b in disc]))).distinct()
    return places.join(shadow, ["i", "j"], "left_anti")


def heights(places: DataFrame) -> DataFrame:
    """places with mm: the height in whole millimetres that each is judged at, the highest of those there are that lies within 0.6 mm of it."""
    own = places.withColumn("mm", F.round(F.col("z") * 1000).cast("long"))
    above = own.select((F.col("mm") - 1).alias("below")).distinct()
    near = F.abs(F.col("z") - (F.col("mm") + 1) / 1000.0) < 6e-4
    return own.join(above, (F.col("mm") == F.col("below")) & near, "left").withColumn("mm", F.col("mm") + F.when(F.col("below").isNotNull(), 1).otherwise(0)).drop("below")


def standable(places: DataFrame, intervals: DataFrame, radius: float, height: float, step: float, cell: float) -> DataFrame:
    """Places (i, j, rank, z ...) around which a body of ``radius`` and ``height`` has room: all cells whose centres are nearer than radius and half a cell hold a place within ``step`` of the height, and no solid interval (i, j, lo, hi) between ``step`` and ``height`` above it.

    Each place looks at the cells of its disc, so the work goes with places times disc. A cell's places and solids are one row. Places of null height have no room; empty tables give none.
    """
    reach = (radius + cell / 2) / cell
    n = int(reach)
    disc = [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if a * a + b * b < reach * reach]
    feet = places.groupBy("i", "j").agg(F.collect_set("z").alias("feet"))
    solids = sweep(intervals.select(F.struct("i", "j").alias("cell"), "lo", "hi"), "cell").groupBy("cell").agg(F.collect_set(F.struct("lo", "hi")).alias("solids")).select("cell.i", "cell.j", "solids")
    around = feet.join(solids, ["i", "j"], "left").select(F.col("i").alias("c_i"), F.col("j").alias("c_j"), "feet", "solids")
    at = heights(places.where("z IS NOT NULL"))
    looks = at.select("i", "j", "mm").distinct().select("i", "j", "mm", F.inline(F.array(*[F.struct((F.col("i") + a).alias("c_i"), (F.col("j") + b).alias("c_j")) for a, b in disc])))
    h = F.col("mm") / 1000.0
    footing = F.exists("feet", lambda z: F.abs(z - h) <= step + 1e-6)
    body = F.exists("solids", lambda s: (s["lo"] < h + height - 1e-6) & (s["hi"] > h + step + 1e-6))
    short = looks.join(around, ["c_i", "c_j"], "left").where(~F.coalesce(footing, F.lit(False)) | F.coalesce(body, F.lit(False))).select("i", "j", "mm").distinct()
    return at.join(short, ["i", "j", "mm"], "left_anti").drop("mm")
