"""Matches between rectangles, cells and names: edges that snap to others, first containers, lists of the largest, and lookups with a fallback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnframe.storage import dealt


def snapped(rects: DataFrame, below: DataFrame, tol: float, margin: float = 40.0, least: float = 4.0) -> DataFrame:
    """rects (name, x0, y0, x1, y1) with each edge moved to the nearest edge of that direction, within ``tol``, of a rectangle below that lies no further than ``margin`` beside it; and moved, how many edges were.

    Ties go to the smaller coordinate. Where a rectangle would be thinner than ``least``, its edges stay. Edges meet by cells of ``tol`` across and of ``margin`` along.
    """
    ends = ("x0", "y0", "x1", "y1")
    numbers = lambda t, *keys: t.select(*keys, *[F.col(c).cast("double").alias(c) for c in ends])
    own, b = dealt(numbers(rects, "name"), "name", rows=20_000), dealt(numbers(below), rows=20_000)
    edge = lambda c, axis: F.struct(F.lit(c).alias("edge"), F.lit(axis).alias("axis"), F.col(c).alias("at"), F.col("y0" if axis == "x" else "x0").alias("lo"), F.col("y1" if axis == "x" else "x1").alias("hi"))
    edges = lambda t: F.inline(F.array(*[edge(c, c[0]) for c in ("x0", "x1", "y0", "y1")]))
    span = lambda lo, hi, m: F.explode(F.sequence(F.floor((F.col(lo) - m) / margin), F.floor((F.col(hi) + m) / margin)))
    cell, reach = 2 * tol, 1.001 * tol
    parts = own.rdd.getNumPartitions() + b.rdd.getNumPartitions()
    a = own.select("name", edges(own)).withColumn("i", F.floor(F.col("at") / cell)).withColumn("j", span("lo", "hi", margin))
    b = b.select(edges(b)).select(F.col("axis").alias("b_axis"), F.col("at").alias("to"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    b = b.withColumn("b_i", F.explode(F.sequence(F.floor((F.col("to") - reach) / cell), F.floor((F.col("to") + reach) / cell)))).withColumn("b_j", span("b_lo", "b_hi", 0.0))
    # Dealt by rows and merged: a broadcast of what lies below, and tasks that sort whole blocks of edges, would grow with the tables.
    a, b = a.repartition(parts, "axis", "i", "j"), b.repartition(parts, "b_axis", "b_i", "b_j")
    met = a.join(b.hint("merge"), (F.col("axis") == F.col("b_axis")) & (F.col("i") == F.col("b_i")) & (F.col("j") == F.col("b_j"))).where((F.col("b_hi") >= F.col("lo") - margin) & (F.col("b_lo") <= F.col("hi") + margin) & (F.abs(F.col("to") - F.col("at")) <= tol))
    # The nearest edge is the last one up to this or the first one from it on; numbers alone are grouped without sorting.
    sides = {"lo": (F.max, F.col("to") <= F.col("at")), "hi": (F.min, F.col("to") >= F.col("at"))}
    near = met.groupBy("name").agg(*[f(F.when((F.col("edge") == c) & side, F.col("to"))).alias(f"{n}_{c}") for c in ends for n, (f, side) in sides.items()])
    both = own.join(near, "name", "left")

    def nearest(c: str) -> Column:
        """Where the edge goes, null if it stays."""
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        to = F.when(hi.isNull() | (F.abs(lo - F.col(c)) <= F.abs(hi - F.col(c))), lo).otherwise(hi)
        return F.when(F.abs(to - F.col(c)) > 1e-9, to)

    both = both.withColumns({f"n_{c}": nearest(c) for c in ends})
    new = {c: F.coalesce(f"n_{c}", c) for c in ends}
    wide = (new["x1"] - new["x0"] >= least) & (new["y1"] - new["y0"] >= least)
    moved = sum((F.col(f"n_{c}").isNotNull().cast("long") for c in ends), F.lit(0))
    return both.select("name", *[F.when(wide, new[c]).otherwise(F.col(c)).alias(c) for c in new], F.coalesce(F.when(wide, moved), F.lit(0)).cast("long").alias("moved"))


def first_container(points: DataFrame, cells: DataFrame, cell: float) -> DataFrame:
    """Points (id, x, y) with the smallest number of the boxes (idx, x0, y0, x1, y1; ends included) that hold them, and how many do; null and 0 where none does."""
    p = points.select("id", "x", "y").withColumn("i", F.floor(F.col("x") / cell)).withColumn("j", F.floor(F.col("y") / cell))
    c = cells.select("idx", "x0", "y0", "x1", "y1").withColumn("i", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))).withColumn("j", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
    held = p.join(c, ["i", "j"]).where((F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))).groupBy("id").agg(F.min("idx").alias("idx"), F.count("*").alias("n"))
    return points.select("id").join(held, "id", "left").select("id", "idx", F.coalesce("n", F.lit(0)).alias("n"))


def named_or_all(rows: DataFrame, named: DataFrame, all_: DataFrame, key: str, value: str) -> DataFrame:
    """rows (key) with the values that ``named`` (key, value) lists for them, or those of ``all_`` (value) for keys that it doesn't have at all. all_ is a short list."""
    listed = named.select(key).distinct()
    own = rows.join(named, key)
    rest = rows.join(listed, key, "left_anti").join(all_.agg(F.array_sort(F.collect_set(value)).alias("values")))  # one row
    return own.select(key, value).unionByName(rest.select(key, F.explode("values").alias(value)))


def largest(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group (of all, without groups) in that order."""
    if not by:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def distinct_sorted(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The distinct values of each group in order; nulls are none."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_set(value)).alias(f"{value}s"))


def large_parts(parts: DataFrame, by: str, share: float) -> DataFrame:
    """Parts (by, label, pixels and more) with as many pixels as ``share`` of their image's, and one at least."""
    total = F.sum("pixels").over(Window.partitionBy(by))
    return parts.withColumn("total", total).where(F.col("pixels") >= F.greatest(F.lit(1.0), share * F.col("total"))).drop("total")


def plan_overlap(plan: DataFrame, model: DataFrame, excluded: DataFrame, margin: int = 0) -> DataFrame:
    """Per image the pixels (img, y, x) of plan and model, but for those within ``margin`` of an excluded one, that both have, that either has, and their ratio."""
    keep = excluded.select("img", F.explode(F.sequence(F.col("y") - margin, F.col("y") + margin)).alias("y"), "x").select("img", "y", F.explode(F.sequence(F.col("x") - margin, F.col("x") + margin)).alias("x")).distinct()
    mark = lambda t, c: t.select("img", "y", "x", F.lit(c).alias("c"))
    seen = mark(plan, 1).unionByName(mark(model, 2)).groupBy("img", "y", "x").agg(F.bit_or("c").alias("c")).join(keep, ["img", "y", "x"], "left_anti")
    return seen.groupBy("img").agg(F.count_if(F.col("c") == 3).alias("both"), F.count("*").alias("either")).withColumn("iou", F.col("both") / F.col("either"))


#: Where an engine puts the axes of a level, and the sign it gives them.
AXES = {"unreal": (("x", 1), ("y", -1), ("z", 1)), "unity": (("x", -1), ("z", 1), ("y", -1))}


def imported(expected: DataFrame, found: DataFrame, engine: str, scale: float = 1.0, tol: float = 1e-3) -> DataFrame:
    """Per mesh of an engine's import (name, x0 .. z1, triangles, uv_layers) or of what was sent (the same) its state and what differs once axes are mapped and lengths scaled."""
    ends = [f"{c}{e}" for c in "xyz" for e in "01"]
    mapped = {}
    for to, (of, sign) in zip("xyz", AXES[engine], strict=True):
        lo, hi = (F.col(f"{of}0"), F.col(f"{of}1")) if sign > 0 else (-F.col(f"{of}1"), -F.col(f"{of}0"))
        mapped |= {f"e_{to}0": lo * scale, f"e_{to}1": hi * scale}
    e = expected.select(F.col("name").alias("e_name"), F.col("triangles").alias("e_triangles"), F.col("uv_layers").alias("e_uv"), *[v.alias(k) for k, v in mapped.items()])
    both = found.join(e, F.col("name") == F.col("e_name"), "full")
    off = F.greatest(*[F.abs(F.col(c) - F.col(f"e_{c}")) for c in ends])
    state = F.when(F.col("name").isNull(), "missing").when(F.col("e_name").isNull(), "extra").otherwise("matched")
    false = F.lit(False)
    matched = F.col("name") == F.col("e_name")
    return both.select(F.coalesce("name", "e_name").alias("name"), state.alias("state"), F.coalesce(matched & (off > tol * scale), false).alias("bounds_differ"), F.coalesce(matched & (F.col("triangles") != F.col("e_triangles")), false).alias("triangles_differ"), F.coalesce(matched & (F.col("uv_layers") < F.col("e_uv")), false).alias("uv_lost"))


def scissor_stairs(stairs: DataFrame, slab: float = 0.2, waist: float = 0.15) -> DataFrame:
    """Steps of two straight flights that climb a whole storey in opposite directions: name, lane (a or b), step, along0, along1, z0, z1.

    stairs: name, height (of the storey), top (of what is built), risers (2 or more; other rows have no steps), run0, run1. A step is as thick as the waist below its riser, and
    ends at the top; steps of no thickness are left out.
    """
    ok = stairs.where(F.col("risers") >= 2).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("risers") - 2)))
    rise, step = F.col("height") / F.col("risers"), (F.col("run1") - F.col("run0")) / (F.col("risers") - 1)
    z1 = F.least((F.col("i") + 1) * rise, "top")
    z0 = F.greatest(F.lit(-slab), F.col("i") * rise - waist)
    lane = lambda n, start, d: ok.select("name", F.lit(n).alias("lane"), F.col("i").alias("step"), F.least(start + F.col("i") * d, start + (F.col("i") + 1) * d).alias("along0"), F.greatest(start + F.col("i") * d, start + (F.col("i") + 1) * d).alias("along1"), z0.alias("z0"), z1.alias("z1"))
    return reduce(DataFrame.unionByName, [lane("a", F.col("run0"), step), lane("b", F.col("run1"), -step)]).where(F.col("z0") < F.col("z1"))
