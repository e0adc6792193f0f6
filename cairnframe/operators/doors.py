"""Doors: their leaves, how they slide and swing, the walls they stand in and the cells in their openings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import box_pairs

#: Thickness of leaves by kind, the gap between the leaves of a pair, and kinds of two leaves or that slide.
THIN, LIFT_THICKNESS, HALF_GAP = 0.012, 0.03, 0.002
PAIRS, SLIDES = ("double", "elev", "slide_double", "slide_double_glass"), ("slide", "slide_glass", "slide_double", "slide_double_glass")


def thickness(kind: Column, leaf: float) -> Column:
    return F.when(kind.isin("glass", "slide_glass", "slide_double_glass"), THIN).when(kind == "elev", LIFT_THICKNESS).otherwise(leaf)


def leaves(doors: DataFrame, leaf: float = 0.04, gap: float = 0.003) -> DataFrame:
    """Closed leaves of doors (name, kind, axis, hinge a or b, and the opening ax, ay, bx, by in metres): leaf (0 or 1), the box x0, y0, x1, y1, hinge hx, hy and free end ex, ey. An open doorway has none.

    Along the wall, a single leaf is hung at its start (for a wall along y, its end) if its hinge is a. Two leaves are hung at the ends.
    """
    along_y = F.col("axis") == "y"
    lo, hi = F.when(along_y, F.col("ay")).otherwise(F.col("ax")) + gap, F.when(along_y, F.col("by")).otherwise(F.col("bx")) - gap
    across = F.when(along_y, F.col("ax") + F.col("bx")).otherwise(F.col("ay") + F.col("by")) / 2
    made = doors.where(F.col("kind") != "open").withColumns({"lo": lo, "hi": hi, "across": across, "half": thickness(F.col("kind"), leaf) / 2, "mid": (lo + hi) / 2})
    at_lo = (F.col("hinge") == "a") != (F.col("axis") == "y")
    one = lambda n, a, b, h, e: F.struct(F.lit(n).alias("leaf"), a.alias("a"), b.alias("b"), h.alias("h"), e.alias("e"))
    low, high, mid = F.col("lo"), F.col("hi"), F.col("mid")
    pair = F.array(one(0, low, mid - HALF_GAP, low, mid), one(1, mid + HALF_GAP, high, high, mid))
    single = F.array(one(0, low, high, F.when(at_lo, low).otherwise(high), F.when(at_lo, high).otherwise(low)))
    each = made.select("*", F.inline(F.when(F.col("kind").isin(*PAIRS), pair).otherwise(single)))
    turned = lambda along, side, x: F.when(F.col("axis") == "y", side if x else along).otherwise(along if x else side)
    c, half = F.col("across"), F.col("half")
    return each.select(
        "name", "kind", "axis", "leaf",
        turned(F.col("a"), c - half, True).alias("x0"), turned(F.col("a"), c - half, False).alias("y0"), turned(F.col("b"), c + half, True).alias("x1"), turned(F.col("b"), c + half, False).alias("y1"),
        turned(F.col("h"), c, True).alias("hx"), turned(F.col("h"), c, False).alias("hy"), turned(F.col("e"), c, True).alias("ex"), turned(F.col("e"), c, False).alias("ey"),
    )


def slide_offsets(leaves_: DataFrame, doors: DataFrame) -> DataFrame:
    """How far the leaves of sliding doors move: name, leaf, dx, dy. Two go outwards; one goes its door's width to its side (N, S, E or W), which must lie along the wall: else ok is false and the offsets null."""
    own = leaves_.where(F.col("kind").isin(*SLIDES)).join(doors.select("name", "side", "width"), "name")
    pair = F.col("kind").isin(*PAIRS)
    sx = F.when(F.col("side") == "E", 1).when(F.col("side") == "W", -1).when(F.col("side").isin("N", "S"), 0)
    sy = F.when(F.col("side") == "N", 1).when(F.col("side") == "S", -1).when(F.col("side").isin("E", "W"), 0)
    ok = F.coalesce(pair | ((F.col("axis") == "x") == (sx != 0)), F.lit(False))
    dx, dy = F.when(pair, F.col("hx") - F.col("ex")).otherwise(sx * F.col("width")), F.when(pair, F.col("hy") - F.col("ey")).otherwise(sy * F.col("width"))
    return own.select("name", "leaf", F.when(ok, dx).alias("dx"), F.when(ok, dy).alias("dy"), ok.alias("ok"))


def swing_sign(hx: Column, hy: Column, ex: Column, ey: Column, tx: Column, ty: Column) -> Column:
    """1 or -1 as a leaf from its hinge to its free end turns against or with the clock to open towards (tx, ty)."""
    return F.signum((ex - hx) * (ty - hy) - (ey - hy) * (tx - hx))


def clear_widths(opened: DataFrame) -> DataFrame:
    """Per door of opened leaves (door, width, length, thick, angle in degrees or null): max_open, the least angle (null if one is unknown), and clear, the width less what the leaves take of it."""
    taken = F.col("length") * F.cos(F.radians("angle")) + F.col("thick") * F.sin(F.radians("angle"))
    known = F.count("angle") == F.count("*")
    return opened.groupBy("door").agg(F.when(known, F.min("angle")).alias("max_open"), F.when(known, F.max("width") - F.sum(taken)).alias("clear"))


def limited(opened: DataFrame, least: float, k: int = 20) -> DataFrame:
    """The k doors that open least, of those that open less than ``least`` degrees."""
    return clear_widths(opened).where(F.col("max_open") < least).orderBy("max_open", "door").limit(k)


def hosts(doors: DataFrame, walls: DataFrame, cell: float = 4.0) -> DataFrame:
    """The wall (by name, rectangle x0, y0, x1, y1, of a floor) that each door (door, floor, rectangle) overlaps most; ties to the first name; null where it meets none. They meet by their boxes."""
    sides = ["x0", "y0", "x1", "y1"]
    boxes = lambda t, name: t.select("floor", F.struct(name, *sides).alias("id"), *sides)
    both = box_pairs(boxes(doors, "door"), boxes(walls, "name"), cell=cell, by=["floor"])
    width = F.least("a_id.x1", "b_id.x1") - F.greatest("a_id.x0", "b_id.x0")
    height = F.least("a_id.y1", "b_id.y1") - F.greatest("a_id.y0", "b_id.y0")
    met = both.where((width > 0) & (height > 0)).select("a_id.door", F.col("b_id.name").alias("wall"), (width * height).alias("area"))
    met = met.groupBy("door").agg(F.max("area").alias("area"), F.min_by("wall", F.struct(-F.col("area"), "wall")).alias("wall"))
    return doors.select("door").join(met, "door", "left").select("door", "wall", "area")


def leaf_of_hinge(hinges: DataFrame, leaves_: DataFrame, by: str, reach: float = 0.10, pivot: float = 0.002) -> DataFrame:
    """hinge and leaf of each level: the leaf whose pivot is within ``pivot`` of a hinge (by, hinge, x, y), else the nearest centre within ``reach`` of those not taken before, hinges in order.

    leaves_: by, leaf, px, py (pivot or null), cx, cy. As one choice hangs on those before, a level's few doors are worked off in one group.
    """

    def one(key, h, l):  # noqa: E741
        import numpy as np
        import pandas as pd

        used, rows = set(), []
        l = l.sort_values("leaf")  # noqa: E741
        for r in h.sort_values("hinge").itertuples():
            close = np.hypot(l.px - r.x, l.py - r.y)
            hit = l.leaf[close <= pivot]
            if len(hit):
                found = hit.iloc[0]
            else:
                free = l[~l.leaf.isin(used)]
                far = np.hypot(free.cx - r.x, free.cy - r.y)
                found = free.leaf.loc[far.idxmin()] if len(free) and far.min() < reach else None
            if found is not None:
                used.add(found)
            rows.append((key[0], r.hinge, found))
        return pd.DataFrame(rows, columns=[by, "hinge", "leaf"])

    kinds = dict(hinges.dtypes) | dict(leaves_.dtypes)
    return hinges.groupBy(by).cogroup(leaves_.groupBy(by)).applyInPandas(one, f"{by} {kinds[by]}, hinge {kinds['hinge']}, leaf {kinds['leaf']}")


def in_opening(cells: DataFrame, doors: DataFrame, cell: float, depth: float = 0.10, flat: float = 0.02) -> DataFrame:
    """Per door (door, x, y, z, yaw in radians, width, depth or null): how many cells (x, y, h, main) stand in its opening, a rectangle of width by depth turned by yaw, within ``flat`` of its height; and how many of them are of the main component.

    Cells and doors meet by squares of side ``cell``.
    """
    d = doors.withColumn("deep", F.coalesce("depth", F.lit(depth))).withColumn("r", F.hypot(F.col("width") / 2, F.col("deep") / 2))
    square = lambda a, b: F.sequence(F.floor(a / cell), F.floor(b / cell))
    d = d.select("door", F.col("x").alias("dx"), F.col("y").alias("dy"), "z", "yaw", "width", "deep", F.explode(square(F.col("x") - F.col("r"), F.col("x") + F.col("r"))).alias("i"), "r")
    d = d.withColumn("j", F.explode(square(F.col("dy") - F.col("r"), F.col("dy") + F.col("r"))))
    met = cells.withColumn("i", F.floor(F.col("x") / cell)).withColumn("j", F.floor(F.col("y") / cell)).join(d, ["i", "j"])
    ox, oy = F.col("x") - F.col("dx"), F.col("y") - F.col("dy")
    inside = (F.abs(ox * F.cos("yaw") + oy * F.sin("yaw")) <= F.col("width") / 2) & (F.abs(oy * F.cos("yaw") - ox * F.sin("yaw")) <= F.col("deep") / 2) & (F.abs(F.col("h") - F.col("z")) <= flat)
    counts = met.where(inside).groupBy("door").agg(F.count("*").alias("standable"), F.count_if("main").alias("reachable"))
    return doors.select("door").join(counts, "door", "left").select("door", F.coalesce("standable", F.lit(0)).alias("standable"), F.coalesce("reachable", F.lit(0)).alias("reachable"))
