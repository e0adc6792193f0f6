"""How far hinged leaves open before they meet what stands fast.

A leaf is a box in its own frame: p along the leaf from the hinge, q towards the side it opens to.
Opening by an angle turns it from p to q. What it meets first is either an edge of an obstacle that
one of its corners, moving on a circle, runs into, or a corner of an obstacle that one of its sides
runs into; both angles are those of a circle and a straight line, so no angle is tried out. Leaves
and edges meet by the boxes of what a leaf can reach. Obstacles without edges, leaves without
length or with null coordinates give no contact; an obstacle that only touches a closed leaf does not hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import box_pairs

#: Fixed values, in metres and degrees: what leaf boxes are made smaller by (free end, each face, top and bottom, beside the thickness at the hinge), how far and how finely they open.
SHRINK, LIMIT, STEP = (0.02, 0.005, 0.06, 0.02), 90.0, 0.1
_STILL = 1e-7


def leaf_boxes(leaves: DataFrame, centred: bool = False, shrink: tuple[float, float, float, float] = SHRINK) -> DataFrame:
    """leaves (id, hx, hy, ex, ey, sx, sy: the unit vector of the side they open to, near and far: where their faces lie on it from the hinge line, z0, z1) with length, thick, and the box made smaller: p0, p1, q0, q1, low, high. ``centred``: as if the box lay about the hinge line."""
    end, face, top, hinge = shrink
    length, thick = F.hypot(F.col("ex") - F.col("hx"), F.col("ey") - F.col("hy")), F.col("far") - F.col("near")
    q0, q1 = (-thick / 2, thick / 2) if centred else (F.col("near"), F.col("far"))
    boxes = leaves.withColumns({"length": length, "thick": thick})
    return boxes.withColumns({"p0": F.least(thick + hinge + end, length), "p1": length - end, "q0": q0 + face, "q1": q1 - face, "low": F.col("z0") + top, "high": F.col("z1") - top})


def _turn(at: Column, start: Column) -> Column:
    """Degrees from start on to at, both in radians, from just above 0 on; what is closer is a full turn."""
    t = F.degrees(F.pmod(at - start, F.lit(6.283185307179586)))
    return F.when(t.between(_STILL, 360 - _STILL), t)


def _corner_meets(p: str, q: str) -> Column:
    """The least turn at which the corner (p, q) of a leaf comes to the edge a - b, in the leaf's frame."""
    dx, dy = F.col("bp") - F.col("ap"), F.col("bq") - F.col("aq")
    a, b = dx * dx + dy * dy, F.col("ap") * dx + F.col("aq") * dy
    c = F.col("ap") * F.col("ap") + F.col("aq") * F.col("aq") - F.col(p) * F.col(p) - F.col(q) * F.col(q)
    root = F.sqrt(F.when((b * b - a * c >= 0) & (a > 0), b * b - a * c))
    start = F.atan2(F.col(q), F.col(p))
    on = [F.when(t.between(0, 1), _turn(F.atan2(F.col("aq") + t * dy, F.col("ap") + t * dx), start)) for t in ((-b - root) / a, (-b + root) / a)]
    return F.least(*on)


def _side_meets() -> Column:
    """The least turn at which a side of the leaf comes to the edge's first point."""
    r2, now = F.col("ap") * F.col("ap") + F.col("aq") * F.col("aq"), F.atan2("aq", "ap")
    hits = []
    for fixed, lo, hi, along_q in (("p0", "q0", "q1", True), ("p1", "q0", "q1", True), ("q0", "p0", "p1", False), ("q1", "p0", "p1", False)):
        root = F.sqrt(F.when(r2 >= F.col(fixed) * F.col(fixed), r2 - F.col(fixed) * F.col(fixed)))
        for other in (root, -root):
            at = F.atan2(other, F.col(fixed)) if along_q else F.atan2(F.col(fixed), other)
            hits.append(F.when(other.between(F.col(lo), F.col(hi)), _turn(now, at)))
    return F.least(*hits)


def _crosses() -> Column:
    """Whether the edge passes through the inside of the closed leaf's box: what the four sides leave of it is longer than nothing."""
    first, last = F.lit(0.0), F.lit(1.0)
    outside = F.lit(False)
    for a, b, lo, hi in (("ap", "bp", "p0", "p1"), ("aq", "bq", "q0", "q1")):
        d = F.col(b) - F.col(a)
        one, two = (F.col(lo) - F.col(a)) / F.nullif(d, F.lit(0.0)), (F.col(hi) - F.col(a)) / F.nullif(d, F.lit(0.0))
        first, last = F.greatest(first, F.least(one, two)), F.least(last, F.greatest(one, two))
        outside |= (d == 0) & ~((F.col(a) > F.col(lo)) & (F.col(a) < F.col(hi)))
    return ~outside & (last - first > 1e-9)


def contacts(leaves: DataFrame, edges: DataFrame, cell: float = 2.0) -> DataFrame:
    """id, contact (degrees to the first contact, null if there is none in a full turn), blocker (the obstacle met first, ties to the first) and closed (whether the closed leaf is within an obstacle), of leaves from leaf_boxes().

    edges: obstacle, ax, ay, bx, by_ (of closed outlines), z0, z1.
    """
    reach = F.col("length") + F.col("thick") + 0.05
    boxes = leaves.select("id", (F.col("hx") - reach).alias("x0"), (F.col("hx") + reach).alias("x1"), (F.col("hy") - reach).alias("y0"), (F.col("hy") + reach).alias("y1"), F.col("low").alias("z0"), F.col("high").alias("z1"))
    numbered = edges.withColumn("edge", F.xxhash64("obstacle", "ax", "ay", "bx", "by_", "z0", "z1"))
    lines = numbered.select(F.col("edge").alias("id"), F.least("ax", "bx").alias("x0"), F.greatest("ax", "bx").alias("x1"), F.least("ay", "by_").alias("y0"), F.greatest("ay", "by_").alias("y1"), "z0", "z1").distinct()
    near = box_pairs(boxes.where("x0 IS NOT NULL AND y0 IS NOT NULL"), lines, axes="xyz", cell=cell).withColumnsRenamed({"a_id": "id", "b_id": "edge"})
    # Merged, not broadcast: of leaves and edges there are as many as the tables have rows.
    met = near.join(leaves.hint("merge"), "id").join(numbered.withColumnsRenamed({"z0": "e_z0", "z1": "e_z1"}).hint("merge"), "edge").where((F.col("e_z0") < F.col("high") - 1e-6) & (F.col("e_z1") > F.col("low") + 1e-6))
    ux, uy = (F.try_divide(F.col(e) - F.col(h), F.col("length")) for h, e in (("hx", "ex"), ("hy", "ey")))
    local = {f"{e}{n}": (F.col(x) - F.col("hx")) * v + (F.col(y) - F.col("hy")) * w for e, x, y in (("a", "ax", "ay"), ("b", "bx", "by_")) for n, v, w in (("p", ux, uy), ("q", F.col("sx"), F.col("sy")))}
    met = met.withColumns(local)
    turn = F.least(_side_meets(), *[_corner_meets(p, q) for p in ("p0", "p1") for q in ("q0", "q1")])
    met = met.select("id", "obstacle", turn.alias("turn"), _crosses().alias("crosses"))
    found = met.groupBy("id").agg(F.min("turn").alias("contact"), F.min(F.when(F.col("turn").isNotNull(), F.struct("turn", "obstacle")))["obstacle"].alias("blocker"), F.bool_or("crosses").alias("crossed"))
    # A closed leaf that no edge crosses is within an obstacle if its middle is: edges to the right of it, by bands across.
    mid = leaves.select("id", "low", "high", *[(F.col(h) + u * (F.col("p0") + F.col("p1")) / 2 + F.col(s) * (F.col("q0") + F.col("q1")) / 2).alias(n) for h, u, s, n in (("hx", ux, "sx", "mx"), ("hy", uy, "sy", "my"))])
    span = edges.groupBy("obstacle").agg(F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.min(F.least("ay", "by_")).alias("y0"), F.max(F.greatest("ay", "by_")).alias("y1"), F.min("z0").alias("z0"), F.max("z1").alias("z1"))
    spots = mid.select("id", F.col("mx").alias("x0"), F.col("mx").alias("x1"), F.col("my").alias("y0"), F.col("my").alias("y1"), F.col("low").alias("z0"), F.col("high").alias("z1"))
    over = box_pairs(spots, span.withColumnRenamed("obstacle", "id"), axes="xyz", cell=cell).withColumnsRenamed({"a_id": "id", "b_id": "obstacle"}).join(mid.hint("merge"), "id").withColumn("band", F.floor(F.col("my") / cell))
    banded = edges.withColumn("band", F.explode(F.sequence(F.floor(F.least("ay", "by_") / cell), F.floor(F.greatest("ay", "by_") / cell))))
    right = (F.col("ay") != F.col("by_")) & (F.least("ay", "by_") <= F.col("my")) & (F.greatest("ay", "by_") > F.col("my")) & (F.col("ax") + (F.col("my") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by_") - F.col("ay")) > F.col("mx"))
    inside = over.join(banded.hint("merge"), ["obstacle", "band"]).where(right & (F.col("z0") < F.col("high") - 1e-6) & (F.col("z1") > F.col("low") + 1e-6)).groupBy("id", "obstacle").agg(F.count("*").alias("n")).where("n % 2 = 1").select("id").distinct().withColumn("within", F.lit(True))
    out = leaves.select("id").join(found.hint("merge"), "id", "left").join(inside.hint("merge"), "id", "left")
    return out.select("id", "contact", "blocker", (F.coalesce("crossed", F.lit(False)) | F.coalesce("within", F.lit(False))).alias("closed"))


def max_open(leaves: DataFrame, edges: DataFrame, limit: float = LIMIT, step: float = STEP, centred: bool = False, shrink: tuple[float, float, float, float] = SHRINK, cell: float = 2.0) -> DataFrame:
    """leaves (see leaf_boxes; further columns stay) with max_open in degrees, down to whole steps and at most ``limit``; blocker, null where that is reached; and closed. A leaf that is within an obstacle when closed does not open."""
    boxes = leaf_boxes(leaves, centred, shrink)
    met = contacts(boxes, edges, cell)
    held = F.coalesce(F.col("contact") < limit, F.lit(False))
    angle = F.when(F.col("closed"), 0.0).when(held, F.floor(F.col("contact") / step + 1e-9) * step).otherwise(limit)
    return boxes.select(*leaves.columns, "length", "thick").join(met.hint("merge"), "id").withColumns({"max_open": F.round(angle, 6), "blocker": F.when(held, F.col("blocker"))}).drop("contact")


def door_swing(leaves: DataFrame, edges: DataFrame, least: float | None = None, **options) -> DataFrame:
    """Per door of leaves (door, width, id ...; see max_open): max_open (of the leaf that opens least), clear (the width less what its leaves take of it), closed (whether one overlaps when closed), and passed: none does, and it opens ``least`` degrees if given. A door of which a leaf has no length is not measured."""
    from .doors import clear_widths

    each = max_open(leaves, edges, **options)
    angle = F.when(F.col("length") > 0, F.col("max_open"))
    wide = clear_widths(each.select("door", "width", "length", "thick", angle.alias("angle")))
    closed = each.groupBy("door").agg(F.bool_or("closed").alias("closed"), F.sort_array(F.collect_set("blocker")).alias("blockers"))
    both = wide.join(closed, "door")
    ok = F.col("max_open").isNotNull() & ~F.col("closed")
    return both.withColumn("passed", ok if least is None else ok & (F.col("max_open") >= least))
