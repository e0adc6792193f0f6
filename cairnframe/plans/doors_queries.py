"""Queries of doors, frames and storeys."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnframe.operators import doors, frames, level, swing

from .catalog import add

# leaves of closed doors.
_LEAVES = """m AS (SELECT *, CASE axis WHEN 'y' THEN ay ELSE ax END + 0.003 AS lo, CASE axis WHEN 'y' THEN "by" ELSE bx END - 0.003 AS hi, CASE axis WHEN 'y' THEN (ax + bx) / 2 ELSE (ay + "by") / 2 END AS mid_across,
      CASE WHEN kind IN ('glass', 'slide_glass', 'slide_double_glass') THEN 0.012 WHEN kind = 'elev' THEN 0.03 ELSE 0.04 END / 2 AS half, kind IN ('double', 'elev', 'slide_double', 'slide_double_glass') AS pair FROM door WHERE kind <> 'open'),
    l AS (SELECT *, 0 AS leaf, lo AS a, CASE WHEN pair THEN (lo + hi) / 2 - 0.002 ELSE hi END AS b, CASE WHEN pair OR (axis = 'x') = (hinge = 'a') THEN lo ELSE hi END AS h, CASE WHEN pair THEN (lo + hi) / 2 WHEN (axis = 'x') = (hinge = 'a') THEN hi ELSE lo END AS e FROM m
      UNION ALL SELECT *, 1, (lo + hi) / 2 + 0.002, hi, hi, (lo + hi) / 2 FROM m WHERE pair),
    leaf AS (SELECT name, kind, axis, leaf, CASE axis WHEN 'x' THEN a ELSE mid_across - half END AS x0, CASE axis WHEN 'x' THEN mid_across - half ELSE a END AS y0, CASE axis WHEN 'x' THEN b ELSE mid_across + half END AS x1, CASE axis WHEN 'x' THEN mid_across + half ELSE b END AS y1,
      CASE axis WHEN 'x' THEN h ELSE mid_across END AS hx, CASE axis WHEN 'x' THEN mid_across ELSE h END AS hy, CASE axis WHEN 'x' THEN e ELSE mid_across END AS ex, CASE axis WHEN 'x' THEN mid_across ELSE e END AS ey FROM l)"""
_SIX = ", ".join(f"round({c}, 6) AS {c}" for c in ("x0", "y0", "x1", "y1", "hx", "hy", "ex", "ey"))
add("door_leaves", f"WITH {_LEAVES} SELECT name, kind, axis, leaf, {_SIX} FROM leaf", "door")(doors.leaves)
# how sliding leaves move.
add(
    "slide_offsets",
    f"""WITH {_LEAVES}, s AS (SELECT leaf.*, d.width, d.side, leaf.kind LIKE '%double' AS two FROM leaf JOIN door d USING (name) WHERE leaf.kind LIKE 'slide%'),
    o AS (SELECT *, coalesce(two OR (axis = 'x' AND side IN ('E', 'W')) OR (axis = 'y' AND side IN ('N', 'S')), FALSE) AS ok FROM s)
    SELECT name, leaf, round(CASE WHEN ok THEN CASE WHEN two THEN hx - ex WHEN side = 'E' THEN width WHEN side = 'W' THEN -width ELSE 0 END END, 6) AS dx, round(CASE WHEN ok THEN CASE WHEN two THEN hy - ey WHEN side = 'N' THEN width WHEN side = 'S' THEN -width ELSE 0 END END, 6) AS dy, ok FROM o""",
    "door",
)(lambda d: doors.slide_offsets(doors.leaves(d), d))
# which way leaves turn to a point in the north-east.
add("swing_signs", f"WITH {_LEAVES} SELECT name, leaf, CAST(sign((ex - hx) * 1000 - (ey - hy) * 900) AS INTEGER) AS turn FROM leaf", "door")(
    lambda d: doors.leaves(d).select("name", "leaf", doors.swing_sign(F.col("hx"), F.col("hy"), F.col("ex"), F.col("ey"), F.col("hx") + 900, F.col("hy") + 1000).cast("int").alias("turn"))
)
# How far doors open.
_CLEAR = """w AS (SELECT door, CASE WHEN count(angle) = count(*) THEN min(angle) END AS max_open, CASE WHEN count(angle) = count(*) THEN max(width) - sum(length * cos(radians(angle)) + thick * sin(radians(angle))) END AS clear FROM opened GROUP BY 1)"""
add("clear_widths", f"WITH {_CLEAR} SELECT door, max_open, round(clear, 6) AS clear FROM w", "opened")(doors.clear_widths)
add("limited_doors", f"WITH {_CLEAR} SELECT door, max_open, round(clear, 6) AS clear FROM w WHERE max_open < 60 ORDER BY max_open, door LIMIT 20", "opened")(lambda t: doors.limited(t, 60.0))
# The wall that a door overlaps most.
add(
    "door_hosts",
    """WITH d AS (SELECT id AS door, brand AS floor, x0, x0 + 4 AS x1, y0, y0 + 3 AS y1 FROM box), w AS (SELECT brand AS floor, id AS wall, x0, x1, y0, y1 FROM box WHERE id % 3 = 0),
    o AS (SELECT door, wall, (least(d.x1, w.x1) - greatest(d.x0, w.x0)) * (least(d.y1, w.y1) - greatest(d.y0, w.y0)) AS area FROM d JOIN w ON d.floor = w.floor AND least(d.x1, w.x1) > greatest(d.x0, w.x0) AND least(d.y1, w.y1) > greatest(d.y0, w.y0)),
    r AS (SELECT *, row_number() OVER (PARTITION BY door ORDER BY area DESC, wall) AS n FROM o) SELECT d.door, r.wall, r.area FROM d LEFT JOIN r ON r.door = d.door AND n = 1""",
    "box",
)(lambda t: doors.hosts(t.select(F.col("id").alias("door"), F.col("brand").alias("floor"), "x0", (F.col("x0") + 4).alias("x1"), "y0", (F.col("y0") + 3).alias("y1")), t.where("id % 3 = 0").select(F.col("id").alias("name"), F.col("brand").alias("floor"), "x0", "x1", "y0", "y1")))
# How far leaves open before a block stops them; the SQL meets every corner and edge of a block near by, and every corner of it and side of the leaf.
_SWING = """l AS (SELECT name AS id, ax AS hx, ay AS hy, ax + width AS ex, ay AS ey, CASE WHEN name % 2 = 0 THEN 1.0 ELSE -1.0 END AS sy, 0.02 AS p_in, width - 0.02 AS p1, -0.02 + 0.005 AS q0, 0.02 - 0.005 AS q1, width FROM door WHERE kind IN ('single', 'double', 'glass') AND width > 0.2),
    f AS (SELECT *, least(0.04 + 0.02 + 0.02, width) AS p0 FROM l), b AS (SELECT id AS obstacle, x0 + 0.25 + id % 5 / 8.0 AS x0, x0 + 0.25 + id % 5 / 8.0 + id % 3 / 16.0 + 0.03125 AS x1, y0 + CASE WHEN id % 4 < 2 THEN 0.25 ELSE -1.0 END + id % 7 / 16.0 AS y0, y0 + CASE WHEN id % 4 < 2 THEN 0.25 ELSE -1.0 END + id % 7 / 16.0 + 0.25 AS y1, CASE WHEN id % 6 = 0 THEN 2.5 ELSE 0.0 END AS z0 FROM box),
    e AS (SELECT obstacle, z0, x0 AS ax, y0 AS ay, x1 AS bx, y0 AS b_y FROM b UNION ALL SELECT obstacle, z0, x1, y0, x1, y1 FROM b UNION ALL SELECT obstacle, z0, x1, y1, x0, y1 FROM b UNION ALL SELECT obstacle, z0, x0, y1, x0, y0 FROM b),
    m AS (SELECT id, obstacle, p0, p1, q0, q1, width, ax - hx AS ap, (ay - hy) * sy AS aq, bx - hx AS bp, (b_y - hy) * sy AS bq FROM f JOIN e ON floor(hx / 600) = floor(ax / 600) AND abs(ax - hx) < 5 AND abs(ay - hy) < 5 AND z0 < 1.9),
    c AS (SELECT *, unnest([p0, p0, p1, p1]) AS p, unnest([q0, q1, q0, q1]) AS q FROM m), k AS (SELECT *, (bp - ap) ** 2 + (bq - aq) ** 2 AS a, ap * (bp - ap) + aq * (bq - aq) AS b, ap ** 2 + aq ** 2 - p ** 2 - q ** 2 AS c FROM c),
    t AS (SELECT *, unnest([(-b - sqrt(b * b - a * c)) / a, (-b + sqrt(b * b - a * c)) / a]) AS t FROM k WHERE b * b >= a * c),
    s AS (SELECT *, unnest([p0, p1, q0, q1]) AS fixed, unnest([q0, q0, p0, p0]) AS lo, unnest([q1, q1, p1, p1]) AS hi, unnest([TRUE, TRUE, FALSE, FALSE]) AS side FROM m), r AS (SELECT *, unnest([1.0, -1.0]) * sqrt(ap ** 2 + aq ** 2 - fixed ** 2) AS other FROM s WHERE ap ** 2 + aq ** 2 >= fixed ** 2),
    h AS (SELECT id, obstacle, atan2(aq + t * (bq - aq), ap + t * (bp - ap)) - atan2(q, p) AS turn FROM t WHERE t BETWEEN 0 AND 1
      UNION ALL SELECT id, obstacle, atan2(aq, ap) - CASE WHEN side THEN atan2(other, fixed) ELSE atan2(fixed, other) END FROM r WHERE other BETWEEN lo AND hi),
    g AS (SELECT id, obstacle, degrees(turn - 2 * pi() * floor(turn / (2 * pi()))) AS turn FROM h), n AS (SELECT id, min(turn) AS turn FROM g WHERE turn BETWEEN 1e-7 AND 360 - 1e-7 GROUP BY 1),
    o AS (SELECT DISTINCT f.id FROM f JOIN b ON floor(hx / 600) = floor(x0 / 600) AND z0 < 1.9 AND x0 < hx + p1 AND x1 > hx + p0 AND CASE WHEN sy > 0 THEN y0 - hy ELSE hy - y1 END < q1 AND CASE WHEN sy > 0 THEN y1 - hy ELSE hy - y0 END > q0)"""
add(
    "door_swing",
    f"WITH {_SWING} SELECT f.id, round(CASE WHEN o.id IS NOT NULL THEN 0 WHEN n.turn < 90 THEN floor(n.turn / 0.1 + 1e-9) * 0.1 ELSE 90 END, 6) AS max_open, o.id IS NOT NULL AS closed, n.turn < 90 IS TRUE AS held FROM f LEFT JOIN n ON n.id = f.id LEFT JOIN o ON o.id = f.id",
    "door", "box",
)(
    lambda d, b: swing.max_open(
        d.where("kind IN ('single', 'double', 'glass') AND width > 0.2").selectExpr("name AS id", "ax AS hx", "ay AS hy", "ax + width AS ex", "ay AS ey", "0D AS sx", "CASE WHEN name % 2 = 0 THEN 1D ELSE -1D END AS sy", "-0.02D AS near", "0.02D AS far", "0D AS z0", "2D AS z1"),
        b.selectExpr("id AS obstacle", "x0 + 0.25D + id % 5 / 8D AS x0", "x0 + 0.25D + id % 5 / 8D + id % 3 / 16D + 0.03125D AS x1", "y0 + CASE WHEN id % 4 < 2 THEN 0.25D ELSE -1D END + id % 7 / 16D AS y0", "y0 + CASE WHEN id % 4 < 2 THEN 0.25D ELSE -1D END + id % 7 / 16D + 0.25D AS y1", "CASE WHEN id % 6 = 0 THEN 2.5D ELSE 0D END AS z0")
        .selectExpr("obstacle", "z0", "3D AS z1", "inline(array(struct(x0 AS ax, y0 AS ay, x1 AS bx, y0 AS by_), struct(x1 AS ax, y0 AS ay, x1 AS bx, y1 AS by_), struct(x1 AS ax, y1 AS ay, x0 AS bx, y1 AS by_), struct(x0 AS ax, y1 AS ay, x0 AS bx, y0 AS by_)))"),
    ).select("id", "max_open", "closed", F.col("blocker").isNotNull().alias("held"))
)
# Cells in openings.
add(
    "cells_in_openings",
    """WITH d AS (SELECT id AS door, x, y, id % 2 * 0.25 AS z, id * 0.1 AS yaw, 60.5 AS width, CASE WHEN id % 3 > 0 THEN 40.25 ELSE 12.5 END AS depth FROM supplier_at), c AS (SELECT x, y, id % 2 * 0.25 + id % 3 * 0.015 AS h, id % 5 > 0 AS main FROM customer_at)
    SELECT d.door, count(c.x) AS standable, count(*) FILTER (c.main) AS reachable FROM d LEFT JOIN c ON abs((c.x - d.x) * cos(yaw) + (c.y - d.y) * sin(yaw)) <= width / 2 AND abs((c.y - d.y) * cos(yaw) - (c.x - d.x) * sin(yaw)) <= depth / 2 AND abs(h - z) <= 0.02 GROUP BY 1""",
    "customer_at", "supplier_at",
)(lambda c, d: doors.in_opening(c.selectExpr("x", "y", "id % 2 * 0.25D + id % 3 * 0.015D AS h", "id % 5 > 0 AS main"), d.selectExpr("id AS door", "x", "y", "id % 2 * 0.25D AS z", "id * 0.1D AS yaw", "60.5D AS width", "CASE WHEN id % 3 > 0 THEN 40.25D END AS depth"), 20.0, 12.5))

# Coordinates between drawings and the world.
add(
    "frame_coordinates",
    """SELECT id, round(r, 6) AS reference, round(CASE WHEN s IS NOT NULL THEN r * s + tx WHEN a IS NOT NULL THEN (r - bx) / a ELSE r END, 6) AS back, round(CASE WHEN s IS NOT NULL THEN 10 / s WHEN a IS NOT NULL THEN 10 * a ELSE 10 END, 6) AS ten, round((r - 100) * 0.02, 6) AS wx, round((100 - r) * 0.02, 6) AS wy, round(p / 2.5 + 3, 6) AS pt
    FROM (SELECT *, CASE WHEN s IS NOT NULL THEN (p - tx) / s WHEN a IS NOT NULL THEN a * p + bx ELSE p END AS r FROM drawing)""",
    "drawing",
)(
    lambda t: t.withColumn("r", frames.to_reference(F.col("p"), "x")).select(
        "id", F.col("r").alias("reference"), frames.from_reference(F.col("r"), "x").alias("back"), (10 * frames.length_factor()).alias("ten"),
        frames.world_x(F.col("r"), F.lit(0.02), F.lit(100.0)).alias("wx"), frames.world_y(F.col("r"), F.lit(0.02), F.lit(100.0)).alias("wy"), frames.px_to_pt(F.col("p"), F.lit(3.0), F.lit(2.5)).alias("pt"),
    )
)
# What pages are; A29: the commonest.
add("page_classes", "SELECT id, CASE WHEN cover > 0.25 AND drawings < 200 THEN 'raster' WHEN cover > 0.05 THEN 'mixed' ELSE 'vector' END AS class FROM drawing", "drawing")(lambda t: t.select("id", frames.page_class(F.col("cover"), F.col("drawings")).alias("class")))
add("commonest_sizes", "SELECT brand, x, n FROM (SELECT brand, x1 - x0 AS x, count(*) AS n, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, x1 - x0) AS r FROM box GROUP BY 1, 2) WHERE r = 1", "box")(lambda t: frames.commonest(t.withColumn("x", F.col("x1") - F.col("x0")), ["brand"], "x"))
# Heights of storeys and columns; J25: storeys that columns cross; J14: shifts from floor to floor.
add("storey_heights", "SELECT *, coalesce(sum(wall + slab) OVER (PARTITION BY building ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z, wall + slab AS height FROM storey", "storey")(level.storeys)
_PILLAR = """p AS (SELECT id, k AS floor, "to", CASE WHEN "to" IS NOT NULL THEN t.z + t.wall WHEN through THEN l.z + l.wall + l.slab ELSE l.z + l.wall END AS z1, l.z AS z0 FROM pillar JOIN level_height l ON l.floor = k LEFT JOIN level_height t ON t.floor = "to")"""
add("column_heights", f"WITH {_PILLAR} SELECT id, z0, z1 FROM p", "pillar", "level_height")(lambda c, f: frames.column_heights(c.select("id", F.col("k").alias("floor"), "to", "through"), f).select("id", "z0", "z1"))
add("crossed_storeys", f"WITH {_PILLAR} SELECT p.id AS name, l.floor AS storey FROM p JOIN level_height l ON p.z0 < l.z + l.wall + l.slab - 0.001 AND p.z1 > l.z + 0.001", "pillar", "level_height")(
    lambda c, f: frames.crossing(
        frames.column_heights(c.select("id", F.col("k").alias("floor"), "to", "through"), f).select(F.lit("all").alias("set"), F.col("id").alias("name"), "z0", "z1"),
        f.select(F.lit("all").alias("set"), F.col("floor").alias("storey"), F.col("z").alias("lo"), F.expr("z + wall + slab").alias("hi")), "set",
    ).drop("set")
)
add(
    "column_shifts",
    """WITH c AS (SELECT building, k, name, min(x) AS x, min(y) AS y FROM pillar GROUP BY 1, 2, 3), f AS (SELECT building, max(k) AS top, min(k) AS bottom FROM c GROUP BY 1),
    j AS (SELECT coalesce(a.building, b.building) AS building, coalesce(a.k, b.k - 1) AS k, coalesce(a.name, b.name) AS name, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM c a FULL JOIN c b ON a.building = b.building AND a.name = b.name AND a.k = b.k - 1)
    SELECT building, k, name, CASE WHEN bx IS NULL THEN 'below' WHEN ax IS NULL THEN 'above' ELSE 'both' END AS side, bx - ax AS dx, b_y - ay AS dy FROM j JOIN f USING (building) WHERE k < top AND k >= bottom""",
    "pillar",
)(lambda t: frames.column_shifts(t.groupBy("building", "k", "name").agg(F.min("x").cast("double").alias("x"), F.min("y").cast("double").alias("y")), "building"))
# Tiles; M11: stairs of two flights; G19: points along rings.
add("tiles", "SELECT img, x0, y0, least(x0 + 512, width) AS x1, least(y0 + 512, height) AS y1 FROM (SELECT *, unnest(range(0, greatest(1, width - 64), 448)) AS x0 FROM image), LATERAL (SELECT unnest(range(0, greatest(1, height - 64), 448)) AS y0)", "image")(lambda t: frames.tiles(t, 512, 64))
add(
    "u_stairs",
    """WITH s AS (SELECT *, unnest(range(1, risers)) AS n FROM stair) SELECT name, 'up' AS part, n AS step, x + (n - 1) * run AS x0, y AS y0, x + n * run AS x1, y + width AS y1, z AS z0, round(z + n * rise / (2 * risers), 6) AS z1 FROM s
    UNION ALL SELECT name, 'back', n, x + run * (risers - 1) - n * run, y + width + gap, x + run * (risers - 1) - (n - 1) * run, y + 2 * width + gap, z, round(z + (risers + n) * rise / (2 * risers), 6) FROM s
    UNION ALL SELECT name, 'landing', 0, x + run * (risers - 1), y, x + run * (risers - 1) + depth, y + 2 * width + gap, z + rise / 2 - 0.2, z + rise / 2 FROM stair""",
    "stair",
)(lambda t: frames.u_stair(t.select("name", "risers", *[F.col(c).cast("double").alias(c) for c in ("z", "rise", "run", "x", "y", "width", "gap", "depth")])))
add(
    "ring_points",
    """WITH r AS (SELECT id AS ring, unnest([0, 1, 2, 3]) AS ord, unnest([x0, x1, x1, x0]) AS x, unnest([y0, y0, y1, y1]) AS y FROM box), p AS (SELECT id, x0, y0, x1 - x0 AS w, y1 - y0 AS h, CAST(greatest(3, round_even(2 * (x1 - x0 + y1 - y0) / 7.0, 0)) AS BIGINT) AS n FROM box),
    q AS (SELECT *, unnest(range(0, n)) AS k FROM p), d AS (SELECT *, k * (2.0 * (w + h) / n) AS d FROM q)
    SELECT id AS ring, k, round(CASE WHEN d < w - 1e-9 THEN x0 + d WHEN d < w + h - 1e-9 THEN x0 + w WHEN d < 2 * w + h - 1e-9 THEN x0 + 2 * w + h - d ELSE x0 END, 6) AS x, round(CASE WHEN d < w - 1e-9 THEN y0 WHEN d < w + h - 1e-9 THEN y0 + d - w WHEN d < 2 * w + h - 1e-9 THEN y0 + h ELSE y0 + 2 * w + 2 * h - d END, 6) AS y FROM d""",
    "box",
)(lambda t: frames.along_ring(t.select(F.col("id").alias("ring"), F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for i, (x, y) in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))]))), "ring", 7.0))
