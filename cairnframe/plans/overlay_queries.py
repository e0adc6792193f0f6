"""Queries of set operations on polygons and of their measures; the SQL looks at unit squares, and at each point and edge."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnframe.operators import overlay
from cairnframe.storage import dealt

from .catalog import add

_L = "c AS (SELECT CAST(floor(id / 6) AS BIGINT) AS plan, id AS ring, id % 2 = 0 AS first, id * 7 % 13 AS x, id * 5 % 11 AS y, id % 5 + 2 AS w, id % 4 + 2 AS h FROM box)"
#: Ls: a rectangle without its upper right quarter.
_SQUARES = f"{_L}, u AS (SELECT *, unnest(range(x, x + 2 * w)) AS i FROM c), s AS (SELECT * FROM (SELECT *, unnest(range(y, y + 2 * h)) AS j FROM u) WHERE i < x + w OR j < y + h), n AS (SELECT plan, i, j, count(*) FILTER (first) % 2 = 1 AS a, count(*) FILTER (NOT first) % 2 = 1 AS b FROM s GROUP BY ALL)"
_RING = "posexplode(array(struct(x AS x, y AS y), struct(x + 2 * w AS x, y AS y), struct(x + 2 * w AS x, y + h AS y), struct(x + w AS x, y + h AS y), struct(x + w AS x, y + 2 * h AS y), struct(x AS x, y + 2 * h AS y))) AS (ord, p)"


def _side(t, first: bool):
    c = t.selectExpr("CAST(floor(id / 6) AS BIGINT) AS plan", "id AS ring", "id % 2 = 0 AS first", "id * 7 % 13 AS x", "id * 5 % 11 AS y", "id % 5 + 2 AS w", "id % 4 + 2 AS h").where("first" if first else "NOT first")
    return c.selectExpr("plan", "ring", _RING).selectExpr("plan", "ring", "ord", "p.x", "p.y")


# Set operations, by area and by where they lie.
for _name, _kept in overlay.OPERATIONS.items():
    add(f"overlay_{_name}", f"WITH {_SQUARES} SELECT plan, count(*) + 0e0 AS area, sum(i) + count(*) / 2e0 AS mx, sum(j) + count(*) / 2e0 AS my FROM n WHERE {_kept} GROUP BY 1", "box")(
        lambda t, name=_name: overlay.overlaid(_side(t, True), _side(t, False), "plan", name).groupBy("plan").agg(*[F.sum(F.expr(e)).alias(c) for e, c in (("(x1 - x0) * (y1 - y0)", "area"), ("(x1 - x0) * (y1 - y0) * (x0 + x1) / 2", "mx"), ("(x1 - x0) * (y1 - y0) * (y0 + y1) / 2", "my"))])
    )

_EDGES = "e AS (SELECT shape, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER f) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER f) AS b_y FROM outline WINDOW w AS (PARTITION BY shape ORDER BY ord), f AS (PARTITION BY shape ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
# Area, length, centroid, and what holds a point.
add(
    "outline_measures",
    f"WITH {_EDGES}, s AS (SELECT shape, sum(ax * b_y - bx * ay) / 2 AS a, sum(sqrt((bx - ax) ** 2 + (b_y - ay) ** 2)) AS length, sum((ax + bx) * (ax * b_y - bx * ay)) AS sx, sum((ay + b_y) * (ax * b_y - bx * ay)) AS sy FROM e GROUP BY 1) SELECT shape, round(abs(a), 6) AS area, round(length, 6) AS length, round(sx / 6 / a, 6) + 0 AS cx, round(sy / 6 / a, 6) + 0 AS cy FROM s",
    "outline",
)(lambda t: overlay.measures(t.selectExpr("shape", "0 AS ring", "ord", "x", "y"), "shape"))
add(
    "points_in_outlines",
    f"WITH {_EDGES}, g AS (SELECT *, ax + shape % 40 * 3 AS gx, bx + shape % 40 * 3 AS hx FROM e), p AS (SELECT id, x / 8.0 AS px, y / 125.0 - 2 AS py FROM supplier_at), m AS (SELECT id, shape, count(*) AS n FROM p JOIN g ON ay <> b_y AND least(ay, b_y) <= py AND greatest(ay, b_y) > py AND gx + (py - ay) * (hx - gx) / (b_y - ay) > px WHERE shape <= 400 GROUP BY ALL) SELECT id, shape FROM m WHERE n % 2 = 1",
    "outline", "supplier_at",
)(lambda t, s: overlay.containing(s.selectExpr("id", "x / 8D AS x", "y / 125D - 2 AS y"), t.where("shape <= 400").selectExpr("shape", "0 AS ring", "ord", "x + shape % 40 * 3 AS x", "y"), "shape"))
# Pieces of rings, disks of 32 corners and octagons; P20: parts that have area.
_PIECES = "s AS (SELECT id, id % 5 + 1e0 AS r0, id % 5 + 2.5e0 AS r1, id * 17 % 360 + 0e0 AS a0, id * 29 % 300 + 13e0 AS turn FROM box), n AS (SELECT *, CAST(greatest(1, ceil(turn / 6 - 1e-9)) AS BIGINT) AS n FROM s)"
add(
    "ring_pieces",
    f"WITH {_PIECES}, o AS (SELECT id, r1 AS r, a0 + turn * i / n AS a, i AS ord FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM n) UNION ALL SELECT id, r0, a0 + turn - turn * i / n, n + 1 + i FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM n)) SELECT id, ord, round(r * cos(radians(a)), 6) + 0 AS x, round(1 + r * sin(radians(a)), 6) + 0 AS y FROM o",
    "box",
)(
    # Dealt by rows, as one small file of boxes makes many corners; rounded once, in add().
    lambda t: dealt(t.select("id"), "id", rows=20_000).selectExpr("id", "id % 5 + 1D AS r0", "id % 5 + 2.5D AS r1", "id * 17 % 360 + 0D AS a0", "id * 29 % 300 + 13D AS turn")
    .select("id", F.posexplode(overlay.sector(F.lit(0.0), F.lit(1.0), F.col("r0"), F.col("r1"), F.col("a0"), F.col("a0") + F.col("turn"))).alias("ord", "p")).select("id", F.col("ord").cast("long").alias("ord"), "p.x", "p.y")
)
add(
    "shape_areas",
    "SELECT id, 'disk' AS kind, round(16 * r * r * sin(radians(11.25)), 6) AS area FROM (SELECT id, id % 9 / 4e0 AS r FROM box) WHERE r > 0 UNION ALL SELECT id, 'oct', round((x1 - x0) * (y1 - y0) - 2 * c * c, 6) FROM (SELECT *, id % 3 / 8e0 AS c FROM box)",
    "box",
)(
    lambda t: overlay.measures(
        overlay.large_parts(
            t.select(F.struct("id", F.lit("disk").alias("kind")).alias("shape"), overlay.disk(F.lit(1.0), F.lit(2.0), F.expr("id % 9 / 4D"), 32).alias("c"))
            .unionByName(t.select(F.struct("id", F.lit("oct").alias("kind")).alias("shape"), overlay.octagon(*map(F.col, ("x0", "y0", "x1", "y1")), F.expr("id % 3 / 8D")).alias("c")))
            .select("shape", F.lit(0).alias("ring"), F.posexplode("c").alias("ord", "p")).select("shape", "ring", "ord", "p.x", "p.y"), "shape"), "shape"
    ).select("shape.id", "shape.kind", "area")
)
