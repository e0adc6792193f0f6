"""Queries of filled polygons and filters; the SQL tests each pixel's middle, and each filter's whole square."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnframe.operators import fills

from .catalog import add

#: Outlines in pixels: 8 to a metre, about the middle of a page of 96 x 64.
_PX = "shape, ord, x * 8 + 40 + shape % 5 AS px, y * 8 + 24 + shape % 3 * 1.25e0 AS py"
_RINGS = f"p AS (SELECT {_PX} FROM outline), e AS (SELECT shape, px AS ax, py AS ay, coalesce(lead(px) OVER w, first_value(px) OVER f) AS bx, coalesce(lead(py) OVER w, first_value(py) OVER f) AS b_y FROM p WINDOW w AS (PARTITION BY shape ORDER BY ord), f AS (PARTITION BY shape ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
_HIT = "ay <> b_y AND least(ay, b_y) <= y + 0.5 AND greatest(ay, b_y) > y + 0.5 AND ax + (y + 0.5 - ay) * (bx - ax) / (b_y - ay) > x + 0.5"
_PIXELS = f"""{_RINGS}, g AS (SELECT unnest(range(0, 64)) AS y), h AS (SELECT unnest(range(0, 96)) AS x),
    c AS (SELECT shape, y, ax + (y + 0.5 - ay) * (bx - ax) / (b_y - ay) AS cut, CASE WHEN b_y > ay THEN 1 ELSE -1 END AS turn FROM e JOIN g ON ay <> b_y AND least(ay, b_y) <= y + 0.5 AND greatest(ay, b_y) > y + 0.5),
    i AS (SELECT shape, y, x, count(*) AS n, sum(turn) AS wind FROM c JOIN h ON cut > x + 0.5 GROUP BY 1, 2, 3)"""


def _rings(t):
    return t.selectExpr("shape", "0 AS ring", *[c.strip() for c in _PX.replace("1.25e0", "1.25D").split(",")[1:]]).withColumnsRenamed({"px": "x", "py": "y"})


# Polygons to runs of pixels, by parity and by winding.
add("filled_runs", f"WITH {_PIXELS}, k AS (SELECT shape, y, x, x - row_number() OVER (PARTITION BY shape, y ORDER BY x) AS island FROM i WHERE n % 2 = 1) SELECT shape, y, min(x) AS lo, max(x) AS hi FROM k GROUP BY shape, y, island", "outline")(lambda t: fills.filled(_rings(t), ["shape"], True, 96, 64))
add("wound_pixels", f"WITH {_PIXELS} SELECT shape, count(*) AS pixels FROM i WHERE wind <> 0 GROUP BY 1", "outline")(lambda t: fills.filled(_rings(t), ["shape"], False, 96, 64).groupBy("shape").agg(F.sum(F.expr("hi - lo + 1")).alias("pixels")))
# A page's paths of one colour, drawn by themselves; some by parity, some by winding.
add(
    "colour_mask",
    f"""WITH {_PIXELS}, m AS (SELECT DISTINCT shape // 16 AS page, y, x FROM i WHERE abs(shape % 7 * 2 - 6) <= 3 AND shape % 9 > 0 AND CASE WHEN shape % 2 = 0 THEN n % 2 = 1 ELSE wind <> 0 END),
    k AS (SELECT *, x - row_number() OVER (PARTITION BY page, y ORDER BY x) AS island FROM m) SELECT page, y, min(x) AS lo, max(x) AS hi FROM k GROUP BY page, y, island""",
    "outline",
)(lambda t: fills.colour_mask(_rings(t).selectExpr("shape div 16 AS page", "shape AS path", "ring", "ord", "x", "y", "CASE WHEN shape % 9 > 0 THEN shape % 7 * 2 END AS r", "100 AS g", "50 AS b", "shape % 2 = 0 AS even_odd"), "page", (6, 100, 50), 3, width=96, height=64))
# Filters of whole squares; how an image's walls and a model's polygons agree (Q16).
_GREY = "d AS (SELECT DISTINCT img FROM pixel), q AS (SELECT img, unnest(range(0, 64)) AS y FROM d), f AS (SELECT q.img, q.y, x, coalesce(r, 0) AS v FROM (SELECT img, y, unnest(range(0, 64)) AS x FROM q) q LEFT JOIN pixel USING (img, y, x))"
_OPEN = lambda v, s: f"o1 AS (SELECT img, y, x, min({v}) OVER (PARTITION BY img, y ORDER BY x ROWS BETWEEN {s} PRECEDING AND {s} FOLLOWING) AS v FROM f), o2 AS (SELECT img, y, x, min(v) OVER (PARTITION BY img, x ORDER BY y ROWS BETWEEN {s} PRECEDING AND {s} FOLLOWING) AS v FROM o1), o3 AS (SELECT img, y, x, max(v) OVER (PARTITION BY img, y ORDER BY x ROWS BETWEEN {s} PRECEDING AND {s} FOLLOWING) AS v FROM o2), o4 AS (SELECT img, y, x, max(v) OVER (PARTITION BY img, x ORDER BY y ROWS BETWEEN {s} PRECEDING AND {s} FOLLOWING) AS v FROM o3)"
add("opened_image", f"WITH {_GREY}, {_OPEN('v', 2)} SELECT img, y, x, v AS r FROM o4", "pixel")(lambda t: fills.opened(fills.dense(t, "img", "r", 64, 64), "img", "r", 5))
add(
    "plan_match",
    f"""WITH {_GREY}, {_OPEN('CASE WHEN v BETWEEN 0 AND 200 THEN 1 ELSE 0 END', 1)}, {_PIXELS}, m AS (SELECT DISTINCT img, y, x FROM i JOIN d ON shape % 16 = img % 16 AND shape < 64 WHERE n % 2 = 1 AND x < 64)
    SELECT img, count(*) FILTER (v = 1 AND m.x IS NOT NULL) AS shared, count(*) FILTER (v = 1 AND m.x IS NULL) AS only_a, count(*) FILTER (v = 0 AND m.x IS NOT NULL) AS only_b,
      round_even(count(*) FILTER (v = 1 AND m.x IS NOT NULL) / greatest(1, count(*) FILTER (v = 1 OR m.x IS NOT NULL)), 4) AS iou FROM o4 LEFT JOIN m USING (img, y, x) GROUP BY img HAVING count(*) FILTER (v = 1 OR m.x IS NOT NULL) > 0""",
    "pixel",
    "outline",
)(
    lambda t, o: fills.plan_match(
        fills.dense(t, "img", "r", 64, 64).withColumnRenamed("r", "grey"), t.select("img").distinct().join(_rings(o).where("shape < 64"), F.expr("shape % 16 = img % 16")).select("img", F.col("shape").alias("path"), "ring", "ord", "x", "y"), "img", (0, 200), 3, 64, 64
    )
)
