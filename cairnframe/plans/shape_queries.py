"""Queries of the shape of outlines, and of pages' scale bars and fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnframe.functions import measures
from cairnframe.operators import bars, lines, raster

from .catalog import add

_EDGES = """e AS (SELECT shape, row_number() OVER w - 1 AS edge, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER f) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER f) AS b_y FROM outline
      WINDOW w AS (PARTITION BY shape ORDER BY ord), f AS (PARTITION BY shape ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    l AS (SELECT *, sqrt((bx - ax) ** 2 + (b_y - ay) ** 2) AS length, degrees(atan2(b_y - ay, bx - ax)) AS d FROM e), s AS (SELECT *, CASE WHEN d < 0 THEN d + 180 WHEN d >= 180 THEN d - 180 ELSE d END AS angle FROM l WHERE length >= 1e-9)"""
_APART = lambda a, b: f"least(abs({a} - {b}), 180 - abs({a} - {b}))"
# edges of outlines; Q09: short ones, and those nearly along an axis.
add("outline_edges", f"WITH {_EDGES} SELECT shape, edge, round(ax, 6) + 0 AS ax, round(ay, 6) + 0 AS ay, round(bx, 6) + 0 AS bx, round(b_y, 6) + 0 AS by_, round(length, 6) AS length, round(angle, 3) AS angle FROM s", "outline")(lambda t: lines.segments(t, "shape").withColumn("angle", F.round("angle", 3)))
add("short_segments", f"WITH {_EDGES} SELECT shape, edge, round(length, 6) AS length FROM s WHERE length < 1.2", "outline")(lambda t: lines.short_segments(lines.segments(t, "shape"), lines.options({"min_segment_m": 1.2})).select("shape", "edge", "length"))
_OFF = f"least({_APART('angle', '0')}, {_APART('angle', '90')}, {_APART('angle', '45')})"
add("skewed_lines", f"WITH {_EDGES} SELECT shape, edge, round({_OFF}, 4) AS off FROM s WHERE length >= 0.3 AND {_OFF} > 0.1 AND {_OFF} <= 3", "outline")(
    lambda t: lines.skewed(lines.segments(t, "shape"), F.array(*map(F.lit, (0.0, 90.0, 45.0)))).select("shape", "edge", F.round("off", 4).alias("off"))
)
# Jogs along an outline; W17, F10: between lines of any.
add(
    "chain_jogs",
    f"""WITH {_EDGES}, n AS (SELECT a.shape, a.edge, abs(-(a.b_y - a.ay) / a.length * ((c.ax + c.bx) / 2 - a.ax) + (a.bx - a.ax) / a.length * ((c.ay + c.b_y) / 2 - a.ay)) AS off FROM s a JOIN s b ON b.shape = a.shape AND b.edge = a.edge + 1 JOIN s c ON c.shape = a.shape AND c.edge = a.edge + 2
      WHERE b.length <= 1.2 AND {_APART('a.angle', 'c.angle')} <= 1) SELECT shape, edge, round(off, 6) AS "offset" FROM n WHERE off > 0.002 AND off <= 1.2""",
    "outline",
)(lambda t: lines.chain_jogs(lines.segments(t, "shape"), "shape", lines.options({"jog_max_m": 1.2})))
add(
    "pair_jogs",
    """WITH w AS (SELECT id, x0 AS ax, y0 % 20 + (id % 7) / 128e0 AS ay, x1 AS bx, y0 % 20 + (id % 7) / 128e0 AS b_y, x1 - x0 AS length, CASE WHEN id % 2 = 0 THEN (id % 3 + 1) / 16e0 END AS t FROM box), p AS (SELECT a.id AS a, b.id AS b, b.ay - a.ay AS d, coalesce(a.t, 0) / 2 AS h1, coalesce(b.t, 0) / 2 AS h2, greatest(b.ax - a.bx, a.ax - b.bx) AS gap
      FROM w a JOIN w b ON a.id <> b.id AND (a.length > b.length OR (a.length = b.length AND a.id < b.id)) AND abs(a.ay - b.ay) < 1 AND greatest(b.ax - a.bx, a.ax - b.bx) <= 1.2), m AS (SELECT a, b, least(abs(d), abs(h2 - h1 - d), abs(h1 - h2 - d)) AS off, gap FROM p)
    SELECT a, b, round(off, 6) AS "offset", gap + 0e0 AS gap FROM m WHERE off > 0.002 AND off <= 0.05""",
    "box",
)(lambda t: lines.pair_jogs(t.select("id", F.col("x0").cast("double").alias("ax"), F.expr("y0 % 20 + (id % 7) / 128D").alias("ay"), F.col("x1").cast("double").alias("bx"), F.expr("y0 % 20 + (id % 7) / 128D").alias("by_"), F.expr("cast(x1 - x0 AS double)").alias("length"), F.lit(0.0).alias("angle"), F.expr("CASE WHEN id % 2 = 0 THEN (id % 3 + 1) / 16D END").alias("thickness"))))
add("sliver_walls", "SELECT id FROM box WHERE (x1 - x0) / 1000.0 < 0.03 OR coalesce(CASE WHEN id % 4 > 0 THEN (y1 - y0) / 4.0 END < 3, FALSE)", "box")(lambda t: lines.slivers(t.select("id", ((F.col("x1") - F.col("x0")) / 1000).alias("thickness"), F.expr("CASE WHEN id % 4 > 0 THEN (y1 - y0) / 4 END").alias("px"))).select("id"))
# How even the chords of a curve are.
add(
    "curve_stats",
    """WITH p AS (SELECT shape, ord, x - lag(x) OVER w AS ux, y - lag(y) OVER w AS uy, lead(x) OVER w - x AS vx, lead(y) OVER w - y AS vy, row_number() OVER w AS k FROM outline WINDOW w AS (PARTITION BY shape ORDER BY ord)),
    q AS (SELECT *, degrees(atan2(ux * vy - uy * vx, ux * vx + uy * vy)) AS turn, sqrt(vx * vx + vy * vy) AS length FROM p), n AS (SELECT shape, count(vx) AS edges, sum(turn) AS total FROM q GROUP BY 1),
    s AS (SELECT shape, any_value(edges) AS edges, stddev_pop(abs(turn)) / avg(abs(turn)) AS tcv, stddev_pop(length) FILTER (k > 1 AND k < edges) / avg(length) FILTER (k > 1 AND k < edges) AS lcv, count(*) FILTER (turn * CASE WHEN total >= 0 THEN 1 ELSE -1 END < -0.1) AS flips, any_value(total) AS total, median(length) AS median_edge FROM q JOIN n USING (shape) GROUP BY 1)
    SELECT shape, edges, round_even(tcv, 3) AS turn_cv, round_even(lcv, 3) AS length_cv, flips, round(total, 0) AS total_turn, round(median_edge, 6) AS median_edge, flips > 0 OR round_even(tcv, 3) > 0.25 OR round_even(lcv, 3) > 0.25 AS irregular FROM s""",
    "outline",
)(lambda t: lines.run_stats(t, "shape").withColumn("total_turn", F.round("total_turn", 0)))
# Issues by type. Runs of curves and directions are folds over an outline's lines, beyond this SQL: the tests hold them against brute force.
add("shape_issues", None, "outline")(lambda t: lines.issues(t, "shape").withColumn("value", F.round("value", 3)))
add("issue_counts", None, "outline")(lambda t: lines.issues(t, "shape").groupBy("type").agg(F.count("*").alias("issues")))
# points on arcs and circles.
add("arc_points", "WITH a AS (SELECT id, unnest(range(0, 5)) AS k FROM box) SELECT id, k, round(10 + id % 9 * cos(radians(30 + 15 * k)), 6) AS x, round(20 + id % 9 * sin(radians(30 + 15 * k)), 6) AS y FROM a", "box")(
    lambda t: t.select("id", F.posexplode(measures.arc_points(F.lit(10.0), F.lit(20.0), (F.col("id") % 9).cast("double"), F.lit(30.0), F.lit(90.0), F.lit(4)))).select("id", F.col("pos").cast("long").alias("k"), "col.x", "col.y")
)
add(
    "arcs_between",
    """WITH a AS (SELECT id, id * 77 % 360 AS a0, CASE WHEN (id * 31 - id * 77 + 180) % 360 < 0 THEN (id * 31 - id * 77 + 180) % 360 + 360 ELSE (id * 31 - id * 77 + 180) % 360 END - 180 AS turn, id % 9 + 1 AS r FROM box), n AS (SELECT *, CAST(greatest(1, ceil(abs(radians(turn)) * r / 0.75)) AS BIGINT) AS n FROM a), p AS (SELECT *, unnest(range(0, n + 1)) AS k FROM n)
    SELECT id, k, round(r * cos(radians(a0 + turn * k / n)), 6) + 0 AS x, round(r * sin(radians(a0 + turn * k / n)), 6) + 0 AS y FROM p""",
    "box",
)(
    lambda t: t.select("id", F.posexplode(measures.arc_between(F.lit(0.0), F.lit(0.0), F.expr("cast(id % 9 + 1 AS double)"), F.expr("cast(id * 77 % 360 AS double)"), F.expr("cast(id * 31 % 360 AS double)"), F.lit(0.75)))).select("id", F.col("pos").cast("long").alias("k"), "col.x", "col.y")
)
add("circle_points", "SELECT id, round(1 + (x - 1) * (sqrt((x - 1) ** 2 + (y - 2) ** 2) + 3) / sqrt((x - 1) ** 2 + (y - 2) ** 2), 6) AS ox, CASE WHEN abs(x - 500) <= 300 THEN round(400 + CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END * sqrt(90000 - (x - 500) ** 2), 6) END AS oy FROM customer_at WHERE x <> 1 OR y <> 2", "customer_at")(
    lambda t: t.where("x <> 1 OR y <> 2").select("id", measures.offset_point(F.lit(1.0), F.lit(2.0), F.col("x"), F.col("y"), F.lit(3.0))["x"].alias("ox"), measures.on_circle(F.lit(500.0), F.lit(400.0), F.lit(300.0), F.col("x"), F.col("id") % 2 == 0).alias("oy"))
)
# what lies between walls.
add("gap_pieces", "SELECT id, round((x1 - x0) * (y1 - y0) / CAST(x1 - x0 + y1 - y0 AS DOUBLE), 6) AS width, CASE WHEN id % 4 >= 2 THEN 'gap' WHEN id % 4 = 1 THEN 'notch' ELSE 'cavity' END AS kind FROM box", "box")(
    lambda t: t.select("id", measures.mean_width(F.expr("(x1 - x0) * (y1 - y0)"), F.expr("2 * (x1 - x0 + y1 - y0)")).alias("width"), measures.gap_kind(F.col("id") % 4).alias("kind"))
)
# Fills of a page; J20, W10, J28, C05, T02: its scale bars, merged step by step, for which there is no SQL; pages of forty rectangles.
_FILLS = """f AS (SELECT brand AS page, id % 7 AS rgb, count(*) AS paths, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area FROM box GROUP BY 1, 2)"""
add("page_fills", f"WITH {_FILLS} SELECT page, rgb, paths, area, rank FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY area DESC, rgb) AS rank FROM f) WHERE rank <= 4", "box")(
    lambda t: raster.fills(t.select(F.col("brand").alias("page"), (F.col("id") % 7).alias("rgb"), "x0", "x1", "y0", "y1"), "page", 4)
)
add("scale_bars", None, "box")(
    lambda t: bars.scale_bars(
        *[t.select(F.floor(F.col("id") / 40).cast("long").alias("page"), *[F.expr(e).alias(c) for c, e in columns.items()]) for columns in (
            {"x0": "id * 7 % 20 * 12D", "x1": "id * 7 % 20 * 12D + 12D + id % 3", "y0": "id div 10 % 4 * 2D + id div 20 % 2 * 30D", "y1": "id div 10 % 4 * 2D + id div 20 % 2 * 30D + id % 3 * 0.25D + 2D", "fill": "CAST(id % 3 AS STRING)"},
            {"word": "concat(id, ' ft')", "x0": "id * 7 % 20 * 12D", "x1": "id * 7 % 20 * 12D + 6D", "y0": "id div 10 % 4 * 2D + id div 20 % 2 * 30D + 6D", "y1": "id div 10 % 4 * 2D + id div 20 % 2 * 30D + 12D"},
        )], "page",
    )
)
# How much of a colour shows; T03: candidates for walls by score.
add("hidden_share", "SELECT img, round(1 - avg(CASE WHEN r < 100 THEN 1.0 ELSE 0.0 END), 6) AS hidden FROM pixel WHERE g < 128 GROUP BY 1", "pixel")(lambda t: raster.hidden_share(t.where("g < 128"), F.col("r") < 100))
add("wall_candidates", "SELECT img, rank, rgb, score FROM (SELECT img, r // 64 AS rgb, round_even(avg(CASE WHEN g < 128 THEN 1.0 ELSE 0.0 END) * max(765 - r - g - b) / 765, 5) AS score, row_number() OVER (PARTITION BY img ORDER BY round_even(avg(CASE WHEN g < 128 THEN 1.0 ELSE 0.0 END) * max(765 - r - g - b) / 765, 5) DESC, r // 64) AS rank FROM pixel GROUP BY 1, 2)", "pixel")(
    lambda t: raster.wall_candidates(t.groupBy("img", F.expr("r div 64").alias("rgb")).agg(F.avg(F.when(F.col("g") < 128, 1.0).otherwise(0.0)).alias("share"), F.max(765 - F.col("r") - F.col("g") - F.col("b")).alias("contrast")))
)
