"""Queries of matches between rectangles, cells and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnframe.operators import matching, raster

from .catalog import add

# Edges that snap to those of the floor below.
add(
    "snapped_walls",
    """WITH w AS (SELECT id AS name, x0 + 0e0 AS x0, y0 + 0e0 AS y0, x1 + 0e0 AS x1, y1 + 0e0 AS y1 FROM box WHERE id % 2 = 0), b AS (SELECT x0 + 0.5e0 AS x0, y0 - 0.25e0 AS y0, x1 + 0.75e0 AS x1, y1 + 0.5e0 AS y1 FROM box WHERE id % 2 = 1),
    e AS (SELECT name, 'x0' AS edge, x0 AS at_, y0 AS lo, y1 AS hi FROM w UNION ALL SELECT name, 'x1', x1, y0, y1 FROM w UNION ALL SELECT name, 'y0', y0, x0, x1 FROM w UNION ALL SELECT name, 'y1', y1, x0, x1 FROM w),
    f AS (SELECT 'x' AS axis, unnest([x0, x1]) AS to_, y0 AS lo, y1 AS hi FROM b UNION ALL SELECT 'y', unnest([y0, y1]), x0, x1 FROM b),
    m AS (SELECT name, edge, min((abs(to_ - at_), to_)) AS best FROM e JOIN f ON edge[1] = axis AND f.hi >= e.lo - 40 AND f.lo <= e.hi + 40 AND abs(to_ - at_) <= 2 GROUP BY 1, 2), n AS (SELECT name, edge, best[2] AS to_ FROM m WHERE best[1] > 1e-9),
    v AS (SELECT w.name, max(to_) FILTER (edge = 'x0') AS a, max(to_) FILTER (edge = 'y0') AS b, max(to_) FILTER (edge = 'x1') AS c, max(to_) FILTER (edge = 'y1') AS d, count(to_) AS moved FROM w LEFT JOIN n USING (name) GROUP BY 1), k AS (SELECT w.*, v.*, coalesce(c, x1) - coalesce(a, x0) >= 4 AND coalesce(d, y1) - coalesce(b, y0) >= 4 AS wide FROM w JOIN v USING (name))
    SELECT name, CASE WHEN wide THEN coalesce(a, x0) ELSE x0 END AS x0, CASE WHEN wide THEN coalesce(b, y0) ELSE y0 END AS y0, CASE WHEN wide THEN coalesce(c, x1) ELSE x1 END AS x1, CASE WHEN wide THEN coalesce(d, y1) ELSE y1 END AS y1, CASE WHEN wide THEN moved ELSE 0 END AS moved FROM k""",
    "box",
)(lambda t: matching.snapped(t.where("id % 2 = 0").withColumnRenamed("id", "name"), t.where("id % 2 = 1").selectExpr("x0 + 0.5D AS x0", "y0 - 0.25D AS y0", "x1 + 0.75D AS x1", "y1 + 0.5D AS y1"), 2.0))
# The first cell that holds a point; J07: and how many do.
add("first_containers", "SELECT p.id, min(b.id) AS idx, count(b.id) AS n FROM customer_at p LEFT JOIN box b ON p.x BETWEEN b.x0 AND b.x1 AND p.y BETWEEN b.y0 AND b.y1 GROUP BY 1", "customer_at", "box")(lambda p, b: matching.first_container(p, b.withColumnRenamed("id", "idx"), 50.0))
# Spaces below a void, those named or all.
add(
    "spaces_below",
    """WITH v AS (SELECT id FROM box WHERE id % 10 = 0), n AS (SELECT id, 'S' || (x0 % 7) AS space FROM box WHERE id % 20 = 0), a AS (SELECT DISTINCT 'S' || (x0 % 7) AS space FROM box) SELECT v.id, n.space FROM v JOIN n USING (id) UNION ALL SELECT v.id, a.space FROM v, a WHERE v.id % 20 <> 0""",
    "box",
)(lambda t: matching.named_or_all(t.where("id % 10 = 0").select("id"), t.where("id % 20 = 0").select("id", F.expr("concat('S', x0 % 7)").alias("space")), t.select(F.expr("concat('S', x0 % 7)").alias("space")), "id", "space"))
# The largest of all and of each group; O08: distinct values in order.
add("largest_boxes", "SELECT id, brand, (x1 - x0) * (y1 - y0) AS area FROM box ORDER BY area DESC, id LIMIT 30", "box")(lambda t: matching.largest(t.select("id", "brand", F.expr("(x1 - x0) * (y1 - y0)").alias("area")), [], [F.desc("area"), "id"], 30))
add("largest_by_brand", "SELECT * FROM (SELECT id, brand, x1 - x0 AS width, row_number() OVER (PARTITION BY brand ORDER BY x1 - x0 DESC, id) AS rank FROM box) WHERE rank <= 40", "box")(lambda t: matching.largest(t.select("id", "brand", F.expr("x1 - x0").alias("width")), ["brand"], [F.desc("width"), "id"], 40))
add("distinct_widths", "SELECT brand, array_to_string(list_sort(list_distinct(list(x1 - x0))), ',') AS widths FROM box GROUP BY 1", "box")(lambda t: matching.distinct_sorted(t.withColumn("width", F.expr("x1 - x0")), "brand", "width").withColumn("widths", F.array_join("widths", ",")))
# Parts of a mask that are large enough.
_PARTS = """m AS (SELECT img, y, x, y * 64 + x AS id FROM pixel WHERE r + g + b < 250), reach AS (SELECT img, id AS root, id FROM m UNION SELECT r.img, r.root, n.id FROM reach r JOIN m ON m.img = r.img AND m.id = r.id JOIN m n ON n.img = m.img AND ((n.y = m.y AND abs(n.x - m.x) = 1) OR (n.x = m.x AND abs(n.y - m.y) = 1))),
    l AS (SELECT img, id, min(root) AS label FROM reach GROUP BY 1, 2), c AS (SELECT img, label, count(*) AS pixels FROM l GROUP BY 1, 2)"""
add("large_parts", f"WITH {_PARTS} SELECT img, count(*) AS parts, CAST(sum(pixels) AS BIGINT) AS pixels FROM (SELECT *, sum(pixels) OVER (PARTITION BY img) AS total FROM c) WHERE pixels >= greatest(1, 0.02 * total) GROUP BY 1", "pixel")(
    lambda t: matching.large_parts(raster.labelled(t.where("r + g + b < 250")).groupBy("img", "label").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("pixels")), "img", 0.02).groupBy("img").agg(F.count("*").alias("parts"), F.sum("pixels").alias("pixels"))
)
# How a plan's walls and a model's agree beside what is left out.
add(
    "plan_overlaps",
    """WITH x AS (SELECT DISTINCT img, y + dy AS y, x + dx AS x FROM pixel, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx) WHERE b < 12), s AS (SELECT img, y, x, max(CASE WHEN r < 128 THEN 1 ELSE 0 END) AS p, max(CASE WHEN g < 128 THEN 1 ELSE 0 END) AS m FROM pixel WHERE r < 128 OR g < 128 GROUP BY 1, 2, 3)
    SELECT img, count(*) FILTER (p = 1 AND m = 1) AS both, count(*) AS either, round(count(*) FILTER (p = 1 AND m = 1) / count(*), 6) AS iou FROM s ANTI JOIN x USING (img, y, x) GROUP BY 1""",
    "pixel",
)(lambda t: matching.plan_overlap(t.where("r < 128"), t.where("g < 128"), t.where("b < 12"), 1))
# Q21: meshes as an engine imported them.
add(
    "imported_meshes",
    """WITH s AS (SELECT name, x0, x1, y0, y1, z0, z1, triangles, uv_layers FROM measured), f AS (SELECT name, x0 * 100 AS x0, x1 * 100 AS x1, -y1 * 100 + CASE WHEN name % 15 = 0 THEN 1 ELSE 0 END AS y0, -y0 * 100 AS y1, z0 * 100 AS z0, z1 * 100 AS z1, CASE WHEN name % 14 = 0 THEN 0 ELSE triangles END AS triangles, 2 AS uv_layers FROM measured WHERE name % 9 > 0 UNION ALL SELECT -name, 0, 0, 0, 0, 0, 0, 0, 0 FROM measured WHERE name % 50 = 1)
    SELECT coalesce(f.name, s.name) AS name, CASE WHEN f.name IS NULL THEN 'missing' WHEN s.name IS NULL THEN 'extra' ELSE 'matched' END AS state, coalesce(f.name = s.name AND f.name % 15 = 0, FALSE) AS bounds_differ, coalesce(f.triangles <> s.triangles, FALSE) AS triangles_differ, coalesce(f.uv_layers < s.uv_layers, FALSE) AS uv_lost FROM f FULL JOIN s ON f.name = s.name""",
    "measured",
)(
    lambda t: matching.imported(
        t,
        t.where("name % 9 > 0").selectExpr("name", "x0 * 100 AS x0", "x1 * 100 AS x1", "-y1 * 100 + CASE WHEN name % 15 = 0 THEN 1D ELSE 0D END AS y0", "-y0 * 100 AS y1", "z0 * 100 AS z0", "z1 * 100 AS z1", "CASE WHEN name % 14 = 0 THEN 0 ELSE triangles END AS triangles", "2 AS uv_layers")
        .unionByName(t.where("name % 50 = 1").selectExpr("-name AS name", *[f"0D AS {c}{e}" for c in "xyz" for e in "01"], "0 AS triangles", "0 AS uv_layers")),
        "unreal", 100.0,
    )
)
# Stairs of two flights past one another.
add(
    "scissor_stairs",
    """WITH s AS (SELECT name, rise AS height, rise - 0.25e0 AS top, risers, x AS r0, x + 4e0 AS r1 FROM stair WHERE risers >= 2), i AS (SELECT *, unnest(range(0, risers - 1)) AS i FROM s), l AS (SELECT *, 'a' AS lane, r0 + i * (r1 - r0) / (risers - 1) AS p, r0 + (i + 1) * (r1 - r0) / (risers - 1) AS q FROM i UNION ALL SELECT *, 'b', r1 - i * (r1 - r0) / (risers - 1), r1 - (i + 1) * (r1 - r0) / (risers - 1) FROM i)
    SELECT name, lane, i AS step, round(least(p, q), 6) AS along0, round(greatest(p, q), 6) AS along1, round(greatest(-0.2e0, i * height / risers - 0.15e0), 6) AS z0, round(least((i + 1) * height / risers, top), 6) AS z1 FROM l WHERE greatest(-0.2e0, i * height / risers - 0.15e0) < least((i + 1) * height / risers, top)""",
    "stair",
)(lambda t: matching.scissor_stairs(t.selectExpr("name", "rise AS height", "rise - 0.25D AS top", "risers", "x AS run0", "x + 4D AS run1")))
