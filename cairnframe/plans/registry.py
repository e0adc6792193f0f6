"""Queries of the library by name, over the driver's tables, with the SQL that gives the same rows.

ids in the comments are those of the operator inventory.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnframe.operators import mesh, predicates, raster, scale, sequences, spatial, walk

from . import cell_queries, doors_queries, fill_queries, level_queries, matching_queries, network_queries, overlay_queries, report_queries, scene_queries, shape_queries, text_queries  # noqa: F401
from .catalog import ORACLE_SQL, QUERIES, add as _add, rounded as _rounded

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

FLAGSHIP = "scale_estimate"


# The scale of each case, and whether its evidence agrees.
_add(
    "scale_estimate",
    """WITH ok AS (SELECT *, kind <> 'fixture' AS strong FROM evidence WHERE m_per_px > 0),
    c AS (SELECT "case", coalesce(median(m_per_px) FILTER (strong), median(m_per_px)) AS m, median(m_per_px) FILTER (strong AND axis = 'x') AS mx, median(m_per_px) FILTER (strong AND axis = 'y') AS my,
      count(*) FILTER (strong AND axis = 'x') AS nx, count(*) FILTER (strong AND axis = 'y') AS ny, count(DISTINCT CASE WHEN kind = 'bar_box' THEN 'bar' ELSE kind END) FILTER (strong) AS kinds FROM ok GROUP BY 1),
    a AS (SELECT *, CASE WHEN nx >= 2 AND ny >= 2 THEN mx / my END AS ratio, nx >= 2 AND ny >= 2 AND abs(mx / my - 1) > 0.04 AS anisotropic FROM c),
    d AS (SELECT ok."case", m, round_even(m_per_px / CASE WHEN anisotropic AND axis = 'x' THEN mx WHEN anisotropic AND axis = 'y' THEN my ELSE m END - 1, 4) AS dev, abs(m_per_px / m - 1) AS whole,
      CASE kind WHEN 'dim' THEN 0.03 WHEN 'bar' THEN 0.02 WHEN 'bar_box' THEN 0.02 WHEN 'area' THEN 0.05 WHEN 'pt' THEN 0.01 ELSE 0.15 END AS k, kind NOT IN ('area', 'pt') AS length, px, tol FROM ok JOIN a USING ("case")),
    v AS (SELECT "case", count(*) AS items, count(*) FILTER (abs(dev) > coalesce(tol, CASE WHEN length THEN round_even(greatest(k, 2 / px), 4) END, k)) AS outliers, round_even(max(whole), 4) AS max_deviation FROM d GROUP BY 1)
    SELECT "case", items, round(m, 6) AS m_per_px, kinds AS strong_kinds, round(ratio, 6) AS x_over_y, anisotropic, outliers, max_deviation,
      outliers = 0 AND kinds >= 2 AND NOT anisotropic AS passed FROM v JOIN a USING ("case")""",
    "evidence",
)(scale.scale_estimate)

# One slope for both axes, an intercept each.
_add(
    "fit_alignment",
    """WITH m AS (SELECT "case", axis, avg(a) AS ma, avg(b) AS mb FROM align GROUP BY 1, 2), c AS (SELECT * FROM align JOIN m USING ("case", axis)),
    s AS (SELECT "case", sum((a - ma) * (b - mb)) / sum((b - mb) * (b - mb)) AS slope FROM c GROUP BY 1)
    SELECT "case", axis, round(any_value(slope), 3) AS slope, round(any_value(ma) - any_value(slope) * any_value(mb), 3) AS intercept,
      round(max(abs(a - ma - slope * (b - mb))), 3) AS max_residual, round(sqrt(avg((a - ma - slope * (b - mb)) ** 2)), 3) AS rms, count(*) AS n
    FROM c JOIN s USING ("case") GROUP BY 1, 2""",
    "align",
)(lambda t: _rounded(scale.alignment(t), 3))

# Circles through points.
_add(
    "fit_circle",
    """WITH m AS (SELECT "case", avg(x) AS mx, avg(y) AS my, count(*) AS n FROM ring GROUP BY 1), p AS (SELECT r.*, mx, my, n, x - mx AS u, y - my AS v FROM ring r JOIN m USING ("case")),
    s AS (SELECT "case", sum(u*u) AS suu, sum(u*v) AS suv, sum(v*v) AS svv, sum(u*(u*u+v*v)) AS suz, sum(v*(u*u+v*v)) AS svz, sum(u*u+v*v) AS sz, any_value(mx) AS mx, any_value(my) AS my, any_value(n) AS n FROM p GROUP BY 1),
    f AS (SELECT "case", (suz*svv - svz*suv)/(suu*svv - suv*suv)/2 AS a, (svz*suu - suz*suv)/(suu*svv - suv*suv)/2 AS b, mx, my, sz, n FROM s WHERE suu*svv - suv*suv <> 0),
    g AS (SELECT "case", a + mx AS cx, b + my AS cy, sqrt(sz/n + a*a + b*b) AS r FROM f)
    SELECT "case", round(any_value(cx), 4) AS cx, round(any_value(cy), 4) AS cy, round(any_value(r), 4) AS r, round(max(abs(sqrt((x-cx)**2 + (y-cy)**2) - r)), 4) AS max_off, round(stddev_pop(sqrt((x-cx)**2 + (y-cy)**2) - r), 4) AS std_off
    FROM ring JOIN g USING ("case") GROUP BY 1 HAVING count(*) >= 5""",
    "ring",
)(lambda t: _rounded(scale.circle_fit(t.join(t.groupBy("case").count().where("count >= 5"), "case", "left_semi")), 4))

# Polygon areas.
_add(
    "polygon_area",
    """SELECT "case", abs(sum(x * ny - nx * y)) / 2.0 AS area, count(*) AS n FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER f) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER f) AS ny
    FROM (SELECT "case", ord, min(x) AS x, min(y) AS y FROM polygon GROUP BY 1, 2) WINDOW w AS (PARTITION BY "case" ORDER BY ord), f AS (PARTITION BY "case" ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY 1""",
    "polygon",
)(lambda t: scale.shoelace(t.groupBy("case", "ord").agg(F.min("x").alias("x"), F.min("y").alias("y"))))

# Runs and edges of masks.
_add(
    "mask_runs",
    """SELECT user_id, min(pos) AS lo, max(pos) AS hi, count(*) AS length FROM (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM mask WHERE "on") GROUP BY user_id, g HAVING count(*) >= 2""",
    "mask",
)(lambda t: sequences.runs(t, ["user_id"], "pos", 2))
_add(
    "band_runs",
    """WITH c AS (SELECT img, x, bool_and(r + g + b < 400) AS "on" FROM pixel WHERE y BETWEEN 3 AND 5 GROUP BY 1, 2)
    SELECT img, min(x) AS lo, max(x) + 1 AS hi, count(*) AS length FROM (SELECT *, x - row_number() OVER (PARTITION BY img ORDER BY x) AS g FROM c WHERE "on") GROUP BY img, g HAVING count(*) >= 1""",
    "pixel",
)(lambda t: sequences.band_runs(t.withColumn("on", F.expr("r + g + b < 400")), 4, 1, 1))
_add(
    "edge_points",
    """WITH o AS (SELECT * FROM pixel WHERE r + g + b < 300), lo AS (SELECT img, min(x) AS x0 FROM o GROUP BY 1)
    SELECT img, x, min(y) AS "first", max(y) AS "last" FROM o JOIN lo USING (img) WHERE (x - x0) % 3 = 0 GROUP BY 1, 2""",
    "pixel",
)(lambda t: sequences.edge_points(t.withColumn("on", F.expr("r + g + b < 300")), 3))

# Sweeps and interval sets.
_SWEEP = """e AS (SELECT col, lo AS z, 1 AS s FROM solid UNION ALL SELECT col, hi, -1 FROM solid), d AS (SELECT *, sum(s) OVER (PARTITION BY col ORDER BY z, s DESC ROWS UNBOUNDED PRECEDING) AS depth FROM e),
    st AS (SELECT col, z AS lo, row_number() OVER (PARTITION BY col ORDER BY z) AS k FROM d WHERE s = 1 AND depth = 1), sp AS (SELECT col, z AS hi, row_number() OVER (PARTITION BY col ORDER BY z) AS k FROM d WHERE s = -1 AND depth = 0),
    swept AS (SELECT col, lo, hi FROM st JOIN sp USING (col, k))"""
_add("solid_intervals", f"WITH {_SWEEP} SELECT * FROM swept", "solid")(lambda t: sequences.sweep(t, "col"))
_add(
    "headroom",
    f"""WITH {_SWEEP}, h AS (SELECT col, hi AS z, lead(lo) OVER (PARTITION BY col ORDER BY lo, hi) - hi AS free, lo FROM swept)
    SELECT col, z, free, row_number() OVER (PARTITION BY col ORDER BY z, lo) - 1 AS rank FROM h WHERE free IS NULL OR free >= 30""",
    "solid",
)(lambda t: sequences.headroom(sequences.sweep(t, "col"), "col", 30).withColumn("free", F.when(F.col("free") < float("inf"), F.col("free").cast("long"))))
_add(
    "merged_intervals",
    """WITH m AS (SELECT *, max(hi) OVER (PARTITION BY col ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM solid),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 0.0001 THEN 1 ELSE 0 END) OVER (PARTITION BY col ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT col, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY col, g""",
    "solid",
)(lambda t: sequences.merged(t, "col"))
_add(
    "subtracted_intervals",
    """WITH p AS (SELECT DISTINCT col, z FROM (SELECT col, unnest([lo, hi]) AS z FROM solid UNION ALL SELECT col, unnest([lo, hi]) FROM carve)),
    el AS (SELECT col, z AS lo, lead(z) OVER (PARTITION BY col ORDER BY z) AS hi FROM p),
    k AS (SELECT el.* FROM el WHERE hi IS NOT NULL AND EXISTS (SELECT 1 FROM solid s WHERE s.col = el.col AND s.lo <= el.lo AND s.hi >= el.hi) AND NOT EXISTS (SELECT 1 FROM carve c WHERE c.col = el.col AND c.lo <= el.lo AND c.hi >= el.hi)),
    g AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev < lo THEN 1 ELSE 0 END) OVER (PARTITION BY col ORDER BY lo ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(hi) OVER (PARTITION BY col ORDER BY lo) AS prev FROM k))
    SELECT col, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY col, g""",
    "solid", "carve",
)(lambda a, b: sequences.subtracted(a, b, "col"))
_add(
    "plane_clusters",
    """WITH c AS (SELECT col, lo, sum(CASE WHEN lo - prev > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY col ORDER BY lo, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, lag(lo) OVER (PARTITION BY col ORDER BY lo, event_id) AS prev FROM solid))
    SELECT col, cluster, min(lo) AS lo, max(lo) AS hi, count(*) AS n FROM c GROUP BY 1, 2""",
    "solid",
)(lambda t: sequences.clusters(t, "col", "lo", 100))
_add("storey_elevations", "SELECT *, coalesce(sum(wall + slab) OVER (PARTITION BY building ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z FROM storey", "storey")(lambda t: sequences.elevations(t, "building", "ord", "wall", "slab"))
# Turns at corners.
_add(
    "corner_turns",
    """WITH p AS (SELECT "case", ord, min(x) AS x, min(y) AS y FROM polygon GROUP BY 1, 2),
    n AS (SELECT *, coalesce(lag(x) OVER w, last_value(x) OVER f) AS px, coalesce(lag(y) OVER w, last_value(y) OVER f) AS py, coalesce(lead(x) OVER w, first_value(x) OVER f) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER f) AS ny FROM p
      WINDOW w AS (PARTITION BY "case" ORDER BY ord), f AS (PARTITION BY "case" ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    t AS (SELECT *, degrees(atan2(ny - y, nx - x) - atan2(y - py, x - px)) + 180 AS d FROM n)
    SELECT "case", ord, x, y, round(abs(d - 360 * floor(d / 360) - 180), 4) AS turn FROM t""",
    "polygon",
)(lambda t: sequences.turns(t.groupBy("case", "ord").agg(F.min("x").alias("x"), F.min("y").alias("y")), "case", "ord").withColumn("turn", F.round(F.abs("turn"), 4)))

# Masks; A24: overlap; A25: mirror; R01, A30: components; R02: erosion, dilation.
_add(
    "wall_mask",
    "SELECT img, count(*) AS pixels, count(*) FILTER (greatest(abs(r - 30), abs(g - 60), abs(b - 90)) <= 40 OR r + g + b < 250) AS wall, count(*) FILTER (greatest(abs(r - 200), abs(g - 200), abs(b - 200)) <= 60) AS background FROM pixel GROUP BY 1",
    "pixel",
)(lambda t: t.groupBy("img").agg(F.count("*").alias("pixels"), F.count_if(raster.wall_mask([(30, 60, 90)], 40, 250)).alias("wall"), F.count_if(raster.background_mask((200, 200, 200), 60)).alias("background")))
_add(
    "mask_iou",
    "SELECT img, count(*) FILTER (r < 128 AND g < 128) AS shared, count(*) AS either, round(count(*) FILTER (r < 128 AND g < 128) / count(*), 6) AS iou FROM pixel WHERE r < 128 OR g < 128 GROUP BY 1",
    "pixel",
)(lambda t: raster.iou(t.where("r < 128"), t.where("g < 128")))
_add(
    "mirror_iou",
    """WITH m AS (SELECT img, y, x FROM pixel WHERE r < 128), e AS (SELECT img, min(x) + max(x) AS ends FROM m GROUP BY 1), f AS (SELECT img, y, ends - x AS x FROM m JOIN e USING (img))
    SELECT img, count(*) FILTER (m.x IS NOT NULL AND f.x IS NOT NULL) AS shared, count(*) AS either, round(count(*) FILTER (m.x IS NOT NULL AND f.x IS NOT NULL) / count(*), 6) AS iou FROM m FULL JOIN f USING (img, y, x) GROUP BY 1""",
    "pixel",
)(lambda t: raster.iou(t.where("r < 128"), raster.mirrored(t.where("r < 128"))))
_NEAR = "((m.y = n.y AND abs(m.x - n.x) <= 1) OR (m.x = n.x AND abs(m.y - n.y) <= 1))"
_add(
    "eroded",
    f"WITH m AS (SELECT img, y, x FROM pixel WHERE r + g + b < 500) SELECT m.img, m.y, m.x FROM m JOIN m n ON m.img = n.img AND {_NEAR} GROUP BY ALL HAVING count(*) + any_value(CASE WHEN m.y IN (0, 63) THEN 1 ELSE 0 END + CASE WHEN m.x IN (0, 63) THEN 1 ELSE 0 END) >= 5",
    "pixel",
)(lambda t: raster.eroded(t.where("r + g + b < 500"), height=64, width=64))
_add(
    "dilated",
    "WITH m AS (SELECT img, y, x FROM pixel WHERE r + g + b < 150) SELECT DISTINCT img, y + dy AS y, x + dx AS x FROM m, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx) WHERE y + dy BETWEEN 0 AND 63 AND x + dx BETWEEN 0 AND 63",
    "pixel",
)(lambda t: raster.dilated(t.where("r + g + b < 150"), height=64, width=64))
_add(
    "mask_components",
    """WITH m AS (SELECT img, y, x, y * 64 + x AS id FROM pixel WHERE r + g + b < 250),
    reach AS (SELECT img, id AS root, id FROM m UNION SELECT r.img, r.root, n.id FROM reach r JOIN m ON m.img = r.img AND m.id = r.id JOIN m n ON n.img = m.img AND ((n.y = m.y AND abs(n.x - m.x) = 1) OR (n.x = m.x AND abs(n.y - m.y) = 1))),
    l AS (SELECT img, id, min(root) AS label FROM reach GROUP BY 1, 2), c AS (SELECT img, label, count(*) AS pixels FROM l GROUP BY 1, 2)
    SELECT img, count(*) AS components, max(pixels) AS largest, sum(pixels)::BIGINT AS pixels FROM c GROUP BY 1""",
    "pixel",
)(lambda t: raster.labelled(t.where("r + g + b < 250")).groupBy("img", "label").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("pixels")).groupBy("img").agg(F.count("*").alias("components"), F.max("pixels").alias("largest"), F.sum("pixels").alias("pixels")))

# Topology and measures of meshes.
_EDGE = "e AS (SELECT mesh, least(p, q) AS u, greatest(p, q) AS v FROM (SELECT mesh, unnest([a, b, c]) AS p, unnest([b, c, a]) AS q FROM tri))"
_add(
    "edge_multiplicity",
    f"WITH {_EDGE}, n AS (SELECT mesh, u, v, count(*) AS n FROM e GROUP BY ALL) SELECT mesh, count(*) AS edges, count(*) FILTER (n <> 2) AS nonmanifold, count(*) FILTER (n = 1) AS boundary, count(*) FILTER (n > 2) AS overconnected FROM n GROUP BY 1",
    "tri",
)(mesh.edge_stats)
_add(
    "boundary_twins",
    "WITH h AS (SELECT mesh, unnest([a, b, c]) AS p, unnest([b, c, a]) AS q FROM tri) SELECT mesh, count(*) AS open_edges FROM h WHERE NOT EXISTS (SELECT 1 FROM h t WHERE t.mesh = h.mesh AND t.p = h.q AND t.q = h.p) GROUP BY 1",
    "tri",
)(lambda t: mesh.boundary_twins(t).groupBy("mesh").agg(F.count("*").alias("open_edges")))
_CORNERS = """k AS (SELECT t.mesh, t.tid, t.a, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM tri t
    JOIN vertex a ON a.mesh = t.mesh AND a.vid = t.a JOIN vertex b ON b.mesh = t.mesh AND b.vid = t.b JOIN vertex c ON c.mesh = t.mesh AND c.vid = t.c),
    s AS (SELECT *, sqrt((("by"-ay)*(cz-az)-(bz-az)*(cy-ay))**2 + ((bz-az)*(cx-ax)-(bx-ax)*(cz-az))**2 + ((bx-ax)*(cy-ay)-("by"-ay)*(cx-ax))**2)/2 AS area, (ax*("by"*cz-bz*cy)+ay*(bz*cx-bx*cz)+az*(bx*cy-"by"*cx))/6 AS volume FROM k)"""
_add(
    "mesh_measures",
    f"WITH {_CORNERS} SELECT mesh, count(*) AS triangles, count(*) FILTER (area < 1e-15) AS zero, count(*) FILTER (area < 1e-10) AS near_zero, round(min(area), 4) AS least_area, round(sum(area), 4) AS area, round(sum(volume), 4) AS volume FROM s GROUP BY 1",
    "tri", "vertex",
)(lambda t, v: _rounded(mesh.area_stats(mesh.corners(v, t)), 4))
_add("mesh_bounds", "SELECT mesh, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM vertex GROUP BY 1", "vertex")(mesh.bounds)
# Islands.
_add(
    "mesh_islands",
    """WITH un AS (SELECT DISTINCT mesh, p, q FROM (SELECT t.mesh, unnest([t.a, t.b, t.b, t.c]) AS p, unnest([t.b, t.a, t.c, t.b]) AS q FROM tri t)),
    node AS (SELECT mesh, vid FROM vertex UNION SELECT mesh, p FROM un), reach AS (SELECT mesh, vid AS root, vid FROM node UNION SELECT r.mesh, r.root, un.q FROM reach r JOIN un ON un.mesh = r.mesh AND un.p = r.vid), i AS (SELECT mesh, vid, min(root) AS island FROM reach GROUP BY 1, 2)
    SELECT mesh, island, count(*) AS vertices FROM i JOIN vertex USING (mesh, vid) GROUP BY 1, 2""",
    "tri", "vertex",
)(lambda t, v: mesh.islands(v, t).groupBy("mesh", "island").agg(F.count("*").alias("vertices")))
# Welding at a tolerance.
_add(
    "welded",
    """WITH w AS (SELECT mesh, vid, min((mesh, vid)) OVER (PARTITION BY round_even(x / 10, 0), round_even(y / 10, 0), round_even(z / 10, 0)) AS w FROM vertex),
    t AS (SELECT a.w AS a, b.w AS b, c.w AS c FROM tri JOIN w a ON a.mesh = tri.mesh AND a.vid = tri.a JOIN w b ON b.mesh = tri.mesh AND b.vid = tri.b JOIN w c ON c.mesh = tri.mesh AND c.vid = tri.c)
    SELECT count(*) AS triangles FROM t WHERE a <> b AND b <> c AND a <> c""",
    "tri", "vertex",
)(lambda t, v: mesh.welded(v, t, 10.0).agg(F.count("*").alias("triangles")))
# A plane section.
_add(
    "plane_section",
    """WITH e AS (SELECT mesh, tid, least(p, q) AS u, greatest(p, q) AS v FROM (SELECT mesh, tid, unnest([a, b, c]) AS p, unnest([b, c, a]) AS q FROM tri)),
    h AS (SELECT e.mesh, e.tid, u.x + (9.5 - u.z) / (v.z - u.z) * (v.x - u.x) AS x, u.y + (9.5 - u.z) / (v.z - u.z) * (v.y - u.y) AS y FROM e JOIN vertex u ON u.mesh = e.mesh AND u.vid = e.u JOIN vertex v ON v.mesh = e.mesh AND v.vid = e.v WHERE (u.z < 9.5) <> (v.z < 9.5)),
    p AS (SELECT mesh, tid, min((x, y)) AS p, max((x, y)) AS q FROM h GROUP BY 1, 2 HAVING count(*) = 2)
    SELECT mesh, count(*) AS segments, round(sum(sqrt((q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2)), 4) AS length FROM p WHERE sqrt((q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2) >= 1e-9 GROUP BY 1""",
    "tri", "vertex",
)(lambda t, v: _rounded(mesh.plane_section(v, t, 9.5).groupBy("mesh").agg(F.count("*").alias("segments"), F.sum(F.expr("sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))")).alias("length")), 4))

# Boxes that meet; J01, O02: comparison by key; J24, T11: nearest; J22, J23: interval lookup; A26: union of rectangles.
_add(
    "box_overlaps",
    "SELECT a.id AS a_id, b.id AS b_id FROM box a JOIN box b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1",
    "box",
)(lambda t: spatial.self_pairs(t, cell=50.0))
_add(
    "box_overlaps_by_brand",
    "SELECT a.brand, a.id AS a_id, b.id AS b_id FROM box a JOIN box b ON a.brand = b.brand AND a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1",
    "box",
)(lambda t: spatial.self_pairs(t, cell=50.0, by=["brand"]))
_add(
    "manifest_comparison",
    """WITH m AS (SELECT id, x, y FROM customer_at WHERE id % 3 <> 0), e AS (SELECT id, x, CASE WHEN id % 7 = 0 THEN y + 1 ELSE y END AS y FROM customer_at WHERE id % 5 <> 0)
    SELECT coalesce(m.id, e.id) AS id, CASE WHEN m.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'extra' ELSE 'matched' END AS state, coalesce(m.id IS NOT NULL AND e.id IS NOT NULL AND m.x <> e.x, FALSE) AS x_differs, coalesce(m.id IS NOT NULL AND e.id IS NOT NULL AND m.y <> e.y, FALSE) AS y_differs
    FROM m FULL JOIN e ON m.id = e.id""",
    "customer_at",
)(lambda t: spatial.compared(t.where("id % 3 <> 0"), t.where("id % 5 <> 0").withColumn("y", F.expr("CASE WHEN id % 7 = 0 THEN y + 1 ELSE y END")), "id", ["x", "y"]))
_add(
    "nearest_points",
    """SELECT * FROM (SELECT p.id AS point_id, o.id AS other_id, CAST((p.x - o.x) ** 2 + (p.y - o.y) ** 2 AS BIGINT) AS distance2, row_number() OVER (PARTITION BY p.id ORDER BY (p.x - o.x) ** 2 + (p.y - o.y) ** 2, o.id) AS rank
    FROM customer_at p JOIN supplier_at o ON (p.x - o.x) ** 2 + (p.y - o.y) ** 2 <= 40000) WHERE rank <= 8""",
    "customer_at", "supplier_at",
)(lambda p, o: spatial.nearest(p, o, 200.0, 8))
_add(
    "interval_lookup",
    "SELECT p.id, p.x AS at, min(i.id) AS ord FROM customer_at p LEFT JOIN box i ON p.x BETWEEN i.x0 AND i.x1 GROUP BY 1, 2",
    "customer_at", "box",
)(lambda p, i: spatial.interval_lookup(p.select("id", F.col("x").alias("at")), i.select(F.col("id").alias("ord"), F.col("x0").alias("lo"), F.col("x1").alias("hi")), 50.0))
_add(
    "rectangle_union",
    """WITH xs AS (SELECT DISTINCT brand, unnest([x0, x1]) AS x FROM box), st AS (SELECT *, lead(x) OVER (PARTITION BY brand ORDER BY x) AS nx FROM xs),
    sp AS (SELECT st.brand, st.x, st.nx, y0, y1, max(y1) OVER (PARTITION BY st.brand, st.x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM st JOIN box b ON b.brand = st.brand AND b.x0 <= st.x AND b.x1 >= st.nx)
    SELECT brand, sum((nx - x) * greatest(0, y1 - greatest(y0, coalesce(reach, y0))))::BIGINT AS area FROM sp GROUP BY 1""",
    "box",
)(lambda t: spatial.rectangle_union_area(t, "brand", 50.0).withColumn("area", F.col("area").cast("long")))

# Cells under triangles, and the lowest above each.
_add(
    "cells_under_triangles",
    """WITH g AS (SELECT id, i, j, (i + 0.5) * 2 AS px, (j + 0.5) * 2 AS py, ax, ay, az, bx, "by", bz, cx, cy, cz, (bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax) AS d FROM facet, range(0, 110) a(i), range(0, 110) b(j) WHERE i BETWEEN floor(ax / 2) - 1 AND ceil(bx / 2) + 1 AND j BETWEEN floor(ay / 2) - 1 AND ceil(cy / 2) + 1),
    w AS (SELECT *, ((px - ax) * (cy - ay) - (py - ay) * (cx - ax)) / d AS wb, ((bx - ax) * (py - ay) - ("by" - ay) * (px - ax)) / d AS wc FROM g)
    SELECT i, j, count(*) AS hits, min(az + wb * (bz - az) + wc * (cz - az)) AS lowest FROM w WHERE wb >= 0 AND wc >= 0 AND wb + wc <= 1 GROUP BY 1, 2""",
    "facet",
)(lambda t: spatial.cells_under(t, 2.0).groupBy("i", "j").agg(F.count("*").alias("hits"), F.min("z").alias("lowest")))

# Where one can stand, walk, and how far it leads.
_STAND = """e AS (SELECT i, j, lo AS z, 1 AS s FROM slab UNION ALL SELECT i, j, hi, -1 FROM slab), d AS (SELECT *, sum(s) OVER (PARTITION BY i, j ORDER BY z, s DESC ROWS UNBOUNDED PRECEDING) AS depth FROM e),
    st AS (SELECT i, j, z AS lo, row_number() OVER (PARTITION BY i, j ORDER BY z) AS k FROM d WHERE s = 1 AND depth = 1), sp AS (SELECT i, j, z AS hi, row_number() OVER (PARTITION BY i, j ORDER BY z) AS k FROM d WHERE s = -1 AND depth = 0),
    h AS (SELECT i, j, hi AS z, coalesce(CAST(lead(lo) OVER (PARTITION BY i, j ORDER BY lo) - hi AS DOUBLE), 1e300) AS free FROM st JOIN sp USING (i, j, k)),
    place AS (SELECT i, j, row_number() OVER (PARTITION BY i, j ORDER BY z) - 1 AS rank, z, free FROM h WHERE free >= 4),
    step AS (SELECT a.i, a.j, a.rank, b.i AS i2, b.j AS j2, b.rank AS rank2 FROM place a JOIN place b ON ((a.i = b.i AND abs(a.j - b.j) = 1) OR (a.j = b.j AND abs(a.i - b.i) = 1)) AND abs(a.z - b.z) <= 5 AND least(a.z + a.free, b.z + b.free) - greatest(a.z, b.z) >= 4)"""
_add("walk_steps", f"WITH {_STAND} SELECT count(*) // 2 AS steps FROM step", "slab")(lambda t: walk.steps(walk.standing(t, 4), 5, 4).agg(F.count("*").alias("steps")))
_add(
    "walk_regions",
    f"""WITH {_STAND}, reach AS (SELECT (i, j, rank) AS root, i, j, rank FROM place UNION SELECT r.root, s.i2, s.j2, s.rank2 FROM reach r JOIN step s USING (i, j, rank)), l AS (SELECT i, j, rank, min(root) AS region FROM reach GROUP BY 1, 2, 3)
    SELECT cells, count(*) AS regions FROM (SELECT region, count(*) AS cells FROM l GROUP BY 1) GROUP BY 1""",
    "slab",
)(lambda t: walk.region_stats(walk.regions(walk.standing(t, 4), 5, 4), 1.0).groupBy("cells").agg(F.count("*").alias("regions")))
_add(
    "clear_of_walls",
    f"WITH {_STAND}, b AS (SELECT DISTINCT i, j FROM slab WHERE lo % 10 = 0) SELECT i, j, rank, z FROM place WHERE NOT EXISTS (SELECT 1 FROM b WHERE (b.i - place.i) ** 2 + (b.j - place.j) ** 2 < 4)",
    "slab",
)(lambda t: walk.clear(walk.standing(t, 4), t.where("lo % 10 = 0").select("i", "j").distinct(), 2).select("i", "j", "rank", "z"))
# Q18: clearance by height, over a floor with steps, low ceilings and beams.
_FLOOR = "id % 50 AS i, CAST(floor(id / 50) AS BIGINT) AS j, 1 + id % 3 * 0.125{0} + CASE WHEN id * 7 % 11 = 0 THEN 0.5{0} ELSE 0{0} END AS hi, id % 41 = 0 AS low, id % 53 = 0 AS beam"
_add(
    "standable_cells",
    f"""WITH c AS (SELECT {_FLOOR.format('e0')} FROM box), o AS (SELECT * FROM (VALUES (-1), (0), (1)) a(a), (VALUES (-1), (0), (1)) b(b))
    SELECT p.i, p.j, p.hi AS z FROM c p CROSS JOIN o LEFT JOIN c ON c.i = p.i + a AND c.j = p.j + b WHERE NOT p.low GROUP BY ALL HAVING bool_and(coalesce(NOT c.low AND abs(c.hi - p.hi) <= 0.3 AND NOT (c.beam AND c.hi + 2.1 < p.hi + 2), FALSE))""",
    "box",
)(lambda t: walk.standable(
    walk.standing(s := t.selectExpr(*_FLOOR.format("D").split(", ")).selectExpr("i", "j", "inline(filter(array(struct(0D AS lo, hi AS hi), struct(hi + CASE WHEN low THEN 1D ELSE 2.1D END AS lo, hi + 2.5D AS hi)), (x, k) -> k = 0 OR k = 1 AND (low OR beam)))"), 2.0), s, 1.2, 2.0, 0.3, 1.0
).select("i", "j", "z"))

# Verdicts.
_add(
    "verdicts",
    """SELECT priority, coalesce(bool_and(passed), FALSE) AND count(passed) > 0 AS passed, count(passed) AS ran, count(*) FILTER (passed = FALSE) AS failed, coalesce(string_agg(name, ',' ORDER BY name) FILTER (passed IS NULL), '') AS not_run FROM record GROUP BY 1""",
    "record",
)(lambda t: predicates.verdict(t, "priority"))

# Selections and top k.
_add(
    "top_boxes",
    "SELECT * FROM (SELECT brand, id, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY brand ORDER BY (x1 - x0) * (y1 - y0) DESC, id) AS rank FROM box) WHERE rank <= 3",
    "box",
)(lambda t: predicates.top(t.select("brand", "id", F.expr("(x1 - x0) * (y1 - y0)").alias("area")), ["brand"], [F.desc("area"), F.col("id")], 3))
_add("selected_names", "SELECT brand, count(*) AS boxes FROM box WHERE regexp_matches(brand, '1$') OR regexp_matches(brand, '#2') GROUP BY 1", "box")(lambda t: t.where(predicates.selected(F.col("brand"), "1$,#2")).groupBy("brand").agg(F.count("*").alias("boxes")))
