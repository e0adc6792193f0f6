"""Queries of levels: roles and comparisons of meshes, coplanar faces, cavities, and what can be reached."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnframe.operators import level, mesh, planes, predicates, sections, sequences

from . import checks
from .catalog import add

# What each mesh is for.
add(
    "mesh_roles",
    """WITH p AS (SELECT DISTINCT render_mesh FROM entry WHERE collision AND render_mesh IS NOT NULL), m AS (SELECT m.name, coalesce(e.collision, starts_with(m.name, 'COL_')) AS collision, p.render_mesh IS NOT NULL AS paired, e.render_mesh IS NULL AS plain FROM mesh_name m LEFT JOIN entry e USING (name) LEFT JOIN p ON p.render_mesh = m.name)
    SELECT name, collision, NOT collision AND paired AS leaf, CASE WHEN collision THEN plain ELSE NOT paired END AS static FROM m""",
    "mesh_name", "entry",
)(level.mesh_roles)
add(
    "mesh_roles_by_name",
    """SELECT name, starts_with(name, 'COL_') AS collision, NOT starts_with(name, 'COL_') AND name LIKE '%DoorLeaf%' AS leaf, name NOT LIKE '%DoorLeaf%' AS static FROM mesh_name""",
    "mesh_name", "entry",
)(lambda m, e: level.mesh_roles(m, e.where("false")))
# Properties of markers, and what is required of doors.
add("required_doors", "SELECT id, coalesce(nullif(kind, ''), CAST(z AS VARCHAR)) AS prop, coalesce(kind, 'None') IN ('void', 'None') AS required FROM marker", "marker")(
    lambda t: t.withColumn("props", F.create_map(F.lit("kind"), "kind", F.lit("z"), F.col("z").cast("string"))).select("id", predicates.first_property(F.col("props"), "kind", "z").alias("prop"), predicates.required(F.col("props"), {"kind": "void|None"}).alias("required"))
)
# Markers by prefix, and against the numbers expected.
add("markers_by_prefix", "SELECT split_part(name, '_', 1) || '_' AS prefix, count(*) FILTER (name LIKE '%\\_%' ESCAPE '\\') AS markers FROM marker GROUP BY 1", "marker")(level.markers_by_prefix)
add("expected_markers", "SELECT prefix, count(*) FILTER (starts_with(name, prefix)) AS found, any_value(n) AS expected, count(*) FILTER (starts_with(name, prefix)) = any_value(n) AS ok FROM marker, (VALUES ('DOOR_', 33::BIGINT), ('OPEN', 66), ('STAIR_', 5)) e(prefix, n) GROUP BY 1", "marker")(
    lambda t: level.counted(t, {"DOOR_": 33, "OPEN": 66, "STAIR_": 5})
)
# The floor whose key a name starts with.
add(
    "floors_of_names",
    """WITH n AS (SELECT DISTINCT name FROM marker), f(floor) AS (VALUES ('STAIR'), ('STAIR_A'), ('OPEN'), ('')) SELECT name, arg_max(floor, length(floor)) AS floor FROM n LEFT JOIN f ON name = floor OR starts_with(name, floor || '_') GROUP BY 1""",
    "marker",
)(lambda t: predicates.floor_of(t.select("name").distinct(), t.sparkSession.createDataFrame([("STAIR",), ("STAIR_A",), ("OPEN",), ("",)], "floor string")))
# Q01: meshes against what was expected of them; Q03: second UV layers.
_TRIP = """j AS (SELECT coalesce(m.name, e.name) AS name, m.name IS NULL AS missing, e.name IS NULL AS extra, CASE WHEN m.name = e.name THEN greatest(abs(m.x0 - e.x0), abs(m.x1 - e.x1), abs(m.y0 - e.y0), abs(m.y1 - e.y1), abs(m.z0 - e.z0), abs(m.z1 - e.z1)) END AS err,
      coalesce(m.triangles <> e.triangles, FALSE) AS tri, m.name = e.name AND NOT m.collision AS render, m.uv_layers < 2 AS uv, m.materials <> e.materials AS mat FROM measured m FULL JOIN expected e ON m.name = e.name),
    r AS (SELECT name, CASE WHEN missing THEN 'missing' WHEN extra THEN 'extra' ELSE 'matched' END AS state, round(err, 6) AS bounds_error, coalesce(err > 1e-4, FALSE) AS bounds_differ, tri AS triangles_differ, coalesce(render AND uv, FALSE) AS uv2_missing, coalesce(render AND mat, FALSE) AS materials_differ FROM j)"""
add("roundtrip", f"WITH {_TRIP} SELECT * FROM r", "measured", "expected")(level.roundtrip)
add("roundtrip_passed", f"WITH {_TRIP} SELECT count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'extra') AS extra, max(bounds_error) AS worst, count(*) FILTER (state <> 'matched' OR bounds_differ OR triangles_differ OR uv2_missing OR materials_differ) = 0 AS passed FROM r", "measured", "expected")(lambda m, e: level.roundtrip_passed(level.roundtrip(m, e)))
add("second_uv", "SELECT count(*) AS render, count(*) FILTER (uv_layers >= 2) AS two, bool_and(uv_layers >= 2) AS passed FROM measured WHERE NOT collision", "measured")(level.second_uv)
# the floor's height; S19 falls back to all files.
add("floor_height", "SELECT coalesce(min(z), 0) AS floor_z FROM marker WHERE z > 1", "marker")(lambda t: level.floor_height(t.where("z > 1").select(F.col("z").alias("floor_z"))))

# Faces that lie on one another; O07: of stacked copies.
_COVER = """plane AS (SELECT *, sum(cut) OVER (PARTITION BY axis, facing ORDER BY "offset" RANGE UNBOUNDED PRECEDING) AS plane FROM (SELECT *, CASE WHEN "offset" - lag("offset") OVER (PARTITION BY axis, facing ORDER BY "offset") > 0.002 THEN 1 ELSE 0 END AS cut FROM {face})),
    unit AS (SELECT axis, facing, plane, mesh, u, unnest(range(v0, v1)) AS v FROM (SELECT *, unnest(range(u0, u1)) AS u FROM plane)), cover AS (SELECT axis, facing, plane, mesh, u, v, count(*) AS n FROM unit GROUP BY ALL),
    found AS (SELECT axis, facing, plane, mesh AS a, mesh AS b, CAST(sum(n - 1) AS BIGINT) AS area FROM cover GROUP BY ALL HAVING sum(n - 1) > 0
      UNION ALL SELECT a.axis, a.facing, a.plane, a.mesh, b.mesh, count(*) FROM cover a JOIN cover b ON a.axis = b.axis AND a.facing = b.facing AND a.plane = b.plane AND a.u = b.u AND a.v = b.v AND a.mesh < b.mesh GROUP BY ALL)"""
add("coplanar_faces", f"WITH {_COVER.format(face='face')} SELECT axis, facing, CAST(plane AS BIGINT) AS plane, a, b, area FROM found", "face")(lambda t: level.coplanar(t, cell=8.0))
add(
    "largest_overlaps",
    f"WITH {_COVER.format(face='face')} SELECT axis, facing, CAST(plane AS BIGINT) AS plane, a, b, area, (SELECT count(*) FROM found) AS pairs, (SELECT CAST(sum(area) AS BIGINT) FROM found) AS total_area FROM found ORDER BY area DESC, axis, facing, plane, a, b LIMIT 50",
    "face",
)(lambda t: level.coplanar_summary(level.coplanar(t, cell=8.0)).withColumn("total_area", F.col("total_area").cast("long")))
# Faces of roofs, that rise as they go, which lie on one another.
add(
    "tilted_overlaps",
    """WITH o AS (SELECT least(a.mesh, b.mesh) AS a, greatest(a.mesh, b.mesh) AS b, sqrt(2) * (least(a.u1, b.u1) - greatest(a.u0, b.u0)) * (least(a.v1, b.v1) - greatest(a.v0, b.v0)) AS area
      FROM face a JOIN face b ON a.axis = b.axis AND a.facing = b.facing AND floor(a."offset") = floor(b."offset") AND (a.mesh, a.id) < (b.mesh, b.id) AND least(a.u1, b.u1) > greatest(a.u0, b.u0) AND least(a.v1, b.v1) > greatest(a.v0, b.v0))
    SELECT a, b, round(sum(area), 6) AS area FROM o GROUP BY 1, 2""",
    "face",
)(
    lambda t: planes.tilted_pairs(
        t.selectExpr(
            "mesh", "id", "facing", "inline(array(struct(0 AS half, u0 AS p0, v0 AS q0, CASE facing WHEN 1 THEN u1 ELSE u1 END AS p1, CASE facing WHEN 1 THEN v0 ELSE v1 END AS q1, u1 AS p2, CASE facing WHEN 1 THEN v1 ELSE v0 END AS q2), struct(1 AS half, u0 AS p0, v0 AS q0, CASE facing WHEN 1 THEN u1 ELSE u0 END AS p1, v1 AS q1, CASE facing WHEN 1 THEN u0 ELSE u1 END AS p2, v1 AS q2)))", "axis", "offset + CASE axis WHEN 'x' THEN 1000 WHEN 'y' THEN 2000 ELSE 3000 END AS up"
        ).selectExpr("mesh", "id * 2 + half AS id", *[f"{e} AS {c}{x}" for c, k in zip("abc", "012", strict=True) for x, e in (("x", f"CAST(p{k} AS DOUBLE)"), ("y", f"CAST(q{k} AS DOUBLE)"), ("z", f"p{k} + up"))]),
        cell=8.0,
    )
)
_STACK = """stack AS (SELECT CASE k WHEN 0 THEN mesh ELSE mesh || '(+1)' END AS mesh, id, axis, facing, CASE axis WHEN 'z' THEN "offset" + k * 5 ELSE "offset" END AS "offset", u0, u1, CASE axis WHEN 'z' THEN v0 ELSE v0 + k * 5 END AS v0, CASE axis WHEN 'z' THEN v1 ELSE v1 + k * 5 END AS v1 FROM face, (VALUES (0), (1)) c(k))"""
add("stacked_overlaps", f"WITH {_STACK}, {_COVER.format(face='stack')} SELECT axis, facing, CAST(plane AS BIGINT) AS plane, a, b, area FROM found WHERE (a LIKE '%(+1)') <> (b LIKE '%(+1)')", "face")(
    lambda t: level.coplanar(level.stacked(t, 5).withColumns({c: F.col(c).cast("long") for c in ("v0", "v1")}), cell=8.0).where("endswith(a, '(+1)') <> endswith(b, '(+1)')")
)
# Faces that touch.
add(
    "face_contacts",
    """WITH f AS (SELECT *, CAST(round("offset" / 0.0005) AS BIGINT) AS k FROM face)
    SELECT least(a.mesh, b.mesh) AS a, greatest(a.mesh, b.mesh) AS b, a.facing = b.facing AS same, count(*) AS n, CAST(sum((least(a.u1, b.u1) - greatest(a.u0, b.u0)) * (least(a.v1, b.v1) - greatest(a.v0, b.v0))) AS BIGINT) AS area
    FROM f a JOIN f b ON a.axis = b.axis AND a.k = b.k AND (a.mesh, a.id) < (b.mesh, b.id) AND least(a.u1, b.u1) > greatest(a.u0, b.u0) AND least(a.v1, b.v1) > greatest(a.v0, b.v0) WHERE a.facing = b.facing OR a.mesh <> b.mesh GROUP BY 1, 2, 3""",
    "face",
)(lambda t: level.contacts(t, cell=8.0))
# What islands are, cavities among them.
add(
    "island_classes",
    """WITH k(k) AS (VALUES (0), (1)) SELECT s.mesh, CAST(8 * k AS BIGINT) AS island, 12 AS triangles, CASE k WHEN 0 THEN 96e0 ELSE 24e0 END AS area, CASE WHEN k = 0 THEN 64e0 WHEN s.mesh % 4 = 1 THEN 8e0 ELSE -8e0 END AS volume,
      CASE k WHEN 0 THEN 'solid' ELSE CASE s.mesh % 4 WHEN 0 THEN 'cavity' WHEN 1 THEN 'solid' ELSE 'inverted' END END AS class FROM (SELECT DISTINCT mesh FROM shell_vertex) s, k WHERE k = 0 OR s.mesh % 4 < 3""",
    "shell_vertex", "shell_tri",
)(lambda v, t: level.island_classes(v, t, cell=2.0).withColumn("island", F.col("island").cast("long")).drop("zmin", "zmax"))
add("floating_islands", "SELECT mesh, CASE WHEN mesh % 4 < 3 THEN 1 ELSE 0 END AS floating FROM (SELECT DISTINCT mesh FROM shell_vertex)", "shell_vertex", "shell_tri")(lambda v, t: level.island_classes(v, t, cell=2.0).groupBy("mesh").agg(F.count_if(F.col("zmin") > 0.01).alias("floating")))

# The nearest place of about the same height; J29: seeds by name; P16, Q10: rooms reached; J31: a rectangle taken out.
_NEAR = """pl AS (SELECT id AS pid, x + 0.5 AS x, y + 0.25 AS y, id % 4 + 0.0 AS h FROM customer_at), n AS (SELECT m.id, p.pid, sqrt((p.x - m.x) ** 2 + (p.y - m.y) ** 2) AS d FROM marker m JOIN pl p ON abs(p.h - m.z) <= 0.5 AND (p.x - m.x) ** 2 + (p.y - m.y) ** 2 <= 900),
    b AS (SELECT id, arg_min(pid, (d, pid)) AS pid, min(d) AS distance FROM n GROUP BY 1)"""
_places = lambda c: c.select(F.col("id").alias("pid"), (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.25).alias("y"), (F.col("id") % 4).cast("double").alias("h"))
add("nearest_standing", f"WITH {_NEAR} SELECT m.id, b.pid, round(b.distance, 6) AS distance FROM marker m LEFT JOIN b USING (id)", "marker", "customer_at")(lambda m, c: level.nearest_standing(m, _places(c), 0.5, 30.0))
add("seed_markers", "WITH w AS (SELECT DISTINCT CASE id % 4 WHEN 0 THEN name ELSE name || 'x' END AS name FROM marker), f AS (SELECT name, min((x, y, z)) AS place FROM marker GROUP BY 1) SELECT w.name, place[1] AS x, place[2] AS y, place[3] AS z, CASE WHEN place IS NULL THEN 'no marker ' || w.name END AS error FROM w LEFT JOIN f USING (name)", "marker")(
    lambda t: level.seeds(t, t.select(F.expr("CASE id % 4 WHEN 0 THEN name ELSE name || 'x' END").alias("name")).distinct())
)
_REACH = f"""{_NEAR.replace("FROM customer_at)", "FROM customer_at WHERE id % 3 > 0)")}, rm AS (SELECT m.id, m.kind, round(b.distance, 6) AS distance, CASE WHEN m.kind = 'void' THEN NULL ELSE b.pid IS NOT NULL END AS reachable FROM marker m LEFT JOIN b ON b.id = m.id AND coalesce(m.kind, '') <> 'void')"""
_reached = lambda m, c: level.rooms_reached(m, _places(c).withColumn("main", F.col("pid") % 3 > 0), 0.5, 30.0)
add("rooms_reached", f"WITH {_REACH} SELECT * FROM rm", "marker", "customer_at")(_reached)
add("reachability", f"WITH {_REACH} SELECT count(*) FILTER (NOT reachable) AS unreachable, count(reachable) AS checked, (SELECT count(*) FROM supplier_at WHERE id % 2 = 0 AND id % 5 = 0) AS blocked, FALSE AS passed FROM rm", "marker", "customer_at", "supplier_at")(
    lambda m, c, s: level.reachability(_reached(m, c), s.select((F.col("id") % 2 == 0).alias("required"), (F.col("id") % 5).alias("reachable")), F.lit(False))
)
# Q10: storeys that the main part leads to, at the same place.
add(
    "storey_links",
    """WITH c AS (SELECT id % 200 AS i, x1 % 7 AS j, 1e0 + id % 5 * 3 + CASE WHEN id % 3 = 0 THEN 0.005e0 ELSE 0 END AS h, id % 4 > 0 AS main FROM box)
    SELECT k AS storey, EXISTS (SELECT 1 FROM c a JOIN c b ON a.i = b.i AND a.j = b.j WHERE a.main AND b.main AND abs(b.h - 7) < 0.01 AND abs(a.h - (7 + 3 * k)) < 0.01) AS linked FROM (VALUES (1), (-1), (2), (3)) t(k)""",
    "box",
)(lambda t: level.storey_links(t.selectExpr("id % 200 AS i", "x1 % 7 AS j", "1D + id % 5 * 3 + CASE WHEN id % 3 = 0 THEN 0.005D ELSE 0 END AS h", "id % 4 > 0 AS main"), 7.0, 3.0, [0, 1, -1, 2, 3]))
add("outside_rectangle", "SELECT id, x, y FROM customer_at WHERE NOT (x BETWEEN 100 AND 400 AND y BETWEEN 50 AND 700)", "customer_at")(lambda t: level.without_rect(t, 400, 50, 100, 700))
# Sections of islands by several planes, and what slabs of them cover.
_SHELLS = "b AS (SELECT DISTINCT s.mesh, k, CASE k WHEN 0 THEN 0e0 ELSE 1e0 END AS lo, CASE k WHEN 0 THEN 4e0 ELSE 3e0 END AS hi, CASE WHEN k = 0 THEN 16e0 WHEN s.mesh % 4 = 1 THEN 4e0 ELSE -4e0 END AS area, CASE k WHEN 0 THEN 16e0 ELSE 8e0 END AS length FROM shell_vertex s, (VALUES (0), (1)) t(k) WHERE k = 0 OR s.mesh % 4 < 3)"


def _islands(v, t):
    return mesh.corners(v, t).withColumn("island", F.expr("tid div 12"))


add("island_sections", f"WITH {_SHELLS} SELECT mesh, CAST(k AS BIGINT) AS island, z, area, length FROM b, (VALUES (0.5e0), (1.5e0), (2e0), (3e0), (3.5e0)) p(z) WHERE z > lo AND z <= hi", "shell_vertex", "shell_tri")(
    lambda v, t: sections.section_areas(sections.sections(c := _islands(v, t), c.select("mesh", "island", F.explode(F.array(*map(F.lit, (0.5, 1.5, 2.0, 3.0, 3.5)))).alias("z")).distinct())).withColumn("island", F.col("island").cast("long"))
)
add("slab_footprints", f"WITH {_SHELLS} SELECT mesh, CAST(k AS BIGINT) AS island, greatest(lo, 0.25e0) AS z0, least(hi, 3.5e0) AS z1, area * (least(hi, 3.5e0) - greatest(lo, 0.25e0)) AS volume FROM b", "shell_vertex", "shell_tri")(
    lambda v, t: sections.footprints(_islands(v, t), 0.25, 3.5).groupBy("obstacle.mesh", F.col("obstacle.island").cast("long").alias("island"), "z0", "z1").agg((F.sum(F.expr("ax * by_ - bx * ay")) / 2).alias("area")).select("mesh", "island", "z0", "z1", F.expr("area * (z1 - z0)").alias("volume"))
)
# Columns that don't close.
_HALF = """e AS (SELECT col, lo AS z, 1 AS s FROM half_open WHERE lo IS NOT NULL UNION ALL SELECT col, hi, -1 FROM half_open WHERE hi IS NOT NULL), d AS (SELECT *, sum(s) OVER (PARTITION BY col ORDER BY z, s DESC ROWS UNBOUNDED PRECEDING) AS depth FROM e),
    st AS (SELECT col, z, row_number() OVER (PARTITION BY col ORDER BY z) AS k FROM d WHERE depth > 0 AND depth - s <= 0), en AS (SELECT col, z, row_number() OVER (PARTITION BY col ORDER BY z) AS k FROM d WHERE depth <= 0 AND depth - s > 0),
    n AS (SELECT col, (SELECT count(*) FROM st WHERE st.col = c.col) = (SELECT count(*) FROM en WHERE en.col = c.col) AS even FROM (SELECT DISTINCT col FROM e) c)"""
add("closure", f"WITH {_HALF} SELECT (SELECT count(*) FROM n WHERE NOT even) AS unbalanced, (SELECT count(*) FROM (SELECT col FROM e GROUP BY 1 HAVING sum(s) <> 0)) AS ending_inside", "half_open")(lambda t: sequences.closure(t, "col"))
add("balanced_stretches", f"WITH {_HALF} SELECT col, st.z AS lo, en.z AS hi FROM st JOIN en USING (col, k) JOIN n USING (col) WHERE even", "half_open")(lambda t: sequences.sweep(t, "col"))
# Successive differences of angles.
add("angle_steps", "SELECT user_id, pos, round(a - lag(a) OVER (PARTITION BY user_id ORDER BY pos), 6) AS step FROM (SELECT user_id, pos, pos * pos % 180 + 0.5e0 AS a FROM mask)", "mask")(
    lambda t: sequences.angle_steps(t.withColumn("a", F.col("pos") * F.col("pos") % 180 + 0.5), "user_id", "pos", "a").select("user_id", "pos", "step")
)
# Heights of ceilings over markers.
add(
    "ceiling_heights",
    """WITH r AS (SELECT id AS name, id * 37 % 200 + 0.25e0 AS x, id * 91 % 200 + 0.125e0 AS y, id % 30 + 0e0 AS z FROM marker), h AS (SELECT name, r.z, az AS up FROM r JOIN facet f ON ((x - ax) * (cy - ay) - (y - ay) * (cx - ax)) / ((bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax)) >= 0
      AND ((bx - ax) * (y - ay) - ("by" - ay) * (x - ax)) / ((bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax)) >= 0 AND ((x - ax) * (cy - ay) - (y - ay) * (cx - ax) + (bx - ax) * (y - ay) - ("by" - ay) * (x - ax)) / ((bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax)) <= 1 AND az - r.z BETWEEN 0.01 AND 100.01)
    SELECT r.name, min(h.up) - any_value(r.z) AS height FROM r LEFT JOIN h USING (name) GROUP BY 1""",
    "marker", "facet",
)(lambda m, t: checks.ceilings(
    t.select(F.lit(0).alias("mesh"), F.inline(F.array(*[F.struct((F.col("id") * 3 + i).alias("vid"), *[F.col(f"{k}{c}").alias(c) for c in "xyz"]) for i, k in enumerate("abc")]))),
    t.select(F.lit(0).alias("mesh"), F.col("id").alias("tid"), *[(F.col("id") * 3 + i).alias(k) for i, k in enumerate("abc")]),
    m.select(F.col("id").alias("name"), F.expr("id * 37 % 200 + 0.25D").alias("x"), F.expr("id * 91 % 200 + 0.125D").alias("y"), F.expr("id % 30 + 0D").alias("z")), cell=4.0,
))
