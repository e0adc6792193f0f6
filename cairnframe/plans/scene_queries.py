"""Queries of scenes of objects with parents; the SQL walks the chains from their first object."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnframe.operators import scene

from .catalog import add

#: An object for each box, below one up to three before it, in chains that start anew every 64; turned by quarters about the upright axis.
_PARENT = "CASE WHEN id % 64 > 0 THEN greatest(id - id % 64, id - 1 - x1 % 3) END"
_CHAIN = f"""o AS (SELECT id AS name, {_PARENT} AS parent, CASE WHEN id % 29 = 0 THEN 2e0 WHEN id % 31 = 0 THEN 0.5e0 ELSE 1e0 END AS k, id % 4 AS q, id % 7 + 0e0 AS x, id % 5 + 0e0 AS y, id % 3 + 0e0 AS z, CASE id % 50 WHEN 7 THEN 'EMPTY' WHEN 9 THEN 'LIGHT' ELSE 'MESH' END AS type FROM box),
    own AS (SELECT name, parent, k, k * CASE q WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS c, k * CASE q WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS s, x, y, z, type FROM o),
    w AS (SELECT * FROM own WHERE parent IS NULL OR parent NOT IN (SELECT name FROM own) UNION ALL SELECT o.name, o.parent, w.k * o.k, w.c * o.c - w.s * o.s, w.c * o.s + w.s * o.c, w.x + w.c * o.x - w.s * o.y, w.y + w.s * o.x + w.c * o.y, w.z + w.k * o.z, o.type FROM own o JOIN w ON o.parent = w.name)"""


def _placed(t):
    o = t.selectExpr("id AS name", f"{_PARENT} AS parent", "CASE WHEN id % 29 = 0 THEN 2D WHEN id % 31 = 0 THEN 0.5D ELSE 1D END AS k", "id % 4 AS q", "id", "CASE id % 50 WHEN 7 THEN 'EMPTY' WHEN 9 THEN 'LIGHT' ELSE 'MESH' END AS type")
    o = o.withColumns({"c": F.expr("k * CASE q WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END"), "s": F.expr("k * CASE q WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END")})
    return scene.world(o.selectExpr("name", "parent", "type", "array(c, -s, 0D, id % 7, s, c, 0D, id % 5, 0D, 0D, k, id % 3) AS matrix"))


# Where objects stand in the world.
add("world_places", f"WITH {_CHAIN} SELECT name, x, y, z, c + 0e0 AS c, s + 0e0 AS s FROM w", "box")(lambda t: _placed(t).select("name", *[(F.col("matrix")[i] + 0.0).alias(c) for c, i in zip("xyzcs", (3, 7, 11, 0, 4), strict=True)]))
# How large objects become, and whether all are of their own size and of known types.
add("object_scales", f"WITH {_CHAIN} SELECT k AS scale, count(*) AS objects FROM w GROUP BY 1", "box")(lambda t: scene.scales(_placed(t)).groupBy(F.round("sx", 6).alias("scale")).agg(F.count("*").alias("objects")))
add("sound_objects", f"WITH {_CHAIN} SELECT count(*) FILTER (type = 'LIGHT') AS other_objects, count(*) FILTER (k <> 1) AS scaled, count(*) FILTER (type = 'EMPTY') AS empties, count(*) FILTER (type = 'LIGHT' OR k <> 1) = 0 AS passed FROM w", "box")(lambda t: scene.sound(_placed(t)))
