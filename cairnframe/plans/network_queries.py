"""Queries of the faces of line networks; the SQL knows where the lines stand."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnframe.operators import network, overlay
from cairnframe.storage import dealt

from .catalog import add

#: A frame for each twelve boxes, lines through and beyond it, and a square on its corner that nothing touches in the frame's first field.
_STRUCTS = [
    ("CASE WHEN id % 2 = 0 THEN id * 28 % 156 + 4 ELSE -1 END", "CASE WHEN id % 2 = 0 THEN -1 ELSE id * 20 % 156 + 4 END", "CASE WHEN id % 2 = 0 THEN id * 28 % 156 + 4 ELSE 161 END", "CASE WHEN id % 2 = 0 THEN 161 ELSE id * 20 % 156 + 4 END"),
    *[("0", "0", "160", "0"), ("160", "0", "160", "160"), ("160", "160", "0", "160"), ("0", "160", "0", "0")],
    *[("2", "1", "3", "2"), ("3", "2", "2", "3"), ("2", "3", "1", "2"), ("1", "2", "2", "1")],
]
_FIELDS = """wall AS (SELECT DISTINCT CAST(floor(id / 12) AS BIGINT) AS plan, id % 2 = 0 AS across, CASE WHEN id % 2 = 0 THEN id * 28 % 156 + 4 ELSE id * 20 % 156 + 4 END AS z FROM box), every AS (SELECT * FROM wall UNION SELECT plan, across, unnest([0, 160]) FROM (SELECT DISTINCT plan FROM wall), (VALUES (TRUE), (FALSE)) s(across)),
    side AS (SELECT plan, across, z AS lo, lead(z) OVER (PARTITION BY plan, across ORDER BY z) AS hi FROM every), field AS (SELECT x.plan, x.lo AS x0, x.hi AS x1, y.lo AS y0, y.hi AS y1 FROM side x JOIN side y ON x.plan = y.plan AND x.across AND NOT y.across AND x.hi IS NOT NULL AND y.hi IS NOT NULL),
    face AS (SELECT *, (x1 - x0) * (y1 - y0) - CASE WHEN x0 = 0 AND y0 = 0 THEN 2 ELSE 0 END + 0e0 AS area, x0 = 0 AND y0 = 0 AS holed FROM field UNION ALL SELECT DISTINCT plan, 1, 3, 1, 3, 2e0, FALSE FROM field)"""


def _faces(t):
    lines = dealt(t.select("id"), "id", rows=50_000).select(F.floor(F.col("id") / 12).cast("long").alias("plan"), F.inline(F.array(*[F.struct(*[F.expr(e).cast("double").alias(c) for e, c in zip(s, network.ENDS, strict=True)]) for s in _STRUCTS])))
    return network.faces(network.noded(lines, "plan", 0.125, 16.0), "plan", 128.0).withColumns({c: F.col(c) * 0.125 for c in "xy"})


# The faces of a network of lines, with holes and dangling ends.
add("network_faces", f"WITH {_FIELDS} SELECT plan, area, CASE WHEN holed THEN 2 ELSE 1 END AS rings, x0 + 0e0 AS x0, x1 + 0e0 AS x1, y0 + 0e0 AS y0, y1 + 0e0 AS y1 FROM face", "box")(
    lambda t: (r := _faces(t)).groupBy("plan", "face").agg(F.count_distinct("ring").alias("rings"), *[f(c).alias(f"{c}{n}") for c in "xy" for f, n in ((F.min, "0"), (F.max, "1"))]).join(overlay.measures(r, "face").select("face", "area"), "face").drop("face")
)
# Seeds name faces; one that has a name, or none, is an error.
add(
    "named_faces",
    f"""WITH {_FIELDS}, seed AS (SELECT CAST(floor(id / 12) AS BIGINT) AS plan, concat('s', id) AS name, id AS ord, id * 44 % 170 + 1.5e0 AS x, id * 68 % 170 + 1.75e0 AS y FROM box),
    hit AS (SELECT s.*, f.x0, f.y0, f.area, row_number() OVER (PARTITION BY f.plan, f.x0, f.y0 ORDER BY s.ord) AS k FROM seed s LEFT JOIN field g ON s.plan = g.plan AND x > g.x0 AND x < g.x1 AND y > g.y0 AND y < g.y1
      LEFT JOIN face f ON f.plan = s.plan AND CASE WHEN abs(x - 2) + abs(y - 2) < 1 THEN f.x0 = 1 AND f.y0 = 1 ELSE f.x0 = g.x0 AND f.y0 = g.y0 END)
    SELECT plan, name, CASE WHEN x0 IS NULL THEN 'no face' WHEN k > 1 THEN 'taken' END AS error, CASE WHEN x0 IS NOT NULL AND k = 1 THEN area END AS area FROM hit
    UNION ALL SELECT plan, NULL, NULL, area FROM face f WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.plan = f.plan AND h.x0 = f.x0 AND h.y0 = f.y0)""",
    "box",
)(
    lambda t: network.seeded(
        (r := _faces(t)), t.select(F.floor(F.col("id") / 12).cast("long").alias("plan"), F.concat(F.lit("s"), "id").alias("name"), F.col("id").alias("ord"), F.expr("id * 44 % 170 + 1.5D").alias("x"), F.expr("id * 68 % 170 + 1.75D").alias("y")), "plan", 16.0
    ).join(overlay.measures(r, "face").select("face", "area"), "face", "left").select("plan", "name", "error", "area")
)
