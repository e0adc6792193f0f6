"""Queries of cells and the mesh around them; the SQL looks at unit cubes and their neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnframe.operators import cells

from .catalog import add

_CELLS = {"x0": "id * 7 % 12", "x1": "id * 7 % 12 + (x1 - x0) % 5", "y0": "id * 5 % 9", "y1": "id * 5 % 9 + (x1 - x0) % 4 + 1", "z0": "id % 3", "z1": "id % 3 + (x1 - x0) % 3 + 1"}
_UNITS = f"""b AS (SELECT CAST(floor(id / 10) AS BIGINT) AS mesh, {', '.join(f'{e} AS {c}' for c, e in _CELLS.items())} FROM box), ux AS (SELECT *, unnest(range(x0, x1)) AS i FROM b), uy AS (SELECT *, unnest(range(y0, y1)) AS j FROM ux),
    u AS (SELECT DISTINCT mesh, i, j, k FROM (SELECT *, unnest(range(z0, z1)) AS k FROM uy)),
    h AS (SELECT mesh, i, j, k, unnest(['x', 'x', 'y', 'y', 'z', 'z']) AS axis, unnest([-1, 1, -1, 1, -1, 1]) AS facing FROM u),
    f AS (SELECT h.* FROM h LEFT JOIN u n ON n.mesh = h.mesh AND n.i = h.i + CASE axis WHEN 'x' THEN facing ELSE 0 END AND n.j = h.j + CASE axis WHEN 'y' THEN facing ELSE 0 END AND n.k = h.k + CASE axis WHEN 'z' THEN facing ELSE 0 END WHERE n.mesh IS NULL)"""


def _cells(t):
    return t.selectExpr("CAST(floor(id / 10) AS BIGINT) AS mesh", *[f"{e} AS {c}" for c, e in _CELLS.items()])


# The faces around cells, and the volume that their triangles enclose.
add("cell_faces", f"WITH {_UNITS} SELECT mesh, axis, facing, CASE axis WHEN 'x' THEN i WHEN 'y' THEN j ELSE k END + CASE WHEN facing > 0 THEN 1 ELSE 0 END AS at_, count(*) AS area FROM f GROUP BY ALL", "box")(
    lambda t: cells.boundary(_cells(t), "mesh").groupBy("mesh", "axis", "facing", F.col("at").alias("at_")).agg(F.sum(F.expr("(u1 - u0) * (v1 - v0)")).alias("area"))
)
add("cell_volumes", f"WITH {_UNITS}, a AS (SELECT mesh, count(*) AS area FROM f GROUP BY 1) SELECT mesh, count(*) + 0e0 AS volume, any_value(area) + 0e0 AS area FROM u JOIN a USING (mesh) GROUP BY 1", "box")(lambda t: cells.volumes(cells.triangles(cells.boundary(_cells(t), "mesh"), "mesh"), "mesh"))
