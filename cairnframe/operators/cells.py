"""The closed mesh around box-shaped cells: the two sides of a face that cells share vanish.

Cells of a mesh are cut along one another's coordinates, so that faces that touch are the same or
apart. Each part of a cell puts forth its six faces, with the way it looks; where two parts meet, their
faces look opposite ways and cancel out. What is left is the boundary, and it is closed. Cells that
overlap or repeat count once; cells without extent have no part. A mesh's coordinates stand in one row of
arrays, as many as its cells have sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = "xyz"


def parts(cells: DataFrame, by: str) -> DataFrame:
    """cells (by, x0, x1, y0, y1, z0, z1) cut along all coordinates of their mesh: by and the same columns, each part once."""
    marks = cells.groupBy(F.col(by).alias("of")).agg(*[F.array_sort(F.array_distinct(F.concat(F.collect_set(f"{x}0"), F.collect_set(f"{x}1")))).alias(f"{x}s") for x in AXES])
    p = cells.join(marks, F.col(by).eqNullSafe(F.col("of"))).select(by, *[f"{x}{e}" for x in AXES for e in "01"], *[f"{x}s" for x in AXES])
    for x in AXES:
        inside = F.expr(f"filter({x}s, c -> c >= {x}0 AND c <= {x}1)")
        spans = F.expr(f"filter(zip_with({x}s, slice({x}s, 2, size({x}s)), (a, b) -> struct(a AS lo, b AS hi)), s -> s.hi IS NOT NULL)")
        p = p.withColumn(f"{x}s", inside).withColumn("span", F.explode(spans)).withColumns({f"{x}0": F.col("span.lo"), f"{x}1": F.col("span.hi")}).drop("span", f"{x}s")
    return p.distinct()


def boundary(cells: DataFrame, by: str) -> DataFrame:
    """Faces around the union of cells: by, axis, at, facing (1 or -1), u0, u1, v0, v1 (the other two axes in order)."""
    sides = []
    for x, (u, v) in zip(AXES, ("yz", "xz", "xy"), strict=True):
        for e, way in (("0", -1), ("1", 1)):
            sides.append(F.struct(F.lit(x).alias("axis"), F.col(f"{x}{e}").alias("at"), F.lit(way).alias("way"), F.col(f"{u}0").alias("u0"), F.col(f"{u}1").alias("u1"), F.col(f"{v}0").alias("v0"), F.col(f"{v}1").alias("v1")))
    halves = parts(cells, by).select(by, F.inline(F.array(*sides)))
    left = halves.groupBy(by, "axis", "at", "u0", "u1", "v0", "v1").agg(F.sum("way").alias("facing")).where("facing <> 0")
    return left.withColumn("facing", F.col("facing").cast("int"))


def triangles(faces: DataFrame, by: str) -> DataFrame:
    """Two triangles for each face of boundary(), by, ax, ay, az .. cz, that turn against the clock seen from outside."""
    corner = lambda u, v: {"x": ("at", u, v), "y": (u, "at", v), "z": (u, v, "at")}

    def point(u: str, v: str, p: str):
        where = corner(u, v)
        return [F.when(F.col("axis") == "x", F.col(where["x"][i])).when(F.col("axis") == "y", F.col(where["y"][i])).otherwise(F.col(where["z"][i])).cast("double").alias(f"{p}{c}") for i, c in enumerate(AXES)]

    # Along y the two other axes, x and z, turn the other way about.
    plain = (F.col("facing") > 0) != (F.col("axis") == "y")
    rows = lambda *c: F.struct(*[x for (u, v), p in zip(c, "abc", strict=True) for x in point(u, v, p)])
    a, b, c, d = ("u0", "v0"), ("u1", "v0"), ("u1", "v1"), ("u0", "v1")
    return faces.select(by, F.inline(F.when(plain, F.array(rows(a, b, c), rows(a, c, d))).otherwise(F.array(rows(a, c, b), rows(a, d, c)))))


def volumes(tris: DataFrame, by: str) -> DataFrame:
    """Volume within the closed triangles of each mesh, and their area."""
    six = F.expr("ax * (by * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by * cx)")
    u, v = [F.expr(f"b{x} - a{x}") for x in AXES], [F.expr(f"c{x} - a{x}") for x in AXES]
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return tris.groupBy(by).agg((F.sum(six) / 6).alias("volume"), (F.sum(F.sqrt(sum(c * c for c in cross))) / 2).alias("area"))
