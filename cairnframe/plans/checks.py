"""Named quality checks over mesh and marker tables: each gives rows (name, passed, detail), passed null where it could not run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.operators import level, lines, mesh, spatial
from cairnframe.operators.predicates import selected, verdict

CHECKS: dict[str, Callable[..., DataFrame]] = {}


def check(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Registers a check under its name; others may be added by callers."""
    CHECKS[f.__name__] = f
    return f


def _record(df: DataFrame, name: str, passed: Column, **detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("name"), passed.alias("passed"), F.to_json(F.struct(*[c.alias(k) for k, c in detail.items()])).alias("detail"))


@check
def mesh_topology(vertex: DataFrame, tri: DataFrame, closed: str | None = None, aggregate: str | None = None, weld: float = 1e-5, cell: float = 1.0, **_) -> DataFrame:
    """Meshes that must be closed (names that match ``closed``; all without it) have no edges used other than twice, no mesh has triangles of no area, and no island is turned inside out; cavities are sound.

    With ``aggregate``, the meshes whose names match it have no open edge when welded into one; if none does, the check fails.
    """
    t, v = tri.withColumn("mesh", F.col("mesh").cast("string")), vertex.withColumn("mesh", F.col("mesh").cast("string"))
    sound = mesh.edge_stats(t).where(selected(F.col("mesh"), closed))
    edges = sound.agg(F.count("*").alias("meshes"), F.coalesce(F.sum("nonmanifold"), F.lit(0)).alias("nonmanifold"))
    areas = mesh.area_stats(mesh.corners(v, t)).agg(F.coalesce(F.sum("zero"), F.lit(0)).alias("zero"))
    classes = level.island_classes(v, t, cell).join(sound.where("nonmanifold = 0").select("mesh"), "mesh", "left_semi")
    islands = classes.agg(F.count_if(F.col("class") == "inverted").alias("inverted"), F.count_if(F.col("class") == "cavity").alias("cavities"))
    one = edges.join(areas).join(islands)  # a row each
    good = (F.col("nonmanifold") == 0) & (F.col("zero") == 0) & (F.col("inverted") == 0)
    detail = {c: F.col(c) for c in ("nonmanifold", "zero", "inverted", "cavities")}
    if aggregate:
        some = selected(F.col("mesh"), aggregate)
        whole = mesh.edge_stats(mesh.welded(v.where(some), t.where(some), weld)).agg(F.count("*").alias("welded"), F.coalesce(F.sum("boundary"), F.lit(0)).alias("boundary"))
        one, good = one.join(whole), good & (F.col("welded") > 0) & (F.col("boundary") == 0)
        detail["boundary"] = F.col("boundary")
    return _record(one, "mesh_topology", F.when(F.col("meshes") > 0, good), **detail)


@check
def second_uv(measured: DataFrame, **_) -> DataFrame:
    """There are render meshes, and all have two UV layers or more."""
    found = level.second_uv(measured)
    return _record(found, "uv2", F.col("passed"), render=F.col("render"), two=F.col("two"))


@check
def coplanar(faces: DataFrame, gap: float = 0.002, least: float = 1e-4, cell: float = 1.0, **_) -> DataFrame:
    """No faces of one direction lie on one another."""
    found = level.coplanar(faces, gap, least, cell).agg(F.count("*").alias("pairs"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"))
    return _record(found, "zfighting", F.col("pairs") == 0, pairs=F.col("pairs"), area=F.col("area"))


@check
def outline_shape(points: DataFrame, by: str = "shape", options: dict | None = None, **_) -> DataFrame:
    """No outline has short, skew or jogging edges or uneven curves."""
    found = lines.issues(points, by, options).agg(F.count("*").alias("issues"))
    return _record(found, "section_shape", F.col("issues") == 0, issues=F.col("issues"))


@check
def floating(vertex: DataFrame, tri: DataFrame, floor_z: float = 0.0, tol: float = 0.01, **_) -> DataFrame:
    """No island that starts over ``tol`` above the floor."""
    found = mesh.island_measures(vertex, tri).agg(F.count("*").alias("islands"), F.count_if(F.col("zmin") - floor_z > tol).alias("floating"))
    return _record(found, "floating", F.when(F.col("islands") > 0, F.col("floating") == 0), floating=F.col("floating"))


@check
def roundtrip(vertex: DataFrame, tri: DataFrame, expected: DataFrame, tol: float = 1e-4, **_) -> DataFrame:
    """Meshes are those expected (mesh, triangles, x0 .. z1), with equal triangles and bounds within ``tol``."""
    sizes = tri.groupBy("mesh").agg(F.count("*").alias("triangles"))
    got = mesh.bounds(vertex).join(sizes, "mesh", "left").fillna(0, ["triangles"])
    ends = [f"{c}{e}" for c in "xyz" for e in "01"]
    both = got.select(F.col("mesh").alias("g"), F.col("triangles").alias("gt"), *[F.col(c).alias(f"g{c}") for c in ends]).join(expected, F.col("g") == F.col("mesh"), "full_outer")
    off = F.greatest(*[F.abs(F.col(f"g{c}") - F.col(c)) for c in ends])
    found = both.agg(F.count_if(F.col("g").isNull()).alias("missing"), F.count_if(F.col("mesh").isNull()).alias("extra"), F.count_if(F.col("gt") != F.col("triangles")).alias("triangles"), F.max(off).alias("off"))
    return _record(found, "roundtrip", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("triangles") == 0) & (F.coalesce("off", F.lit(0.0)) <= tol), missing=F.col("missing"), extra=F.col("extra"), triangles=F.col("triangles"), off=F.col("off"))


def ceilings(vertex: DataFrame, tri: DataFrame, rooms: DataFrame, offset: float = 0.01, most: float = 100.0, cell: float = 1.0) -> DataFrame:
    """name and height of rooms (name, x, y, z): from each marker to the lowest triangle over it, as a ray finds it that starts ``offset`` above and ends after ``most``; null where none is. Upright triangles are none."""
    t = mesh.corners(vertex, tri).withColumn("id", F.struct("mesh", "tid")).withColumns({f"{c}{e}": f(f"a{c}", f"b{c}", f"c{c}") for c in "xy" for e, f in (("0", F.least), ("1", F.greatest))})
    points = rooms.select("name", "x", "y", "z").withColumns({"id": F.col("name"), "x0": F.col("x"), "x1": F.col("x"), "y0": F.col("y"), "y1": F.col("y")})
    over = spatial.box_pairs(points, t, cell=cell).join(points.drop("x0", "x1", "y0", "y1").hint("merge"), F.col("a_id") == F.col("id")).drop("id").join(t.drop("x0", "x1", "y0", "y1").hint("merge"), F.col("b_id") == F.col("id"))
    over = over.withColumn("d", F.expr("(bx - ax) * (cy - ay) - (by - ay) * (cx - ax)")).where(F.abs("d") > 1e-12)
    over = over.withColumn("wb", F.expr("((x - ax) * (cy - ay) - (y - ay) * (cx - ax)) / d")).withColumn("wc", F.expr("((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / d")).where("wb >= 0 AND wc >= 0 AND wb + wc <= 1")
    up = over.withColumn("up", F.expr("az + wb * (bz - az) + wc * (cz - az)") - F.col("z")).where((F.col("up") >= offset) & (F.col("up") <= offset + most))
    return rooms.select("name").join(up.groupBy("name").agg(F.min("up").alias("height")).hint("merge"), "name", "left")


@check
def ceiling_height(vertex: DataFrame, tri: DataFrame, rooms: DataFrame, tol: float = 0.002, cell: float = 1.0, skip: tuple[str, ...] = ("void",), offset: float = 0.01, **_) -> DataFrame:
    """Over every room (name, x, y, z, expected, and kind, if there is one) the ceiling is at the expected height; an unknown one is a failure. Rooms of kinds that are skipped have none; without any other, the check fails."""
    kind = F.col("kind") if "kind" in rooms.columns else F.lit(None).cast("string")
    asked = rooms.where(~F.coalesce(kind.isin(*skip), F.lit(False)))
    judged = asked.select("name", "expected").join(ceilings(vertex, tri, asked, offset, cell=cell), "name").withColumn("ok", F.coalesce(F.abs(F.col("height") - F.col("expected")) <= tol, F.lit(False)))
    found = judged.agg(F.count("*").alias("rooms"), F.count_if("ok").alias("ok")).join(rooms.agg(F.count("*").alias("markers")))  # a row each
    return _record(found, "ceiling_height", F.when(F.col("markers") > 0, (F.col("rooms") > 0) & (F.col("ok") == F.col("rooms"))), rooms=F.col("rooms"), ok=F.col("ok"))


def report(records: list[DataFrame]) -> DataFrame:
    """The verdict over all records, with each record's own as a JSON map."""
    everything = records[0]
    for r in records[1:]:
        everything = everything.unionByName(r)
    summary = everything.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "passed"))))).alias("summary"))
    return verdict(everything).join(summary)  # a row each
