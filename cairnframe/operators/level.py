"""Levels of meshes and markers: which mesh is what, comparisons with what was expected, coplanar faces, cavities, and reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import mesh, sequences, spatial
from .predicates import is_collision


def mesh_roles(meshes: DataFrame, entries: DataFrame, prefix: str = "COL_", leaf: str = "DoorLeaf") -> DataFrame:
    """meshes (name) with collision, leaf (render meshes that a collision entry names as its render mesh) and static (no leaf; a collision mesh without a render mesh).

    entries: name, collision or null, render_mesh or null. Without any entries names decide: those with ``prefix`` are for collision, those that match ``leaf`` are leaves.
    """
    e = entries.select(F.col("name").alias("of"), F.col("collision").alias("flag"), "render_mesh")
    known = entries.agg((F.count("*") > 0).alias("known"))  # one row
    paired = entries.where("collision AND render_mesh IS NOT NULL").select(F.col("render_mesh").alias("paired")).distinct()
    all_ = meshes.select("name").distinct().join(e, F.col("name") == F.col("of"), "left").join(paired, F.col("name") == F.col("paired"), "left").join(F.broadcast(known))
    collision = is_collision(F.col("flag"), F.col("name"), prefix)
    named = F.col("name").rlike(leaf)
    is_leaf = ~collision & F.when(F.col("known"), F.col("paired").isNotNull()).otherwise(named)
    static = F.when(collision, F.when(F.col("known"), F.col("render_mesh").isNull()).otherwise(~named)).otherwise(~is_leaf)
    return all_.select("name", collision.alias("collision"), is_leaf.alias("leaf"), static.alias("static"))


def markers_by_prefix(markers: DataFrame) -> DataFrame:
    """How many markers (name) start with each prefix, the text before the first "_" and that: a name without one starts with none."""
    prefix = F.concat(F.substring_index("name", "_", 1), F.lit("_"))
    return markers.groupBy(prefix.alias("prefix")).agg(F.count_if(F.contains("name", F.lit("_"))).alias("markers"))


def counted(names: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Prefixes with how many names start with them and how many were expected: prefix, found, expected, ok. One pass, whatever the number of prefixes."""
    counts = names.agg(*[F.count_if(F.col("name").startswith(p)).alias(f"n{i}") for i, p in enumerate(expected)])
    rows = F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(f"n{i}").alias("found"), F.lit(n).cast("long").alias("expected")) for i, (p, n) in enumerate(expected.items())])
    return counts.select(F.inline(rows)).withColumn("ok", F.col("found") == F.col("expected"))


def roundtrip(measured: DataFrame, expected: DataFrame, tol: float = 1e-4) -> DataFrame:
    """Per mesh name of either table its state, and of matches what differs.

    measured: name, x0 .. z1, triangles, uv_layers, materials, collision; expected: name, and the same but uv_layers and collision, null where nothing is expected.
    Materials and the second UV layer are asked of render meshes only.
    """
    ends = [f"{c}{e}" for c in "xyz" for e in "01"]
    m = measured.select(F.col("name").alias("m_name"), *[F.col(c).alias(f"m_{c}") for c in [*ends, "triangles", "uv_layers", "materials", "collision"]])
    both = m.join(expected, F.col("m_name") == F.col("name"), "full")
    matched = F.col("m_name").isNotNull() & F.col("name").isNotNull()
    state = F.when(F.col("m_name").isNull(), "missing").when(F.col("name").isNull(), "extra").otherwise("matched")
    off = F.when(matched, F.greatest(*[F.abs(F.col(f"m_{c}") - F.col(c)) for c in ends]))
    render = matched & ~F.col("m_collision")
    false = F.lit(False)
    return both.select(
        F.coalesce("m_name", "name").alias("name"), state.alias("state"), off.alias("bounds_error"), F.coalesce(off > tol, false).alias("bounds_differ"),
        F.coalesce(matched & (F.col("m_triangles") != F.col("triangles")), false).alias("triangles_differ"),
        F.coalesce(render & (F.col("m_uv_layers") < 2), false).alias("uv2_missing"), F.coalesce(render & (F.col("m_materials") != F.col("materials")), false).alias("materials_differ"),
    )


def roundtrip_passed(rows: DataFrame) -> DataFrame:
    """One row: passed, missing, extra and worst of roundtrip()."""
    bad = (F.col("state") != "matched") | F.col("bounds_differ") | F.col("triangles_differ") | F.col("uv2_missing") | F.col("materials_differ")
    return rows.agg(F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "extra").alias("extra"), F.max("bounds_error").alias("worst"), (F.count_if(bad) == 0).alias("passed"))


def second_uv(measured: DataFrame) -> DataFrame:
    """One row: render meshes, those with two UV layers or more, and passed: there are some, and all have."""
    render = measured.where(~F.col("collision"))
    return render.agg(F.count("*").alias("render"), F.count_if(F.col("uv_layers") >= 2).alias("two"), F.coalesce(F.every(F.coalesce(F.col("uv_layers") >= 2, F.lit(False))), F.lit(False)).alias("passed"))


def floor_height(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.min("floor_z"), F.lit(0.0)).alias("floor_z"))


def stacked(faces: DataFrame, pitch: float, copies: int = 2, axis: str = "z") -> DataFrame:
    """faces ``copies`` times, each ``pitch`` above the one before and named by its number: mesh becomes mesh(+k). faces: mesh, axis, offset, u0, u1, v0, v1 (u, v: the other two axes in order)."""
    k = faces.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    up = F.col("k") * pitch
    # The third axis is the offset of faces across it, and v of all others.
    moved = {"offset": F.col("offset") + F.when(F.col("axis") == axis, up).otherwise(0.0)} | {c: F.col(c) + F.when(F.col("axis") == axis, 0.0).otherwise(up) for c in ("v0", "v1")}
    return k.withColumns(moved).withColumn("mesh", F.when(F.col("k") == 0, F.col("mesh")).otherwise(F.concat("mesh", F.lit("(+"), F.col("k"), F.lit(")")))).drop("k")


#: Metres of offsets that are numbered together.
OFFSETS = 1.0


def with_planes(faces: DataFrame, gap: float) -> DataFrame:
    """faces (axis, facing, offset ...) with plane: which of the planes of their direction, in the order of offsets, that lie more than ``gap`` apart.

    Offsets are numbered in blocks; whether a block's first plane is the last of the block before is read
    off the blocks' ends, a row for each block.
    """
    key = ["axis", "facing"]
    f = faces.withColumn("block", F.floor(F.col("offset") / OFFSETS))
    w = Window.partitionBy(*key, "block").orderBy("offset")
    cut = F.when(F.col("offset") - F.lag("offset").over(w) > gap, 1).otherwise(0)
    f = f.withColumn("cut", cut).withColumn("plane", F.sum("cut").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    ends = f.groupBy(*key, "block").agg(F.min("offset").alias("first"), F.max("offset").alias("last"), F.sum("cut").alias("cuts"))
    along = Window.partitionBy(*key).orderBy("block")
    ends = ends.withColumn("new", F.col("cuts") + F.when(F.col("first") - F.lag("last").over(along) > gap, 1).otherwise(0))
    ends = ends.withColumn("before", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cuts")).select(*key, "block", "before")
    return f.join(ends, [*key, "block"]).withColumn("plane", F.col("plane") + F.col("before")).drop("cut", "block", "before")


def coplanar(faces: DataFrame, gap: float = 0.002, least: float = 1e-4, cell: float = 1.0) -> DataFrame:
    """Overlaps of rectangular faces that look the same way in one plane: axis, facing, plane (its number), a, b (mesh names, a <= b) and area over ``least``.

    faces: mesh, id (unique), axis, facing, offset, u0, u1, v0, v1. Offsets further apart than ``gap`` part planes. Two meshes' area is that of
    the union of their faces' overlaps; a mesh with itself has what its faces cover more than once.
    """
    placed = with_planes(faces, gap).drop("offset")
    key = F.concat_ws("/", "axis", F.col("facing").cast("string"), F.col("plane").cast("string"))
    boxes = placed.select(key.alias("plane_key"), F.struct("mesh", "id", "u0", "u1", "v0", "v1").alias("id"), F.col("u0").alias("x0"), F.col("u1").alias("x1"), F.col("v0").alias("y0"), F.col("v1").alias("y1"))
    met = spatial.box_pairs(boxes, boxes, cell=cell, by=["plane_key"]).where(F.col("a_id") < F.col("b_id"))
    over = met.select(
        F.struct("plane_key", F.least("a_id.mesh", "b_id.mesh").alias("a"), F.greatest("a_id.mesh", "b_id.mesh").alias("b")).alias("of"),
        F.greatest("a_id.u0", "b_id.u0").alias("x0"), F.least("a_id.u1", "b_id.u1").alias("x1"), F.greatest("a_id.v0", "b_id.v0").alias("y0"), F.least("a_id.v1", "b_id.v1").alias("y1"),
    ).where("x0 < x1 AND y0 < y1")
    between = spatial.rectangle_union_area(over.where("of.a <> of.b"), "of", 16 * cell).select("of.*", "area")
    own = over.where("of.a = of.b").select("of.plane_key", F.col("of.a").alias("a")).distinct()
    mine = boxes.select("plane_key", F.col("id.mesh").alias("a"), "x0", "x1", "y0", "y1").join(own, ["plane_key", "a"], "left_semi").withColumn("of", F.struct("plane_key", "a"))
    sums = mine.groupBy("of").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("sum"))
    within = sums.join(spatial.rectangle_union_area(mine.select("of", "x0", "x1", "y0", "y1"), "of", 16 * cell), "of").select("of.plane_key", "of.a", F.col("of.a").alias("b"), (F.col("sum") - F.col("area")).alias("area"))
    parts = F.split("plane_key", "/")
    found = between.unionByName(within).where(F.col("area") > least)
    return found.select(parts[0].alias("axis"), parts[1].cast("int").alias("facing"), parts[2].cast("long").alias("plane"), "a", "b", "area")


def coplanar_summary(pairs: DataFrame, k: int = 50) -> DataFrame:
    """The k largest overlaps, with the number and area of all."""
    total = pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("total_area"))
    return pairs.orderBy(F.desc("area"), "axis", "facing", "plane", "a", "b").limit(k).join(total)  # one row


def contacts(faces: DataFrame, step: float = 5e-4, cell: float = 1.0) -> DataFrame:
    """Area in which rectangular faces of two meshes in one plane (offsets to ``step``) touch: a, b, same (they look the same way) and area, number of pairs and area summed. Opposite faces of one mesh are its own thickness and don't count."""
    key = F.concat_ws("/", "axis", F.round(F.col("offset") / step).cast("long").cast("string"))
    boxes = faces.select(key.alias("plane_key"), F.struct("mesh", "id", "facing", "u0", "u1", "v0", "v1").alias("id"), F.col("u0").alias("x0"), F.col("u1").alias("x1"), F.col("v0").alias("y0"), F.col("v1").alias("y1"))
    met = spatial.box_pairs(boxes, boxes, cell=cell, by=["plane_key"]).where(F.struct("a_id.mesh", "a_id.id") < F.struct("b_id.mesh", "b_id.id"))
    same = F.col("a_id.facing") == F.col("b_id.facing")
    area = (F.least("a_id.u1", "b_id.u1") - F.greatest("a_id.u0", "b_id.u0")) * (F.least("a_id.v1", "b_id.v1") - F.greatest("a_id.v0", "b_id.v0"))
    rows = met.where(same | (F.col("a_id.mesh") != F.col("b_id.mesh"))).select(F.least("a_id.mesh", "b_id.mesh").alias("a"), F.greatest("a_id.mesh", "b_id.mesh").alias("b"), same.alias("same"), area.alias("area")).where("area > 0")
    return rows.groupBy("a", "b", "same").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


def crossings(points: DataFrame, tri_corners: DataFrame, cell: float = 1.0) -> DataFrame:
    """How many triangles a ray from each point (mesh, pid, x, y, z) along x meets: mesh, pid, hits, of triangles (mesh, island, ax .. cz) of its mesh but not of its own island.

    Points are moved a hair off y and z, so that rays pass beside edges; points and triangles meet by squares of y and z.
    """
    p = points.withColumn("y", F.col("y") + 1.3e-5).withColumn("z", F.col("z") + 2.7e-5).withColumn("i", F.floor(F.col("y") / cell)).withColumn("j", F.floor(F.col("z") / cell)).withColumnRenamed("island", "own")
    span = lambda c: F.sequence(F.floor(F.least(f"a{c}", f"b{c}", f"c{c}") / cell), F.floor(F.greatest(f"a{c}", f"b{c}", f"c{c}") / cell))
    t = tri_corners.select("mesh", "island", *[f"{k}{c}" for k in "abc" for c in "xyz"]).withColumn("i", F.explode(span("y"))).withColumn("j", F.explode(span("z")))
    met = p.join(t, ["mesh", "i", "j"]).where("island <> own")
    met = met.withColumn("d", F.expr("(`by` - ay) * (cz - az) - (bz - az) * (cy - ay)")).where(F.abs("d") > 1e-18)
    met = met.withColumn("wb", F.expr("((y - ay) * (cz - az) - (z - az) * (cy - ay)) / d")).withColumn("wc", F.expr("((`by` - ay) * (z - az) - (bz - az) * (y - ay)) / d"))
    ahead = met.where("wb >= 0 AND wc >= 0 AND wb + wc <= 1 AND ax + wb * (bx - ax) + wc * (cx - ax) > x")
    hits = ahead.groupBy("mesh", "pid").agg(F.count("*").alias("hits"))
    return points.select("mesh", "pid").join(hits, ["mesh", "pid"], "left").select("mesh", "pid", F.coalesce("hits", F.lit(0)).alias("hits"))


def island_classes(vertex: DataFrame, tri: DataFrame, cell: float = 1.0) -> DataFrame:
    """mesh.island_measures with class cavity for islands of negative volume of which a corner lies inside other islands of the mesh, by parity of a ray's crossings."""
    own = mesh.islands(vertex, tri)
    t = mesh.with_measures(mesh.corners(vertex, tri)).join(own.withColumnRenamed("vid", "a"), ["mesh", "a"])
    m = t.groupBy("mesh", "island").agg(F.count("*").alias("triangles"), F.sum("area").alias("area"), F.sum("volume").alias("volume"), F.min(F.least("az", "bz", "cz")).alias("zmin"), F.max(F.greatest("az", "bz", "cz")).alias("zmax"), F.min_by(F.struct("ax", "ay", "az"), "tid").alias("at"))
    flat = F.abs("volume") <= F.col("area") * 1e-6
    inward = m.where(~flat & (F.col("volume") < 0)).select("mesh", "island", F.col("island").alias("pid"), F.col("at.ax").alias("x"), F.col("at.ay").alias("y"), F.col("at.az").alias("z"))
    hits = crossings(inward, t, cell).select("mesh", F.col("pid").alias("island"), "hits")
    klass = F.when(flat, "flat").when(F.col("volume") >= 0, "solid").when(F.col("hits") % 2 == 1, "cavity").otherwise("inverted")
    return m.join(hits, ["mesh", "island"], "left").select("mesh", "island", "triangles", "area", "volume", "zmin", "zmax", klass.alias("class"))


def nearest_standing(points: DataFrame, places: DataFrame, step: float, radius: float) -> DataFrame:
    """For each point (id, x, y, z) the nearest place (pid, x, y, h) within ``radius`` whose height is within ``step`` of its own; ties to the smaller pid; null where there is none."""
    square = lambda c: F.sequence(F.floor((F.col(c) - radius) / radius), F.floor((F.col(c) + radius) / radius))
    p = points.select("id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz")).withColumn("i", F.explode(square("px"))).withColumn("j", F.explode(square("py")))
    o = places.select("pid", "x", "y", "h").withColumn("i", F.floor(F.col("x") / radius)).withColumn("j", F.floor(F.col("y") / radius))
    # Merged, not broadcast: places and points grow with the tables, and what Spark takes them for is their files' size.
    met = p.join(o.hint("merge"), ["i", "j"]).where(F.abs(F.col("h") - F.col("pz")) <= step + 1e-6).withColumn("distance", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).where(F.col("distance") <= radius)
    best = met.groupBy("id").agg(F.min(F.struct("distance", "pid")).alias("best"))
    return points.select("id").join(best.hint("merge"), "id", "left").select("id", "best.pid", "best.distance")


def seeds(markers: DataFrame, names: DataFrame) -> DataFrame:
    """names (name) with the marker of just that name (the first by position, of several): x, y, z, and error where there is none."""
    own = markers.groupBy("name").agg(F.min(F.struct("x", "y", "z")).alias("at"))
    return names.join(own, "name", "left").select("name", "at.x", "at.y", "at.z", F.when(F.col("at").isNull(), F.concat(F.lit("no marker "), "name")).alias("error"))


def without_rect(places: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Places outside a rectangle, edges included."""
    return places.where(~(F.col("x").between(min(x0, x1), max(x0, x1)) & F.col("y").between(min(y0, y1), max(y0, y1))))


def main_region(regions: DataFrame, floor_z: float = 0.0, near: float = 0.01) -> DataFrame:
    """The region (of places region, z) with most places at floor height; ties to the first. One row, or none."""
    counts = regions.where(F.abs(F.col("z") - floor_z) < near).groupBy("region").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "region").limit(1)


def rooms_reached(rooms: DataFrame, places: DataFrame, step: float, tol: float, skip: tuple[str, ...] = ("void",)) -> DataFrame:
    """Rooms (id, x, y, z, kind) with reachable: a place of the main region (places with main) stands within ``tol``; null for kinds that are skipped."""
    checked = rooms.where(~F.coalesce(F.col("kind").isin(*skip), F.lit(False)))
    near = nearest_standing(checked, places.where("main"), step, tol)
    return rooms.join(near.withColumnRenamed("id", "of").hint("merge"), F.col("id") == F.col("of"), "left").select("id", "kind", "distance", F.when(F.col("of").isNotNull(), F.col("pid").isNotNull()).alias("reachable"))


def reachability(rooms: DataFrame, doors: DataFrame, unbalanced: Column, links: DataFrame | None = None) -> DataFrame:
    """One row: unreachable rooms, required doors that no reachable cell stands in, and passed. rooms: of rooms_reached(); doors: required, reachable (cells); unbalanced: whether columns of the solid don't close; links: of storey_links(), then with unlinked, how many storeys the main part does not lead to."""
    r = rooms.agg(F.count_if(F.col("reachable") == F.lit(False)).alias("unreachable"), F.count("reachable").alias("checked"))
    d = doors.agg(F.count_if(F.col("required") & (F.col("reachable") == 0)).alias("blocked"))
    passed, both = (F.col("unreachable") == 0) & (F.col("blocked") == 0) & ~unbalanced, r.join(d)
    if links is not None:
        both, passed = both.join(links.agg(F.count_if(~F.col("linked")).alias("unlinked"))), passed & (F.col("unlinked") == 0)
    return both.withColumn("passed", passed)


def storeys(floors: DataFrame) -> DataFrame:
    """floors (building, ord, wall, slab) with z, and height, wall and slab together."""
    return sequences.elevations(floors, "building", "ord", "wall", "slab").withColumn("height", F.col("wall") + F.col("slab"))


def storey_links(cells: DataFrame, floor_z: float, pitch: float, stack: list[int], tol: float = 0.01) -> DataFrame:
    """A row for each storey of ``stack`` (1 above, -1 below, 0 is left out): storey, and linked: whether a cell (i, j, h, main) of the main part at its floor lies over or under one of the main part at ``floor_z``. Cells of null height or part link nothing."""
    main = cells.where("main AND h IS NOT NULL").select("i", "j", "h")
    base = main.where(F.abs(F.col("h") - floor_z) < tol).select("i", "j").distinct()
    storeys = [k for k in stack if k]
    # Which storeys a cell is at the floor of; they may be more than one where storeys are lower than tol.
    at = main.select("i", "j", F.explode(F.array(*[F.when(F.abs(F.col("h") - (floor_z + k * pitch)) < tol, F.lit(k)) for k in storeys] or [F.lit(None).cast("int")])).alias("storey")).where("storey IS NOT NULL")
    met = at.join(base, ["i", "j"], "left_semi").select("storey").distinct().withColumn("linked", F.lit(True))
    asked = cells.sparkSession.createDataFrame([(k,) for k in storeys], "storey int")
    return asked.join(met, "storey", "left").select("storey", F.coalesce("linked", F.lit(False)).alias("linked"))
