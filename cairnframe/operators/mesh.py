"""Topology and measures of triangle meshes: vertex (mesh, vid, x, y, z) and tri (mesh, tid, a, b, c)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components

#: Areas below which a triangle counts as zero or nearly so.
ZERO, NEAR_ZERO = 1e-15, 1e-10


def corners(vertex: DataFrame, tri: DataFrame) -> DataFrame:
    """Triangles with their corners' coordinates, as doubles: ax .. cz."""
    v = vertex.select("mesh", "vid", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    out = tri
    for k in "abc":  # merged, not broadcast: there may be as many vertices as triangles
        out = out.join(v.select("mesh", F.col("vid").alias(k), *[F.col(c).alias(f"{k}{c}") for c in "xyz"]).hint("merge"), ["mesh", k])
    return out


def edges(tri: DataFrame) -> DataFrame:
    """Undirected edges u <= v of all triangles, one row per use, with ``forward``: whether the triangle runs from u to v. Degenerate edges stay."""
    ends = F.inline(F.array(*[F.struct(F.col(a).alias("p"), F.col(b).alias("q")) for a, b in ("ab", "bc", "ca")]))
    return tri.select("mesh", "tid", ends).select("mesh", "tid", F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"), (F.col("p") <= F.col("q")).alias("forward"))


def edge_stats(tri: DataFrame) -> DataFrame:
    """Per mesh: edges, and those not used twice (nonmanifold), once (boundary), over twice (overconnected)."""
    uses = edges(tri).groupBy("mesh", "u", "v").agg(F.count("*").alias("n"))
    return uses.groupBy("mesh").agg(F.count("*").alias("edges"), F.count_if(F.col("n") != 2).alias("nonmanifold"), F.count_if(F.col("n") == 1).alias("boundary"), F.count_if(F.col("n") > 2).alias("overconnected"))


def boundary_twins(tri: DataFrame) -> DataFrame:
    """Directed edges (p, q) without a triangle that runs along them the other way."""
    ends = F.inline(F.array(*[F.struct(F.col(a).alias("p"), F.col(b).alias("q")) for a, b in ("ab", "bc", "ca")]))
    half = tri.select("mesh", "tid", ends)
    twin = half.select("mesh", F.col("q").alias("p"), F.col("p").alias("q"))
    return half.join(twin, ["mesh", "p", "q"], "left_anti")


_CROSS = {
    "nx": "(by - ay) * (cz - az) - (bz - az) * (cy - ay)",
    "ny": "(bz - az) * (cx - ax) - (bx - ax) * (cz - az)",
    "nz": "(bx - ax) * (cy - ay) - (by - ay) * (cx - ax)",
}
_VOLUME = "(ax * (by * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by * cx)) / 6"


def with_measures(tri_corners: DataFrame) -> DataFrame:
    """corners() with area and signed volume of each triangle against the origin."""
    out = tri_corners.withColumns({k: F.expr(e) for k, e in _CROSS.items()})
    return out.withColumn("area", F.sqrt(F.expr("nx * nx + ny * ny + nz * nz")) / 2).withColumn("volume", F.expr(_VOLUME)).drop(*_CROSS)


def area_stats(tri_corners: DataFrame) -> DataFrame:
    """Per mesh: triangles, zero and nearly zero ones, the least area, total area and signed volume."""
    m = with_measures(tri_corners)
    return m.groupBy("mesh").agg(F.count("*").alias("triangles"), F.count_if(F.col("area") < ZERO).alias("zero"), F.count_if(F.col("area") < NEAR_ZERO).alias("near_zero"), F.min("area").alias("least_area"), F.sum("area").alias("area"), F.sum("volume").alias("volume"))


def islands(vertex: DataFrame, tri: DataFrame) -> DataFrame:
    """island of each vertex (mesh, vid): the smallest vid that triangles connect it with; vertices of no triangle are islands of their own."""
    key = lambda v: F.struct("mesh", F.col(v).alias("vid"))
    e = tri.select(key("a").alias("a"), key("b").alias("b")).unionByName(tri.select(key("b").alias("a"), key("c").alias("b")))
    label = components(e).select(F.col("node.mesh").alias("mesh"), F.col("node.vid").alias("vid"), F.col("label.vid").alias("island"))
    return vertex.select("mesh", "vid").join(label, ["mesh", "vid"], "left").select("mesh", "vid", F.coalesce("island", "vid").alias("island"))


def island_measures(vertex: DataFrame, tri: DataFrame) -> DataFrame:
    """Per (mesh, island) that has triangles: area, volume, and the z range of used vertices; class flat, solid or inverted."""
    own = islands(vertex, tri)
    t = with_measures(corners(vertex, tri)).join(own.withColumnRenamed("vid", "a"), ["mesh", "a"])
    m = t.groupBy("mesh", "island").agg(F.count("*").alias("triangles"), F.sum("area").alias("area"), F.sum("volume").alias("volume"), F.min(F.least("az", "bz", "cz")).alias("zmin"), F.max(F.greatest("az", "bz", "cz")).alias("zmax"))
    return m.withColumn("class", F.when(F.abs("volume") <= F.col("area") * 1e-6, "flat").when(F.col("volume") < 0, "inverted").otherwise("solid"))


def welded(vertex: DataFrame, tri: DataFrame, weld: float) -> DataFrame:
    """Triangles of all meshes as one, vertices at the same multiple of ``weld`` made one (the first by mesh and vid); triangles left with two equal corners go. ``mesh`` becomes ""."""
    keyed = vertex.select("mesh", "vid", *[F.rint(F.col(c).cast("double") / weld).cast("long").alias(f"k{c}") for c in "xyz"])
    first = keyed.groupBy("kx", "ky", "kz").agg(F.min(F.struct("mesh", "vid")).alias("w"))
    to = keyed.join(first, ["kx", "ky", "kz"]).select("mesh", "vid", "w")
    out = tri
    for k in "abc":
        out = out.join(to.select("mesh", F.col("vid").alias(k), F.col("w").alias(f"w{k}")), ["mesh", k])
    distinct = (F.col("wa") != F.col("wb")) & (F.col("wb") != F.col("wc")) & (F.col("wa") != F.col("wc"))
    return out.where(distinct).select(F.lit("").alias("mesh"), F.struct("mesh", "tid").alias("tid"), F.col("wa").alias("a"), F.col("wb").alias("b"), F.col("wc").alias("c"))


def bounds(vertex: DataFrame) -> DataFrame:
    return vertex.groupBy("mesh").agg(*[f(c).alias(f"{c}{n}") for c in "xyz" for f, n in ((F.min, "0"), (F.max, "1"))])


def plane_section(vertex: DataFrame, tri: DataFrame, z: float, eps: float = 1e-7) -> DataFrame:
    """Segments in which the plane at z cuts triangles: (mesh, tid, x0, y0, x1, y1).

    An edge is cut from its lower vertex id to its higher, so neighbours agree to the bit; vertices on the plane are lifted by eps; segments under 1e-9 go.
    """
    v = vertex.select("mesh", "vid", "x", "y", F.when(F.col("z") == z, F.col("z") + eps).otherwise(F.col("z")).cast("double").alias("z"))
    e = edges(tri)
    for k in "uv":
        e = e.join(v.select("mesh", F.col("vid").alias(k), *[F.col(c).cast("double").alias(f"{k}{c}") for c in "xyz"]), ["mesh", k])
    t = (F.lit(z) - F.col("uz")) / (F.col("vz") - F.col("uz"))
    hits = e.where((F.col("uz") < z) != (F.col("vz") < z)).select("mesh", "tid", (F.col("ux") + t * (F.col("vx") - F.col("ux"))).alias("x"), (F.col("uy") + t * (F.col("vy") - F.col("uy"))).alias("y"))
    pairs = hits.groupBy("mesh", "tid").agg(F.min(F.struct("x", "y")).alias("p"), F.max(F.struct("x", "y")).alias("q"), F.count("*").alias("n")).where("n = 2")
    length = F.sqrt(F.pow(F.col("q.x") - F.col("p.x"), 2) + F.pow(F.col("q.y") - F.col("p.y"), 2))
    return pairs.where(length >= 1e-9).select("mesh", "tid", F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.col("q.x").alias("x1"), F.col("q.y").alias("y1"))
