"""Triangles of any direction that lie on one another: directions by cells of the sphere, overlaps by clipping.

A triangle's direction is that of its normal; those without area, or with null corners, have none and take
no part. Triangles meet where their directions lie in neighbouring cells of a grid about the
unit sphere and their boxes come near; the area that two share is measured in the plane of the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnframe.storage import stored

from .spatial import box_pairs

_CORNERS = [f"{p}{x}" for p in "abc" for x in "xyz"]


def _with_normals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = np.stack([batch.column(name).to_numpy(zero_copy_only=False).astype(float) for name in _CORNERS], 1).reshape(-1, 3, 3)  # null is not a number
        with np.errstate(invalid="ignore", over="ignore"):
            n = np.cross(c[:, 1] - c[:, 0], c[:, 2] - c[:, 0])
            size = np.sqrt(_dot(n, n))
        good = size > 1e-12
        n = n[good] / size[good, None]
        yield pa.RecordBatch.from_arrays([*batch.filter(pa.array(good)).columns, *map(pa.array, n.T.copy())], [*batch.schema.names, "nx", "ny", "nz"])


def normals(tris: DataFrame) -> DataFrame:
    """Triangles (ax, ay, az .. cz) that have area, with the unit normal nx, ny, nz."""
    # A batch at a time: as column expressions, each of which repeats the ones before, compiling took longer than the work.
    return tris.mapInArrow(_with_normals, T.StructType([*tris.schema, *[T.StructField(f"n{x}", T.DoubleType()) for x in "xyz"]]))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(-1)


def _follows(n: np.ndarray, width: int) -> np.ndarray:
    """For each row's n corners the place of the next one, of the last one 0."""
    at = np.arange(1, width + 1)
    return np.where(at < n[:, None], at, 0)


def clipped_areas(poly: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Area that each convex polygon (row, corner, x and y) shares with its anticlockwise triangle: all rows are cut by one side after the other."""
    n = np.full(len(poly), poly.shape[1])  # corners that are left; those behind them are filling
    for i in range(3):
        a, b = by[:, None, i], by[:, None, (i + 1) % 3]
        width = poly.shape[1]
        there, nxt = np.arange(width) < n[:, None], _follows(n, width)
        side = (b - a)[..., 0] * (poly - a)[..., 1] - (b - a)[..., 1] * (poly - a)[..., 0]
        other, to = np.take_along_axis(side, nxt, 1), np.take_along_axis(poly, nxt[..., None], 1)
        keep, crosses = there & (side >= 0), there & ((side >= 0) != (other >= 0))
        t = np.divide(side, side - other, out=np.zeros_like(side), where=crosses)
        both = np.stack([poly, poly + t[..., None] * (to - poly)], 2).reshape(len(poly), 2 * width, 2)
        kept = np.stack([keep, crosses], 2).reshape(len(poly), 2 * width)
        n = kept.sum(1)
        first = np.argsort(~kept, axis=1, kind="stable")[:, : max(1, n.max(initial=0))]
        poly = np.take_along_axis(both, first[..., None], 1)
    nxt = _follows(n, poly.shape[1])
    to = np.take_along_axis(poly, nxt[..., None], 1)
    cross = poly[..., 0] * to[..., 1] - to[..., 0] * poly[..., 1]
    return np.abs(np.where(np.arange(poly.shape[1]) < n[:, None], cross, 0.0).sum(1)) / 2


def _shared(degrees: float, gap: float):
    """From pairs of triangles (structs of id, corners and normal) a, b and area of those that look the same way and lie on one another."""
    limit = math.cos(math.radians(degrees))

    def areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, *of_a), (b, *of_b) = (c.flatten() for c in batch.columns)
            p, q = (np.stack([c.to_numpy(zero_copy_only=False) for c in of], 1).reshape(-1, 4, 3) for of in (of_a, of_b))
            p, q, n, m = p[:, :3], q[:, :3], p[:, 3], q[:, 3]
            meet = (_dot(n, m) >= limit) & (np.abs(_dot(q - p[:, :1], n[:, None])).max(1) <= gap)
            p, q, n = p[meet], q[meet], n[meet]
            start, along = p[:, :1], p[:, 1] - p[:, 0]
            u = along / np.sqrt(_dot(along, along))[:, None]
            w = np.cross(n, u)
            flat = lambda of: np.stack([_dot(of - start, u[:, None]), _dot(of - start, w[:, None])], -1)  # noqa: B023, E731
            keep = pa.array(meet)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep), pa.array(clipped_areas(flat(q), flat(p)))], ["a", "b", "area"])

    return areas


def tilted(tris: DataFrame, degrees: float = 1.0) -> DataFrame:
    """Those of normals() that are further than ``degrees`` from every axis."""
    return tris.where(F.greatest(*[F.abs(f"n{x}") for x in "xyz"]) < math.cos(math.radians(degrees)))


def overlaps(tris: DataFrame, degrees: float = 1.0, gap: float = 0.002, cell: float = 1.0) -> DataFrame:
    """a, b (ids, a before b) and area of triangles (mesh, id: unique, ax .. cz, nx, ny, nz) that look the same way to ``degrees`` and lie on one another: all corners of b within ``gap`` of a's plane."""
    grid = 2 * math.sin(math.radians(degrees) / 2) * 1.0001  # as far apart as two such directions can be
    own = [F.floor(F.col(f"n{x}") / grid).alias(f"g{x}") for x in "xyz"]
    box = [f((*[F.col(f"{p}{x}") for p in "abc"],)).alias(f"{x}{e}") for x in "xyz" for e, f in (("0", lambda c: F.least(*c)), ("1", lambda c: F.greatest(*c)))]
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    # What is asked of a pair goes along with its ids: looked up afterwards, the triangles would be a table to send to all.
    # Written first, the normals are worked out once for both sides.
    right = stored(tris.select(F.struct("id", *_CORNERS, "nx", "ny", "nz").alias("id"), *own, *box), "facing")
    left = right
    for x in "xyz":
        left = left.withColumn("step", F.explode(near)).withColumn(f"g{x}", F.col(f"g{x}") + F.col("step")).drop("step")
    cells = right.select("gx", "gy", "gz").distinct()  # as many as cover a sphere, at most
    left = left.join(F.broadcast(cells), ["gx", "gy", "gz"], "left_semi")
    met = box_pairs(left, right, axes="xyz", cell=cell, slack=gap, by=["gx", "gy", "gz"]).where("a_id.id < b_id.id")
    kind = T.StructType([T.StructField("a", tris.schema["id"].dataType), T.StructField("b", tris.schema["id"].dataType), T.StructField("area", T.DoubleType())])
    return met.select("a_id", "b_id").mapInArrow(_shared(degrees, gap), kind)


def tilted_pairs(tris: DataFrame, degrees: float = 1.0, gap: float = 0.002, least: float = 1e-4, cell: float = 1.0) -> DataFrame:
    """Meshes (a <= b) of triangles (mesh, id, ax .. cz) that are not along an axis, and the area in which they lie on one another, where over ``least``; a mesh with itself too."""
    t = tilted(normals(tris), degrees).withColumn("id", F.struct("mesh", "id"))
    found = overlaps(t, degrees, gap, cell).where("area > 1e-9")
    sums = found.groupBy(F.least("a.mesh", "b.mesh").alias("a"), F.greatest("a.mesh", "b.mesh").alias("b")).agg(F.sum("area").alias("area"))
    return sums.where(F.col("area") > least)
