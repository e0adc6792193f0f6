"""Triangle meshes and their manifests from files, as vertex and tri tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = """schema STRUCT<version: INT>, files ARRAY<STRUCT<floor: STRING, path: STRING, floor_z_m: DOUBLE, storey_pitch_m: DOUBLE,
    meshes: ARRAY<STRUCT<name: STRING, collision: BOOLEAN, materials: ARRAY<STRING>, triangles: INT, bounds_m: ARRAY<ARRAY<DOUBLE>>, pivot_m: ARRAY<DOUBLE>, properties: MAP<STRING, STRING>>>,
    markers: ARRAY<STRUCT<name: STRING, position_m: ARRAY<DOUBLE>, rotation_euler_rad: ARRAY<DOUBLE>, properties: MAP<STRING, STRING>>>>>,
    materials ARRAY<STRUCT<name: STRING, base_color_rgba: ARRAY<DOUBLE>>>"""


def read_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row per file that the manifests list: floor, path, floor_z_m, storey_pitch_m, meshes, markers."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.inline("files"))


def mesh_entries(manifest: DataFrame) -> DataFrame:
    return manifest.select("floor", F.inline("meshes"))


def markers(manifest: DataFrame, prefix: str = "") -> DataFrame:
    return manifest.select("floor", F.inline("markers")).where(F.col("name").startswith(prefix))


def restricted(manifest: DataFrame, files: list[str]) -> DataFrame:
    """Only the files named, by base name in any case; all of them if none of those is listed."""
    base = F.lower(F.substring_index(F.replace("path", F.lit("\\"), F.lit("/")), "/", -1))
    named = base.isin([f.replace("\\", "/").rsplit("/", 1)[-1].lower() for f in files])
    some = manifest.agg(F.coalesce(F.max(named), F.lit(False)).alias("some")).first().some
    return manifest.where(named) if some else manifest


def read_obj(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """vertex and tri tables of OBJ files, a mesh per file: "v" and "f" lines, faces of more corners as fans, indices from 1 (or from the end, if negative) with or without /texture/normal."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("mesh"), "value")
    lines = whole.select("mesh", F.filter(F.split("value", "\r?\n"), lambda x: x.startswith("v ")).alias("v"), F.filter(F.split("value", "\r?\n"), lambda x: x.startswith("f ")).alias("f"))
    number = lambda line: F.split(F.trim(line), r"\s+")
    v = lines.select("mesh", F.posexplode("v").alias("vid", "line"))
    vertex = v.select("mesh", F.col("vid").cast("long").alias("vid"), *[number("line")[i + 1].cast("float").alias(c) for i, c in enumerate("xyz")])
    f = lines.select("mesh", F.size("v").alias("n"), F.posexplode("f").alias("face", "line"))
    index = F.transform(F.slice(number("line"), F.lit(2), F.size(number("line"))), lambda x: F.split(x, "/")[0].cast("long"))
    corners = f.select("mesh", "face", F.transform(index, lambda i: F.when(i < 0, F.col("n") + i).otherwise(i - 1)).alias("at"))
    fans = corners.where(F.size("at") >= 3).select("mesh", "face", "at", F.explode(F.sequence(F.lit(2), F.size("at") - 1)).alias("k"))
    tri = fans.select("mesh", (F.shiftleft(F.col("face").cast("long"), 32) + F.col("k")).alias("tid"), F.col("at")[0].alias("a"), F.element_at("at", F.col("k")).alias("b"), F.element_at("at", F.col("k") + 1).alias("c"))
    return vertex, tri


def read_npz(spark: SparkSession, path: str | list[str], label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """vertex and tri tables of NPZ files, a mesh per file: arrays vertices or V, triangles, faces or F; of those that have labels, only triangles whose own holds ``label``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(kind: tuple[str, ...], make):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    with np.load(io.BytesIO(content)) as arrays:
                        found = next(arrays[k] for k in kind if k in arrays)
                        named = arrays["labels"].astype(str) if label and "labels" in arrays else None
                    yield make(name, found, named)

        return run

    def vertices(name: str, a: np.ndarray, _: np.ndarray | None) -> pa.RecordBatch:
        a = a.astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(a), pa.string()), pa.array(np.arange(len(a))), *[pa.array(a[:, i]) for i in range(3)]], names=["mesh", "vid", "x", "y", "z"])

    def triangles(name: str, a: np.ndarray, named: np.ndarray | None) -> pa.RecordBatch:
        a = a.astype(np.int64)
        if named is not None:
            a = a[[label in x for x in named]]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(a), pa.string()), pa.array(np.arange(len(a))), *[pa.array(a[:, i]) for i in range(3)]], names=["mesh", "tid", "a", "b", "c"])

    return files.mapInArrow(rows(("vertices", "V"), vertices), "mesh string, vid long, x float, y float, z float"), files.mapInArrow(rows(("triangles", "faces", "F"), triangles), "mesh string, tid long, a long, b long, c long")


def placed_markers(manifest: DataFrame | None, objects: DataFrame, prefixes: tuple[str, ...] = ("DOOR_", "ROOM_", "STAIR_", "OPEN_")) -> DataFrame:
    """Markers (name, x, y, z, yaw, properties, origin) of a manifest or, without one, of empties among objects (name, type, x, y, z, yaw, properties) whose names start with a prefix."""
    if manifest is None:
        starts = F.lit(False)
        for p in prefixes:
            starts |= F.col("name").startswith(p)
        return objects.where((F.col("type") == "EMPTY") & starts).select("name", "x", "y", "z", "yaw", "properties", F.lit("empty").alias("origin"))
    at = lambda c, i: F.coalesce(F.get(c, F.lit(i)), F.lit(0.0))
    return markers(manifest).select("name", *[at("position_m", i).alias(c) for i, c in enumerate("xyz")], at("rotation_euler_rad", 2).alias("yaw"), F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"), F.lit("manifest").alias("origin"))


def in_world(vertex: DataFrame, placed: DataFrame) -> DataFrame:
    """Vertices in world space: placed has the mesh's matrix as m, three rows of four; a mesh that isn't placed stays as it is."""
    both = vertex.join(placed, "mesh", "left")
    row = lambda i, c: F.when(F.col("m").isNull(), F.col(c)).otherwise(sum((F.col("m")[i][k] * F.col(v) for k, v in enumerate("xyz")), F.col("m")[i][3]))
    return both.select("mesh", "vid", *[row(i, c).alias(c) for i, c in enumerate("xyz")])
