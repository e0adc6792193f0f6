"""Scale evidence, profiles and alignment pairs from JSON, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.functions.measures import area_m2, axis_class, length_m

POINT = "ARRAY<DOUBLE>"
ITEMS = f"""image STRING, profile STRING, items ARRAY<STRUCT<kind: STRING, label: STRING, p0: {POINT}, p1: {POINT}, px: DOUBLE, length: STRING, box: ARRAY<INT>,
    polygon: ARRAY<{POINT}>, px_area: DOUBLE, area: STRING, m_per_pt: DOUBLE, px_per_pt: DOUBLE, tol: DOUBLE>>"""
PROFILE = """family STRING, title STRING, format STRING, sources ARRAY<STRING>, background_rgb ARRAY<INT>, background_tol INT,
    wall STRUCT<rgb: ARRAY<ARRAY<INT>>, tol: INT, dark_sum: INT>, render_dpi DOUBLE, units STRUCT<dims: STRING, area: STRING>,
    scale STRUCT<method: STRING, evidence: ARRAY<STRING>, notes: STRING>, page_layout STRING, quirks ARRAY<STRING>"""
PAIRS = f"x ARRAY<{POINT}>, y ARRAY<{POINT}>"
SIDECAR = "pdf STRING, page INT, dpi DOUBLE, px_per_pt DOUBLE, clip_pt ARRAY<DOUBLE>, page_size_pt ARRAY<DOUBLE>, rotation INT, size_px ARRAY<INT>, drop_text STRING, dropped_spans INT"


def read_json(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One row per file, with its path as ``source``."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("source", F.input_file_name())


def read_evidence(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row per item: case (the file), ord, kind, label, axis, px, m_per_px and tol, for scale_estimate(). Lengths and areas may be numbers or written out; what can't be read has a null m_per_px."""
    items = read_json(spark, path, ITEMS).select(F.col("source").alias("case"), F.posexplode("items").alias("ord", "i"))
    dx, dy = F.col("i.p1")[0] - F.col("i.p0")[0], F.col("i.p1")[1] - F.col("i.p0")[1]
    px = F.coalesce("i.px", F.sqrt(dx * dx + dy * dy))
    ring = F.col("i.polygon")
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    shoelace = F.abs(F.aggregate(F.zip_with(ring, after, lambda p, q: p[0] * q[1] - q[0] * p[1]), F.lit(0.0), lambda s, x: s + x)) / 2
    px_area = F.coalesce("i.px_area", F.when(F.size(ring) >= 3, shoelace))
    metres = F.when(F.col("i.kind") == "area", F.sqrt(area_m2(F.col("i.area")) / F.nullif(px_area, F.lit(0.0))))
    metres = metres.when(F.col("i.kind") == "pt", F.col("i.m_per_pt") / F.nullif(F.col("i.px_per_pt"), F.lit(0.0))).otherwise(length_m(F.col("i.length")) / F.nullif(px, F.lit(0.0)))
    return items.select("case", "ord", "i.kind", "i.label", F.when(dx.isNotNull(), axis_class(dx, dy)).alias("axis"), F.when(F.col("i.kind") == "area", F.sqrt(px_area)).otherwise(px).alias("px"), metres.alias("m_per_px"), "i.tol")


def read_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignment pairs as (case, axis, a, b)."""
    both = read_json(spark, path, PAIRS)
    one = lambda axis: both.select(F.col("source").alias("case"), F.lit(axis).alias("axis"), F.explode(axis).alias("p"))
    return one("x").unionByName(one("y")).select("case", "axis", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))


def first_there(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of the paths that exists, in any file system Spark reads."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return p
    return None


def read_profile(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """The profile of that name: the path as given, with .json, or either in ``folder``; the first that exists. No such profile is an error."""
    found = first_there(spark, [name, f"{name}.json", f"{folder}/{name}", f"{folder}/{name}.json"])
    if found is None:
        raise FileNotFoundError(f"no profile {name}")
    return read_json(spark, found, PROFILE)


def with_sidecars(images: DataFrame, sidecars: DataFrame) -> DataFrame:
    """images (path) with what the sidecar <path>.json says, nulls where there is none. sidecars: of read_json(.., SIDECAR)."""
    return images.join(sidecars.withColumn("path", F.regexp_replace("source", r"\.json$", "")).drop("source"), "path", "left")


SOURCE = "family STRING, image STRING, scale STRING, render STRUCT<page: INT, dpi: DOUBLE, clip: ARRAY<DOUBLE>, drop_text: STRING>, expect STRUCT<scale_passed: BOOLEAN>"


def read_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The cases of a suite, a folder each that holds a source.json: folder and what is in it."""
    found = read_json(spark, f"{folder}/*/source.json", SOURCE)
    return found.withColumn("folder", F.element_at(F.split("source", "/"), -2)).drop("source").orderBy("folder")


def bar_extents(boxes: DataFrame, mask: DataFrame) -> DataFrame:
    """px of each bar box (case, ord, x0, y0, x1, y1; ends exclusive): columns from the first to the last that holds a set pixel of mask (case, y, x). Null where none does."""
    from cairnframe.operators.spatial import box_pairs

    sides = ["x0", "y0", "x1", "y1"]
    own = boxes.select("case", F.struct("ord", *sides).alias("id"), *sides)
    pixels = mask.select("case", F.struct("x", "y").alias("id"), F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("y").alias("y0"), F.col("y").alias("y1"))
    inside = box_pairs(own, pixels, cell=16.0, by=["case"]).where((F.col("b_id.x") < F.col("a_id.x1")) & (F.col("b_id.y") < F.col("a_id.y1")))
    spans = inside.groupBy("case", F.col("a_id.ord").alias("ord")).agg((F.max("b_id.x") - F.min("b_id.x") + 1).cast("double").alias("px"))
    return boxes.join(spans, ["case", "ord"], "left").select("case", "ord", "px")


def without_text(spans: DataFrame, pattern: str) -> DataFrame:
    """Text spans (text) that don't match the pattern anywhere; null texts stay."""
    return spans.where(~F.coalesce(F.col("text").rlike(pattern), F.lit(False)))


def trace_rows(own: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows of a trace table in its floor's frame, then those given on the reference drawing, with frame floor or reference. Columns that only one has are null in the other."""
    return own.withColumn("frame", F.lit("floor")).unionByName(reference.withColumn("frame", F.lit("reference")), allowMissingColumns=True)


def points_of(json_text: Column) -> Column:
    """An array of points from a JSON property such as hinges or slide offsets; null where it is none."""
    return F.from_json(json_text, "array<array<double>>")


def wall_rule(profile_rgb: Column, profile_tol: Column, profile_dark: Column, rgb: Column, tol: Column, dark: Column) -> Column:
    """The rule for walls of a profile (colours, tolerance, dark sum), over which values given by hand go: colours by hand take the profile's dark sum away. Colours without a tolerance have 24; without any rule, sums under 300 are walls."""
    colours = F.coalesce(rgb, profile_rgb)
    tolerance = F.coalesce(tol, profile_tol)
    sum_ = F.coalesce(dark, F.when(rgb.isNull(), profile_dark))
    nothing = colours.isNull() & tolerance.isNull() & sum_.isNull()
    return F.struct(colours.alias("rgb"), F.when(colours.isNotNull(), F.coalesce(tolerance, F.lit(24))).otherwise(tolerance).alias("tol"), F.when(nothing, 300).otherwise(sum_).alias("dark_sum"))
