"""Reports of checks and surveys: as rows, as JSON, as a line and as an exit code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.operators.predicates import verdict


def quality_report(records: DataFrame, inputs: Column, generated_by: str, seconds: Column | None = None) -> DataFrame:
    """One row of records (name, passed, detail: a JSON text): generated_by, inputs, seconds, passed, summary, not_run and checks. A report has as many records as there are checks."""
    sums = records.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "passed")))).alias("summary"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "detail")))).alias("checks"),
    )
    one = verdict(records).join(sums)
    not_run = F.filter(F.split("not_run", ","), lambda x: x != "")
    return one.select(F.lit(generated_by).alias("generated_by"), inputs.alias("inputs"), F.round(F.lit(0.0) if seconds is None else seconds, 1).alias("seconds"), "passed", "summary", not_run.alias("not_run"), "checks")


def as_json(df: DataFrame) -> DataFrame:
    """Each row as JSON; nulls are written."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as JSON text in a folder of any file system Spark writes to."""
    as_json(report).coalesce(1).write.mode("overwrite").text(path)


def result_line(report: DataFrame) -> DataFrame:
    """The line by which other programs read a result."""
    return as_json(report.select("passed", "summary", "not_run")).select(F.concat(F.lit("QA_RESULT "), "value").alias("line"))


def exit_code(report: DataFrame) -> int:
    """0 if it passed, 1 if not, 2 if there is none."""
    found = report.select("passed").head(1)
    return 2 if not found else 0 if found[0].passed else 1


def validation(floors: DataFrame, problems: DataFrame) -> DataFrame:
    """Counts of floors (floor, doors, spaces, area) with their problems (floor, text): a row per floor and, with a null floor, the totals."""
    own = problems.groupBy("floor").agg(F.count("*").alias("problems"))
    rows = floors.join(own, "floor", "left").select("floor", "doors", "spaces", "area", F.coalesce("problems", F.lit(0)).alias("problems"))
    total = rows.agg(*[F.sum(c).alias(c) for c in ("doors", "spaces", "area", "problems")]).select(F.lit(None).cast(rows.schema["floor"].dataType).alias("floor"), "doors", "spaces", "area", "problems")
    return rows.unionByName(total)


def survey(evidence: DataFrame, bars: DataFrame, by: str) -> DataFrame:
    """What pages offer for their scale, per document: dims and area (units, or none), and evidence. evidence: by, pattern and count, of text_evidence(); bars: by and labelled."""
    text = evidence.groupBy(by, "pattern").agg(F.sum("count").alias("n")).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("pattern", "n"))).alias("n"))
    bar = bars.groupBy(by).agg(F.max("labelled").alias("bar"))
    has = lambda *names: F.coalesce(F.greatest(F.lit(0), *[F.coalesce(F.col("n")[x], F.lit(0)) for x in names]) > 0, F.lit(False))
    joined = text.join(bar, by, "full")
    named = lambda *pairs: F.coalesce(F.nullif(F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]), lambda x: x.isNotNull()), "+"), F.lit("")), F.lit("none"))
    return joined.select(
        by, named(("ft-in", has("ft_in", "ft_dims")), ("metric", has("metric_dims", "mm_dims"))).alias("dims"), named(("sq ft", has("sq_ft")), ("sq m", has("sq_m"))).alias("area"),
        named(("bar", F.coalesce("bar", F.lit(False))), ("dims", has("ft_dims", "metric_dims")), ("area", has("area_table", "sq_ft", "sq_m")), ("ceiling_height", has("ceiling_height"))).alias("evidence"),
    )


def tessellated(products: DataFrame) -> DataFrame:
    """One row of products (class, triangles; openings and spaces left out): count, failed (no triangles), by_class and passed: there are some and none failed."""
    solid = products.where(~F.col("class").isin("opening", "space"))
    per = solid.groupBy("class").agg(F.count("*").alias("n"), F.count_if(F.coalesce("triangles", F.lit(0)) <= 0).alias("bad"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.coalesce(F.sum("bad"), F.lit(0)).alias("failed"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "n")))).alias("by_class")).withColumn("passed", (F.col("count") > 0) & (F.col("failed") == 0))
