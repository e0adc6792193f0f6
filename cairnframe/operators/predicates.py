"""Selections by name, property and kind, and the fold of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def selected(name: Column, patterns: str | None) -> Column:
    """Name matches any of comma-separated patterns, anywhere in it; all names without patterns."""
    if not patterns:
        return F.lit(True)
    found = F.lit(False)
    for p in patterns.split(","):
        found |= name.rlike(p)
    return found


def first_property(props: Column, *names: str) -> Column:
    """The first of the properties that is neither null nor empty."""
    return F.coalesce(*[F.nullif(props[n], F.lit("")) for n in names])


def required(props: Column, rules: dict[str, str]) -> Column:
    """Every property is among its "|"-separated values; one that is missing is the text None."""
    ok = F.lit(True)
    for name, values in rules.items():
        ok &= F.coalesce(props[name], F.lit("None")).isin(*values.split("|"))
    return ok


def is_collision(flag: Column, name: Column, prefix: str = "COL_") -> Column:
    return F.coalesce(flag, name.startswith(prefix))


def floor_of(names: DataFrame, floors: DataFrame) -> DataFrame:
    """names (name) with the longest floor (floor) that is the name or stands before "_" in it; null where none is.

    Every part of a name that could be a floor is a join key.
    """
    parts = F.split("name", "_")
    starts = names.withColumn("start", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "_"))))
    hits = starts.join(floors.select("floor").distinct(), F.col("start") == F.col("floor"), "left")
    return hits.groupBy("name").agg(F.max_by("floor", F.length("floor")).alias("floor"))


def verdict(records: DataFrame, *by: str) -> DataFrame:
    """A row per group of records (name, passed or null): passed is true if some ran and all those passed; not_run lists the rest."""
    return records.groupBy(*by).agg(
        (F.coalesce(F.every("passed"), F.lit(False)) & (F.count("passed") > 0)).alias("passed"),
        F.count("passed").alias("ran"),
        F.count_if(F.col("passed") == F.lit(False)).alias("failed"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("passed").isNull(), F.col("name")))), ",").alias("not_run"),
    )


def top(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
