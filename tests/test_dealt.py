"""Rows in one task: parts follow the rows, not their size as written."""

from pyspark.sql import functions as F

from cairnframe.operators import fills
from cairnframe.plans import registry
from cairnframe.storage import dealt


def squares(spark, n):
    corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0))])
    return spark.range(n).select(F.col("id").alias("shape"), F.lit(0).alias("ring"), F.posexplode(corners).alias("ord", "p")).select("shape", "ring", "ord", "p.x", "p.y")


def shares(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_parts_follow_rows(spark):
    assert len(shares(dealt(squares(spark, 1000), "shape", rows=250))) == 16
    assert dealt(squares(spark, 0), "shape").count() == 0


def test_runs_keep_to_small_parts(spark):
    rings = squares(spark, 300_000)  # 1.2 million points, a few MB as written
    runs = fills.filled(rings, ["shape"])
    assert runs.count() == 900_000 and max(shares(runs)) < 120_000


def parts_of(spark, tmp_path, n=400):
    spark.range(1, n + 1).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size", "'b' AS p_brand").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_corners_of_one_small_file_go_to_all_cores(spark, tmp_path):
    pieces = registry.QUERIES["ring_pieces"](spark, parts_of(spark, tmp_path))
    assert len(shares(pieces)) >= 4 and pieces.select("id").distinct().count() == 400


def test_doors_and_obstacles_are_not_broadcast(spark, tmp_path):
    swing = registry.QUERIES["door_swing"](spark, parts_of(spark, tmp_path))
    assert swing.count() > 100 and "Broadcast" not in swing._jdf.queryExecution().executedPlan().toString()


def test_lines_of_one_small_file_go_to_all_cores_and_are_not_broadcast(spark, tmp_path):
    jogs = registry.QUERIES["pair_jogs"](spark, parts_of(spark, tmp_path))
    plan = jogs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "hashpartitioning(id" in plan and "SortMergeJoin" in plan
    assert len(plan.split("SortMergeJoin")[1].split("\n")[0]) < 250  # only which line is longer is asked within the join
    assert jogs.count() == jogs.select("a", "b").distinct().count() > 100
