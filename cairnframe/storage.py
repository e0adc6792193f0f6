"""Tables written between steps, in the folder that driver and executors share, and rows dealt to as many tasks as they need."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a new local folder only where that is unset, as in tests."""
    return (spark.conf.get("spark.checkpoint.dir", None) or _own_folder()).rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again: later steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that stored() wrote, once nothing that is still to be computed reads them."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame, *keys: str, rows: int = 100_000, count: int | None = None) -> DataFrame:
    """df dealt by ``keys`` to parts of about ``rows`` rows, which are counted first unless ``count`` is given; windows and sums over them then need no other shuffle.

    Left to itself, Spark joins parts up to a size as written: points that compress well to a few dozen MB
    are millions of rows in one task's memory.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-(df.count() if count is None else count) // rows))
    return df.repartition(parts, *keys)
