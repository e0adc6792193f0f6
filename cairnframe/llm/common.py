"""What the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.storage import discard, shared_dir, stored

__all__ = ["discard", "shared_dir", "sifted", "slices", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Cells of the coarse filter, a bit each: a broadcast of at most CELLS / 64 words, whatever the input's size.
CELLS = 1 << 22


def sifted(rows: DataFrame, value: Column, wanted: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """rows in two parts: those whose ``value`` (long) may be one of wanted's column ``name``, and those where it is none, which need no join."""
    cell = F.pmod(F.col(name), F.lit(CELLS))
    words = wanted.select((cell / 64).cast("int").alias("word"), F.pmod(cell, F.lit(64)).cast("int").alias("bit"))
    words = stored(words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")), "cells")
    at = F.pmod(value, F.lit(CELLS))
    found = rows.withColumn("cell_word", (at / 64).cast("int")).withColumn("cell_bit", F.pmod(at, F.lit(64)).cast("int"))
    found = found.join(F.broadcast(words), F.col("cell_word") == F.col("word"), "left").withColumn("there", F.coalesce(F.expr("getbit(bits, cell_bit) = 1"), F.lit(False)))
    return found.where("there").select(rows.columns), found.where("NOT there").select(rows.columns)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows, so that long texts are Python objects only a few at a time."""
    for whole in batches:
        for start in range(0, len(whole), rows):
            yield whole.slice(start, rows)
