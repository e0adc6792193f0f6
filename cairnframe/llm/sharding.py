"""Extendible hashing: shards by hash prefix, of which only oversized ones split on another bit.

The directory starts as one bucket. A bucket over its byte limit splits on the next bit of the
hash, until all fit. Bytes are summed once per cell, a prefix of CELL_BITS bits; the buckets of
all depths up to that follow from the cells. Only cells that are too large themselves go on to the
next CELL_BITS bits, with their rows. Rows that agree in all bits, which no split parts, are
copies; their bucket is cut into pages, as many copies to each as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Bytes of a shard at most, in production.
LIMIT = 64 << 20
#: Bits that are summed at a time, and rounds of them: 48 bits in all.
CELL_BITS, ROUNDS = 16, 3


def hashed(*columns: Column) -> Column:
    """A 48-bit hash as a long: the first 12 hex digits of the MD5 of the columns, joined."""
    text = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x1e")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 2 * CELL_BITS * ROUNDS // 8), 16, 10).cast("long")


def _leaves(cells: DataFrame, limit: int, depth: int) -> DataFrame:
    """Of cells (parent, cell, bytes, n), the smallest depth at which the bucket around each fits; null where the cell alone is over the limit.

    Each cell adds to the buckets around it at every depth; these sums are partial before the shuffle.
    """
    levels = cells.select("parent", "cell", "bytes", "n", F.explode(F.sequence(F.lit(0), F.lit(CELL_BITS))).alias("bits"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, cast({CELL_BITS} - bits as int))"))
    sums = levels.groupBy("parent", "bits", "prefix").agg(F.sum("bytes").alias("bucket_bytes"), F.sum("n").alias("bucket_rows"))
    # A bucket that fits is a leaf if the one around it doesn't; the root of a later round never fits.
    around = sums.select(F.col("parent").alias("p"), (F.col("bits") + 1).alias("b"), F.col("prefix").alias("q"), F.col("bucket_bytes").alias("outer_bytes"))
    fits = F.col("bucket_bytes") <= limit
    joined = sums.where(fits if depth == 0 else fits & (F.col("bits") > 0)).join(around, (F.col("parent") == F.col("p")) & (F.col("bits") == F.col("b")) & (F.expr("shiftright(prefix, 1)") == F.col("q")), "left")
    return joined.where(F.col("outer_bytes").isNull() | (F.col("outer_bytes") > limit)).select("parent", "bits", "prefix", "bucket_bytes", "bucket_rows")


def shard(docs: DataFrame, key: list[str], size: Column, limit: int = LIMIT) -> DataFrame:
    """The rows of docs as a struct ``row``, with bytes, hash, depth (bits of the shard's prefix), shard (the prefix as bits, and "/page" for pages of copies), shard_bytes and shard_rows.

    key: columns that are hashed, nulls too. size: a row's bytes (null: 0). A row that is larger
    than the limit alone has a shard, or a page, of its own.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes"), hashed(*map(F.col, key)).alias("hash"))
    total_bits = CELL_BITS * ROUNDS
    open_rows = rows.select("hash", "bytes")
    leaves = None
    for turn in range(ROUNDS):
        low = total_bits - CELL_BITS * (turn + 1)
        parent, cell = F.shiftright("hash", low + CELL_BITS), F.shiftright("hash", low).bitwiseAND(F.lit((1 << CELL_BITS) - 1))
        cells = open_rows.groupBy(parent.alias("parent"), cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        cells = stored(cells, "cells")
        found = _leaves(cells, limit, turn * CELL_BITS).select((F.col("bits") + turn * CELL_BITS).alias("depth"), F.expr("shiftleft(parent, cast(bits as int)) | prefix").alias("prefix"), "bucket_bytes", "bucket_rows")
        leaves = found if leaves is None else leaves.unionByName(found)
        over = stored(cells.where(F.col("bytes") > limit).select(F.expr(f"shiftleft(parent, {CELL_BITS}) | cell").alias("wide")), "oversized-cells")
        if over.isEmpty():
            break
        if turn < ROUNDS - 1:
            open_rows = open_rows.join(over, F.shiftright("hash", low) == F.col("wide"), "left_semi")
        else:  # full hashes over the limit: copies
            leaves = leaves.unionByName(cells.join(over, F.expr(f"shiftleft(parent, {CELL_BITS}) | cell") == F.col("wide")).select(F.lit(total_bits).alias("depth"), F.col("wide").alias("prefix"), F.col("bytes").alias("bucket_bytes"), F.col("n").alias("bucket_rows")))
    leaves = stored(leaves.withColumnRenamed("bucket_bytes", "shard_bytes").withColumnRenamed("bucket_rows", "shard_rows"), "leaves")
    # Of the buckets around a row, one at each depth that occurs, exactly one is a leaf.
    depths = sorted(r.depth for r in leaves.select("depth").distinct().collect()) or [0]  # few of 0 to 48
    around = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.shiftright("hash", total_bits - d).alias("p")) for d in depths]))
    placed = rows.withColumn("x", around).join(leaves, (F.col("x.d") == F.col("depth")) & (F.col("x.p") == F.col("prefix"))).drop("x")
    name = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    placed = placed.withColumn("shard", name)
    if total_bits not in depths:
        return placed.select(*COLUMNS)
    fitting = (F.col("depth") < total_bits) | (F.col("shard_bytes") <= limit)
    return placed.where(fitting).select(*COLUMNS).unionByName(_paged(placed.where(~fitting), limit))


COLUMNS = ("row", "bytes", "hash", "depth", "shard", "shard_bytes", "shard_rows")


def _paged(copies: DataFrame, limit: int) -> DataFrame:
    """Rows of buckets that no bit splits, in pages: rows over half the limit each have one, others fill them to half the limit by their running bytes.

    The running sums are those within a partition of the stored rows, on top of the sums of the
    partitions before it, so that no task takes all rows of a bucket.
    """
    half = max(1, limit // 2)
    stay = stored(copies, "copies").withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    large = F.col("bytes") > half
    counted = F.when(large, 0).otherwise(F.col("bytes"))
    sums = stay.groupBy("shard", "part").agg(F.sum(counted).alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = stored(sums.select(F.col("shard").alias("s"), F.col("part").alias("q"), before.alias("base")), "bases")
    within = F.coalesce(F.sum(counted).over(Window.partitionBy("shard", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = stay.withColumn("within", within).join(bases, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("q")))
    page = F.when(large, F.concat(F.lit("own"), F.col("place"))).otherwise(F.floor((F.col("base") + F.col("within")) / half).cast("string"))
    paged = stored(at.withColumn("shard", F.concat("shard", F.lit("/"), page)).drop("shard_bytes", "shard_rows"), "pages")
    totals = paged.groupBy(F.col("shard").alias("s2")).agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return paged.join(totals, F.col("shard") == F.col("s2")).select(*COLUMNS)


def query(docs: DataFrame) -> DataFrame:
    found = shard(docs.select("doc_id", F.octet_length("text").alias("size")), ["doc_id"], F.col("size"))
    return found.select("row.doc_id", "bytes", "depth", "shard", "shard_bytes", "shard_rows")


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(30))), 1, 12) AS BIGINT) AS h
  FROM documents
), b AS (
  SELECT bits, h >> (48 - bits) AS prefix, sum(bytes) AS shard_bytes, count(*) AS shard_rows
  FROM d, generate_series(0, 48) AS g(bits) GROUP BY ALL
), fits AS (
  SELECT d.doc_id, d.bytes, d.h, b.bits, b.prefix, b.shard_bytes, b.shard_rows,
    row_number() OVER (PARTITION BY d.doc_id, d.h ORDER BY b.bits) AS n
  FROM d JOIN b ON d.h >> (48 - b.bits) = b.prefix WHERE b.shard_bytes <= {LIMIT}
)
SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, CAST(bits AS INTEGER) AS depth,
  CASE WHEN bits = 0 THEN '' ELSE lpad(bin(prefix), CAST(bits AS INTEGER), '0') END AS shard,
  CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows
FROM fits WHERE n = 1
"""
