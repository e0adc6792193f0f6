"""Approximate nearest neighbours: a small-world graph per shard, the shards' results merged.

Equal vectors are one point of a graph, so that a vector that many rows share neither breaks the
graph apart nor fills one shard; a point carries the smallest ids of its rows, as many as a result can
hold. A shard holds vectors of lengths within a factor of two, so that in none a long vector
swamps the others; its graph is one row of a stored index. Queries meet the shards in large blocks, for each of
which a shard is read and lifted once. What a graph
finds is ranked by inner products in double precision of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import hnsw
from .common import stored

#: Points of a shard, about: a part of its table in MOST_SHARDS, within these bounds; queries of a block, about, of which so many are searched for together; and the breadth of a search.
SHARD, LARGEST_SHARD, MOST_SHARDS, BLOCK, TOGETHER, EF = 8192, 131_072, 64, 32_768, 1024, 128
SALTS = 32


def usable(df: DataFrame, vector: str, dim: int | None) -> DataFrame:
    """Rows whose vector is there, of length ``dim`` (None: the commonest, ties to the shortest; others have no inner product with them), finite in every component, and not zero."""
    v = F.col(vector)
    if dim is None:
        top = df.where(v.isNotNull()).groupBy(F.size(v).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
        dim = top[0].dim if top else 0
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(v.isNotNull() & (F.size(v) == dim)).where(F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def points(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """A row per distinct vector: vector, and members, its k + 1 smallest ids in order (nulls take no part). Rows of one vector are first sifted in SALTS parts."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double") + 0.0).alias("vector"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("vector", "salt").orderBy("id"))).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("members"))


def _octave(vector: str) -> Column:
    """The power of two nearest to the length of a vector that is not zero, so that lengths about one power stay together."""
    largest = F.array_max(F.transform(vector, F.abs))
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + (x / largest) * (x / largest))
    return F.floor(F.log2(largest) + F.log2(squares) / 2 + 0.5).cast("int")


def index(found: DataFrame, shard_rows: int = SHARD, m: int = hnsw.M, ef: int = hnsw.EF_BUILD) -> DataFrame:
    """A row per shard of ``found`` (of points()): shard, its vectors, members and the graph's neighbour arrays by layer, as bytes."""
    found = stored(found.withColumn("octave", _octave("vector")), "points")
    sizes = found.groupBy("octave").agg(F.count("*").alias("n")).orderBy("octave").collect()  # as many as a double has exponents, at most
    rows = max(shard_rows, min(LARGEST_SHARD, sum(r.n for r in sizes) // MOST_SHARDS))
    parts, start = [], 0
    for r in sizes:
        parts.append((r.octave, start, max(1, -(-r.n // rows))))
        start += parts[-1][2]
    parts = found.sparkSession.createDataFrame(parts, "of int, start int, shards int")
    spread = F.xxhash64("vector")
    dealt = found.join(F.broadcast(parts), F.col("octave") == F.col("of"))
    dealt = dealt.select((F.col("start") + F.pmod(spread, F.col("shards"))).cast("int").alias("shard"), spread.alias("turn"), "vector", "members")

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("turn").combine_chunks()
        vectors = _matrix(table.column("vector").combine_chunks())
        graph = hnsw.build(vectors, m, ef)
        members = table.column("members").combine_chunks()
        row = [table.column("shard")[0].as_py(), vectors.shape[0], vectors.tobytes(), members.offsets.to_numpy().astype(np.int32).tobytes(), members.flatten().to_numpy().tobytes(), [x.tobytes() for x in graph.links], [x.shape[1] for x in graph.links]]
        return pa.table({f.name: pa.array([x], f.type) for f, x in zip(arrow, row, strict=True)})

    arrow = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("vectors", pa.binary()), ("ends", pa.binary()), ("members", pa.binary()), ("links", pa.list_(pa.binary())), ("widths", pa.list_(pa.int32()))])
    return stored(dealt.groupBy("shard").applyInArrow(one, "shard int, n int, vectors binary, ends binary, members binary, links array<binary>, widths array<int>"), "index")


def search(graphs: DataFrame, queries: DataFrame, k: int = 20, ef: int = EF) -> DataFrame:
    """query_id, rank (from 1), id and score (inner product) of the k rows nearest found to each query (id, vector), but for those of the query's own id.

    Ties go to the smaller id. Queries with a null id take no part; of queries with one id, each vector counts and a row its best score.
    """
    q = queries.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    q = stored(q.distinct(), "queries")
    blocks = max(1, -(-q.count() // BLOCK))
    shards = graphs.count()
    block = F.pmod(F.xxhash64("id", "vector"), F.lit(blocks))
    packed = q.groupBy(block.alias("block")).agg(F.collect_list(F.struct("id", "vector")).alias("queries"))  # BLOCK of them, about
    met = packed.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1))))).join(graphs, F.col("at") == F.col("shard")).drop("at", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                row = {name: batch.column(name)[r] for name in batch.schema.names}
                n = row["n"].as_py()
                vectors = np.frombuffer(row["vectors"].as_buffer(), float).reshape(n, -1)
                links = [np.frombuffer(x, np.int32).reshape(-1, w) for x, w in zip(row["links"].as_py(), row["widths"].as_py(), strict=True)]
                ends, members = np.frombuffer(row["ends"].as_buffer(), np.int32), np.frombuffer(row["members"].as_buffer(), np.int64)
                ends = ends - ends[0]
                all_ids = row["queries"].values.field("id").to_numpy()
                graph, every = hnsw.Graph(hnsw.lifted(vectors), links), _matrix(row["queries"].values.field("vector"))
                for start in range(0, len(all_ids), TOGETHER):
                    ids, wanted = all_ids[start : start + TOGETHER], every[start : start + TOGETHER]
                    found = hnsw.search(graph, wanted, min(n, max(ef, k + 1)))
                    which, col = np.nonzero(found >= 0)
                    point = found[which, col]
                    score = np.einsum("ij,ij->i", wanted[which], vectors[point])
                    order = np.lexsort((members[ends[point]], -score, which))
                    which, point, score = which[order], point[order], score[order]
                    first = np.searchsorted(which, which)  # the place of a query's best
                    near = np.arange(len(which)) - first <= k
                    which, point, score = which[near], point[near], score[near]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ends[point + 1] - ends[point])]).astype(np.int32)), pa.array(np.concatenate([members[ends[p] : ends[p + 1]] for p in point] or [members[:0]])))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[which]), pa.array(score), lists], names=["query_id", "score", "members"])

    hits = met.mapInArrow(run, "query_id long, score double, members array<long>")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("members")[0])
    nearest = hits.withColumn("n", F.dense_rank().over(by_score)).where(F.col("n") <= k + 1)
    rows = nearest.select("query_id", "score", F.explode("members").alias("id")).where(F.col("id") != F.col("query_id"))
    rows = rows.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    rows = usable(embeddings.select("vec_id", "embedding"), "embedding", None)
    graphs = index(points(rows, "vec_id", "embedding", 20))
    asked = rows.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search(graphs, asked).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
