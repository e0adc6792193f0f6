import hashlib

from pyspark.sql import functions as F

from cairnframe.llm import sharding


def h(key):
    return int(hashlib.md5((str(key) if key is not None else "\x1e").encode()).hexdigest()[:12], 16)


def check(spark, rows, limit):
    df = spark.createDataFrame([(i, n, "x", 0) for i, n in rows], "doc_id long, size long, shard string, hash int")
    got = sharding.shard(df, ["doc_id"], F.col("size"), limit).collect()
    assert len(got) == len(rows)
    shards: dict = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    for name, inside in shards.items():
        total = sum(r.bytes for r in inside)
        assert total == inside[0].shard_bytes and len(inside) == inside[0].shard_rows
        assert total <= limit or len(inside) == 1
        assert all(format(h(r.row.doc_id), "048b").startswith(name.split("/")[0]) for r in inside)
        if name and "/" not in name:  # what it was split from did not fit
            outer = sum(n or 0 for i, n in rows if format(h(i), "048b").startswith(name[:-1]))
            assert outer > limit
    return shards


def test_shards_fit_and_split_only_where_needed(spark):
    rows = [(i, 10 + i % 90) for i in range(2000)] + [(None, 5), (5000, None), (5001, 0)]
    assert len(check(spark, rows, 4000)) > 20
    assert list(check(spark, rows, 10**9)) == [""]


def test_copies_and_large_rows(spark):
    check(spark, [(i, 10) for i in range(200)] + [(7, 10)] * 300 + [(8, 999)] + [(9, 5000)] * 3, 600)


def test_deep_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_BITS", 2)  # cells of two bits: rounds of splitting cells
    monkeypatch.setattr(sharding, "ROUNDS", 24)
    check(spark, [(i, 50) for i in range(100)], 200)


def test_empty_table(spark):
    assert sharding.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0
