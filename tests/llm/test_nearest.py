import numpy as np
import pytest

from cairnframe.llm import ann, hnsw


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 20 == 0:
            near = sorted(((-float(v @ w), i) for i, w in good if i != q))
            out[q] = [i for _, i in near[:k]]
    return out


def run(spark, rows, k=20, schema="vec_id long, embedding array<float>"):
    rows = [(i, v and [x if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, schema)
    usable = ann.usable(df, "embedding", None)
    asked = usable.where("vec_id % 20 = 0").selectExpr("vec_id AS id", "embedding AS vector")
    found = ann.search(ann.index(ann.points(usable, "vec_id", "embedding", k), shard_rows=40), asked, k).orderBy("query_id", "rank").collect()
    out = {}
    for r in found:
        out.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    return out


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(60)]
    rows += [(100, None), (101, [0.0] * 4), (102, [float("nan"), 1, 1, 1]), (103, [float("inf"), 1, 1, 1]), (104, [1.0, None, 1, 1]), (120, [1.0, 2.0]), (None, [1.0, 1, 1, 1])]
    rows += [(200 + i, [1.0, 2.0, 0.0, 1.0]) for i in range(50)]  # one vector, many rows; ties go to the smaller id
    got, want = run(spark, rows), brute(rows, 20)
    assert set(got) == set(want)
    for q in want:
        assert [r for r, _, _ in got[q]] == list(range(1, len(want[q]) + 1))
        assert [i for _, i, _ in got[q]] == want[q]


@pytest.mark.parametrize("norms", ["even", "spread", "outlier", "huge"])
def test_recall_whatever_the_lengths(spark, norms):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    length = {"even": np.ones(3000), "spread": 10.0 ** rng.uniform(-3, 3, 3000), "outlier": np.where(np.arange(3000) == 7, 1e6, 1.0), "huge": np.where(np.arange(3000) % 2 == 0, 1e30, 1e25)}[norms]
    v *= length[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.query(df).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = []
    for q in range(0, 3000, 20):
        true = v @ v[q]
        true[q] = -np.inf
        got = sorted(found[q])
        assert len(got) == 20 and all(abs(score - true[i]) <= 1e-12 * abs(v[q]) @ abs(v[i]) for _, i, score in got)
        hits.append(len({i for _, i, _ in got} & set(np.argsort(-true, kind="stable")[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.95


def test_columns_of_the_operators_own_names(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)], "x", "y") for i in range(45)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string, octave string")
    assert ann.query(df).count() == 3 * 20


def test_fewer_candidates_than_asked_for_and_none(spark):
    assert [i for _, i, _ in run(spark, [(0, [1.0, 0, 0, 0]), (1, [1.0, 0, 0, 0]), (2, [0.0, 1, 0, 0])])[0]] == [1, 2]
    assert run(spark, []) == {}


def test_repeated_row_counts_once(spark):
    got = run(spark, [(0, [1.0, 0, 0, 1]), (0, [1.0, 0, 0, 1]), (5, [1.0, 1, 0, 0]), (5, [1.0, 1, 0, 0])])
    assert [i for _, i, _ in got[0]] == [5]


def test_recall_of_a_graph():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(2000, 32))
    graph = hnsw.build(v)
    found = hnsw.search(graph, v[:200], 128)[:, :10]
    true = np.argsort(-(v[:200] @ v.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, true, strict=True)]) > 0.95
    assert all(x.dtype == np.int32 for x in graph.links)


def test_blocks_of_queries_do_not_change_what_is_found(spark, monkeypatch):
    vectors = np.random.default_rng(9).normal(size=(300, 6))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, ann.query(df).collect()))
    monkeypatch.setattr(ann, "BLOCK", 6)
    monkeypatch.setattr(ann, "TOGETHER", 4)
    assert sorted(map(tuple, ann.query(df).collect())) == whole and len(whole) == 15 * 20
