import math

import pytest

from cairnframe.llm import mixing


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            target.update({s: level * w[s] for s in open_})
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_taken_words(spark):
    rows = [(i, ["b", "a", None, "Z", "é"][i % 5], "w " * (1 + (i * 7919) % (40 if i % 5 else 900)), 1) for i in range(3000)]
    rows += [(5000, "a", None, 1), (5001, "a", " \n", 1), (5002, "empty", "", 1), (6001, "a", "same row", 1), (6001, "a", "same row", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    got = mixing.query(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    by_id = {r[0]: r for r in rows}
    taken = {}
    for r in got:
        source = by_id[r.doc_id][1]
        assert r.source_size == sizes[source] and r.taken <= 2 * r.size
        assert r.target == pytest.approx(want[source], rel=1e-9, abs=1e-9)
        taken[source] = taken.get(source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 600)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.query(df).collect()), key=str)


def test_newton_finds_the_rate(spark):
    got = spark.createDataFrame([(100.0, 1.0), (100.0, 200.0), (7.0, 7.0), (5.0, 0.0), (0.0, 3.0), (1e9, 1.0)], "size double, target double").select("size", "target", mixing.tilt(mixing.F.col("size"), mixing.F.col("target")).alias("rate")).collect()
    for r in got:
        want = r.target / r["size"] if r["size"] and r.target else 0.0
        assert math.isclose(r.rate, want, rel_tol=1e-9)


def test_empty_table(spark):
    assert mixing.query(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
