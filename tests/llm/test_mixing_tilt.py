import math

import numpy as np
import pytest

from cairnframe.llm import mixing

#: Few and many documents, of 1 to 20,000 words, on both sides of powers of two and of any block.
SIZES = {
    "a": [1 + i * i % 240 for i in range(300)] + [250, 255, 256, 257, 258, 300, 511, 512, 513, 5000, 20_000],
    "b": [1 + i % 50 for i in range(2000)],
    "c": [20_000, 3, 1],
    "d": [1 + (i * 7919) % 20_000 for i in range(15)] + [2] * 40,
    None: [5 + i % 200 for i in range(300)],
}


def newton(sizes, target, most=2.0):
    """The tilt per word that gives target words, by plain bisection."""
    sizes = np.array(sizes, float)
    lo, hi = -1000.0 / sizes.min(), math.log(most) / sizes.min()
    for _ in range(300):
        mid = (lo + hi) / 2
        taken = (sizes * np.exp(np.minimum(math.log(most), mid * sizes))).sum()
        lo, hi = (mid, hi) if taken < target else (lo, mid)
    return (lo + hi) / 2


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, s, "w " * n) for s, of in SIZES.items() for i, n in enumerate(of)]
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3), weights=(1.0,), share=0.5).collect()


def test_one_tilt_a_source_as_by_bisection(mixed):
    free = 0
    for name, sizes in SIZES.items():
        mine = [r for r in mixed if r.source_size == sum(sizes)]
        target = mine[0].target
        assert sorted(r["size"] for r in mine) == sorted(sizes)
        assert sum(r.rate * r["size"] for r in mine) == pytest.approx(target, rel=1e-8)
        assert all(r.rate > 0 for r in mine)
        if target >= 2 * sum(sizes) * (1 - 1e-9):
            assert all(r.rate == pytest.approx(2) for r in mine)
            continue
        want = newton(sizes, target)
        for r in mine:
            assert r.rate == pytest.approx(math.exp(min(math.log(2), want * r["size"])), rel=1e-6)
        free += 1
    assert free == 5


def test_words_taken_miss_by_less_than_a_short_document(mixed):
    for name, sizes in SIZES.items():
        mine = [r for r in mixed if r.source_size == sum(sizes)]
        if name not in ("c", "d"):  # these have too few short ones to make up for the long
            assert abs(sum(r.copies * r["size"] for r in mine) - mine[0].target) <= max(5, 2 * min(sizes))
        for r in mine:
            assert math.floor(r.rate + 1e-9) <= r.copies <= math.floor(r.rate + 1e-9) + 1


def test_documents_of_one_size_are_taken_alike(mixed):
    mine = [r for r in mixed if r.source_size == sum(SIZES["b"])]
    for size in set(SIZES["b"]):
        same = [r for r in mine if r["size"] == size]
        assert abs(sum(r.copies for r in same) - sum(r.rate for r in same)) <= 50 / size + 1


def test_many_sizes_in_chunks(spark):
    rows = [(i, "s", "w " * n) for i, n in enumerate(range(1, 3 * mixing.CHUNK + 7))] + [(9999, "t", "w " * 200_000)]
    got = [r for r in mixing.query(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect() if r.doc_id != 9999]
    assert abs(sum(r.taken for r in got) - got[0].target) <= 8  # the few rates below the limit are those of the shortest
    assert len(got) == len(rows) - 1


def test_the_result_does_not_hang_on_the_partitions(spark):
    rows = [(i, "ab"[i % 3 > 0], "w " * (1 + i % 7)) for i in range(600)] + [(5, "a", "same")] * 50
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    one, other = (sorted(map(tuple, mixing.query(df.repartition(n, "text", "doc_id")).collect())) for n in (1, 6))
    assert one == other
