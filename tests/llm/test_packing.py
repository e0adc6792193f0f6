import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnframe.llm import packing


def cost(ends, kinds, size):
    total, last = 0, 0
    for e in ends:
        n = e - last
        if n > size:
            return None
        pad = 0 if kinds[e] == packing.DOC and n & (n - 1) == 0 else size - n
        total += pad + packing.WINDOW_PRICE + {packing.DOC: 0, packing.SENTENCE: packing.SENTENCE_PRICE, packing.HARD: packing.HARD_PRICE}[kinds[e]]
        last = e
    return total


@given(st.lists(st.integers(1, 9), min_size=1, max_size=6), st.sets(st.integers(1, 30), max_size=4), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_cuts_cost_least(lengths, marks, looks):
    size = 8
    docs = np.cumsum(lengths)
    total = int(docs[-1])
    sentences = np.array(sorted(m for m in marks if m < total), dtype=int)
    cutter, got, start = packing.Cutter(size), [], 0
    for i, end in enumerate(docs.tolist()):
        cutter.feed([p for p in sentences.tolist() if start < p < end], end)
        start = end
        if i % looks == 0:
            got += cutter.settled()
    got += cutter.settled(last=True)
    assert got[-1] == total and all(0 < b - a <= size for a, b in zip([0, *got], got, strict=False))
    # Brute force over the cut points that the operator allows.
    soft = sorted({0, total, *docs.tolist(), *sentences.tolist()})
    kinds = {p: packing.HARD for p in range(total)}
    kinds.update({int(p): packing.SENTENCE for p in sentences})
    kinds.update({int(p): packing.DOC for p in docs})
    hard = {s + size for s in soft[:-1]} | {p for a, b in zip(soft, soft[1:], strict=False) for p in range(a + size, b, size)}
    points = sorted(p for p in {*soft[1:-1], *hard} if 0 < p < total)
    best = min(c for n in range(len(points) + 1) for some in combinations(points, n) if (c := cost([*some, total], kinds, size)) is not None) if len(points) <= 14 else None
    if best is not None:
        assert cost(got, kinds, size) == best


@given(st.lists(st.integers(1, 40), min_size=1, max_size=200), st.integers(1, 9))
@settings(max_examples=40, deadline=None)
def test_looks_change_no_cut_and_a_bound_keeps_windows_valid(lengths, looks):
    def cut(looks, **bound):
        cutter, ends, end, most = packing.Cutter(16, **bound), [], 0, 0
        for i, n in enumerate(lengths):
            cutter.feed(list(range(end + 5, end + n, 7)), end + n)
            end += n
            if i % looks == 0:
                ends += cutter.settled()
                most = max(most, end - (ends or [0])[-1])
        return ends + cutter.settled(last=True), most

    whole, _ = cut(10**9)
    assert cut(looks)[0] == whole
    bounded, most = cut(1, most_open=32)
    assert bounded[-1] == sum(lengths) and all(0 < b - a <= 16 for a, b in zip([0, *bounded], bounded, strict=False)) and most <= 32 + 32


BY_BATCHES: dict = {}


@pytest.mark.parametrize("rows", [7, 100, 10_000])
def test_size_of_batches_changes_nothing(spark, rows):
    texts = [(i, "Words of a sentence. " * (1 + i * 37 % 90)) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = sorted(tuple(r) for r in packing.query(df).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    used = Counter()
    for r in got:
        used[r[5]] += r[2]
    padding = sum(packing.SIZE - n for n in used.values() if n & (n - 1))
    assert padding < 0.02 * used.total()
    assert got == BY_BATCHES.setdefault("first", got)


TEXTS = [None, "", "One word.", "A sentence here. Another one there! " * 400, "x" * 5000, "café \n\n naïve  text\t" * 30, "<|endoftext|> in a text", "same", "same"]


@pytest.mark.parametrize("ranks", [None, public_tokenizers.path("byte_bpe_50k.tiktoken")])
def test_every_id_lies_in_one_piece(spark, ranks):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(i, t, i * 2, "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, start long, row string").coalesce(1)
    got = packing.pack(df, path, ranks, with_ids=True).select("row.doc_id", *packing.COLUMNS, "ids").collect()
    encode = packing.Encoder(path)
    for i, t in enumerate(TEXTS):
        ids = [*(encode(t) if t else []), 1]
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == ids
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        assert all(r.doc_tokens == len(ids) and r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in pieces)
    for s in {r.sequence_id for r in got}:
        inside = sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset)
        assert [r.offset for r in inside] == np.cumsum([0, *[r.length for r in inside]])[:-1].tolist()
        assert sum(r.length for r in inside) <= packing.SIZE


def test_ids_are_those_of_the_tokenizers_file():
    fast = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in [*TEXTS[1:], "a  b \n c\n\n d\t e  'll  it's", "x\x1c\x85  y ", "中文 字 👍🏽 ' ll", "123 ½٣ we've I'm 'T"]:
        assert fast(t) == plain(t)


def test_empty_table(spark):
    assert packing.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0
