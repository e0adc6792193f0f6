"""Filled polygons and filters against each pixel's own test."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cairnframe.operators import fills

RING = "shape long, ring long, ord long, x double, y double"


def inside(rings, x, y, even_odd):
    n = wind = 0
    for pts in rings:
        for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1]):
            if ay != by and min(ay, by) <= y < max(ay, by) and ax + (y - ay) * (bx - ax) / (by - ay) > x:
                n, wind = n + 1, wind + (1 if by > ay else -1)
    return n % 2 == 1 if even_odd else wind != 0


def pixels(runs):
    return {(r.shape, r.y, x) for r in runs for x in range(r.lo, r.hi + 1)}


def shapes():
    r = random.Random(4)
    out = {}
    for s in range(12):
        star = [(20 + r.uniform(3, 18) * math.cos(a), 15 + r.uniform(3, 14) * math.sin(a)) for a in (i * 4 * math.pi / 11 for i in range(11))]
        box = [(10.5, 8.5), (24.5, 8.5), (24.5, 19.5), (10.5, 19.5)]  # edges through middles
        out[s] = [star, box if s % 3 else box[::-1]][: 1 + s % 2]
    return out | {90: [[(1, 1), (5, 5)]], 91: [[(2, 2)]], 92: [[(0, 3), (9, 3), (4, 3)]]}


def rows(of):
    return [(s, k, i, float(x), float(y)) for s, rings in of.items() for k, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]


@pytest.mark.parametrize("even_odd", [True, False])
def test_pixels_are_those_whose_middle_is_inside(spark, even_odd):
    of = shapes()
    df = spark.createDataFrame(rows(of) + [(93, 0, 0, None, 1.0)], RING).repartition(3)
    got = fills.filled(df, ["shape"], even_odd).collect()
    assert pixels(got) == {(s, y, x) for s, rings in of.items() for y in range(-5, 40) for x in range(-5, 50) if inside(rings, x + 0.5, y + 0.5, even_odd)}
    assert all(a.hi + 1 < b.lo for a, b in zip(sorted(got), sorted(got)[1:], strict=False) if (a.shape, a.y) == (b.shape, b.y))
    clipped = pixels(fills.filled(df, ["shape"], even_odd, 18, 12).collect())
    assert clipped == {p for p in pixels(got) if 0 <= p[1] < 12 and 0 <= p[2] < 18}


def test_colour_mask_and_comparison(spark):
    of = shapes()
    df = spark.createDataFrame(rows(of), RING).select(F.lit(1).alias("page"), F.col("shape").alias("path"), "ring", "ord", "x", "y", F.expr("CASE WHEN shape = 3 THEN NULL ELSE 200 + shape END AS r"), F.lit(0).alias("g"), F.lit(0).alias("b"), F.expr("shape % 2 = 0").alias("even_odd"))
    got = fills.colour_mask(df, "page", (203, 0, 0), 2)
    want = {(y, x) for s in (1, 2, 4, 5) for y in range(40) for x in range(50) if inside(of[s], x + 0.5, y + 0.5, s % 2 == 0)}
    assert {(r.y, x) for r in got.collect() for x in range(r.lo, r.hi + 1)} == want
    box = spark.createDataFrame([(1, y, 10, 20) for y in range(5, 20)], "page int, y long, lo long, hi long")
    square = {(y, x) for y in range(5, 20) for x in range(10, 21)}
    (r,) = fills.compared(got, box, "page").collect()
    assert (r.shared, r.only_a, r.only_b) == (len(want & square), len(want - square), len(square - want))
    assert r.iou == pytest.approx(len(want & square) / len(want | square), abs=1e-4)


@pytest.mark.parametrize("size", [1, 3, 5, 9, 31])
def test_filters_are_those_of_the_whole_square(spark, size):
    r = random.Random(size)
    images = {i: [[r.randrange(9) for _ in range(w)] for _ in range(h)] for i, (w, h) in enumerate([(17, 11), (4, 30), (1, 1), (9, 9)])}
    df = spark.createDataFrame([(i, y, x, v) for i, rows_ in images.items() for y, row in enumerate(rows_) for x, v in enumerate(row)], "img int, y int, x int, v int").repartition(3)
    for least in (True, False):
        got = {(p.img, p.y, p.x): p.v for p in fills.rank_filter(df, "img", "v", size, least).collect()}
        h = size // 2
        for i, image in images.items():
            for y in range(len(image)):
                for x in range(len(image[0])):
                    near = [image[b][a] for b in range(max(0, y - h), min(len(image), y + h + 1)) for a in range(max(0, x - h), min(len(image[0]), x + h + 1))]
                    assert got[i, y, x] == (min(near) if least else max(near))
    with pytest.raises(ValueError):
        fills.rank_filter(df, "img", "v", 4, True)


def test_empty_tables(spark):
    none = spark.createDataFrame([], RING)
    runs = fills.filled(none, ["shape"])
    assert runs.count() == 0 and fills.compared(runs, runs, "shape").count() == 0
    assert fills.opened(spark.createDataFrame([], "img int, y int, x int, v int"), "img", "v", 3).count() == 0
