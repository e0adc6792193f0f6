"""Operators that work step by step within a group, against plain Python, and their edge cases."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from cairnframe.operators import bars, doors, level, lines, raster


def apart(a, b):
    d = abs(a - b) % 180
    return min(d, 180 - d)


def test_directions(spark):
    r = random.Random(5)
    rows = [(s, r.choice([30, 31, 33.5, 60, 61, 0.5, 92, 178, 120]) + r.random(), r.choice([0.5, 1.5, 2.0, 3.0]) + r.random() / 7) for s in range(20) for _ in range(12)]
    got = {x.set_by: x.directions for x in lines.directions(spark.createDataFrame(rows, "shape long, angle double, length double"), "shape").collect()}
    for s in range(20):
        clusters = []
        for _, a, n in sorted(((-n, a, n) for t, a, n in rows if t == s)):
            if n < 1 or min(apart(a, 0), apart(a, 90)) <= 3:
                continue
            c = next((c for c in clusters if apart(c[0], a) <= 3), None)
            if c is None:
                clusters.append([a, [(a, n)]])
            else:
                c[1].append((a, n))
                ref = c[1][0][0]
                c[0] = (ref + sum(((x - ref + 90) % 180 - 90) * m for x, m in c[1]) / sum(m for _, m in c[1])) % 180
        assert len(got[s]) == 2 + len(clusters) and all(abs(x - c[0]) < 1e-3 for x, c in zip(got[s][2:], clusters, strict=True))


def test_pair_jogs_of_slanted_lines_against_all_pairs(spark):
    r = random.Random(11)
    rows = []
    for i in range(260):
        a, n = r.choice([0, 0, 90, 30, 30.4, 179.6, 0.3, 45]) + r.choice([0, 0, 0.2]), r.choice([0.04, 0.6, 2.0, 2.0, 9.0, 40.0])
        x, y, turn = r.choice([0, 1, 3, 7]) + r.random() / 20, r.choice([0, 0.5, 2]) + r.random() / 9, r.choice([0, 180])
        u = (math.cos(math.radians(a + turn)), math.sin(math.radians(a + turn)))
        rows.append((i, x, y, x + n * u[0], y + n * u[1], n, math.degrees(math.atan2(u[1], u[0])) % 180, r.choice([None, 0.1, 0.2, 0.35]), i % 2))
    want = {}
    for p in rows:
        for q in rows:
            if p[0] == q[0] or min(p[5], q[5]) < 0.05 or (q[5], -q[0]) > (p[5], -p[0]) or apart(p[6], q[6]) > 1:
                continue
            ux, uy = (p[3] - p[1]) / p[5], (p[4] - p[2]) / p[5]
            d = -uy * ((q[1] + q[3]) / 2 - p[1]) + ux * ((q[2] + q[4]) / 2 - p[2])
            s, t = (sorted((ux * z[1] + uy * z[2], ux * z[3] + uy * z[4])) for z in (p, q))
            h1, h2 = (p[7] or 0) / 2, (q[7] or 0) / 2
            off, gap = min(abs(d), abs(h2 - h1 - d), abs(h1 - h2 - d)), max(t[0] - s[1], s[0] - t[1])
            if 0.002 < off <= 0.05 and gap <= 1.2:
                want[p[0], q[0]] = off, gap
    df = spark.createDataFrame(rows, "id long, ax double, ay double, bx double, by_ double, length double, angle double, thickness double, floor int")
    for block in (16.0, 1.5):
        got = lines.pair_jogs(df, block=block).collect()
        assert len(got) == len({(x.a, x.b) for x in got}) == len(want) > 300
        assert all(abs(x.offset - want[x.a, x.b][0]) < 1e-9 and abs(x.gap - want[x.a, x.b][1]) < 1e-9 for x in got)
    apart_ = {(x.a, x.b) for x in lines.pair_jogs(df, by="floor").collect()}
    assert apart_ == {k for k in want if k[0] % 2 == k[1] % 2}


def test_pair_jogs_of_lines_one_degree_apart(spark):
    """Rounding takes a difference of a hair over one degree for one; such lines lie in frames two degrees apart."""
    rows = []
    for i, (a, b) in enumerate([(0.4999999999999997, 1.5), (0.9999999999999996, 2.0), (0.0, 179.0), (89.49999999999999, 90.5), (89.99999999999999, 91.0)]):
        for k, (angle, n) in enumerate([(a, 8.0), (b, 1.0)]):
            ux, uy = math.cos(math.radians(angle)), math.sin(math.radians(angle))
            x, y = 100.0 * i - k * 0.02 * math.sin(math.radians(a)), k * 0.02 * math.cos(math.radians(a))
            rows.append((2 * i + k, x - ux * n / 2, y - uy * n / 2, x + ux * n / 2, y + uy * n / 2, n, angle, None))
    df = spark.createDataFrame(rows, "id long, ax double, ay double, bx double, by_ double, length double, angle double, thickness double")
    assert {(x.a, x.b, round(x.offset, 6)) for x in lines.pair_jogs(df).collect()} == {(2 * i, 2 * i + 1, 0.02) for i in range(5)}


def test_directions_are_those_of_all_outlines_of_a_scope(spark):
    """A slanted line beside a longer one of the same mesh is off the mean of both, not off its own direction."""
    def square(turn, size, at):
        u = (math.cos(math.radians(turn)), math.sin(math.radians(turn)))
        return [(at, 0), (at + size * u[0], size * u[1]), (at + size * (u[0] - u[1]), size * (u[1] + u[0])), (at - size * u[1], size * u[0])]

    rows = [(shape, i, float(x), float(y), "m") for shape, (turn, size, at) in enumerate([(30, 20, 0), (31, 3, 50)]) for i, (x, y) in enumerate(square(turn, size, at))]
    df = spark.createDataFrame(rows, "shape long, ord long, x double, y double, mesh string")
    assert lines.issues(df, "shape").count() == 0
    got = {(x.shape, x.edge): x.value for x in lines.issues(df, "shape", scope="mesh").collect()}
    mean = (30 * 20 + 31 * 3) / 23
    assert {k for k in got} == {(s, e) for s in (0, 1) for e in range(4)}
    assert all(abs(v - abs((30 + s) - mean)) < 1e-3 for (s, _), v in got.items())
    assert lines.issues(df, "shape", scope="mesh", declared=(30.0, 120.0)).count() == 4


def outline(spark, points, shape=1):
    return spark.createDataFrame([(shape, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "shape long, ord long, x double, y double")


def test_curves(spark):
    circle = [(math.cos(2 * math.pi * i / 24), math.sin(2 * math.pi * i / 24)) for i in range(24)]
    whole = lines.curve_runs(outline(spark, circle), "shape").collect()
    assert len(whole) == 25 and {r.run for r in whole} == {0}
    rounded = [(0, 0), (4, 0), *[(4 + math.sin(math.pi / 2 * i / 6), 1 - math.cos(math.pi / 2 * i / 6)) for i in range(1, 7)], (5, 4), (0, 4)]
    run = lines.curve_runs(outline(spark, rounded), "shape").orderBy("ord").collect()
    assert len(run) == 9 and run[0].x == 0 and (run[-1].x, run[-1].y) == (5, 4)  # the straight sides that it runs into turn little too
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert lines.curve_runs(outline(spark, square), "shape").count() == 0 and lines.issues(outline(spark, square), "shape").count() == 0
    steps = [(0, 0), (2, 0), (2, 0.03), (4, 0.03), (4, 4), (0, 4)]
    kinds = {(r.type, r.edge): r.value for r in lines.issues(outline(spark, steps), "shape").collect()}
    assert set(kinds) == {("short_segment", 1), ("wall_jog", 0)} and abs(kinds["wall_jog", 0] - 0.03) < 1e-12
    skew = [(0, 0), (4, 0.1), (4, 4), (0, 4)]
    assert {r.type for r in lines.issues(outline(spark, skew), "shape").collect()} == {"near_axis_skew"}


def test_loops_and_collinear_corners(spark):
    seg = [(1, 0, 0, 2, 0), (1, 2, 2, 2, 0), (1, 2, 2, 0, 2.0000001), (1, 0, 2, 0, 0), (1, 5, 5, 6, 5), (1, 7, 5, 6, 5)]
    df = spark.createDataFrame([tuple(map(float, s)) for s in seg], "z double, x0 double, y0 double, x1 double, y1 double")
    got = lines.section_loops(df, "z").collect()
    chains = {}
    for r in got:
        chains.setdefault(r.chain, []).append((r.closed, r.x, r.y))
    assert sorted(len(c) for c in chains.values()) == [3, 4] and sorted(c[0][0] for c in chains.values()) == [False, True]
    ring = [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2.0000001), (0, 2)]
    left = lines.without_collinear(outline(spark, ring), "shape").orderBy("ord").collect()
    assert {(r.x, r.y) for r in left} == {(0, 0), (2, 0), (2, 2), (0, 2)}


def test_scale_bars(spark):
    rects = [("p", 10.0 * i, 100.0, 10.0 * i + 10, 102.0, str(i % 2)) for i in range(4)] + [("p", 10.0 * i, 102.0, 10.0 * i + 10, 104.0, "1") for i in range(4)]
    rects += [("p", 300.0, 50.0, 360.0, 52.0, None), ("p", 400.0, 50.0, 405.0, 50.5, None), ("p", 0.0, 0.0, 50.0, 40.0, "1"), ("q", 0.0, 0.0, 20.0, 2.0, "1")]
    words = [("p", "10 ft", 20.0, 110.0, 40.0, 118.0), ("p", "north", 0.0, 90.0, 10.0, 98.0), ("p", "3", 900.0, 100.0, 910.0, 110.0), ("q", None, 0.0, 0.0, 1.0, 1.0)]
    found = bars.scale_bars(spark.createDataFrame(rects, "page string, x0 double, y0 double, x1 double, y1 double, fill string"), spark.createDataFrame(words, "page string, word string, x0 double, y0 double, x1 double, y1 double"), "page").collect()
    got = {(r.page, r["rank"]): (r.length, r.cells, r.alternating, r.labels) for r in found}
    assert got == {("p", 1): (40.0, 8, True, ["10 ft"]), ("p", 2): (60.0, 1, False, []), ("q", 1): (20.0, 1, False, [])}


def test_colours_and_bands_and_shifts(spark):
    pixels = [(1, y, x, *((200, 30, 30) if x < 30 else (204, 28, 33) if x < 40 else (10, 10, 10))) for y in range(20) for x in range(50)]
    df = spark.createDataFrame(pixels, "img long, y long, x long, r int, g int, b int")
    got = raster.colour_classes(df).orderBy("rank").collect()
    assert [(r.r, r.share) for r in got] == [(200, 0.8), (10, 0.2)]  # the fullest bin holds the former shade alone
    band = [(1, y, x) for y in range(40) for x in range(40) if 10 <= y < 18] + [(2, y, x) for y in range(40) for x in range(40) if x % 7 == 0 and y % 7 == 0]
    wide = {r.img: r for r in raster.band_profile(spark.createDataFrame(band, "img long, y long, x long")).collect()}
    assert wide[1].width in (6.0, 8.0) and wide[1].share > 0.6 and wide[2].width is None
    rng = np.random.default_rng(0)
    mask = rng.random((40, 50)) < 0.3
    moved = [(1, int(y) + 3, int(x) + 7) for y, x in zip(*np.nonzero(mask), strict=True)]
    here = [(1, int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)]
    r = raster.aligned(spark.createDataFrame(moved, "img long, y long, x long"), spark.createDataFrame(here, "img long, y long, x long"), 10).first()
    assert (r.dx, r.dy, r.iou, r.at_edge) == (7, 3, 1.0, False)


def test_leaves_of_hinges(spark):
    h = spark.createDataFrame([("l", 1, 0.0, 0.0), ("l", 2, 1.0, 0.0), ("l", 3, 1.01, 0.0), ("l", 4, 9.0, 9.0)], "level string, hinge long, x double, y double")
    v = spark.createDataFrame([("l", 10, 0.001, 0.0, 5.0, 5.0), ("l", 11, None, None, 1.02, 0.0), ("l", 12, None, None, 1.05, 0.0)], "level string, leaf long, px double, py double, cx double, cy double")
    assert {r.hinge: r.leaf for r in doors.leaf_of_hinge(h, v, "level").collect()} == {1: 10, 2: 11, 3: 12, 4: None}


def test_hollow_and_flipped_cubes(spark):
    faces = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]
    cube = lambda mesh, base, at, size, flip: ([(mesh, base + v, at + size * (v & 1), at + size * (v >> 1 & 1), at + size * (v >> 2)) for v in range(8)], [(mesh, base + i, base + a, base + (c if flip else b), base + (b if flip else c)) for i, (a, b, c) in enumerate(faces)])
    v, t = [], []
    for m, base, at, size, flip in (("hollow", 0, 0.0, 4.0, False), ("hollow", 100, 1.0, 2.0, True), ("flipped", 0, 0.0, 1.0, True), ("two", 0, 0.0, 1.0, False), ("two", 100, 5.0, 1.0, True)):
        a, b = cube(m, base, at, size, flip)
        v, t = v + a, t + b
    got = {(r.mesh, r.island): r["class"] for r in level.island_classes(spark.createDataFrame(v, "mesh string, vid long, x double, y double, z double"), spark.createDataFrame(t, "mesh string, tid long, a long, b long, c long")).collect()}
    assert got == {("hollow", 0): "solid", ("hollow", 100): "cavity", ("flipped", 0): "inverted", ("two", 0): "solid", ("two", 100): "inverted"}


def test_nulls_and_empty_tables(spark):
    assert level.nearest_standing(spark.createDataFrame([], "id long, x double, y double, z double"), spark.createDataFrame([], "pid long, x double, y double, h double"), 1.0, 1.0).count() == 0
    faces = spark.createDataFrame([], "mesh string, id long, axis string, facing int, offset double, u0 long, u1 long, v0 long, v1 long")
    assert level.coplanar(faces).count() == 0 and level.coplanar_summary(level.coplanar(faces)).count() == 0
    empty = outline(spark, [])
    assert lines.issues(empty, "shape").count() == 0 and lines.segments(outline(spark, [(1, 1)]), "shape").count() == 0
    assert doors.leaves(spark.createDataFrame([(1, None, "x", None, 0.0, 0.0, 1.0, 0.2)], "name long, kind string, axis string, hinge string, ax double, ay double, bx double, by double")).where(F.col("x0").isNotNull()).count() == 0


def test_boxes_of_all_sizes_meet(spark):
    from cairnframe.operators import spatial

    r = random.Random(1)
    rows = [(i, x := r.uniform(-50, 50), x + s, y := r.uniform(-50, 50), y + r.choice([s, 0.0])) for i in range(120) for s in (r.choice([0.0, 0.3, 1.0, 5.0, 90.0]),)]
    df = spark.createDataFrame(rows, "id long, x0 double, x1 double, y0 double, y1 double")
    for slack in (0.0, 0.5):
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] <= b[2] + slack and b[1] <= a[2] + slack and a[3] <= b[4] + slack and b[3] <= a[4] + slack}
        got = [(p.a_id, p.b_id) for p in spatial.self_pairs(df, cell=1.0, slack=slack).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert spatial.self_pairs(df.where("false"), cell=1.0).count() == 0


def test_union_in_cells_is_the_union(spark):
    from cairnframe.operators import spatial

    r = random.Random(2)
    rows = [(i % 3, x := r.randrange(-40, 40), x + r.randrange(0, 30), y := r.randrange(20), y + r.randrange(9)) for i in range(90)]
    df = spark.createDataFrame(rows, "g long, x0 long, x1 long, y0 long, y1 long")
    want = {g: len({(x, y) for h, a, b, c, d in rows if h == g for x in range(a, b) for y in range(c, d)}) for g in range(3)}
    assert {x.g: x.area for x in spatial.rectangle_union_area(df, "g", 7.0).collect()} == {x.g: x.area for x in spatial.rectangle_union_area(df, "g").collect()} == want


def test_rounds_of_erosion_and_dilation_at_once(spark):
    rng = np.random.default_rng(3)
    image = rng.random((14, 17)) < 0.9
    df = spark.createDataFrame([(1, int(y), int(x)) for y, x in zip(*np.nonzero(image), strict=True)] * 2, "img long, y long, x long")

    def step(m, outside, f):
        p = np.pad(m, 1, constant_values=outside)
        return f.reduce([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])

    for op, outside, f, source in ((raster.eroded, True, np.logical_and, image), (raster.dilated, False, np.logical_or, ~image)):
        own = df if source is image else spark.createDataFrame([(1, int(y), int(x)) for y, x in zip(*np.nonzero(source), strict=True)], "img long, y long, x long")
        want = source
        for rounds in range(1, 6):
            want = step(want, outside, f)
            if rounds in (1, 2, 5):
                got = [(r.y, r.x) for r in op(own, rounds=rounds, height=14, width=17).collect()]
                assert len(got) == len(set(got)) and set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(want)), strict=True))


def test_curve_runs_make_no_python_groups(spark):
    """A call of Python for each outline took nearly all the time of shape_issues; runs go over the start, and a null corner breaks them."""
    arc = [(5 * math.cos(math.radians(15 * i)), 5 * math.sin(math.radians(15 * i))) for i in range(-4, 6)]
    rows = [("a", k, x, y) for k, (x, y) in enumerate([*arc[4:], (-9.0, 9.0), (-9.0, -9.0), *arc[:4]])]
    rows += [("closed", *r[1:]) for r in rows] + [("closed", 99, *rows[0][2:])]
    rows += [("broken", k, None if k == 7 else x, y) for k, (x, y) in enumerate(arc)]
    df = lines.curve_runs(spark.createDataFrame(rows, "shape string, ord long, x double, y double").repartition(3), "shape")
    assert "Pandas" not in df._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in df.orderBy("shape", "run", "ord").collect():
        got.setdefault((r.shape, r.run), []).append((r.ord, r.x, r.y))
    assert set(got) == {("a", 8), ("closed", 8), ("broken", 0)}
    assert got["a", 8] == got["closed", 8] == [(k, *p) for k, p in enumerate(arc)]
    assert got["broken", 0] == [(k, *p) for k, p in enumerate(arc[:7])]
