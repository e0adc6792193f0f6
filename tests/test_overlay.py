"""Set operations on rectilinear polygons and measures against squares and plain Python."""

import math
import random

import pytest

from cairnframe.operators import overlay

RING = "plan string, ring int, ord int, x double, y double"


def stairs(r, at):
    """A rectilinear ring of a few steps, turning either way, not crossing itself."""
    xs, ys = sorted(r.sample(range(at, at + 12), 4)), sorted(r.sample(range(12), 4))
    pts = [(xs[0], ys[0]), (xs[3], ys[0]), (xs[3], ys[1]), (xs[2], ys[1]), (xs[2], ys[2]), (xs[1], ys[2]), (xs[1], ys[3]), (xs[0], ys[3])]
    return pts[::-1] if r.random() < 0.5 else pts


def squares(rings):
    out = {}
    for pts in rings:
        for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1]):
            if ay != by:
                for j in range(min(ay, by), max(ay, by)):
                    for i in range(ax, 40):
                        out[i, j] = not out.get((i, j), False)
    return {k for k, v in out.items() if v}


def test_operations_on_squares(spark):
    r = random.Random(12)
    plans = {f"p{k}": ([stairs(r, 0) for _ in range(r.randrange(4))], [stairs(r, 3) for _ in range(r.randrange(4))]) for k in range(14)}
    of = lambda n: spark.createDataFrame([(p, k, i, float(x), float(y)) for p, sides in plans.items() for k, pts in enumerate(sides[n]) for i, (x, y) in enumerate(pts)] + [("none", 0, 0, None, 1.0)], RING).repartition(3)
    for name, keep in (("union", lambda a, b: a | b), ("intersection", lambda a, b: a & b), ("difference", lambda a, b: a - b), ("either", lambda a, b: a ^ b)):
        got = {}
        for q in overlay.overlaid(of(0), of(1), "plan", name).collect():
            cells = [(i, j) for i in range(int(q.x0), int(q.x1)) for j in range(int(q.y0), int(q.y1))]
            mine = got.setdefault(q.plan, set())
            assert cells and not mine & set(cells)
            mine.update(cells)
        assert got == {p: u for p, (a, b) in plans.items() if (u := keep(squares(a), squares(b)))}
    with pytest.raises(ValueError):
        overlay.overlaid(of(0), of(1), "plan", "xor")
    empty = spark.createDataFrame([], RING)
    assert overlay.overlaid(empty, empty, "plan", "union").count() == 0


def test_measures_and_points_inside(spark):
    ring = lambda p, k, pts: [(p, k, i, float(x), float(y)) for i, (x, y) in enumerate(pts)]
    far = 1e6
    rows = ring("holed", 0, [(far, far), (far + 4, far), (far + 4, far + 4), (far, far + 4)]) + ring("holed", 1, [(far + 1, far + 1), (far + 1, far + 2), (far + 2, far + 2), (far + 2, far + 1)])
    rows += ring("tri", 0, [(0, 0), (0, 3), (6, 0)]) + ring("line", 0, [(0, 0), (5, 5)])
    df = spark.createDataFrame(rows, RING)
    got = {x.plan: x for x in overlay.measures(df, "plan").collect()}
    assert (got["holed"].area, got["holed"].length) == (15, 20) and got["holed"].cx == pytest.approx(far + (4 * 8 - 1.5) / 15, abs=1e-6)
    assert (got["tri"].area, got["tri"].cx, got["tri"].cy) == (9, 2, 1) and got["tri"].length == pytest.approx(9 + math.sqrt(45))
    assert got["line"].area == 0 and got["line"].cx is None
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, far + 1.5, far + 1.5), (3, far + 3.0, far + 3.0), (4, 0.0, 0.0), (5, 5.9, 2.9), (6, None, 1.0)], "id int, x double, y double")
    for cell in (1.0, 7.0):
        assert {(x.id, x.plan) for x in overlay.containing(points, df, "plan", cell).collect()} == {(1, "tri"), (3, "holed"), (4, "tri")}
