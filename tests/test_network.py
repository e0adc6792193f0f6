"""Faces of line networks: as many as Euler's formula says, apart from one another, and the same on both ends of whatever meets no line."""

import random
from fractions import Fraction

from cairnframe.operators import network, overlay

LINE = "plan string, ax double, ay double, bx double, by_ double"
GRID = 1 / 1024


def cuts(a, b):
    """Where two segments with ends on whole numbers meet."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = a, b
    det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    if det:
        t, u = Fraction((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), det), Fraction((cx - ax) * (by - ay) - (cy - ay) * (bx - ax), det)
        return [(ax + t * (bx - ax), ay + t * (by - ay))] if 0 <= t <= 1 and 0 <= u <= 1 else []
    if (cx - ax) * (by - ay) != (cy - ay) * (bx - ax):
        return []
    return [(x, y) for x, y in ((cx, cy), (dx, dy)) if min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by)]


def euler(lines):
    """Bounded faces of a network: edges less corners, and one for each part."""
    edges = set()
    for a in lines:
        points = {(Fraction(a[0]), Fraction(a[1])), (Fraction(a[2]), Fraction(a[3]))} | {p for b in lines if b != a for p in cuts(a, b)}
        row = sorted(points)
        edges |= set(zip(row, row[1:], strict=False))
    of = {p: p for e in edges for p in e}

    def root(p):
        while of[p] != p:
            p = of[p]
        return p

    for a, b in edges:
        of[root(a)] = root(b)
    return len(edges) - len(of) + len({root(p) for p in of})


def test_faces(spark):
    r = random.Random(11)
    plans = {}
    for k in range(5):
        plans[f"p{k}"] = [tuple(r.randrange(14) for _ in range(4)) for _ in range(9 + 3 * k)]
    # A square in a square in a square, with a bridge between two, and lines on one another.
    squares = [(a, a, b, a) for a, b in ((0, 12), (3, 9), (5, 7))] + [(b, a, b, b) for a, b in ((0, 12), (3, 9), (5, 7))] + [(a, b, b, b) for a, b in ((0, 12), (3, 9), (5, 7))] + [(a, a, a, b) for a, b in ((0, 12), (3, 9), (5, 7))]
    plans["nested"] = [*squares, (7, 6, 9, 6), (2, 0, 15, 0), (12, 0, 3, 0)]
    plans["loose"] = [(0, 0, 5, 5), (5, 0, 0, 5)]
    plans = {k: [x for x in v if x[:2] != x[2:]] for k, v in plans.items()}
    rows = [(k, *map(float, x)) for k, v in plans.items() for x in v]
    rows += [rows[0], ("p0", 1.0, 1.0, 1.0, 1.0), ("p0", None, 1.0, 2.0, 3.0)]
    rings = network.faces(network.noded(spark.createDataFrame(rows, LINE).repartition(3), "plan", GRID, 4.0), "plan", 4.0 / GRID).withColumns({"x": overlay.F.col("x") * GRID, "y": overlay.F.col("y") * GRID}).cache()
    counts = {x.plan: x.n for x in rings.groupBy("plan").agg(overlay.F.count_distinct("face").alias("n")).collect()}
    assert counts == {k: n for k, v in plans.items() if (n := euler(v))}
    areas = sorted(round(x.area, 6) for x in overlay.measures(rings.where("plan = 'nested'"), "face").collect())
    assert areas == [4.0, 32.0, 108.0]
    spots = [(k, f"{k}-{i}", i, r.random() * 14, r.random() * 14) for k in plans for i in range(40)]
    found = network.containing(spark.createDataFrame(spots, "plan string, id string, ord long, x double, y double"), rings, "face", 2.0, ["plan"]).collect()
    of = {x.id: x.face for x in found}
    assert len(of) == len(found)  # faces do not overlap
    side = lambda ax, ay, bx, by, x, y: (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    for k, a, _, ax, ay in spots:
        for k2, b, _, bx, by in spots:
            if k == k2 and a < b and not any(side(*s, ax, ay) * side(*s, bx, by) <= 0.05 and side(ax, ay, bx, by, *s[:2]) * side(ax, ay, bx, by, *s[2:]) <= 0.05 for s in plans[k]):
                assert of.get(a) == of.get(b), (k, a, b)
    assert network.faces(network.noded(spark.createDataFrame([], LINE), "plan"), "plan", 1.0).count() == 0


def test_seeds(spark):
    lines = spark.createDataFrame([("a", *x) for x in [(0.0, 0.0, 4.0, 0.0), (4.0, 0.0, 4.0, 2.0), (4.0, 2.0, 0.0, 2.0), (0.0, 2.0, 0.0, 0.0), (2.0, 0.0, 2.0, 2.0), (3.0, -1.0, 3.0, 3.0)]], LINE)
    rings = network.faces(network.noded(lines, "plan", GRID, 1.0), "plan", 1.0 / GRID).withColumns({"x": overlay.F.col("x") * GRID, "y": overlay.F.col("y") * GRID})
    seeds = spark.createDataFrame([("a", "hall", 1, 1.0, 1.0), ("a", "twice", 2, 0.5, 0.5), ("a", "out", 3, 9.0, 9.0), ("a", "bath", 4, 2.5, 1.0), ("b", "other", 5, 1.0, 1.0)], "plan string, name string, ord long, x double, y double")
    got = {(x.plan, x.name, x.hits, x.error, x.face is not None) for x in network.seeded(rings, seeds, "plan", 1.0).collect()}
    assert got == {("a", "hall", 1, None, True), ("a", "twice", 1, "taken", False), ("a", "out", 0, "no face", False), ("a", "bath", 1, None, True), ("b", "other", 0, "no face", False), ("a", None, None, None, True)}


def test_rings_in_tasks_and_by_joins(spark, monkeypatch):
    r = random.Random(3)
    rows = [(f"p{k}" if k else None, *(float(r.randrange(14)) for _ in range(4))) for k in range(6) for _ in range(20)] + [("far", *(1e6 + 8.0 * c for c in x)) for x in ((0, 0, 9, 0), (9, 0, 9, 9), (9, 9, 0, 9), (0, 9, 0, 0), (2, 2, 4, 2), (4, 2, 2, 5), (2, 5, 2, 2))]
    pieces = network.stored(network.noded(spark.createDataFrame(rows, LINE), "plan", GRID, 4.0), "test")
    assert pieces.count() > 300

    def shapes(in_task):
        rings = {}
        for x in network.faces(pieces, "plan", 4.0 / GRID, in_task).collect():
            rings.setdefault((x.plan, x.face, x.ring), []).append((x.ord, x.x, x.y))
        turned = {k: [p[1:] for p in sorted(v)] for k, v in rings.items()}
        assert all([p[0] for p in sorted(v)] == list(range(len(v))) for v in rings.values())
        turned = {k: min(v[i:] + v[:i] for i in range(len(v))) for k, v in turned.items()}  # from the smallest corner on
        faces = {}
        for (plan, face, _), v in turned.items():
            faces.setdefault((plan, face), []).append(tuple(v))
        return sorted((str(plan), sorted(v)) for (plan, _), v in faces.items())

    by_joins, some = shapes(0), shapes(60)
    monkeypatch.setattr(network, "_ringed", None)  # plans that fit a task take no rounds of joins
    assert shapes(network.IN_TASK) == by_joins == some and len(by_joins) > 50
    assert any(plan == "far" and len(v) == 2 for plan, v in by_joins)
