"""Contacts of opening leaves against leaves turned step by step."""

import math
import random

import pytest

from cairnframe.operators import swing

LEAF = "door int, id int, hx double, hy double, ex double, ey double, sx double, sy double, near double, far double, z0 double, z1 double, width double"
EDGE = "obstacle string, ax double, ay double, bx double, by_ double, z0 double, z1 double"


def convex_overlap(a, b):
    """Whether two convex polygons share more than a touch."""
    for pts in (a, b):
        for (x0, y0), (x1, y1) in zip(pts, pts[1:] + pts[:1]):
            nx, ny = y1 - y0, x0 - x1
            n = math.hypot(nx, ny)
            s, t = ([(nx * x + ny * y) / n for x, y in of] for of in (a, b))
            if max(s) <= min(t) + 1e-9 or max(t) <= min(s) + 1e-9:
                return False
    return True


def test_contact_is_where_turned_boxes_first_overlap(spark):
    r = random.Random(8)
    leaves, blocks = [], []
    for i in range(60):
        hx, hy, a, turn = 10.0 * i, r.uniform(-3, 3), r.uniform(0, 2 * math.pi), r.choice([1, -1])
        n, t = r.uniform(0.5, 1.2), r.choice([0.04, 0.1])
        u = (math.cos(a), math.sin(a))
        s = (-turn * u[1], turn * u[0])
        leaves.append((i // 2, i, hx, hy, hx + n * u[0], hy + n * u[1], *s, -t / 2, t / 2, 0.0, 2.0, n))
        for k in range(r.randrange(4)):
            at, far, size, b = a + turn * r.uniform(-0.4, 2.2), r.uniform(0.2, 1.3), r.uniform(0.02, 0.4), r.uniform(0, 7)
            x, y = hx + far * math.cos(at), hy + far * math.sin(at)
            blocks.append((f"o{i}-{k}", [(x + size * math.cos(b + j * math.pi / 2), y + size * math.sin(b + j * math.pi / 2)) for j in range(4)], r.choice([0.0, 0.0, 1.95]), 3.0))
    edges = [(o, *p, *q, z0, z1) for o, pts, z0, z1 in blocks for p, q in zip(pts, pts[1:] + pts[:1])]
    got = {x.id: x for x in swing.max_open(spark.createDataFrame(leaves, LEAF).repartition(3), spark.createDataFrame(edges, EDGE).repartition(3)).collect()}
    assert len(got) == 60
    end, face, top, hinge = swing.SHRINK
    some = 0
    for door, i, hx, hy, ex, ey, sx, sy, near, far, z0, z1, n in leaves:
        ux, uy = (ex - hx) / n, (ey - hy) / n
        corners = [(min(far - near + hinge + end, n), near + face), (n - end, near + face), (n - end, far - face), (min(far - near + hinge + end, n), far - face)]

        def box(deg, ux=ux, uy=uy, sx=sx, sy=sy, hx=hx, hy=hy, corners=corners):
            c, s = math.cos(math.radians(deg)), math.sin(math.radians(deg))
            return [(hx + ux * (p * c - q * s) + sx * (p * s + q * c), hy + uy * (p * c - q * s) + sy * (p * s + q * c)) for p, q in corners]

        mine = [(o, pts) for o, pts, b0, b1 in blocks if o.startswith(f"o{i}-") and b0 < z1 - top - 1e-6]
        hits = lambda deg: [o for o, pts in mine if convex_overlap(box(deg), pts)]  # noqa: B023, E731
        closed = bool(hits(0.0))
        assert got[i].closed == closed
        first = 0.0 if closed else next((k / 20 for k in range(1, 1801) if hits(k / 20)), None)
        if first is None:
            assert got[i].max_open == 90 and got[i].blocker is None
        elif not closed:
            assert -0.06 <= first - got[i].max_open <= 0.16 and got[i].blocker in hits(first + 0.05)
            some += 1
    assert some > 12 and sum(x.closed for x in got.values()) > 3


def test_doors_and_leaves_within_walls(spark):
    leaf = lambda door, i, x, sy=1.0: (door, i, x, 0.0, x + 1.0, 0.0, 0.0, sy, -0.02, 0.02, 0.0, 2.0, 1.0)
    leaves = [leaf(1, 1, 0.0), leaf(2, 2, 10.0), leaf(2, 3, 20.0), leaf(3, 4, 30.0), leaf(4, 5, 40.0, -1.0), (5, 6, 50.0, 0.0, 50.0, 0.0, 0.0, 1.0, -0.02, 0.02, 0.0, 2.0, 1.0)]
    ring = lambda o, x0, y0, x1, y1: [(o, x0, y0, x1, y0, 0.0, 3.0), (o, x1, y0, x1, y1, 0.0, 3.0), (o, x1, y1, x0, y1, 0.0, 3.0), (o, x0, y1, x0, y0, 0.0, 3.0)]
    edges = ring("deep", 25.0, -5.0, 36.0, 5.0) + ring("stop", 10.2, 0.5, 10.4, 0.6) + ring("stop", 10.2, 0.5, 10.4, 0.6) + ring("back", 40.2, 0.3, 40.9, 0.6)
    got = {x.door: x for x in swing.door_swing(spark.createDataFrame(leaves, LEAF), spark.createDataFrame(edges, EDGE), least=60.0).collect()}
    assert (got[1].max_open, got[1].passed, got[1].clear) == (90, True, pytest.approx(1 - 0.04))
    assert got[2].blockers == ["stop"] and got[2].max_open < 90 and not got[2].closed
    assert got[3].closed and got[3].max_open == 0 and not got[3].passed  # the leaf stands wholly inside, no edge near
    assert got[4].passed  # what is behind it does not hold it
    assert got[5].max_open is None and not got[5].passed
    none = spark.createDataFrame([], EDGE)
    assert {x.max_open for x in swing.max_open(spark.createDataFrame(leaves[:2], LEAF), none).collect()} == {90.0}
    assert swing.max_open(spark.createDataFrame([], LEAF), none).count() == 0
