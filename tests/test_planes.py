"""Tilted overlaps against clipping in plain Python."""

import math
import random

import pytest

from cairnframe.operators import level, planes

TRI = "mesh string, id long, " + ", ".join(f"{p}{x} double" for p in "abc" for x in "xyz")


def sub(p, q):
    return [a - b for a, b in zip(p, q, strict=True)]


def dot(p, q):
    return sum(a * b for a, b in zip(p, q, strict=True))


def cross(p, q):
    return [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]


def unit(p):
    n = math.sqrt(dot(p, p))
    return [a / n for a in p]


def clip(poly, tri):
    for (ax, ay), (bx, by) in zip(tri, tri[1:] + tri[:1]):
        out = []
        for p, q in zip(poly, poly[1:] + poly[:1]):
            s, t = ((bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in (p, q))
            if s >= 0:
                out.append(p)
            if (s >= 0) != (t >= 0):
                out.append((p[0] + s / (s - t) * (q[0] - p[0]), p[1] + s / (s - t) * (q[1] - p[1])))
        poly = out
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(poly, poly[1:] + poly[:1]))) / 2 if poly else 0.0


def test_overlaps_are_those_of_all_pairs(spark):
    r = random.Random(2)
    rows = []
    for i in range(140):
        n = unit(r.choice([[1, 1, 0.5], [1, 1, 0.5], [1, 1, 0.505], [-1, -1, -0.5], [0.2, -1, 1], [0, 0.004, 1]]))
        u = unit(cross(n, [0, 0, 1] if abs(n[2]) < 0.9 else [1, 0, 0]))
        v = cross(n, u)
        at = [n[k] * r.choice([1.0, 1.001, 1.0, 2.0]) + u[k] * r.uniform(-0.5, 0.5) + v[k] * r.uniform(-0.5, 0.5) for k in range(3)]
        pts = [[at[k] + s * (u[k] * math.cos(a) + v[k] * math.sin(a)) for k in range(3)] for s, a in ((r.uniform(0.1, 1), 0.1), (r.uniform(0.1, 1), 2.2), (r.uniform(0.1, 3), 4.3))]
        rows.append((f"m{i % 5}", i, *pts[0], *pts[1], *pts[2]))
    rows += [("flat", 900, *[0.0] * 9), ("thin", 901, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0), ("null", 902, None, *[1.0] * 8)]
    limit, want = math.cos(math.radians(1)), {}
    tris = []
    for m, i, *c in rows[:-3]:
        p = [c[0:3], c[3:6], c[6:9]]
        n = unit(cross(sub(p[1], p[0]), sub(p[2], p[0])))
        if max(map(abs, n)) < limit:
            tris.append(((m, i), p, n))
    for a, p, n in tris:
        for b, q, k in tris:
            if a < b and dot(n, k) >= limit and all(abs(dot(sub(x, p[0]), n)) <= 0.002 for x in q):
                u = unit(sub(p[1], p[0]))
                v = cross(n, u)
                flat = lambda pts: [(dot(sub(x, p[0]), u), dot(sub(x, p[0]), v)) for x in pts]  # noqa: B023, E731
                if (area := clip(flat(q), flat(p))) > 1e-9:
                    key = tuple(sorted((a[0], b[0])))
                    want[key] = want.get(key, 0.0) + area
    want = {k: v for k, v in want.items() if v > 1e-4}
    df = spark.createDataFrame(rows, TRI).repartition(3)
    for cell in (1.0,):
        got = {(x.a, x.b): x.area for x in planes.tilted_pairs(df, cell=cell).collect()}
        assert set(got) == set(want) and len(want) > 5
        assert all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-9) for k in want)
    assert planes.tilted_pairs(spark.createDataFrame([], TRI)).count() == 0


def test_planes_part_where_offsets_do(spark):
    """Chains of offsets go on over the edges of the blocks that share out the work."""
    r = random.Random(6)
    offsets = sorted([0.998 + k * 0.0015 for k in range(8)] + [r.uniform(-3, 3) for _ in range(300)] + [2.0, 2.0, 7.5])
    rows = [(f"m{i}", i, "x", 1, o, 0, 1, 0, 1) for i, o in enumerate(offsets)]
    df = spark.createDataFrame(rows, "mesh string, id long, axis string, facing int, offset double, u0 long, u1 long, v0 long, v1 long").repartition(5)
    got = {x.id: x.plane for x in level.with_planes(df, 0.002).collect()}
    plane, want = 0, {}
    for i, o in enumerate(offsets):
        plane += i > 0 and o - offsets[i - 1] > 0.002
        want[i] = plane
    assert got == want


def test_overlaps_are_clipped_in_batches(spark):
    """Pairs are not sent to all, and their areas are worked out a batch at a time: the plan has neither a broadcast of triangles nor a column function of polygons."""
    n = 60
    rows = [("m", i, float(i), 0.0, float(i), float(i + 2), 0.0, float(i + 2), float(i), 2.0, float(i)) for i in range(n)]
    found = planes.overlaps(planes.normals(spark.createDataFrame(rows, TRI)), cell=4.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan and "strategy=merge" in plan
    # A triangle moved by one has a quarter of its area in common with the one before; the plane rises, so areas grow by the root of 2.
    got = {(r.a, r.b): r.area for r in found.collect() if r.area > 1e-9}
    assert set(got) == {(i, i + 1) for i in range(n - 1)} and all(a == pytest.approx(math.sqrt(2) / 2) for a in got.values())
