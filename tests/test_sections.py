"""Sections and footprints of known solids, and how they stop a door."""

import pytest
from pyspark.sql import functions as F

from cairnframe.operators import sections, swing

TRI = "mesh string, island long, " + ", ".join(f"{p}{x} double" for p in "abc" for x in "xyz")
BOX = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]


def solid(mesh, island, points, faces, inward=False):
    return [(mesh, island, *points[a], *points[c if inward else b], *points[b if inward else c]) for a, b, c in faces]


def box(mesh, island, x0, x1, y0, y1, z0, z1, inward=False):
    return solid(mesh, island, [(float(x), float(y), float(z)) for z in (z0, z1) for y in (y0, y1) for x in (x0, x1)], BOX, inward)


def rows():
    tip = solid("tip", 0, [(0.0, 0.0, 0.0), (3.0, 0.0, 0.0), (0.0, 3.0, 0.0), (0.0, 0.0, 3.0)], [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)])
    return box("room", 0, 0, 4, 0, 4, 0, 3) + box("room", 1, 1, 2, 1, 2, 1, 2, True) + tip + [("flat", 0, *[1.0] * 9), ("null", 0, None, *[0.0] * 8)]


def test_sections_by_several_planes(spark):
    t = spark.createDataFrame(rows(), TRI).repartition(3)
    planes = t.select("mesh", "island", F.explode(F.array(*map(F.lit, (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 7.0)))).alias("z")).distinct()
    for cell in (1.0, 0.3):
        got = {(x.mesh, x.island, x.z): (x.area, x.length) for x in sections.section_areas(sections.sections(t, planes, cell)).collect()}
        for z in (0.5, 1.0, 1.5, 2.0, 2.5, 3.0):
            assert got["room", 0, z] == pytest.approx((16, 16))
        assert {k[2] for k in got if k[:2] == ("room", 1)} == {1.5, 2.0} and got["room", 1, 1.5] == pytest.approx((-1, 4))
        for z in (0.5, 1.0, 1.5, 2.0, 2.5):
            assert got["tip", 0, z][0] == pytest.approx((3 - z) ** 2 / 2, abs=1e-6)
        assert not [k for k in got if k[0] in ("flat", "null") or k[2] in (0.0, 7.0)]


def test_segments_join_up(spark):
    t = spark.createDataFrame(rows(), TRI)
    cut = sections.sections(t, t.select("mesh", "island", F.lit(0.7).alias("z")).distinct()).collect()
    starts, ends = sorted((x.mesh, x.x0, x.y0) for x in cut), sorted((x.mesh, x.x1, x.y1) for x in cut)
    assert starts == ends and len(starts) > 8


def test_slabs_and_footprints_stop_doors(spark):
    t = spark.createDataFrame(rows(), TRI)
    got = sorted((x.mesh, x.island, round(x.z0, 6), round(x.z1, 6), round(x.z, 6)) for x in sections.slabs(t, 0.5, 2.5).collect())
    assert [g for g in got if g[0] == "room"] == [("room", 0, 0.5, 2.5, 1.5), ("room", 1, 1.0, 2.0, 1.5)]
    assert [g[4] for g in got if g[0] == "tip"] == [round(0.5 + 2 * s, 6) for s in (1 / 6, 0.5, 5 / 6)]
    post = spark.createDataFrame(box("post", 0, 0.4, 0.6, 0.5, 0.7, 0, 3) + box("lamp", 0, 0.0, 2.0, 0.1, 2.0, 2.2, 3), TRI)
    leaf = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, -0.02, 0.02, 0.0, 2.0)], "id int, hx double, hy double, ex double, ey double, sx double, sy double, near double, far double, z0 double, z1 double")
    (r,) = swing.max_open(leaf, sections.footprints(post, 0.0, 2.5)).collect()
    assert r.blocker.mesh == "post" and 30 < r.max_open < 60 and not r.closed
    assert sections.footprints(spark.createDataFrame([], TRI), 0.0, 1.0).count() == 0
