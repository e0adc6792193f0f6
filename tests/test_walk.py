"""Room to stand, cell by cell, and the heights at which it is judged."""

import random

from cairnframe.operators import level, walk


def test_standable(spark):
    r = random.Random(2)
    solids = [(i, j, 0.0, 1.0 + r.choice((0, 0, 0, 0.0004, 0.2, 0.6))) for i in range(12) for j in range(12) if r.random() < 0.95]
    solids += [(i, j, hi + r.choice((1.0, 2.05, 3.0)), hi + 4.0) for i, j, _, hi in solids if r.random() < 0.2]
    df = spark.createDataFrame(solids, "i long, j long, lo double, hi double").repartition(3)
    places = walk.standing(df, 2.0).cache()
    of, feet = {}, {}
    for i, j, lo, hi in solids:
        of.setdefault((i, j), []).append((lo, hi))
    rows = [(p.i, p.j, p.z) for p in places.collect()]
    for i, j, z in rows:
        feet.setdefault((i, j), []).append(z)
    levels = sorted({round(z * 1000) for _, _, z in rows})
    want = set()
    for i, j, z in rows:
        h = max(k / 1000 for k in levels if abs(z - k / 1000) < 6e-4)
        near = [(i + a, j + b) for a in range(-3, 4) for b in range(-3, 4) if a * a + b * b < 1.9**2]
        if all(any(abs(y - h) <= 0.3 for y in feet.get(c, [])) and not any(lo < h + 2 - 1e-6 and hi > h + 0.3 + 1e-6 for lo, hi in of[c]) for c in near):
            want.add((i, j, z))
    got = walk.standable(places, df, 1.4, 2.0, 0.3, 1.0).collect()
    assert want and {(p.i, p.j, p.z) for p in got} == want and len(got) == len(want)
    assert walk.standable(places.where("false"), df, 1.4, 2.0, 0.3, 1.0).count() == 0


def test_heights_go_to_the_highest_near(spark):
    df = spark.createDataFrame([(0, 0, 1.00045), (0, 1, 1.001), (0, 2, 0.9996), (0, 3, 2.0)], "i long, j long, z double")
    assert {p.j: p.mm for p in walk.heights(df).collect()} == {0: 1001, 1: 1001, 2: 1000, 3: 2000}


def test_storey_links(spark):
    cells = [(0, 0, 0.0, True), (0, 0, 3.0, True), (1, 0, 0.0, True), (1, 0, -3.0, False), (2, 0, -3.0, True), (0, 0, None, True), (0, 0, 6.0, None)]
    df = spark.createDataFrame(cells, "i long, j long, h double, main boolean")
    got = lambda t, stack: {x.storey: x.linked for x in level.storey_links(t, 0.0, 3.0, stack).collect()}
    assert got(df, [0, 1, -1, 2]) == {1: True, -1: False, 2: False}
    assert got(df.where("false"), [1]) == {1: False} and got(df, []) == {}
    rooms, doors = spark.createDataFrame([(True,), (None,)], "reachable boolean"), spark.createDataFrame([(True, 2), (False, 0)], "required boolean, reachable long")
    whole = lambda stack: level.reachability(rooms, doors, level.F.lit(False), level.storey_links(df, 0.0, 3.0, stack)).first()
    assert (whole([1]).unlinked, whole([1]).passed, whole([1, -1]).unlinked, whole([1, -1]).passed) == (0, True, 1, False)
