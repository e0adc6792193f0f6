"""Edges that snap: against all pairs, and in a plan whose tasks do not grow with the tables."""

import random

from cairnframe.operators import matching

RECT = "x0 double, y0 double, x1 double, y1 double"


def brute(rects, below, tol, margin, least):
    out = {}
    for name, *r in rects:
        new, moved = list(r), 0
        for k in range(4):
            lo, hi = (r[1], r[3]) if k % 2 == 0 else (r[0], r[2])
            near = [(abs(b[m] - r[k]), b[m]) for b in below for m in (k % 2, k % 2 + 2) if (b[1 - k % 2 + 2] >= lo - margin and b[1 - k % 2] <= hi + margin and abs(b[m] - r[k]) <= tol)]
            if near and min(near)[0] > 1e-9:
                new[k], moved = min(near)[1], moved + 1
        wide = new[2] - new[0] >= least and new[3] - new[1] >= least
        out[name] = (*new, moved) if wide else (*r, 0)
    return out


def test_snapped_against_all_pairs(spark):
    r = random.Random(4)
    rect = lambda: (x := r.randrange(-80, 200) / 2, y := r.randrange(-80, 200) / 2, x + r.randrange(2, 40) / 2, y + r.randrange(2, 40) / 2)
    rects, below = [(i, *rect()) for i in range(150)], [rect() for _ in range(40)]
    want = brute(rects, below, 2.0, 40.0, 4.0)
    got = matching.snapped(spark.createDataFrame(rects, f"name long, {RECT}"), spark.createDataFrame([*below, (None, None, None, None)], RECT), 2.0)
    assert {x.name: (x.x0, x.y0, x.x1, x.y1, x.moved) for x in got.collect()} == want and len({v[4] for v in want.values()}) > 2
    assert matching.snapped(spark.createDataFrame(rects, f"name long, {RECT}"), spark.createDataFrame([], RECT), 2.0).where("moved > 0").isEmpty()
    plan = got._jdf.queryExecution().toString()
    # Neither all that lies below in one place, nor all meetings of edges sorted to find the nearest.
    assert "BroadcastHashJoin [axis" not in plan and "SortAggregate" not in plan and "REPARTITION_BY_NUM" in plan
