"""The mesh around cells is closed and encloses their union."""

import random
from collections import Counter

from cairnframe.operators import cells

CELL = "mesh string, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double"


def test_faces_are_those_between_inside_and_outside(spark):
    r = random.Random(3)
    rows = []
    for m in range(4):
        for _ in range(9):
            x, y, z = (r.randrange(6) / 2 for _ in range(3))
            rows.append((f"m{m}", x, x + r.randrange(4) / 2, y, y + r.randrange(1, 4) / 2, z, z + r.randrange(1, 3) / 2))
    rows += [rows[0], ("one", 0.0, 1.0, 0.0, 1.0, 0.0, 1.0), ("flat", 0.0, 0.0, 0.0, 1.0, 0.0, 1.0), (None, 0.0, 2.0, 0.0, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, CELL).repartition(3)
    faces = cells.boundary(df, "mesh")
    tris = cells.triangles(faces, "mesh").collect()
    edges = Counter()
    for t in tris:
        p = [(t[f"{c}x"], t[f"{c}y"], t[f"{c}z"]) for c in "abc"]
        for a, b in zip(p, p[1:] + p[:1], strict=True):
            edges[t.mesh, a, b] += 1
    assert all(edges[m, b, a] == n for (m, a, b), n in edges.items())  # every edge is walked both ways alike
    units = {}
    for m, x0, x1, y0, y1, z0, z1 in rows:
        units.setdefault(m, set()).update((i, j, k) for i in range(int(2 * x0), int(2 * x1)) for j in range(int(2 * y0), int(2 * y1)) for k in range(int(2 * z0), int(2 * z1)))
    steps = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    want = {m: (len(u) / 8, sum((i + a, j + b, k + c) not in u for i, j, k in u for a, b, c in steps) / 4) for m, u in units.items() if u}
    got = {x.mesh: (round(x.volume, 9), round(x.area, 9)) for x in cells.volumes(cells.triangles(faces, "mesh"), "mesh").collect()}
    assert got == want
    assert cells.boundary(spark.createDataFrame([], CELL), "mesh").count() == 0
