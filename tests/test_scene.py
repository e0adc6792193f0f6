"""World matrices against numpy, along chains, loops and what is missing."""

import random

import numpy as np

from cairnframe.operators import scene

OBJECT = "name string, parent string, type string, matrix array<double>"


def test_world(spark):
    r = random.Random(5)
    rows = {}
    for i in range(60):
        parent = None if i in (0, 20) else f"o{max(0, i - 1 - (i % 7 == 0) * 2)}"
        rows[f"o{i}"] = (f"o{i}", parent, "MESH", [r.uniform(-1, 1) for _ in range(12)])
    rows["stray"] = ("stray", "nobody", "EMPTY", rows["o3"][3])
    odd = [("loop", "back", "MESH", [1.0] * 12), ("back", "loop", "MESH", [1.0] * 12), ("under", "loop", "MESH", [1.0] * 12), ("self", "self", "MESH", [1.0] * 12), ("bare", None, "MESH", None), ("short", None, None, [1.0]), ("child", "bare", "MESH", [1.0] * 12)]
    got = {x.name: x.matrix for x in scene.world(spark.createDataFrame([*rows.values(), *odd], OBJECT).repartition(3)).collect()}
    assert {o[0] for o in odd} == {n for n, m in got.items() if m is None}
    full = lambda m: np.vstack([np.array(m).reshape(3, 4), [0, 0, 0, 1]])
    for name in rows:
        want, at = np.eye(4), name
        while at in rows:
            want, at = full(rows[at][3]) @ want, rows[at][1]
        assert np.allclose(full(got[name]), want, rtol=1e-9, atol=1e-9), name
    assert scene.world(spark.createDataFrame([], OBJECT)).count() == 0


def test_scales(spark):
    eye = [1.0, 0, 0, 5.0, 0, 1.0, 0, 6.0, 0, 0, 1.0, 7.0]
    mirrored = [-1.0, *eye[1:]]
    rows = [("a", None, "MESH", eye), ("b", None, "LIGHT", eye), ("c", None, "EMPTY", mirrored), ("d", None, None, [2 * x for x in eye]), ("e", None, "MESH", None)]
    df = spark.createDataFrame([(n, p, t, m and [float(x) for x in m]) for n, p, t, m in rows], OBJECT)
    assert {x.name: (x.sx, x.sy, x.sz) for x in scene.scales(df).collect()} == {"a": (1, 1, 1), "b": (1, 1, 1), "c": (-1, -1, -1), "d": (2, 2, 2), "e": (None, None, None)}
    assert tuple(scene.sound(df).first()) == (2, 3, 1, False)
    assert tuple(scene.sound(df.where("name = 'a'")).first()) == (0, 0, 0, True)
    assert tuple(scene.sound(df.where("false")).first()) == (0, 0, 0, True)
