import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnframe.functions import measures
from cairnframe.operators import components, mesh, predicates, raster, scale, sequences, spatial, walk
from cairnframe.plans import checks
from cairnframe.sources import evidence, meshes

CUBE = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
FACES = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def solids(spark, *shapes):
    """vertex and tri tables of (name, scale, lift, faces)."""
    v = [(n, i, float(x * s), float(y * s), float(z * s + up)) for n, s, up, _ in shapes for i, (x, y, z) in enumerate(CUBE)]
    t = [(n, i, *f) for n, _, _, faces in shapes for i, f in enumerate(faces)]
    return spark.createDataFrame(v, "mesh string, vid long, x double, y double, z double"), spark.createDataFrame(t, "mesh string, tid long, a long, b long, c long")


def test_lengths_and_areas(spark):
    cases = {"12'6\"": 3.81, "5' 3 1/2\"": 5 * 0.3048 + 3.5 * 0.0254, "9’": 9 * 0.3048, "30″": 0.762, "3.2 m": 3.2, "3200mm": 3.2, "10 ft": 3.048, "4": 4.0, "about 3": None, "": None, None: None}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", measures.length_m(F.col("t")).alias("m")).collect()
    for r in rows:
        assert r.m == (None if cases[r.t] is None else pytest.approx(cases[r.t]))
    areas = {"79.62 m2": 79.62, "1,857 sq ft": 1857 * 0.3048**2, "80": 80.0, "large": None}
    for r in spark.createDataFrame([(t,) for t in areas], "t string").select("t", measures.area_m2(F.col("t")).alias("m")).collect():
        assert r.m == (None if areas[r.t] is None else pytest.approx(areas[r.t]))


def test_evidence_from_json(spark, tmp_path):
    items = [{"kind": "dim", "p0": [0, 0], "p1": [1000, 0], "length": "10 m"}, {"kind": "dim", "p0": [0, 0], "p1": [0, 500], "length": 5.0}, {"kind": "area", "polygon": [[0, 0], [100, 0], [100, 100], [0, 100]], "area": "1 m2"}, {"kind": "bar", "px": 100, "length": "1.5 m"}]
    (tmp_path / "a.json").write_text(json.dumps({"image": "a.png", "items": items}))
    (tmp_path / "b.json").write_text(json.dumps({"image": "b.png", "items": items[:3]}))
    got = {r.case.rsplit("/", 1)[1]: r for r in scale.scale_estimate(evidence.read_evidence(spark, str(tmp_path))).collect()}
    assert got["b.json"].passed and got["b.json"].m_per_px == pytest.approx(0.01)
    assert not got["a.json"].passed and got["a.json"].outliers == 1


def test_alignment_and_circle(spark):
    pairs = [("c", "x", 2 * b + 3, b) for b in (0.0, 1.0, 5.0)] + [("c", "y", 2 * b - 7, b) for b in (2.0, 9.0)]
    for r in scale.alignment(spark.createDataFrame(pairs, "case string, axis string, a double, b double")).collect():
        assert r.slope == pytest.approx(2) and r.intercept == pytest.approx(3 if r.axis == "x" else -7) and r.rms < 1e-9
    ring = [("r", 5 + 2 * math.cos(a), -3 + 2 * math.sin(a)) for a in (0, 1, 2, 4, 5)]
    r = scale.circle_fit(spark.createDataFrame(ring, "case string, x double, y double")).first()
    assert (r.cx, r.cy, r.r) == pytest.approx((5, -3, 2)) and r.max_off < 1e-9


def test_intervals(spark):
    a = spark.createDataFrame([("c", 0, 10), ("c", 5, 12), ("c", 20, 30), ("d", 0, 1)], "col string, lo int, hi int")
    b = spark.createDataFrame([("c", 3, 4), ("c", 11, 25)], "col string, lo int, hi int")
    rows = lambda df: sorted((r.col, r.lo, r.hi) for r in df.collect())
    assert rows(sequences.merged(a, "col")) == rows(sequences.sweep(a, "col")) == [("c", 0, 12), ("c", 20, 30), ("d", 0, 1)]
    assert rows(sequences.subtracted(a, b, "col")) == [("c", 0, 3), ("c", 4, 11), ("c", 25, 30), ("d", 0, 1)]
    assert sorted((r.col, r.z, r.rank) for r in sequences.headroom(sequences.merged(a, "col"), "col", 9).collect()) == [("c", 30, 0), ("d", 1, 0)]
    assert sorted((r.col, r.z, r.rank) for r in sequences.headroom(sequences.merged(a, "col"), "col", 8).collect()) == [("c", 12, 0), ("c", 30, 1), ("d", 1, 0)]


def test_mesh_queries(spark):
    vertex, tri = solids(spark, ("cube", 1, 0, FACES), ("open", 1, 0, FACES[2:]), ("inside_out", 1, 0, [(a, c, b) for a, b, c in FACES]))
    stats = {r.mesh: r for r in mesh.edge_stats(tri).collect()}
    assert stats["cube"].nonmanifold == 0 and stats["open"].boundary == 4
    areas = {r.mesh: r for r in mesh.area_stats(mesh.corners(vertex, tri)).collect()}
    assert areas["cube"].area == pytest.approx(6) and abs(areas["cube"].volume) == pytest.approx(1) and areas["cube"].volume == pytest.approx(-areas["inside_out"].volume)
    assert sum(r["count"] for r in mesh.islands(vertex, tri).groupBy("mesh", "island").count().collect()) == 24
    assert mesh.boundary_twins(tri).where("mesh = 'open'").count() == 4
    section = mesh.plane_section(vertex, tri, 0.5).where("mesh = 'cube'")
    assert section.selectExpr("sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))) AS l").first().l == pytest.approx(4)
    assert mesh.welded(vertex, tri.where("mesh != 'open'"), 0.01).count() == 24


def test_checks_and_report(spark):
    good = FACES if mesh.area_stats(mesh.corners(*solids(spark, ("cube", 1, 0, FACES)))).first().volume > 0 else [(a, c, b) for a, b, c in FACES]
    vertex, tri = solids(spark, ("cube", 1, 0, good))
    high = solids(spark, ("cube", 1, 2, good))
    rooms = spark.createDataFrame([("r", 0.3, 0.6, 0.5, 0.5)], "name string, x double, y double, z double, expected double")
    records = [checks.mesh_topology(vertex, tri), checks.floating(vertex, tri), checks.ceiling_height(vertex, tri, rooms)]
    assert [r.first().passed for r in records] == [True, True, True]
    assert not checks.floating(*high).first().passed
    assert not checks.ceiling_height(vertex, tri, rooms.withColumn("expected", F.lit(0.6))).first().passed
    assert checks.floating(vertex.where("false"), tri.where("false")).first().passed is None
    out = checks.report([*records, checks.floating(vertex.where("false"), tri.where("false")).withColumn("name", F.lit("other"))]).first()
    assert out.passed and out.ran == 3 and out.not_run == "other"


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 30))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_masks_against_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.random((12, 15)) < 0.7
    mask = spark.createDataFrame([(1, int(y), int(x)) for y, x in np.argwhere(m)], "img int, y int, x int")
    padded = np.pad(m, 1, constant_values=True)
    want = m & padded[:-2, 1:-1] & padded[2:, 1:-1] & padded[1:-1, :-2] & padded[1:-1, 2:]
    assert sorted((r.y, r.x) for r in raster.eroded(mask, height=12, width=15).collect()) == [tuple(map(int, p)) for p in np.argwhere(want)]
    labels = {}
    for r in raster.labelled(mask).collect():
        for x in range(r.lo, r.hi + 1):
            labels[r.y, x] = r.label
    for y, x in labels:
        for n in ((y + 1, x), (y, x + 1)):
            assert n not in labels or labels[n] == labels[y, x]
    assert raster.iou(mask, mask).first().iou == 1.0


def test_joins_against_brute_force(spark):
    rng = np.random.default_rng(1)
    boxes = [(i, *map(float, (x, x + w, y, y + h))) for i, (x, y, w, h) in enumerate(zip(*rng.random((4, 60)) * np.array([[20], [20], [4], [4]]), strict=True))]
    got = {(r.a_id, r.b_id) for r in spatial.self_pairs(spark.createDataFrame(boxes, "id int, x0 double, x1 double, y0 double, y1 double"), cell=3.0).collect()}
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2] and a[3] <= b[4] and b[3] <= a[4]}
    assert got == want


def test_walk(spark):
    slabs = [(0, 0, 0, 1), (1, 0, 0, 1), (2, 0, 0, 3), (3, 0, 0, 3), (3, 0, 4, 5)]
    places = walk.standing(spark.createDataFrame(slabs, "i int, j int, lo int, hi int"), 2)
    got = {(r.i, r.z): r.region.i for r in walk.regions(places, 1, 2).collect()}
    assert got == {(0, 1): 0, (1, 1): 0, (2, 3): 2, (3, 5): 3}


def test_names_and_verdicts(spark):
    names = spark.createDataFrame([("L1_Wall",), ("L1_A_Wall",), ("L10_Wall",), ("Other",)], "name string")
    floors = spark.createDataFrame([("L1",), ("L1_A",)], "floor string")
    assert {r.name: r.floor for r in predicates.floor_of(names, floors).collect()} == {"L1_Wall": "L1", "L1_A_Wall": "L1_A", "L10_Wall": None, "Other": None}
    assert not predicates.verdict(spark.createDataFrame([("a", None)], "name string, passed boolean")).first().passed


def test_mesh_files(spark, tmp_path):
    (tmp_path / "quad.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\nf -4 -3 -2\n")
    vertex, tri = meshes.read_obj(spark, str(tmp_path / "quad.obj"))
    assert vertex.count() == 4 and sorted((r.a, r.b, r.c) for r in tri.collect()) == [(0, 1, 2), (0, 1, 2), (0, 2, 3)]
    np.savez(tmp_path / "cube.npz", V=np.array(CUBE, float), F=np.array(FACES))
    vertex, tri = meshes.read_npz(spark, str(tmp_path / "cube.npz"))
    assert mesh.edge_stats(tri).first().nonmanifold == 0 and vertex.count() == 8
