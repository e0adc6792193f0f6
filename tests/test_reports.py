"""Sources, checks and reports."""

import json

import numpy as np
from pyspark.sql import functions as F

from cairnframe.plans import checks, reports
from cairnframe.sources import evidence, meshes


def test_checks_and_report(spark, tmp_path):
    faces = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]
    v, t = [], []
    for m, base, at, size, flip in (("box", 0, 0.0, 4.0, False), ("box", 100, 1.0, 2.0, True), ("beside", 0, 4.0, 1.0, False)):
        v += [(m, base + i, at + size * (i & 1), size * (i >> 1 & 1) + (1 if flip else 0), size * (i >> 2) + (1 if flip else 0)) for i in range(8)]
        t += [(m, base + i, base + a, base + (c if flip else b), base + (b if flip else c)) for i, (a, b, c) in enumerate(faces)]
    vertex = spark.createDataFrame(v, "mesh string, vid long, x double, y double, z double")
    tri = spark.createDataFrame(t, "mesh string, tid long, a long, b long, c long")
    topology = checks.mesh_topology(vertex, tri)
    assert topology.first().passed and json.loads(topology.first().detail)["cavities"] == 1  # a hollow box is sound
    assert not checks.mesh_topology(vertex, tri.where("tid <> 3")).first().passed
    assert checks.mesh_topology(vertex, tri.where("mesh <> 'beside' OR tid <> 3"), closed="box").first().passed
    assert checks.mesh_topology(vertex, tri, aggregate="box").first().passed and not checks.mesh_topology(vertex, tri, aggregate="none").first().passed
    assert not checks.mesh_topology(vertex, tri.where("mesh <> 'beside' OR tid <> 3"), closed="box", aggregate="beside").first().passed
    rooms = spark.createDataFrame([("a", 0.5, 0.25, 0.1, 3.9, None), ("v", 90.0, 0.0, 0.0, None, "void")], "name string, x double, y double, z double, expected double, kind string")
    assert checks.ceiling_height(vertex, tri, rooms).first().passed and not checks.ceiling_height(vertex, tri, rooms.where("kind = 'void'")).first().passed
    assert not checks.ceiling_height(vertex, tri, rooms.withColumn("expected", F.lit(None).cast("double"))).first().passed
    uv = checks.second_uv(spark.createDataFrame([("a", False, 2), ("b", True, 0)], "name string, collision boolean, uv_layers int"))
    unknown = topology.select(F.lit("later").alias("name"), F.lit(None).cast("boolean").alias("passed"), "detail")
    records = topology.unionByName(uv).unionByName(unknown)
    report = reports.quality_report(records, F.struct(F.lit(2).alias("meshes")), "test")
    r = report.first()
    assert r.passed and r.not_run == ["later"] and r.summary == {"mesh_topology": True, "uv2": True, "later": None}
    reports.write_report(report, str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report")).first().value)["summary"]["later"] is None
    assert reports.result_line(report).first().line.startswith('QA_RESULT {"passed":true') and reports.exit_code(report) == 0
    assert reports.exit_code(report.withColumn("passed", F.lit(False))) == 1 and reports.exit_code(report.where("false")) == 2


def test_profiles_sidecars_and_cases(spark, tmp_path):
    (tmp_path / "profiles").mkdir()
    (tmp_path / "profiles" / "tower.json").write_text(json.dumps({"family": "tower", "wall": {"rgb": [[1, 2, 3]], "tol": 9}}))
    assert evidence.read_profile(spark, "tower", str(tmp_path / "profiles")).first().wall.tol == 9
    try:
        evidence.read_profile(spark, "nowhere", str(tmp_path))
        raise AssertionError("found a profile that is not there")
    except FileNotFoundError:
        pass
    (tmp_path / "a.png.json").write_text(json.dumps({"page": 3, "dpi": 200, "px_per_pt": 2.5}))
    side = evidence.read_json(spark, str(tmp_path / "a.png.json"), evidence.SIDECAR)
    images = spark.createDataFrame([(side.first().source.removesuffix(".json"),), ("b.png",)], "path string")
    assert {r.path[-5:]: r.page for r in evidence.with_sidecars(images, side).collect()} == {"a.png": 3, "b.png": None}
    for name in ("two", "one"):
        (tmp_path / "cases" / name).mkdir(parents=True)
        (tmp_path / "cases" / name / "source.json").write_text(json.dumps({"family": "f", "expect": {"scale_passed": name == "one"}}))
    (tmp_path / "cases" / "empty").mkdir()
    assert [(r.folder, r.expect.scale_passed) for r in evidence.read_cases(spark, str(tmp_path / "cases")).collect()] == [("one", True), ("two", False)]


def test_meshes_and_markers(spark, tmp_path):
    np.savez(tmp_path / "m.npz", V=np.zeros((4, 3)), F=np.array([[0, 1, 2], [1, 2, 3]]), labels=np.array(["wall a", "door"]))
    assert meshes.read_npz(spark, str(tmp_path / "m.npz"))[1].count() == 2 and [r.a for r in meshes.read_npz(spark, str(tmp_path / "m.npz"), "door")[1].collect()] == [1]
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\nf -3 -2 -1\n")
    tri = meshes.read_obj(spark, str(tmp_path / "m.obj"))[1].collect()
    assert sorted((r.a, r.b, r.c) for r in tri) == [(0, 1, 2), (0, 2, 3), (1, 2, 3)] and len({r.tid for r in tri}) == 3
    objects = spark.createDataFrame([("DOOR_1", "EMPTY", 1.0, 2.0, 3.0, 0.5, {"w": "1"}), ("DOOR_2", "MESH", 0.0, 0.0, 0.0, 0.0, None), ("LAMP", "EMPTY", 0.0, 0.0, 0.0, 0.0, None)], "name string, type string, x double, y double, z double, yaw double, properties map<string,string>")
    assert [r.name for r in meshes.placed_markers(None, objects).collect()] == ["DOOR_1"]
    (tmp_path / "manifest.json").write_text(json.dumps({"files": [{"path": "a\\B.fbx", "markers": [{"name": "ROOM_1", "position_m": [1, 2, 3]}]}]}))
    manifest = meshes.read_manifest(spark, str(tmp_path / "manifest.json"))
    m = meshes.placed_markers(manifest, objects).collect()
    assert [(r.name, r.x, r.yaw, r.origin, r.properties) for r in m] == [("ROOM_1", 1.0, 0.0, "manifest", {})]
    vertex = spark.createDataFrame([("a", 0, 1.0, 2.0, 3.0), ("b", 0, 1.0, 2.0, 3.0)], "mesh string, vid long, x double, y double, z double")
    placed = spark.createDataFrame([("a", [[0.0, -1.0, 0.0, 10.0], [1.0, 0.0, 0.0, 20.0], [0.0, 0.0, 2.0, 0.0]])], "mesh string, m array<array<double>>")
    assert sorted((r.mesh, r.x, r.y, r.z) for r in meshes.in_world(vertex, placed).collect()) == [("a", 8.0, 21.0, 6.0), ("b", 1.0, 2.0, 3.0)]
