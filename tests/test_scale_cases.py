"""Seven measured plans whose scale is known to hold or not, and lengths as people write them."""

import pytest
from pyspark.sql import functions as F

from cairnframe.functions import measures
from cairnframe.operators import scale

# Kind, axis, pixels (of an area: square pixels) and metres (square metres, or as written) of each item.
CASES = {
    "a": [("dim", "x", 292.0, 3.9624), ("dim", "y", 353.35, 4.826), ("dim", "x", 447.0, 6.0706), ("dim", "y", 535.0, 7.2898), ("dim", "x", 245.0, 3.302), ("dim", "y", 333.0, 4.5466), ("dim", "x", 249.5, 3.429), ("dim", "y", 202.0, 2.7432), ("dim", "x", 153.0, 2.1336), ("dim", "y", 125.0, 1.6764), ("dim", "x", 136.0, 1.905), ("dim", "y", 463.0, 6.2992), ("dim", "x", 426.0, 5.7912), ("dim", "y", 158.0, 2.0066), ("dim", "x", 208.0, 2.7178), ("dim", "y", 165.0, 2.2352)],
    "b": [("dim", "x", 145.5, 4.5), ("dim", "y", 183.0, 5.7), ("dim", "x", 143.42, 4.4), ("dim", "y", 154.89, 4.8), ("area", None, 232473.3, "239 m2"), ("area", None, 232473.3, "2,570 sq ft")],
    "c": [("area", None, 136052.3, "59.88 m2"), ("dim", "x", 131.0, 3.7), ("dim", "x", 124.0, 2.4), ("dim", "x", 143.0, 3.0), ("dim", "x", 398.0, 9.1), ("dim", "x", 194.0, 4.9), ("dim", "x", 204.0, 4.2), ("dim", "x", 398.0, 9.1), ("dim", "y", 75.0, 1.5), ("dim", "y", 116.0, 2.4), ("dim", "y", 84.0, 1.7), ("dim", "y", 161.0, 3.3), ("dim", "y", 57.0, 1.2), ("dim", "y", 26.0, 0.5), ("dim", "y", 519.0, 10.6), ("dim", "y", 117.0, 2.3), ("dim", "y", 114.0, 2.4), ("dim", "y", 226.0, 4.6), ("dim", "y", 82.0, 1.7), ("dim", "y", 539.0, 11.0)],
    "d": [("area", None, 197146.5, "206.89 m2"), ("fixture", "y", 29.0, 0.9), ("fixture", "x", 30.0, 0.9), ("fixture", "y", 27.0, 0.8)],
    "e": [("bar", "x", 384.0, 6.096), ("dim", "x", 518.6, 7.62), ("dim", "y", 296.0, 4.2672), ("dim", "x", 299.1, 4.4958), ("dim", "y", 271.5, 3.937), ("dim", "x", 459.9, 6.7056), ("dim", "y", 255.5, 3.6576), ("dim", "x", 327.5, 4.7244), ("dim", "y", 228.0, 3.3528), ("dim", "y", 448.0, 6.604), ("dim", "x", 644.0, 9.4488), ("area", None, 2147093.0, "427 m2")],
    "f": [("area", None, 819840.5, "107.68 m2"), ("dim", "x", 547.0, 6.65), ("dim", "y", 472.0, 5.58), ("dim", "x", 347.0, 4.24), ("dim", "y", 357.0, 4.19)],
    "g": [("area", None, 1800218.0, "79.62 m2"), ("area", None, 1800218.0, "857 sq ft"), ("fixture", "x", 153.0, 1.0), ("fixture", "x", 347.0, 2.2)],
}
# Scale, strong kinds, number of outliers, largest deviation, x over y, and whether it holds.
WANT = {"a": (0.013588, 1, 3, 0.0653, 0.9996, False), "b": (0.031069, 2, 0, 0.0320, 0.9915, True), "c": (0.020639, 2, 7, 0.3685, 1.1199, False), "d": (0.032395, 1, 0, 0.0854, None, False), "e": (0.014626, 3, 1, 0.0854, 1.0125, False), "f": (0.011822, 2, 1, 0.0336, 1.0347, False), "g": (0.006650, 1, 0, 0.0467, None, False)}
SCHEMA = "case string, kind string, axis string, px double, m_per_px double, tol double"


def test_verdicts(spark):
    rows = [(c, k, a, px, str(m)) for c, items in CASES.items() for k, a, px, m in items]
    raw = spark.createDataFrame(rows, "case string, kind string, axis string, size double, written string")
    area = F.col("kind") == "area"
    items = raw.select("case", "kind", "axis", F.when(~area, F.col("size")).alias("px"), F.when(area, F.sqrt(measures.area_m2(F.col("written")) / F.col("size"))).otherwise(measures.length_m(F.col("written")) / F.col("size")).alias("m_per_px"), F.lit(None).cast("double").alias("tol"))
    got = {r["case"]: r for r in scale.scale_estimate(items).collect()}
    for c, (m, kinds, outliers, most, ratio, passed) in WANT.items():
        r = got[c]
        assert abs(r.m_per_px - m) < 1e-6 and (r.strong_kinds, r.outliers, r.passed) == (kinds, outliers, passed)
        assert abs(r.max_deviation - most) < 1e-4 and (ratio is None) == (r.x_over_y is None) and (ratio is None or abs(r.x_over_y - ratio) < 1e-4)
    assert got["c"].anisotropic and not any(r.anisotropic for c, r in got.items() if c != "c")


def test_kinds_have_their_tolerances(spark):
    base = [("t", "dim", "x", 1000.0, 0.01, None)] * 3
    off = lambda kind, by, px=1000.0, tol=None: scale.scale_estimate(spark.createDataFrame([*base, ("t", kind, None, px, 0.01 * by, tol)], SCHEMA)).first().outliers
    assert off("pt", 1.02, None) == 1 and off("pt", 1.009, None) == 0 and off("pt", 1.02, 26.0) == 1  # a vector's scale is not measured in pixels
    assert off("fixture", 1.14) == 0 and off("fixture", 1.16) == 1
    assert off("bar", 1.07, 26.0) == 0 and off("bar", 1.03, 26.0, 0.02) == 1
    weak = scale.scale_estimate(spark.createDataFrame([("w", "fixture", "x", 30.0, m, None) for m in (0.01, 0.011, 0.02)], SCHEMA)).first()
    assert weak.m_per_px == 0.011 and weak.outliers == 1 and weak.strong_kinds == 0
    with pytest.raises(Exception, match="unknown kind"):
        scale.scale_estimate(spark.createDataFrame([("u", "guess", None, 1.0, 1.0, None)], SCHEMA)).collect()
    assert scale.scale_estimate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suite(spark):
    v = spark.createDataFrame([("a", True), ("b", False)], "case string, passed boolean")
    row = lambda c, want, clip: (c, want, 1, 300, 10, 20, None, [1.0, 2.00001], 1, 300, 10, 20, None, clip)
    names = ["page long", "dpi long", "width long", "height long", "drop_text string", "clip array<double>"]
    e = spark.createDataFrame([row("a", True, [1.0, 2.0]), row("b", True, [1.0, 2.0]), row("b", False, [1.0, 2.1]), row("z", True, [1.0, 2.0])], "case string, passed_expected boolean, " + ", ".join(names) + ", " + ", ".join(f"was_{n}" for n in names))
    assert [(r["case"], r.same_render, r.ok) for r in scale.suite(v, e).orderBy("case", "same_render").collect()] == [("a", True, True), ("b", False, False), ("b", True, False), ("z", True, None)]


def test_lengths_and_areas(spark):
    foot, inch = 0.3048, 0.0254
    lengths = {"12'-6\"": 3.81, "3810 mm": 3.81, "12'-6": 3.81, "12'-6''": 3.81, "12' 6 1/2\"": 12 * foot + 6.5 * inch, "12'": 12 * foot, "12’": 12 * foot, '6"': 6 * inch, "6″": 6 * inch, "10 ft": 10 * foot, "10 FEET": 10 * foot, "381 cm": 3.81, "3.81": 3.81, " 7 in ": 7 * inch, "-3 m": None, "3 km": None, "": None, "1/2": None, "12'-": 12 * foot, "x 12'": None, "12' x": None, None: None, "3.": None, "6 1/2\"": None}
    areas = {"795 sq ft": 795 * foot * foot, "795 square feet": 795 * foot * foot, "73.9 sq m": 73.9, "73.9 m2": 73.9, "2,559 SQ.FT": 2559 * foot * foot, "40": 40.0, "40 sqm2": 40.0, "40 sf": 40 * foot * foot, "40 acres": None, "-4": None, "": None, None: None, "m2": None}
    for texts, f in ((lengths, measures.length_m), (areas, measures.area_m2)):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", f(F.col("t")).alias("v")).collect()
        for r in got:
            assert (r.v is None) == (texts[r.t] is None) and (r.v is None or abs(r.v - texts[r.t]) < 1e-9), r


def test_joins_with_tables_that_grow_are_merged(spark, tmp_path):
    """Whatever the files' size, none of these tables is sent to the driver and from there to all."""
    from cairnframe.operators import level

    rooms = spark.createDataFrame([(1, 0.0, 0.0, 0.0, "a"), (2, 9.0, 9.0, 0.0, "void"), (3, 50.0, 0.0, 0.0, None)], "id long, x double, y double, z double, kind string")
    places = spark.createDataFrame([(7, 1.0, 0.0, 0.0, True), (8, 0.5, 0.0, 0.0, False), (9, -1.0, 0.0, 0.0, True)], "pid long, x double, y double, h double, main boolean")
    for name, t in (("rooms", rooms), ("places", places)):  # tables of files are small enough to be sent, those of rows are of unknown size
        t.write.parquet(str(tmp_path / name))
    found = level.rooms_reached(*[spark.read.parquet(str(tmp_path / name)) for name in ("rooms", "places")], 0.5, 3.0)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.distance, r.reachable) for r in found.collect()} == {(1, 1.0, True), (2, None, None), (3, None, False)}


def test_ceilings_are_merged(spark, tmp_path):
    from cairnframe.plans import checks

    vertex = spark.createDataFrame([(0, k, x, y, 3.0) for k, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)])], "mesh int, vid int, x double, y double, z double")
    tables = {"vertex": vertex, "tri": spark.createDataFrame([(0, 0, 0, 1, 2)], "mesh int, tid int, a int, b int, c int"), "rooms": spark.createDataFrame([(1, 1.0, 1.0, 0.5), (2, 9.0, 1.0, 0.5)], "name int, x double, y double, z double")}
    for name, t in tables.items():
        t.write.parquet(str(tmp_path / name))
    found = checks.ceilings(*[spark.read.parquet(str(tmp_path / name)) for name in tables])
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.name, r.height) for r in found.collect()} == {(1, 2.5), (2, None)}
