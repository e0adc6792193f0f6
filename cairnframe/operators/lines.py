"""Shape of outlines: short edges, skew, jogs, curves drawn as chords, and the directions that lines keep to."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnframe.functions.measures import align_shifts, angle_180, angle_apart
from cairnframe.storage import dealt

#: Fixed values, in metres and degrees: what counts as short, as a jog, as skew, as a direction, as a sliver, and as a curve.
SHAPE = {
    "min_segment_m": 0.05, "jog_max_m": 0.05, "jog_gap_m": 1.2, "skew_min_deg": 0.1, "skew_max_deg": 3.0, "skew_min_len_m": 0.3, "direction_min_len_m": 1.0, "min_wall_m": 0.03, "min_wall_px": 3.0,
    "curve_min_edges": 4, "curve_max_edge_m": 10.0, "curve_turn_deg": (0.1, 25.0), "curve_min_total_deg": 6.0, "curve_cv": 0.25, "curve_fine_edge_m": 0.5,
}


def options(given: dict | None = None) -> dict:
    """SHAPE with what is given in its place; an unknown name is an error."""
    if unknown := set(given or {}) - set(SHAPE):
        raise ValueError(f"unknown options: {sorted(unknown)}")
    return SHAPE | (given or {})


def segments(points: DataFrame, by: str, closed: bool = True) -> DataFrame:
    """Edges of outlines of points (by, ord, x, y): edge (from 0), ax, ay, bx, by_, angle (0 to 180) and length; those shorter than 1e-9 go, a closed one has an edge back to its start."""
    w = Window.partitionBy(by).orderBy("ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) if closed else F.lead(c).over(w)
    e = points.select(by, (F.row_number().over(w) - 1).alias("edge"), F.col("x").cast("double").alias("ax"), F.col("y").cast("double").alias("ay"), nxt("x").cast("double").alias("bx"), nxt("y").cast("double").alias("by_"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    return e.withColumn("length", F.hypot(dx, dy)).where("length >= 1e-9").withColumn("angle", angle_180(dx, dy))


def short_segments(lines: DataFrame, o: dict = SHAPE) -> DataFrame:
    return lines.where(F.col("length") < o["min_segment_m"])


def deviation(angle: Column, directions: Column) -> Column:
    """Degrees from the nearest of an array of directions."""
    return F.array_min(F.transform(directions, lambda d: angle_apart(angle, d)))


def skewed(lines: DataFrame, directions: Column, o: dict = SHAPE) -> DataFrame:
    """Lines nearly but not quite along a direction, with how far off."""
    return lines.withColumn("off", deviation(F.col("angle"), directions)).where((F.col("length") >= o["skew_min_len_m"]) & (F.col("off") > o["skew_min_deg"]) & (F.col("off") <= o["skew_max_deg"]))


def directions(lines: DataFrame, by: str, declared: tuple[float, ...] = (), o: dict = SHAPE) -> DataFrame:
    """set_by and directions of each group of lines (by, angle, length): 0, 90, those declared, and the length-weighted means of slanted ones.

    Lines from the longest on join the first cluster whose running mean is within the window, or start one; those near a
    known direction, or short, take no part. As each line's choice hangs on those before, it is a fold over a group's sorted
    lines: those of one mesh's sections or one plan, not of a table.
    """
    window = o["skew_max_deg"]
    known = F.array(*[F.lit(float(d) % 180.0) for d in (0.0, 90.0, *declared)])
    far = lines.where((F.col("length") >= o["direction_min_len_m"]) & (deviation(F.col("angle"), known) > window))
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("l"), F.col("angle").alias("a")))), lambda x: F.struct((-x["l"]).alias("length"), x["a"].alias("angle")))
    kind = "array<struct<ref:double,sum:double,weight:double,mean:double>>"

    def step(acc: Column, x: Column) -> Column:
        near = F.transform(acc, lambda c: angle_apart(c["mean"], x["angle"]) <= window)
        at = F.array_position(near, F.lit(True))

        def grown(c: Column) -> Column:
            total = c["sum"] + (F.pmod(x["angle"] - c["ref"] + 90.0, F.lit(180.0)) - 90.0) * x["length"]
            weight = c["weight"] + x["length"]
            return F.struct(c["ref"].alias("ref"), total.alias("sum"), weight.alias("weight"), F.pmod(c["ref"] + total / weight, F.lit(180.0)).alias("mean"))

        joined = F.transform(acc, lambda c, i: F.when(i + 1 == at, grown(c)).otherwise(c))
        fresh = F.struct(x["angle"].alias("ref"), F.lit(0.0).alias("sum"), x["length"].alias("weight"), x["angle"].alias("mean"))
        return F.when(at > 0, joined).otherwise(F.concat(acc, F.array(fresh))).cast(kind)

    found = far.groupBy(by).agg(F.aggregate(sorted_, F.array().cast(kind), step).alias("clusters"))
    means = F.transform("clusters", lambda c: F.bround(c["mean"], 4))
    return lines.select(F.col(by).alias("set_by")).distinct().join(found, F.col("set_by").eqNullSafe(F.col(by)), "left").select("set_by", F.concat(known, F.coalesce(means, F.array().cast("array<double>"))).alias("directions"))


def chain_jogs(lines: DataFrame, by: str, o: dict = SHAPE) -> DataFrame:
    """Lines k and k + 2 of an outline that run the same way with a short one between, and lie 2 mm to jog_max_m apart: by, edge, offset."""
    w = Window.partitionBy(by).orderBy("edge")
    there = lambda n: F.lead("edge", n).over(w) == F.col("edge") + n
    after = {c: F.lead(c, 2).over(w) for c in ("angle", "ax", "ay", "bx", "by_")}
    e = lines.withColumns({f"n_{c}": v for c, v in after.items()} | {"between": F.lead("length").over(w), "whole": there(1) & there(2)})
    ux, uy = (F.col("bx") - F.col("ax")) / F.col("length"), (F.col("by_") - F.col("ay")) / F.col("length")
    off = F.abs(-uy * ((F.col("n_ax") + F.col("n_bx")) / 2 - F.col("ax")) + ux * ((F.col("n_ay") + F.col("n_by_")) / 2 - F.col("ay")))
    jog = e.where(F.col("whole") & (F.col("between") <= o["jog_max_m"]) & (angle_apart(F.col("angle"), F.col("n_angle")) <= 1.0)).withColumn("offset", off)
    return jog.where((F.col("offset") > 0.002) & (F.col("offset") <= o["jog_max_m"])).select(by, "edge", "offset")


def pair_jogs(lines: DataFrame, o: dict = SHAPE, by: str | None = None, block: float = 16.0) -> DataFrame:
    """Pairs of lines (id, thickness or null, and of segments()) of about one direction that lie 2 mm to jog_max_m off one line or face, at most jog_gap_m apart along it: a, b (ids), offset, gap.

    The longer one is the rule. ``by``, if given, is a column within whose values pairs are looked for. In a
    frame turned by whole degrees, a line's middle, moved by none or half of its thickness to either side,
    is a point; the longer line, moved likewise and drawn out as far as a middle may lie, runs through bands
    of jog_max_m's width in blocks of ``block`` along it. So lines meet only where centre lines or faces are
    about in line. A line goes to a band once, however many of its three ways lie there, and a pair is kept in
    the band of the shorter line's first way in which it is.
    """
    most, band = o["jog_max_m"], 2 * o["jog_max_m"]
    cols = ("id", "ax", "ay", "bx", "by_", "length", "angle", "half")
    # Frames lie along whole degrees, so that lines along the axes keep to their bands.
    base = lines.where((F.col("length") >= o["min_segment_m"]) & F.col("angle").isNotNull()).withColumns({"degree": F.pmod(F.floor(F.col("angle") + 0.5).cast("int"), F.lit(180)), "half": F.coalesce(F.col("thickness"), F.lit(0.0)) / 2, "of": F.lit(0) if by is None else F.col(by)})
    there = {r["degree"]: r["count"] for r in base.groupBy("degree").count().collect()}  # 180 at most
    base = dealt(base.select("of", "degree", *cols), "id", rows=50_000, count=sum(there.values()))
    turned = F.radians(F.col("degree").cast("double"))
    across = lambda x, y: -F.sin(turned) * x + F.cos(turned) * y
    along = lambda x, y: F.cos(turned) * x + F.sin(turned) * y
    middle = [(F.col(p) + F.col(q)) / 2 for p, q in (("ax", "bx"), ("ay", "by_"))]
    at_band = lambda off, side, half: F.floor((off + side * half) / band)
    bands = lambda low, high: F.explode(F.array_distinct(F.flatten(F.array(*[F.sequence(at_band(low, F.lit(s), F.col("half")), at_band(high, F.lit(s), F.col("half"))) for s in (0.0, 1.0, -1.0)]))))
    right = base.withColumns({"at": F.floor(along(*middle) / block), "off": across(*middle)}).withColumn("band", bands(F.col("off"), F.col("off")))
    right = right.select("of", "degree", "at", "band", F.col("off").alias("b_off"), *[F.col(c).alias(f"b_{c}") for c in cols])
    ux, uy = (F.col("bx") - F.col("ax")) / F.col("length"), (F.col("by_") - F.col("ay")) / F.col("length")
    own = [ux * F.col(x) + uy * F.col(y) for x, y in (("ax", "ay"), ("bx", "by_"))]
    # Frames of all lines within a degree; what is one degree off may be rounded to either side of it.
    near = F.transform(F.sequence(*[F.floor(F.col("angle") + 0.5 + d).cast("int") for d in (-1 - 1e-9, 1 + 1e-9)]), lambda x: F.pmod(x, F.lit(180)))
    left = base.withColumn("degree", F.explode(F.array_intersect(near, F.array(*map(F.lit, sorted(there))).cast("array<int>"))))
    left = left.withColumns({"s0": along(F.col("ax"), F.col("ay")), "s1": along(F.col("bx"), F.col("by_")), "o0": across(F.col("ax"), F.col("ay")), "o1": across(F.col("bx"), F.col("by_"))})
    reach = o["jog_gap_m"] + F.col("length") / 2 + most  # a shorter line's middle is no farther than half of it beyond the gap
    left = left.withColumn("slope", (F.col("o1") - F.col("o0")) / (F.col("s1") - F.col("s0"))).withColumns({"from": F.least("s0", "s1") - reach, "until": F.greatest("s0", "s1") + reach})
    left = left.withColumn("at", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor(F.col("until") / block))))
    edge = lambda s: F.col("o0") + F.col("slope") * (s - F.col("s0"))
    ends = [edge(F.greatest(F.col("from"), F.col("at") * block)), edge(F.least(F.col("until"), (F.col("at") + 1) * block))]
    left = left.withColumns({"low": F.least(*ends) - most * 1.05, "high": F.greatest(*ends) + most * 1.05}).withColumn("band", bands(F.col("low"), F.col("high")))
    # A plus side of the turned frame is that of the line if they point alike, else its minus side; align_shifts has the minus side first.
    alike = ux * F.cos(turned) + uy * F.sin(turned) > 0
    left = left.select("of", "degree", "at", "band", *[F.col(c).alias(f"a_{c}") for c in ("id", "ax", "ay", "length", "angle", "half")], ux.alias("ux"), uy.alias("uy"), F.least(*own).alias("a_lo"), F.greatest(*own).alias("a_hi"), alike.alias("alike"))
    # Merged, not broadcast: the table behind a side may look small before its lines are spread over bands.
    met = left.join(right.hint("merge"), ["of", "degree", "at", "band"]).where((F.col("a_length") > F.col("b_length")) | ((F.col("a_length") == F.col("b_length")) & (F.col("a_id") < F.col("b_id"))))
    met = met.where(angle_apart(F.col("a_angle"), F.col("b_angle")) <= 1.0)
    ux, uy = F.col("ux"), F.col("uy")
    d = -uy * ((F.col("b_ax") + F.col("b_bx")) / 2 - F.col("a_ax")) + ux * ((F.col("b_ay") + F.col("b_by_")) / 2 - F.col("a_ay"))
    ends = [ux * F.col(f"b_{x}") + uy * F.col(f"b_{y}") for x, y in (("ax", "ay"), ("bx", "by_"))]
    gap = F.greatest(F.least(*ends) - F.col("a_hi"), F.col("a_lo") - F.greatest(*ends))
    # As a row of its own, what a pair measures is worked out once; conditions on it would else go into the join with its expressions repeated.
    met = met.select("*", F.inline(F.array(F.struct(d.alias("d"), gap.alias("gap"))))).where(F.col("gap") <= o["jog_gap_m"])
    shifts = align_shifts(F.col("d"), F.col("a_half"), F.col("b_half"))
    misses = [F.abs(shifts[k]) for k in range(3)]
    side = F.when(misses[0] <= most, 0.0).when((misses[1] <= most) == F.col("alike"), -1.0).otherwise(1.0)
    out = met.withColumn("offset", F.least(*misses)).where((F.col("offset") > 0.002) & (F.col("offset") <= most) & (F.col("band") == at_band(F.col("b_off"), side, F.col("b_half"))))
    return out.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "offset", "gap")


def slivers(walls: DataFrame, o: dict = SHAPE) -> DataFrame:
    """Walls (thickness in metres, px in pixels or null) too thin to be walls."""
    return walls.where((F.col("thickness") < o["min_wall_m"]) | F.coalesce(F.col("px") < o["min_wall_px"], F.lit(False)))


def variation(values: str) -> Column:
    """Coefficient of variation, as an aggregate: 0 of one value or without a positive mean."""
    return F.when((F.count(values) > 1) & (F.avg(values) > 0), F.stddev_pop(values) / F.avg(values)).otherwise(0.0)


def run_stats(runs: DataFrame, by: str, o: dict = SHAPE) -> DataFrame:
    """Per run of a curve's chords (by, ord, x, y: its points in order): edges, turn_cv, length_cv (without the first and last of four edges or more), flips, total_turn, median_edge and irregular."""
    w = Window.partitionBy(by).orderBy("ord")
    p = runs.select(by, "ord", *[F.col(c).cast("double").alias(c) for c in "xy"])
    p = p.withColumns({"ux": F.col("x") - F.lag("x").over(w), "uy": F.col("y") - F.lag("y").over(w), "vx": F.lead("x").over(w) - F.col("x"), "vy": F.lead("y").over(w) - F.col("y")})
    turn = F.degrees(F.atan2(F.expr("ux * vy - uy * vx"), F.expr("ux * vx + uy * vy")))
    n = Window.partitionBy(by)
    p = p.withColumn("turn", turn).withColumn("length", F.hypot("vx", "vy")).withColumn("k", F.row_number().over(w)).withColumn("edges", F.count("vx").over(n)).withColumn("total", F.sum("turn").over(n))
    main = F.when(F.col("total") >= 0, 1).otherwise(-1)
    inner = F.when((F.col("edges") < 4) | ((F.col("k") > 1) & (F.col("k") < F.col("edges"))), F.col("length"))
    p = p.withColumns({"bent": F.abs("turn"), "inner": inner, "flip": F.coalesce(F.col("turn") * main < -o["curve_turn_deg"][0], F.lit(False))})
    s = p.groupBy(by).agg(F.first("edges").alias("edges"), F.bround(variation("bent"), 3).alias("turn_cv"), F.bround(variation("inner"), 3).alias("length_cv"), F.count_if("flip").alias("flips"), F.bround(F.coalesce(F.first("total"), F.lit(0.0)), 2).alias("total_turn"), F.median("length").alias("median_edge"))
    return s.withColumn("irregular", (F.col("flips") > 0) | (F.col("turn_cv") > o["curve_cv"]) | (F.col("length_cv") > o["curve_cv"]))


def curve_runs(points: DataFrame, by: str, closed: bool = True, o: dict = SHAPE) -> DataFrame:
    """Runs of chords that draw a curve on outlines of points (by, ord, x, y): run (its first edge), ord (from 0) and x, y of its points.

    A run is a stretch of edges no longer than curve_max_edge_m, at whose inner corners the outline turns by more than 0 and at most
    the greater of curve_turn_deg, of curve_min_edges or more that turn by curve_min_total_deg together. A closed outline's runs go on over its start; one that is
    all curve is one run. Outlines are worked off by windows over their points, not one by one in Python.
    """
    w = Window.partitionBy(by).orderBy(F.asc_nulls_last("ord"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nan = F.lit(float("nan"))
    p = points.select(by, "ord", *[F.coalesce(F.col(c).cast("double"), nan).alias(c) for c in "xy"])
    if closed:  # an end that repeats the start goes
        p = p.withColumns({"at": F.row_number().over(w), "n": F.count(F.lit(1)).over(whole), "x0": F.first("x").over(whole), "y0": F.first("y").over(whole)})
        p = p.where(~((F.col("n") > 1) & (F.col("at") == F.col("n")) & (F.hypot(F.expr("x - x0"), F.expr("y - y0")) < 1e-9))).select(by, "ord", "x", "y")
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) if closed else F.lead(c).over(w)
    e = p.withColumns({"edge": (F.row_number().over(w) - 1).cast("long"), "nx": after("x"), "ny": after("y")}).where("nx IS NOT NULL")
    e = e.withColumns({"dx": F.expr("nx - x"), "dy": F.expr("ny - y")}).withColumn("short", F.hypot("dx", "dy") <= o["curve_max_edge_m"])
    before = lambda c: F.coalesce(F.lag(c).over(w), F.last(c).over(whole))
    e = e.withColumns({"ux": before("dx"), "uy": before("dy"), "was_short": before("short"), "n": F.count(F.lit(1)).over(whole)})
    # At each edge's start.
    e = e.withColumn("turn", F.degrees(F.atan2(F.expr("ux * dy - uy * dx"), F.expr("ux * dx + uy * dy"))))
    goes_on = F.col("short") & F.col("was_short") & (F.abs("turn") <= o["curve_turn_deg"][1])
    e = e.withColumn("goes_on", goes_on if closed else goes_on & (F.col("edge") > 0)).withColumn("breaks", F.when(F.col("goes_on"), 0).otherwise(1))
    e = e.withColumns({"stretch": F.sum("breaks").over(w.rowsBetween(Window.unboundedPreceding, 0)), "stretches": F.sum("breaks").over(whole)})
    # What goes on before the first break belongs to the last stretch, over the start.
    over = F.expr("stretch = 0 AND stretches > 0")
    e = e.select(by, "x", "y", "nx", "ny", "short", "goes_on", "turn", F.when(over, F.col("edge") + F.col("n")).otherwise(F.col("edge")).alias("at"), F.when(over, F.col("stretches")).otherwise(F.col("stretch")).alias("stretch"))
    s = Window.partitionBy(by, "stretch")
    e = e.withColumns({"run": F.min("at").over(s), "k": F.count(F.lit(1)).over(s), "total": F.sum(F.when(F.col("goes_on"), F.col("turn")).otherwise(0.0)).over(s), "all_short": F.every("short").over(s)})
    kept = e.where(F.col("all_short") & (F.col("k") >= o["curve_min_edges"]) & (F.abs("total") >= o["curve_min_total_deg"])).withColumn("ord", F.expr("at - run"))
    point = lambda ord, x, y: F.struct(ord.alias("ord"), F.col(x).alias("x"), F.col(y).alias("y"))
    own, end = point(F.col("ord"), "x", "y"), point(F.col("ord") + 1, "nx", "ny")
    return kept.select(by, "run", F.inline(F.when(F.expr("ord = k - 1"), F.array(own, end)).otherwise(F.array(own))))


def section_loops(segments_: DataFrame, by: str, places: int = 5) -> DataFrame:
    """Chains of section segments (by, x0, y0, x1, y1) joined where ends agree to ``places``: chain, ord, x, y and closed. A group's segments are those of one section."""

    def one(key, t):
        import pandas as pd

        ends: dict = {}
        seg = [((round(a, places), round(b, places)), (round(c, places), round(d, places))) for a, b, c, d in t.sort_values(["x0", "y0", "x1", "y1"])[["x0", "y0", "x1", "y1"]].itertuples(index=False)]
        for i, (p, q) in enumerate(seg):
            ends.setdefault(p, []).append(i)
            ends.setdefault(q, []).append(i)
        used, rows, chain = [False] * len(seg), [], 0

        def walk(at):
            path = []
            while True:
                i = next((i for i in ends[at] if not used[i]), None)
                if i is None:
                    return path
                used[i] = True
                at = seg[i][1] if seg[i][0] == at else seg[i][0]
                path.append(at)

        for i in range(len(seg)):
            if used[i]:
                continue
            used[i] = True
            forward = [seg[i][1], *walk(seg[i][1])]
            back = walk(seg[i][0])
            path = [*reversed(back), seg[i][0], *forward]
            is_closed = len(path) > 2 and path[0] == path[-1]
            rows += [(key[0], chain, k, *p, is_closed) for k, p in enumerate(path[:-1] if is_closed else path)]
            chain += 1
        return pd.DataFrame(rows, columns=[by, "chain", "ord", "x", "y", "closed"])

    return segments_.groupBy(by).applyInPandas(one, f"{by} {dict(segments_.dtypes)[by]}, chain long, ord long, x double, y double, closed boolean")


def without_collinear(points: DataFrame, by: str, degrees: float = 0.05) -> DataFrame:
    """Rings of points (by, ord, x, y) without those at which they turn by less than ``degrees``: the first such goes, then the ring is looked at anew, until none is left."""

    def one(key, t):
        import pandas as pd

        p = t.sort_values("ord")[["x", "y"]].to_numpy(float).tolist()
        i = 0
        while len(p) > 3 and i < len(p):
            (ax, ay), (bx, by_), (cx, cy) = p[i - 1], p[i], p[(i + 1) % len(p)]
            ux, uy, vx, vy = bx - ax, by_ - ay, cx - bx, cy - by_
            if abs(math.degrees(math.atan2(ux * vy - uy * vx, ux * vx + uy * vy))) < degrees:
                del p[i]
                i = max(0, i - 1) if i else 0
                continue
            i += 1
        return pd.DataFrame([(key[0], k, x, y) for k, (x, y) in enumerate(p)], columns=[by, "ord", "x", "y"])

    return points.select(by, "ord", *[F.col(c).cast("double").alias(c) for c in "xy"]).groupBy(by).applyInPandas(one, f"{by} {dict(points.dtypes)[by]}, ord long, x double, y double")


def issues(points: DataFrame, by: str, given: dict | None = None, scope: str | None = None, declared: tuple[float, ...] = ()) -> DataFrame:
    """What is wrong with the shape of closed outlines (by, ord, x, y), a row each: type (short_segment, near_axis_skew, wall_jog or irregular_curve), edge and value.

    scope: a column that says which outlines' straight lines set the directions together, a mesh's or a
    plan's (all heights of it); without it each outline sets its own. ``declared`` are directions that are known.
    """
    o = options(given)
    scopes = points.groupBy(by).agg(F.first(scope or by).alias("scope"))
    lines = segments(points, by)
    curves = curve_runs(points, by, o=o)
    name = F.struct(by, "run")
    curved = curves.groupBy(by, "run").agg(F.max("ord").alias("n"))
    size = lines.groupBy(by).agg((F.max("edge") + 1).alias("of"))
    on_curve = curved.join(size, by).select(by, F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.pmod(F.col("run") + i, F.col("of")))).alias("edge")).distinct()
    straight = lines.join(on_curve.withColumn("edge", F.col("edge").cast("int")), [by, "edge"], "left_anti")
    row = lambda df, kind, value: df.select(by, F.lit(kind).alias("type"), F.col("edge").cast("long").alias("edge"), value.alias("value"))
    scoped = straight.join(scopes, by)
    skew = scoped.join(directions(scoped, "scope", declared, o), scoped["scope"].eqNullSafe(F.col("set_by")))
    bent = run_stats(curves.withColumn("of", name).select("of", "ord", "x", "y"), "of", o).where("irregular").select(f"of.{by}", F.col("of.run").alias("edge"), "turn_cv")
    return row(short_segments(straight, o), "short_segment", F.col("length")).unionByName(row(skewed(skew, F.col("directions"), o), "near_axis_skew", F.col("off"))).unionByName(row(chain_jogs(straight, by, o), "wall_jog", F.col("offset"))).unionByName(row(bent, "irregular_curve", F.col("turn_cv")))
