"""Faces of networks of lines: lines cut where they meet, half-edges with what follows each round its face, and seeds that name faces.

Corners lie on a grid, so that those of one place are equal; a cut is moved by half of the grid's step at
most, and what that brings to touch is not cut again. Null coordinates and lines without length take
no part, repeated lines count once, empty tables have no faces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnframe.storage import dealt, discard, stored

from .overlay import containing
from .spatial import box_pairs

ENDS = ["ax", "ay", "bx", "by_"]
#: Pieces of a plan up to which its rings are followed in one task; those of larger plans are followed by joins.
IN_TASK = 500_000


def _whole(x: Column) -> Column:
    """The nearest whole number, halves away from 0: as round() has it, without its decimals."""
    size = F.abs(x)
    return (F.signum(x) * (F.floor(size) + F.when(size - F.floor(size) >= 0.5, 1).otherwise(0))).cast("long")


def _cuts():
    """For mapInArrow: where lines (by, ends) that meet others (o_ and ends) are cut by them: by, ends, x, y."""
    import numpy as np
    import pyarrow as pa

    names = list(ENDS)

    def whole(x):  # as _whole()
        size = np.abs(x)
        return (np.sign(x) * (np.floor(size) + (size - np.floor(size) >= 0.5))).astype(np.int64)

    def run(batches):
        for batch in batches:
            (ax, ay, bx, by_), (cx, cy, ox, oy) = ([batch.column(p + c).to_numpy() for c in names] for p in ("", "o_"))
            dx, dy, ex, ey, fx, fy = bx - ax, by_ - ay, ox - cx, oy - cy, cx - ax, cy - ay
            if any(len(d) and np.abs(d).max() > 1_500_000_000 for d in (dx, dy, ex, ey, fx, fy)):
                raise OverflowError("lines of more than 1.5 billion steps of the grid")
            det, side, t = dx * ey - dy * ex, fx * dy - fy * dx, fx * ey - fy * ex
            sign, size = np.sign(det), np.abs(det)
            # Along each line the cut lies at t / det, along the other at side / det.
            i = np.flatnonzero((det != 0) & (t * sign >= 0) & (t * sign <= size) & (side * sign >= 0) & (side * sign <= size))
            found = [(i, whole(ax[i] + dx[i] * (t[i] / det[i])), whole(ay[i] + dy[i] * (t[i] / det[i])))]
            same = (det == 0) & (side == 0)
            for x, y in ((cx, cy), (ox, oy)):
                on = (x - ax) * dx + (y - ay) * dy
                k = np.flatnonzero(same & (on >= 0) & (on <= dx * dx + dy * dy))
                found.append((k, x[k], y[k]))
            at, x, y = (np.concatenate(c) for c in zip(*found, strict=True))
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *[batch.column(c).take(rows) for c in names], pa.array(x), pa.array(y)], names=[batch.schema.names[0], *names, "x", "y"])

    return run


def noded(lines: DataFrame, by: str, grid: float = 5e-4, cell: float = 1.0) -> DataFrame:
    """Distinct pieces (by, ax, ay, bx, by_: long, in steps of ``grid``; a before b) of lines (by, ax, ay, bx, by_) cut where they cross, touch or lie on one another. Lines meet by their boxes within cells of side ``cell``."""
    snapped = lines.select(by, *[_whole(F.col(c) / grid).alias(c) for c in ENDS]).where("ax <> bx OR ay <> by_").dropna(subset=ENDS)
    turned = F.expr("(ax, ay) > (bx, by_)")
    e = stored(snapped.select(by, *[F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(ENDS, ENDS[2:] + ENDS[:2], strict=True)]).distinct(), "lines")
    boxes = e.select(by, F.struct(*ENDS).alias("id"), F.col("ax").alias("x0"), F.col("bx").alias("x1"), F.least("ay", "by_").alias("y0"), F.greatest("ay", "by_").alias("y1"))
    # A batch at a time: as column expressions, the cuts made one method too long to be compiled.
    met = box_pairs(boxes, boxes, cell=cell / grid, by=[by]).where("a_id <> b_id").select(by, *[F.col(f"a_id.{c}") for c in ENDS], *[F.col(f"b_id.{c}").alias(f"o_{c}") for c in ENDS])
    own = e.select(by, *ENDS, F.inline(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by_").alias("y")))))
    points = own.unionByName(met.mapInArrow(_cuts(), own.schema)).repartition(by, *ENDS).distinct()
    w = Window.partitionBy(by, *ENDS).orderBy(F.expr("(x - ax) * (bx - ax) + (y - ay) * (by_ - ay)"), "x", "y")
    pieces = points.select(by, F.col("x").alias("px"), F.col("y").alias("py"), F.lead("x").over(w).alias("qx"), F.lead("y").over(w).alias("qy")).where("qx IS NOT NULL")
    back = F.expr("(px, py) > (qx, qy)")
    return pieces.select(by, *[F.when(back, F.col(b)).otherwise(F.col(a)).alias(c) for a, b, c in zip(("px", "py", "qx", "qy"), ("qx", "qy", "px", "py"), ENDS, strict=True)]).distinct()


def _halves(edges: DataFrame, by: str) -> DataFrame:
    """Both ways along each edge (by, edge, ends): half (twice the edge, and one back), u and v, and next, the half that follows with the same face on its left."""
    both = edges.select(by, F.inline(F.array(*[F.struct((F.col("edge") * 2 + i).alias("half"), *[F.col(c).alias(n) for c, n in zip(ends, ("ux", "uy", "vx", "vy"), strict=True)]) for i, ends in enumerate((ENDS, ENDS[2:] + ENDS[:2]))])))
    w = Window.partitionBy(by, "ux", "uy")
    order = w.orderBy(F.atan2(F.expr("vy - uy").cast("double"), F.expr("vx - ux").cast("double")))
    before = F.coalesce(F.lag("half").over(order), F.last("half").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # From where this half sets out comes its twin, which goes on by the half before it round the corner.
    return both.select(by, F.col("half").bitwiseXOR(F.lit(1)).alias("half"), F.col("vx").alias("ux"), F.col("vy").alias("uy"), F.col("ux").alias("vx"), F.col("uy").alias("vy"), before.alias("next"))


def _ringed(halves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """halves (stored) with ring, its smallest half, and ahead, how many steps that is away; and the stored table that this is read from. By pointer jumping: each looks at twice as many halves ahead in each round, until none finds a smaller one."""
    now = stored(halves.select("half", F.col("next").alias("to"), F.col("half").alias("ring"), F.lit(0).cast("long").alias("ahead")), "pointers")
    step = 1
    while True:
        far = now.select(F.col("half").alias("to"), F.col("to").alias("to_to"), F.col("ring").alias("f_ring"), F.col("ahead").alias("f_ahead"))
        nearer = F.col("ring") <= F.col("f_ring")
        joined = now.join(far, "to").select("half", F.col("to_to").alias("to"), F.least("ring", "f_ring").alias("ring"), F.when(nearer, F.col("ahead")).otherwise(F.col("f_ahead") + step).alias("ahead"), (F.col("ring") == F.col("f_ring")).alias("same"))
        then = stored(joined, "pointers")
        discard(now)
        if then.where("NOT same").isEmpty():
            return halves.join(then.select("half", "ring", "ahead"), "half"), then
        now, step = then, step * 2


def _followed():
    """For mapInArrow: rings (by, ring, area2, ord, x, y) of the pieces (by, edge, ends) of whole plans."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = list(ENDS)

    def ringed(plan, ends):
        """Per half (twice the edge, and one back): its ring, how many steps that is away, and how many halves it has. As _halves() and _ringed()."""
        n = 2 * len(plan)
        ux, uy, vx, vy = (np.stack([ends[i], ends[j]], axis=1).ravel() for i, j in ((0, 2), (1, 3), (2, 0), (3, 1)))
        at = np.repeat(plan, 2)
        order = np.lexsort((np.arctan2((vy - uy).astype(float), (vx - ux).astype(float)), uy, ux, at))
        # Where the halves of a corner start, in that order; the one before the first is the corner's last.
        starts = np.flatnonzero(np.any([np.diff(c[order], prepend=c[order[0]] - 1) != 0 for c in (at, ux, uy)], axis=0))
        before = np.arange(-1, n - 1)
        before[starts] = np.append(starts[1:], n) - 1
        to = np.empty(n, np.int64)
        to[order ^ 1] = order[before]
        ring, ahead, step = np.arange(n), np.zeros(n, np.int64), 1
        while True:
            far = ring[to]
            if (far == ring).all():
                return ring, ahead, np.bincount(ring, minlength=n)[ring]
            ahead = np.where(ring <= far, ahead, ahead[to] + step)
            ring, to, step = np.minimum(ring, far), to[to], step * 2

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by("edge").combine_chunks()
        plan = pc.dictionary_encode(t.column(0), null_encoding="encode").combine_chunks().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = [t.column(c).to_numpy() for c in names]
        ring = ringed(plan, ends)[0]
        kept = np.flatnonzero(ring[::2] != ring[1::2])
        if not len(kept):
            return
        t, plan, ends = t.take(pa.array(kept)), plan[kept], [c[kept] for c in ends]
        ring, ahead, n = ringed(plan, ends)
        x, y = (np.stack([ends[i], ends[i + 2]], axis=1).ravel() for i in (0, 1))
        # About a corner of the ring, so that products stay small.
        qx, qy = (c.reshape(-1, 2)[:, ::-1].ravel() - c[ring] for c in (x, y))
        area2 = np.zeros(len(ring), np.int64)
        np.add.at(area2, ring, (x - x[ring]) * qy - qx * (y - y[ring]))
        half = t.column("edge").to_numpy()[ring // 2] * 2 + ring % 2
        columns = [t.column(0).take(pa.array(np.arange(len(ring)) // 2)), *map(pa.array, (half, area2[ring], (n - ahead) % n, x, y))]
        yield from pa.table(columns, names=[t.column_names[0], "ring", "area2", "ord", "x", "y"]).to_batches(max_chunksize=10_000)

    return run


def _rings_by_joins(edges: DataFrame, by: str) -> DataFrame:
    """Rings as _followed() has them, of plans of any size."""
    halves = stored(_halves(edges, by), "halves")
    first, pointers = _ringed(halves)
    bounding = first.groupBy(F.expr("half div 2").alias("edge")).agg((F.min("ring") != F.max("ring")).alias("bounds")).where("bounds").select("edge")
    kept = stored(_halves(edges.join(bounding, "edge", "left_semi").select(by, "edge", *ENDS), by), "halves")
    discard(halves, pointers)
    second, pointers = _ringed(kept)
    rings = stored(second, "rings")
    discard(kept, pointers)
    areas = rings.groupBy("ring").agg(F.sum(F.expr("ux * vy - vx * uy")).alias("area2"), F.count("*").alias("n"))
    return rings.join(areas, "ring").select(by, "ring", "area2", F.pmod(F.col("n") - F.col("ahead"), F.col("n")).alias("ord"), F.col("ux").alias("x"), F.col("uy").alias("y"))


def faces(pieces: DataFrame, by: str, cell: float, in_task: int = IN_TASK) -> DataFrame:
    """Rings (by, face, ring, ord, x, y; in the pieces' steps) of the bounded faces of a network of noded pieces: outlines turn left, holes right. Pieces with the same face on both sides bound none and are left out. cell: in the pieces' steps, for finding the face that a hole lies in.

    Plans of up to ``in_task`` pieces are dealt to tasks that follow their rings in memory, larger ones are followed by joins of half-edges; both give the same rings.
    """
    edges = stored(pieces.select(by, F.monotonically_increasing_id().alias("edge"), *ENDS), "pieces")
    large = edges.groupBy(by).count().where(F.col("count") > in_task).select(F.col(by).alias("large"))
    some = not large.isEmpty()
    small = edges.join(F.broadcast(large), F.col(by).eqNullSafe(F.col("large")), "left_anti") if some else edges
    found = dealt(small, by).mapInArrow(_followed(), f"{by} {dict(edges.dtypes)[by]}, ring long, area2 long, ord long, x long, y long")
    if some:
        found = found.unionByName(_rings_by_joins(stored(edges.join(F.broadcast(large), F.col(by).eqNullSafe(F.col("large")), "left_semi"), "pieces"), by))
    rings = stored(found, "rings")
    discard(edges)
    outlines = rings.where("area2 > 0").withColumn("face", F.col("ring"))
    holes = rings.where("area2 < 0")
    # A hole lies in the smallest face that is larger than all within it.
    spots = holes.where("ord = 0").select(by, F.struct("ring", F.col("area2").alias("area2")).alias("id"), "x", "y")
    areas = rings.where("ord = 0").select(F.col("ring").alias("face"), F.col("area2").alias("f_area2"))
    hit = containing(spots, outlines, "face", cell, [by]).join(areas, "face").where(F.col("f_area2") > -F.col("id.area2"))
    of = hit.groupBy(F.col("id.ring").alias("ring")).agg(F.min_by("face", F.struct("f_area2", "face")).alias("face"))
    columns = [by, "face", "ring", "ord", "x", "y"]
    return stored(outlines.select(columns).unionByName(holes.join(of, "ring").select(columns)), "faces")


def seeded(rings: DataFrame, seeds: DataFrame, by: str, cell: float) -> DataFrame:
    """What each seed (by, name, ord, x, y) names, and faces left over: by, name, face, hits (faces that hold it), error: a seed that lies in no face, in several, or in one that a seed before it (by ord, name) has, has an error and no face; a face left over has no name."""
    held = containing(seeds.select(by, F.struct("name", "ord").alias("id"), "x", "y"), rings, "face", cell, [by])
    of = held.groupBy(by, "id").agg(F.count("*").alias("hits"), F.min("face").alias("face"))
    s = seeds.select(by, F.struct("name", "ord").alias("id")).join(of, [by, "id"], "left").select(by, "id", F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.col("hits") == 1, F.col("face")).alias("face"))
    rank = F.row_number().over(Window.partitionBy("face").orderBy("id.ord", "id.name"))
    error = F.when(F.col("hits") == 0, "no face").when(F.col("hits") > 1, "several faces").when(F.col("rank") > 1, "taken")
    # Seeds without a face are not ranked, so they make no group.
    ranked = s.where("face IS NOT NULL").withColumn("rank", rank).unionByName(s.where("face IS NULL").withColumn("rank", F.lit(1)))
    named = ranked.withColumn("error", error).select(by, "id.name", F.when(F.col("error").isNull(), F.col("face")).alias("face"), "hits", "error")
    left = rings.select(by, "face").distinct().join(named.where("face IS NOT NULL").select("face"), "face", "left_anti")
    return named.unionByName(left.select(by, F.lit(None).cast("string").alias("name"), "face", F.lit(None).cast("long").alias("hits"), F.lit(None).cast("string").alias("error")))
