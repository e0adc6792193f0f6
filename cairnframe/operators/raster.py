"""Masks, components and overlaps of images as pixel tables (img, y, x, r, g, b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnframe.storage import stored

from .components import components


def wall_mask(colours: list[tuple[int, int, int]], tol: int, dark_sum: int | None) -> Column:
    """A pixel within ``tol`` of a colour in every channel, or of a channel sum under dark_sum."""
    near = F.lit(False)
    for colour in colours:
        near |= F.greatest(*[F.abs(F.col(c).cast("int") - v) for c, v in zip("rgb", colour, strict=True)]) <= tol
    return near if dark_sum is None else near | (F.col("r") + F.col("g") + F.col("b") < dark_sum)


def background_mask(colour: tuple[int, int, int], tol: int = 20) -> Column:
    return F.greatest(*[F.abs(F.col(c).cast("int") - v) for c, v in zip("rgb", colour, strict=True)]) <= tol


def iou(a: DataFrame, b: DataFrame, by: str = "img") -> DataFrame:
    """Pixels in both over pixels in either, of masks as tables of set pixels (by, y, x)."""
    both = a.select(by, "y", "x").distinct().withColumn("in_a", F.lit(1)).join(b.select(by, "y", "x").distinct().withColumn("in_b", F.lit(1)), [by, "y", "x"], "full_outer")
    return both.groupBy(by).agg(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("shared"), F.count("*").alias("either")).withColumn("iou", F.col("shared") / F.col("either"))


def mirrored(mask: DataFrame, by: str = "img", axis: str = "x") -> DataFrame:
    """Set pixels (by, y, x) reflected within their extent along ``axis``."""
    extent = mask.groupBy(by).agg((F.min(axis) + F.max(axis)).alias("ends"))
    return mask.join(extent, by).withColumn(axis, F.col("ends") - F.col(axis)).select(by, "y", "x")


#: Rounds of erosion or dilation that one shuffle does.
AT_ONCE = 3


def _diamond(r: int) -> list[tuple[int, int]]:
    """Steps to all pixels that r moves to a neighbour reach."""
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dy) + abs(dx) <= r]


def _around(steps: list[tuple[int, int]]) -> Column:
    return F.inline(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps]))


def _outside(y: Column, x: Column, height: int | None, width: int | None) -> Column:
    out = F.lit(False)
    if height is not None:
        out |= ~y.between(0, height - 1)
    if width is not None:
        out |= ~x.between(0, width - 1)
    return out


def eroded(mask: DataFrame, by: str = "img", rounds: int = 1, height: int | None = None, width: int | None = None) -> DataFrame:
    """Set pixels whose four neighbours are set, ``rounds`` times; neighbours outside an image of height x width (None: without bounds) have no say.

    That is, those whose every pixel within ``rounds`` moves is set or outside, so some rounds are one count.
    """
    mask = mask.select(by, "y", "x").distinct()
    while rounds > 0:
        steps = _diamond(min(rounds, AT_ONCE))
        votes = mask.select(by, _around(steps)).groupBy(by, "y", "x").agg(F.count("*").alias("votes"))
        gone = F.lit(0)
        if height is not None or width is not None:
            gone = F.aggregate(F.array(*[_outside(F.col("y") + dy, F.col("x") + dx, height, width).cast("int") for dy, dx in steps]), F.lit(0), lambda n, x: n + x)
        left = votes.join(mask, [by, "y", "x"], "left_semi").where(F.col("votes") + gone >= len(steps)).select(by, "y", "x")
        rounds -= AT_ONCE
        mask = stored(left, "eroded") if rounds > 0 else left
    return mask


def dilated(mask: DataFrame, by: str = "img", rounds: int = 1, height: int | None = None, width: int | None = None) -> DataFrame:
    """Set pixels and their four neighbours within the image, ``rounds`` times: all pixels of the image within so many moves of a set one."""
    mask = mask.select(by, "y", "x")
    while rounds > 0:
        grown = mask.select(by, _around(_diamond(min(rounds, AT_ONCE)))).where(~_outside(F.col("y"), F.col("x"), height, width)).distinct()
        rounds -= AT_ONCE
        mask = stored(grown, "dilated") if rounds > 0 else grown
    return mask


def labelled(mask: DataFrame, by: str = "img") -> DataFrame:
    """4-connected components of set pixels: each with label, the number of its component's first pixel (y << 32 | x). Runs along rows are joined, not pixels."""
    from .sequences import runs

    rows = runs(mask.select(by, "y", "x", F.lit(True).alias("on")), [by, "y"], "x").withColumn("node", F.concat_ws(":", F.col(by).cast("string"), F.lpad(F.col("y").cast("string"), 10, "0"), F.lpad(F.col("lo").cast("string"), 10, "0")))
    # Overlapping runs of neighbouring rows share a column: cells of a fixed width bring them together.
    width = 64
    cells = rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    below = cells.select(F.col(by).alias("by2"), (F.col("y") - 1).alias("y2"), "cell", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("node").alias("node2")).withColumnRenamed("cell", "cell2")
    touching = cells.join(below, (F.col(by) == F.col("by2")) & (F.col("y") == F.col("y2")) & (F.col("cell") == F.col("cell2")) & (F.col("lo") <= F.col("hi2")) & (F.col("lo2") <= F.col("hi")))
    tied = components(touching.select(F.col("node").alias("a"), F.col("node2").alias("b")))
    return rows.join(tied.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(by, "y", "lo", "hi", F.coalesce("label", "node").alias("label"))


def fills(rects: DataFrame, by: str, k: int = 4) -> DataFrame:
    """The k fills of each page (by, rgb, x0, x1, y0, y1) with the largest area of boxes: paths, area, rank; ties by colour."""
    sums = rects.groupBy(by, "rgb").agg(F.count("*").alias("paths"), F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("area"), "rgb"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= k)


def hidden_share(pixels: DataFrame, shown: Column) -> DataFrame:
    """Per image the share of its pixels that are not shown."""
    return pixels.groupBy("img").agg((1 - F.avg(F.when(shown, 1.0).otherwise(0.0))).alias("hidden"))


def wall_candidates(colours: DataFrame) -> DataFrame:
    """Colours of images (img, rgb, share that bands take of it, contrast of 765) by score, share times contrast; ties by colour."""
    score = F.bround(F.col("share") * F.col("contrast") / 765, 5)
    scored = colours.select("img", "rgb", score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("img").orderBy(F.desc("score"), "rgb")))


def _grid(t, columns: list[str]):
    """The pixels of one image as an array of its extent, with what each column holds (0 elsewhere)."""
    import numpy as np

    y, x = t["y"].to_numpy(), t["x"].to_numpy()
    out = np.zeros((len(columns), int(y.max()) + 1, int(x.max()) + 1))
    for i, c in enumerate(columns):
        out[i, y, x] = t[c].to_numpy()
    return out


def colour_classes(pixels: DataFrame, n: int = 8, tol: int = 24, least: float = 0.002) -> DataFrame:
    """Main colours of each image (img, y, x, r, g, b): rank, r, g, b (means) and share.

    The fullest bin of sixteen levels of what is left gives a mean colour, which claims all left within ``tol`` of it, until n are found or a bin
    holds less than ``least`` of the image. Each claim hangs on those before, so an image is one group, as its distinct colours and their numbers.
    """
    counts = pixels.groupBy("img", "r", "g", "b").agg(F.count("*").alias("n"))

    def one(key, t):
        import numpy as np
        import pandas as pd

        rgb, c = t[["r", "g", "b"]].to_numpy(float), t["n"].to_numpy(float)
        bins = ((rgb // 16) @ np.array([256, 16, 1])).astype(int)
        left, total, rows = np.ones(len(c), bool), c.sum(), []
        for _ in range(3 * n):
            if len(rows) == n or not left.any():
                break
            full = np.bincount(bins[left], c[left])
            top = int(full.argmax())
            if full[top] < least * total:
                break
            inside = left & (bins == top)
            mean = np.rint(np.average(rgb[inside], axis=0, weights=c[inside]))
            mine = left & ((np.abs(rgb - mean).max(axis=1) <= tol) | inside)
            rows.append((key[0], len(rows), *mean.astype(int).tolist(), c[mine].sum() / total))
            left &= ~mine
        return pd.DataFrame(rows, columns=["img", "rank", "r", "g", "b", "share"])

    return counts.groupBy("img").applyInPandas(one, f"img {dict(pixels.dtypes)['img']}, rank int, r int, g int, b int, share double")


def band_profile(pixels: DataFrame, most: int = 40) -> DataFrame:
    """How wide the bands of a mask are, per image of set pixels (img, y, x): share, what is left of it after it is closed by 2 and thinned by 1, and width, the steps of thinning after which under a fifth of that is left, doubled (null if it never is in ``most`` steps)."""

    def one(key, t):
        import numpy as np
        import pandas as pd

        m = np.pad(_grid(t.assign(on=1.0), ["on"])[0] > 0, 3)

        def moved(a, fill):
            b = np.pad(a, 1, constant_values=fill)
            return b[:-2, 1:-1], b[2:, 1:-1], b[1:-1, :-2], b[1:-1, 2:]

        grow = lambda a: np.logical_or.reduce([a, *moved(a, False)])
        thin = lambda a: np.logical_and.reduce([a, *moved(a, True)])
        closed = thin(thin(grow(grow(m))))
        now = thin(closed)
        first, width, k = now.sum(), None, 1
        while first and k <= max(2, most // 2):
            if now.sum() < 0.2 * first:
                width = 2 * k
                break
            now, k = thin(now), k + 1
        return pd.DataFrame([(key[0], float(first / max(1, m.sum())), width)], columns=["img", "share", "width"])

    return pixels.select("img", "y", "x").distinct().groupBy("img").applyInPandas(one, f"img {dict(pixels.dtypes)['img']}, share double, width double")


def aligned(a: DataFrame, b: DataFrame, reach: int, peaks: int = 25) -> DataFrame:
    """The shift (dx, dy) of mask b against mask a (pairs of images img; set pixels y, x), no further than ``reach``, whose overlap is best: shared and iou, and at_edge, whether it lies at the end of the search.

    All shifts are scored by their common pixels (by fast Fourier transform), the ``peaks`` best by intersection over union; ties to the shorter shift, then dy, dx. An image pair is one group.
    """

    def one(key, p, q):
        import numpy as np
        import pandas as pd

        columns = ["img", "dx", "dy", "shared", "iou", "at_edge"]
        if not len(p) or not len(q):
            return pd.DataFrame([], columns=columns)
        u, v = _grid(p.assign(on=1.0), ["on"])[0], _grid(q.assign(on=1.0), ["on"])[0]
        size = [max(m, n) + reach for m, n in zip(u.shape, v.shape, strict=True)]
        both = np.rint(np.fft.irfft2(np.fft.rfft2(u, size) * np.conj(np.fft.rfft2(v, size)), size))
        rows = []
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                rows.append((both[dy % size[0], dx % size[1]], dx, dy))
        rows.sort(key=lambda r: (-r[0], r[1] ** 2 + r[2] ** 2, r[2], r[1]))
        total = u.sum() + v.sum()
        best = max(rows[:peaks], key=lambda r: (r[0] / (total - r[0]), -(r[1] ** 2 + r[2] ** 2), -r[2], -r[1]))
        n, dx, dy = best
        return pd.DataFrame([(key[0], dx, dy, int(n), n / (total - n), max(abs(dx), abs(dy)) == reach)], columns=columns)

    kind = dict(a.dtypes)["img"]
    left, right = (t.select("img", "y", "x").distinct().groupBy("img") for t in (a, b))
    return left.cogroup(right).applyInPandas(one, f"img {kind}, dx int, dy int, shared long, iou double, at_edge boolean")
