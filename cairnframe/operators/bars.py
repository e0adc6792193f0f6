"""Scale bars among the rectangles of a page: rows of cells, bars that touch, and the words beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values, in points: height and slimness of a bar's cells, how near they lie, the least length of a bar, and where its words stand.
MAX_HEIGHT, ASPECT, GAP, SAME, LEAST_LENGTH = 10.0, 3.0, 2.0, 1.0, 15.0
BESIDE = (25.0, 40.0, 30.0)
LABEL = r"(?i)\d|ft|feet|m\b|'"


def _merged(pages):
    """Bars of one page's slim rectangles: cells of a row first, then bars that touch, until none do."""
    import pandas as pd

    cells = pages.assign(yc=(pages.y0 + pages.y1) / 2, h=pages.y1 - pages.y0)
    cells = cells.assign(row=(cells.yc).round()).sort_values(["row", "x0", "x1", "yc"])
    bars: list[dict] = []
    for c in cells.itertuples():
        last = bars[-1] if bars else None
        if last and abs(c.yc - (last["y0"] + last["y1"]) / 2) < SAME and c.x0 <= last["x1"] + GAP and abs(c.h - (last["y1"] - last["y0"])) < SAME:
            last["x1"] = max(last["x1"], c.x1)
            last["cells"] += 1
            last["fills"].add(c.fill)
        else:
            bars.append({"x0": c.x0, "x1": c.x1, "y0": c.y0, "y1": c.y1, "cells": 1, "fills": {c.fill}, "checker": False})

    def join(a, b):
        if a["x0"] > b["x1"] + GAP or b["x0"] > a["x1"] + GAP or max(a["y1"], b["y1"]) - min(a["y0"], b["y0"]) > 2.5 * MAX_HEIGHT:
            return None
        stacked = abs(a["y1"] - b["y0"]) < SAME or abs(b["y1"] - a["y0"]) < SAME
        level = abs(a["y0"] - b["y0"]) < SAME and abs(a["y1"] - b["y1"]) < SAME
        if not (stacked or level):
            return None
        apart = abs((a["y0"] + a["y1"]) - (b["y0"] + b["y1"])) / 2 > 0.5
        return {k: f(a[k], b[k]) for k, f in (("x0", min), ("x1", max), ("y0", min), ("y1", max))} | {"cells": a["cells"] + b["cells"], "fills": a["fills"] | b["fills"], "checker": a["checker"] or b["checker"] or apart}

    i = 0
    while i < len(bars):
        met = next(((j, both) for j in range(i + 1, len(bars)) if (both := join(bars[i], bars[j]))), None)
        if met is None:
            i += 1
        else:
            del bars[met[0]]
            bars[i] = met[1]
            i = 0
    return pd.DataFrame([(b["x0"], b["y0"], b["x1"], b["y1"], b["cells"], len(b["fills"]) > 1 or b["checker"]) for b in bars], columns=["x0", "y0", "x1", "y1", "cells", "alternating"])


def bars(rects: DataFrame, by: str) -> DataFrame:
    """Bars of pages of rectangles (by, x0, y0, x1, y1, fill): their box, cells and alternating (fills or rows change along them). Each merge hangs on those before, so a page's slim rectangles are one group."""
    slim = rects.where((F.col("y1") > F.col("y0")) & (F.col("y1") - F.col("y0") <= MAX_HEIGHT) & (F.col("x1") - F.col("x0") >= ASPECT * (F.col("y1") - F.col("y0"))))
    slim = slim.select(by, *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], F.coalesce("fill", F.lit("")).alias("fill"))

    def one(key, t):
        out = _merged(t)
        out.insert(0, by, key[0])
        return out

    found = slim.groupBy(by).applyInPandas(one, f"{by} {dict(rects.dtypes)[by]}, x0 double, y0 double, x1 double, y1 double, cells long, alternating boolean")
    return found.where(F.col("x1") - F.col("x0") >= LEAST_LENGTH)


def labels(found: DataFrame, words: DataFrame, by: str) -> DataFrame:
    """Words (by, word, x0, y0, x1, y1) that lie wholly in the box around a bar and look like a length: by, and the bar's x0, y0, with labels in order of place."""
    left, right, up = BESIDE
    w = words.where(F.col("word").rlike(LABEL)).select(F.col(by).alias("w_page"), "word", *[F.col(c).alias(f"w_{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = (F.col("w_x0") >= F.col("x0") - left) & (F.col("w_x1") <= F.col("x1") + right) & (F.col("w_y0") >= F.col("y0") - up) & (F.col("w_y1") <= F.col("y1") + up)
    met = found.join(w, (F.col(by) == F.col("w_page")) & inside)
    order = F.transform(F.array_sort(F.collect_list(F.struct("w_y0", "w_x0", "word"))), lambda x: x["word"])
    return met.groupBy(by, "x0", "y0").agg(order.alias("labels"))


def scale_bars(rects: DataFrame, words: DataFrame, by: str, k: int = 4) -> DataFrame:
    """The k likeliest scale bars of each page: with labels before without, of several cells before one, then the longest; ties by place."""
    found = bars(rects, by)
    named = found.join(labels(found, words, by), [by, "x0", "y0"], "left")
    length = F.col("x1") - F.col("x0")
    order = Window.partitionBy(by).orderBy(F.col("labels").isNull(), (F.col("cells") <= 1), F.desc(length), "x0", "y0")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(by, "rank", "x0", "y0", length.alias("length"), "cells", "alternating", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))
