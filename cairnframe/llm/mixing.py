"""Mixing sources to target weights by entropy balancing.

Of all ways to weigh documents that give each source its target number of words, the one nearest
to the base rates in relative entropy tilts them exponentially: a document's rate is exp(l * words
/ scale) with one l per source, or the limit where that is lower. Its convex dual is solved by Newton steps; Spark sums words * rate
and words^2 * rate per source for each of them. A document's rate depends on its source and words
alone, so the sums run over counts of sizes, a source's in one row: as many as its texts have
different numbers of words. All steps of a source are one expression, and sources are dealt out.

The rates are then rounded into whole copies, from the longest documents to the shortest: of those of
one size as many get one more as bring the words taken so far nearest to the rates' words, so what
a long document adds or lacks is made up for by shorter ones as far as there are any, and the last miss
is about half of a source's shortest document. Which of equally long documents get one more is decided by a hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
NEWTON_STEPS, MOST_STEPS = 40, 100
#: Sizes of a source that are folded together, so that a source of very many sizes is no slower for each.
CHUNK = 256
#: Rows of a partition, at most: monotonically_increasing_id() has the partition above these bits.
ROW_BITS = 33


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size: a row per source) with target.

    Sources in code-point order, null last, weigh as ``weights``, repeated. They share ``share`` of
    all words; a target stops at ``most`` times its source's size and the rest is shared anew.
    The level at which that ends is found from sums over the sources in the order in which they
    reach their limit: those before a row have stopped, the others hold level x weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    limited = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - before) / rest
    stops = level * F.col("weight") >= F.col("limit")
    marked = limited.withColumn("level", level).withColumn("stops", stops)
    # The level of the first source that doesn't stop holds for it and all after it.
    final = F.min(F.when(~F.col("stops"), F.struct((F.col("limit") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(everything)["level"]
    return marked.withColumn("target", F.when(F.col("stops"), F.col("limit")).otherwise(final * F.col("weight"))).select("source", "source_size", "target")


def tilt(size: Column, target: Column) -> Column:
    """Newton's solution of min over t of size * exp(t) - target * t, exp of which is the rate; 0 without a target or words.

    The dual is convex; a step up is at most 1, as far below the solution full steps overshoot.
    """
    step = lambda t, _: t + F.least(F.lit(1.0), target / (size * F.exp(t)) - 1.0)
    return F.when((size > 0) & (target > 0), F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step))).otherwise(F.lit(0.0))


def solved(sizes: Column, target: Column, scale: Column, most: float) -> Column:
    """The tilt at which rates give ``target`` words (positive, at most ``most`` times all): Newton steps on the logarithm of the words taken, kept between the bounds found.

    sizes: array of (size, n), the documents with that many words. At a tilt of scale * log(most) all
    are at the limit. An error if MOST_STEPS do not do.
    """
    limit = math.log(most)
    zero = F.struct(F.lit(0.0).alias("first"), F.lit(0.0).alias("second"))

    def sums(t: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            share = x["size"] / scale
            taken = x["n"] * x["size"] * F.exp(F.least(F.lit(limit), t * share))
            return F.struct((acc["first"] + taken).alias("first"), (acc["second"] + F.when(t * share < limit, taken * share).otherwise(0.0)).alias("second"))

        return F.aggregate(sizes, zero, add)

    def state(t: Column, lo: Column, hi: Column, met: Column) -> Column:
        return F.struct(t.alias("t"), lo.alias("lo"), hi.alias("hi"), met.alias("met"))

    def step(s: Column, _: Column) -> Column:
        def moved(got: Column) -> Column:
            lo = F.when(got["first"] < target, s["t"]).otherwise(s["lo"])
            hi = F.when(got["first"] > target, s["t"]).otherwise(s["hi"])
            newton = s["t"] + F.log(target / got["first"]) * got["first"] / got["second"]
            inside = (got["second"] > 0) & (got["first"] > 0) & (newton < hi) & (lo.isNull() | (newton > lo))
            halved = F.when(lo.isNull(), s["t"] - F.greatest(F.lit(1.0), F.abs(s["t"]))).otherwise((lo + hi) / 2)
            met = F.abs(got["first"] / target - 1) <= 1e-11
            return state(F.when(met, s["t"]).when(inside, newton).otherwise(halved), lo, hi, met)

        # One-element transform: the sums are taken once and used by name.
        return F.when(s["met"], s).otherwise(F.transform(F.array(sums(s["t"])), moved)[0])

    words = F.aggregate(sizes, F.lit(0.0), lambda acc, x: acc + x["n"] * x["size"])
    top = scale * limit
    full = target >= words * (most * (1 - 1e-12))
    # The rate that all would have if it were one is the first guess.
    start = state(F.when(full, top).otherwise(F.least(top, F.log(tilt(words, target)))), F.lit(None).cast("double"), top, full)
    end = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_STEPS)), start, step)
    return F.transform(F.array(end), lambda s: F.when(s["met"] | (F.abs(s["hi"] - s["lo"]) <= F.abs(s["hi"]) * 1e-13), s["t"]).otherwise(F.raise_error(F.lit("the dual of a source has not converged")).cast("double")))[0]


def rates(sizes: Column, tilt_: Column, scale: Column, most: float) -> Column:
    """array of (size, n) with each size's rate; 0 without a tilt."""
    rate = lambda x: F.when(tilt_.isNull(), F.lit(0.0)).otherwise(F.exp(F.least(F.lit(math.log(most)), tilt_ * x["size"] / scale)))
    return F.transform(sizes, lambda x: F.struct(x["size"].alias("size"), x["n"].alias("n"), rate(x).alias("rate")))


def _more(groups: Column) -> Column:
    """Array of (size, n, rate), longest first: with whole, the copies that each of the n gets, and more, how many get one beside."""
    out = "array<struct<size:bigint,n:bigint,rate:double,whole:bigint,more:bigint>>"

    def one(s: Column, g: Column) -> Column:
        whole = F.floor(g["rate"] + 1e-9)
        owed = s["owed"] + g["n"] * g["size"] * F.greatest(F.lit(0.0), g["rate"] - whole)
        most = F.when(g["rate"] - whole > 1e-9, g["n"]).otherwise(F.lit(0).cast("long"))
        more = F.least(most, F.greatest(F.lit(0).cast("long"), F.round(owed / g["size"]).cast("long")))
        return F.struct((owed - more * g["size"]).alias("owed"), F.concat(s["out"], F.array(F.struct(g["size"].alias("size"), g["n"].alias("n"), g["rate"].alias("rate"), whole.alias("whole"), more.alias("more")))).alias("out"))

    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast(out).alias("out"))

    def chunk(s: Column, at: Column) -> Column:
        inner = F.aggregate(F.slice(groups, at, CHUNK), F.struct(s["owed"].alias("owed"), F.array().cast(out).alias("out")), one)
        return F.transform(F.array(inner), lambda x: F.struct(x["owed"].alias("owed"), F.concat(s["out"], F.array(x["out"])).alias("out")))[0]

    chunks = F.struct(F.lit(0.0).alias("owed"), F.array().cast(f"array<{out}>").alias("out"))
    starts = F.when(F.size(groups) > 0, F.sequence(F.lit(1), F.size(groups), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.aggregate(starts, chunks, chunk)["out"])


def rounded(counts: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """of (source), size, rate, whole and more of each source's documents of ``size`` words, longest first in their rounding.

    counts: own (source), size (positive), n documents of it; goals: source and target, which is at
    most ``most`` times the source's words.
    """
    sizes = counts.groupBy("own").agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "n")))).alias("sizes"))
    squares = F.aggregate("sizes", F.lit(0.0), lambda a, x: a + x["n"].cast("double") * x["size"] * x["size"])
    words = F.aggregate("sizes", F.lit(0.0), lambda a, x: a + x["n"].cast("double") * x["size"])
    now = sizes.join(goals.select("source", "target"), F.col("source").eqNullSafe(F.col("own"))).withColumn("scale", squares / words)
    # Written before the rounding, so that no step is taken twice.
    now = stored(now.withColumn("tilt", F.when(F.col("target") > 0, solved(F.col("sizes"), F.col("target"), F.col("scale"), most))).select("own", "sizes", "tilt", "scale"), "tilts")
    groups = now.withColumn("groups", rates(F.col("sizes"), F.col("tilt"), F.col("scale"), most))
    found = stored(groups.select(F.col("own").alias("of"), F.explode(_more(F.col("groups"))).alias("g")).select("of", "g.size", "g.rate", "g.whole", "g.more"), "copies-of-sizes")
    discard(now)
    return found


def _numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows, stored in that order (which must be total), with number (from 0): the place in a distributed sort's partition beyond the rows of those before."""
    ordered = stored(rows.orderBy(*order).withColumn("id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("id", ROW_BITS)
    offsets, start = [], 0
    for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each task of the sort
        offsets.append((r.part, start))
        start += r.n
    offsets = rows.sparkSession.createDataFrame(offsets, "part long, start long")
    number = F.col("start") + F.col("id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return ordered.join(F.broadcast(offsets), part == F.col("part")).withColumn("number", number).drop("id", "part", "start")


def mix(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of docs without their text, as a struct ``row``, with source, size, source_size, target, rate and copies.

    size: words of the text (null: 0). Rows without words get no copies. Null sources are one
    source. Equal rows are rounded each on its own; among documents of one source and size a
    hash of the row, then its place in the stored input, says which get the copies that are left, so
    reruns agree. copies is at most ceil(most).
    """
    kept = [c for c in docs.columns if c != text]
    sized = docs.select(F.struct(*kept).alias("row"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.monotonically_increasing_id().alias("place"))
    sized = stored(sized.withColumn("chance", F.xxhash64("row", "size")), "sizes")
    counts = stored(sized.groupBy(F.col("source").alias("own"), "size").agg(F.count("*").alias("n")), "size-counts")
    sums = counts.groupBy(F.col("own").alias("source")).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goals = stored(targets(sums, weights, share, most), "targets")
    groups = rounded(counts.where(F.col("size") > 0), goals, float(most))
    ordered = _numbered(sized, F.col("source").asc_nulls_last(), F.desc("size"), F.col("chance"), F.col("place"))
    of_size = groups.withColumnRenamed("size", "of_size").withColumn("known", F.lit(True))
    plan = ordered.groupBy(F.col("source").alias("own"), F.col("size").alias("own_size")).agg(F.min("number").alias("first"))
    plan = plan.join(of_size, F.col("own").eqNullSafe(F.col("of")) & (F.col("own_size") == F.col("of_size")), "left").join(goals, F.col("own").eqNullSafe(F.col("source")))
    none = lambda c: F.when(F.col("known"), F.col(c)).otherwise(F.lit(0)).alias(c)
    plan = stored(plan.select("own", "own_size", "first", "source_size", "target", none("rate"), none("whole"), none("more")), "plan")
    met = ordered.join(plan, F.col("source").eqNullSafe(F.col("own")) & (F.col("size") == F.col("own_size")))
    copies = F.col("whole") + (F.col("number") - F.col("first") < F.col("more")).cast("long")
    discard(sized, counts, goals, groups)
    return met.select("row", "source", "size", "source_size", "target", "rate", copies.cast("long").alias("copies"))


def query(docs: DataFrame) -> DataFrame:
    mixed = mix(docs.select("doc_id", "source", "text"))
    return mixed.select("row.doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")
