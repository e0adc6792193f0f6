"""Quality rules with risk-controlled thresholds.

Per document a few plain measures are taken over the whole text. Fixed base rules reject the
worst; for each further rule a cutoff is learned per stratum from labelled documents, so that
the share of good documents that it rejects is provably small: a cutoff counts as safe if the
exact binomial test rejects "its false rejection rate is over its share of alpha". Cutoffs
of a rule are tried from the loosest to the strictest and the walk stops at the first that is not
proven safe (fixed-sequence testing, which needs no correction within the walk). This is done in
two ways, each with half of the level: a walk per rule, alpha and level divided over the rules,
for which a stratum needs many labels; and one walk over the cutoffs of all rules, with the whole
alpha for what they reject together. Over strata the level is divided (Bonferroni). Of the safe cutoffs, all of which hold together with the
stated probability, that with the most poor documents caught, less PRICE times the good ones lost,
is taken; ties go to the loosest.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stored

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
WINDOW = 8
_SYMBOL = re.compile(r"[#*$%&|<>]")
_SPACE = b" \t\n\x0b\f\r"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words that the text has twice or more."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        rolled = (rolled ^ hashes[i : i + n]) * _MIX
        rolled ^= rolled >> np.uint64(29)
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(hashes) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + width, -1)
    return int((np.cumsum(steps) > 0).sum())


def measures(text: str | None) -> tuple[int, ...]:
    """MEASURES of a text; null counts as empty. Words are runs of anything but space and U+0009 to U+000D."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\f", b"\r")))
    return len(words), chars, len(_SYMBOL.findall(text)), len(lines), len(lines) - len(set(lines)), repeated_words(hashes)


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with MEASURES (long) in a struct ``measured`` beside the rest of the row in a struct ``row``."""
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("measured", T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measures(x) for x in batch.column("text").to_pylist()], dtype=np.int64).reshape(-1, len(MEASURES))
            measured = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(MEASURES))], names=list(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column("row"), measured], names=["row", "measured"])

    return rows.mapInArrow(run, schema)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


#: Rules by name: the value, of which more is worse, from the measures; and the cutoffs, loosest first. A document fails the rule if its value is over the cutoff.
RULES: dict[str, tuple] = {
    "symbols_per_word": (lambda m: m["n_symbols"] / m["n_words"], [2.0 * 0.9**i for i in range(60)]),
    "dup_line_share": (lambda m: m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)), [0.96 * 0.93**i for i in range(50)]),
    "repeat_share": (lambda m: m["n_repeat_words"] / m["n_words"], [0.30 * 0.92**i for i in range(50)]),
    "long_words": (lambda m: m["word_chars"] / m["n_words"], [40.0 * 0.96**i for i in range(60)]),
    "short_words": (lambda m: m["n_words"] / m["word_chars"], [1.0 * 0.96**i for i in range(60)]),
}


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly summed, from the largest term down."""
    if k >= n:
        return 1.0
    log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, term = 1.0, 1.0
    if k > n * p:  # sum the upper tail instead
        total, term, i = 0.0, 1.0, k
        while i < n:
            term *= (n - i) / (i + 1) * p / (1 - p)
            total += term
            i += 1
            if term < 1e-17 * total:
                break
        return max(0.0, 1.0 - math.exp(log_term) * total)
    i = k
    while i > 0:
        term *= i / (n - i + 1) * (1 - p) / p
        total += term
        i -= 1
        if term < 1e-17 * total:
            break
    return min(1.0, math.exp(log_term) * total)


#: Poor documents that a rule must catch for each good one that it loses.
PRICE = 10


def _under(v: Column):
    return lambda cutoff: cutoff < v


def _proven(share: float, level: float):
    """Whether k false rejections of n good documents prove at ``level`` that the rate is not over ``share``."""

    @F.pandas_udf("boolean")
    def proven(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_cdf(int(a), int(b), share) <= level for a, b in zip(k, n, strict=True)], dtype=bool)

    return proven


def _cutoff(name: str, step: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RULES[name][1])), step + 1).alias(name)


def _by_rule(tried: DataFrame, alpha: float, level: float) -> DataFrame:
    """A walk per rule, each with its part of alpha and level: a row per stratum with a column per rule."""
    walk = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    safe = tried.withColumn("safe", _proven(alpha / len(RULES), level / len(RULES))("k", "n").cast("int")).withColumn("so_far", F.min("safe").over(walk))
    gain = F.struct((F.col("caught") - PRICE * F.col("k")).alias("gain"), (-F.col("step")).alias("loose"))
    best = safe.where("so_far = 1").groupBy("stratum").agg(*[(-F.max(F.when(F.col("rule") == name, gain))["loose"]).alias(name) for name in RULES])
    return best.select("stratum", *[_cutoff(name, F.col(name)) for name in RULES])


def _by_path(tried: DataFrame, passed: DataFrame, alpha: float, level: float) -> DataFrame:
    """One walk over the cutoffs of all rules, the union of their false rejections tested against the whole alpha: columns as of _by_rule().

    The path of a stratum is ordered by the share of good documents of the *other* strata that a
    cutoff rejects, then by step, so it does not depend on the good documents that it is tested on.
    """
    every = Window.partitionBy("rule", "step")
    cost = (F.sum("k").over(every) - F.col("k")) / F.greatest(F.lit(1), F.sum("n").over(every) - F.col("n"))
    path = tried.withColumn("cost", cost).withColumn("at", F.row_number().over(Window.partitionBy("stratum").orderBy("cost", "step", "rule")))
    path = stored(path.select("stratum", "rule", "step", "at"), "path")
    places = path.groupBy("stratum").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("rule") == name, F.struct("step", "at")))), lambda x: x["at"]).alias(name) for name in RULES])
    places = stored(places.withColumnRenamed("stratum", "path_of"), "path-places")
    # A document fails from the first place of the path on at which one of the rules rejects it.
    fails = [F.when(F.col("over")[name] > 0, F.element_at(F.col(name), F.lit(len(grid) + 1) - F.col("over")[name])) for name, (_, grid) in RULES.items()]
    first = passed.join(places, F.col("stratum") == F.col("path_of")).select("stratum", F.least(*fails).alias("at"), "good")
    counts = first.groupBy("stratum", "at").agg(F.count_if("good").alias("n"), F.count_if(~F.col("good")).alias("poor"))
    up_to = Window.partitionBy("stratum").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy("stratum"))
    walked = counts.withColumn("total", total).where("at IS NOT NULL").select("stratum", "at", F.col("total").alias("n"), F.sum("n").over(up_to).alias("k"), F.sum("poor").over(up_to).alias("caught"))
    safe = walked.withColumn("safe", _proven(alpha, level)("k", "n").cast("int")).withColumn("so_far", F.min("safe").over(up_to))
    gain = F.struct((F.col("caught") - PRICE * F.col("k")).alias("gain"), (-F.col("at")).alias("loose"))
    best = safe.where("so_far = 1").groupBy(F.col("stratum").alias("own")).agg((-F.max(gain)["loose"]).alias("until"))
    kept = path.join(best, (F.col("stratum") == F.col("own")) & (F.col("at") <= F.col("until")))
    steps = kept.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == name, F.col("step"))).alias(name) for name in RULES])
    return steps.select("stratum", *[_cutoff(name, F.col(name)) for name in RULES])


def cutoffs(labelled: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Safe cutoffs: a row per stratum with a column per rule (null: none is proven safe, the rule stands aside).

    labelled: stratum (string), measured, good (boolean). With probability 1 - delta or more, no
    stratum loses more than alpha of its good documents to all rules together. Rows with a null
    label, and those that the base rules reject, take no part.
    """
    m = F.col("measured")
    # The number of cutoffs that a value exceeds: a histogram by it holds all that the tests need.
    over = [F.size(F.filter(F.array(*map(F.lit, grid)), _under(F.coalesce(value(m), F.lit(0.0))))).alias(name) for name, (value, grid) in RULES.items()]
    passed = stored(labelled.where(F.col("good").isNotNull() & ~base_failed(m)).select("stratum", F.struct(*over).alias("over"), "good"), "rule-places")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col("over")[name].alias("over")) for name in RULES]))
    counts = passed.select("stratum", each.alias("x"), "good").groupBy("stratum", "x.rule", "x.over").agg(F.count_if("good").alias("n"), F.count_if(~F.col("good")).alias("poor"))
    counts = stored(counts, "rule-counts")
    strata = max(1, counts.select("stratum").distinct().count())
    # A value over the cutoff of a step is over those of all later (lower) steps: over size - step of them or more.
    size = F.create_map(*[F.lit(x) for name, (_, g) in RULES.items() for x in (name, len(g))])[F.col("rule")]
    total = F.sum("n").over(Window.partitionBy("stratum", "rule"))
    spread = counts.withColumn("total", total).withColumn("step", F.explode(F.sequence(F.lit(0), size - 1)))
    fails = F.col("over") >= size - F.col("step")
    tried = spread.groupBy("stratum", "rule", "step").agg(F.max("total").alias("n"), *[F.sum(F.when(fails, F.col(c)).otherwise(0)).alias(to) for c, to in (("n", "k"), ("poor", "caught"))])
    tried = stored(tried, "rule-steps")
    level = delta / 2 / strata
    ways = [_by_rule(tried, alpha, level).withColumn("way", F.lit(1)), _by_path(tried, passed, alpha, level).withColumn("way", F.lit(0))]
    ways = stored(ways[0].unionByName(ways[1]), "ways")
    # Both ways hold; the better on the labels is taken.
    rejects = [F.col("over")[name] > F.coalesce(F.size(F.filter(F.array(*map(F.lit, grid)), _under(F.col(name)))), F.lit(len(grid))) for name, (_, grid) in RULES.items()]
    rejected = passed.join(ways.withColumnRenamed("stratum", "own"), F.col("stratum") == F.col("own")).where(functools.reduce(Column.__or__, rejects))
    gains = rejected.groupBy("stratum", "way").agg((F.count_if(~F.col("good")) - PRICE * F.count_if("good")).alias("gain"))
    named = ways.join(gains, ["stratum", "way"], "left")
    best = named.groupBy("stratum").agg(F.max(F.struct(F.coalesce("gain", F.lit(0)).alias("gain"), "way", *RULES)).alias("best"))
    return best.select("stratum", *[F.col("best")[name].alias(name) for name in RULES])


def judged(measured: DataFrame, labelled: DataFrame, stratum: str, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """measured (of with_measures) with base_failed and kept.

    stratum names a field of ``row`` (null is a stratum of its own, as the empty string); a
    stratum without labels has no learned cutoffs. labelled: as for cutoffs().
    """
    # Written first, the few rows have a known size, by which Spark decides to broadcast them.
    limits = stored(cutoffs(labelled, alpha, delta), "cutoffs").select(F.col("stratum").alias("limit_of"), F.struct(*RULES).alias("limits"))
    m = F.col("measured")
    rows = measured.withColumn("stratum", F.coalesce(F.col("row")[stratum].cast("string"), F.lit(""))).join(limits, F.col("stratum") == F.col("limit_of"), "left")
    passes = F.lit(True)
    for name, (value, _) in RULES.items():
        passes &= F.coalesce(value(m) <= F.col("limits")[name], F.lit(True))
    failed = base_failed(m)
    return rows.select("row", "measured", failed.alias("base_failed"), (~failed & F.when(failed, True).otherwise(passes)).alias("kept"))


def labelled_rows(measured: DataFrame, labels: DataFrame, stratum: str, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """stratum, measured and good, of the rows whose key is labelled. Null keys match none; a key that is labelled twice counts as good only if all its labels are. Of rows that share a key one counts, as they are no independent trials: the first by stratum, then measures."""
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("labelled_key")).agg((F.min(F.col(label)) > 0).alias("good"))
    own = F.coalesce(F.col("row")[stratum].cast("string"), F.lit(""))
    return measured.select(own.alias("stratum"), "measured", F.col("row")[key].alias("own_key")).join(marks, F.col("own_key") == F.col("labelled_key")).groupBy("own_key").agg(F.min(F.struct("stratum", "measured")).alias("row"), F.first("good").alias("good")).select("row.*", "good")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    measured = stored(with_measures(docs.select("doc_id", "lang", "text")), "measures")
    found = judged(measured, labelled_rows(measured, labels, "lang"), "lang")
    return found.select("row.doc_id", *[F.col("measured")[m].alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")
