"""Phrase collocations: word runs that are frequent together, beside how frequent their parts are alone.

All runs of 1 to ``longest`` words become rows and are counted per language; a piece of text that
repeats is counted once with its number first, so a group of copies costs one row. A run of two words
or more that is there ``least`` times is a candidate, and so is every part of it, so runs of three
words or more are rows only where a coarse filter of a fixed number of bits does not say that the run
without its last or its first word is rarer. The filter loses none: all that pass are counted exactly.
A candidate's score is that of its weakest cut, in exact decimals. Candidates that stand mostly within
one longer run give way to it.
If a run of any length holds a candidate that often, the run one word longer on the way to it does
too, so one-word extensions are all that is looked at.

Null texts are empty; null languages are ``und``; rows that are equal count each.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stored, table
from .resampling import grams, lowered

PIECE_END, BLANKS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
LONGEST, LEAST, SHARE, TOP, SCALE = 4, 30, 80, 2000, 2_000_000
#: A language's best are taken from each of so many parts of its candidates first, then together.
SALTS = 64
#: Cells of the filter on runs of three words and more: a broadcast of CELLS / 64 rows at most.
CELLS = 1 << 24


def _bits(found: DataFrame) -> DataFrame:
    """word and bits: a bit for each of CELLS in which a phrase of found lies; CELLS / 64 rows at most."""
    cell = F.pmod(F.xxhash64("lang", "phrase"), F.lit(CELLS))
    marks = found.select(F.shiftright(cell, 6).cast("int").alias("word"), F.pmod(cell, F.lit(64)).cast("int").alias("bit"))
    return stored(marks.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")), "phrase-bits")


def _may_be(rows: DataFrame, phrase: str, bits: DataFrame) -> DataFrame:
    """The rows whose ``phrase`` may be one of those behind bits."""
    cell = F.pmod(F.xxhash64("lang", phrase), F.lit(CELLS))
    at = rows.withColumn("at", cell)
    met = at.join(F.broadcast(bits), F.shiftright("at", 6).cast("int") == F.col("word"))
    return met.where(F.expr("getbit(bits, CAST(pmod(at, 64) AS INT)) = 1")).select(rows.columns)


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, phrase (words joined by a space), words (how many) and f: all runs that are there ``least`` times, and all single words."""
    of = F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang")
    pieces = docs.select(of, F.explode(F.split(lowered(F.col(text)), PIECE_END)).alias("piece"))
    pieces = pieces.where(F.col("piece").rlike(r"[^\x20\x09]")).groupBy("lang", "piece").agg(F.count("*").alias("times"))
    pieces = stored(pieces, "pieces")
    split = pieces.select("lang", "times", F.filter(F.split("piece", BLANKS), lambda w: w != "").alias("split"))
    enough = F.col("f") >= least
    runs = grams(split, "split", 2).groupBy("lang", F.col("gram").alias("phrase")).agg(F.sum("times").alias("f"))
    found = [stored(runs.withColumn("words", F.when(F.instr("phrase", " ") > 0, 2).otherwise(1)).where(enough | (F.col("words") == 1)).select("lang", "phrase", "words", "f"), "phrases")]
    for n in range(3, longest + 1):
        bits = _bits(found[-1].where(enough & (F.col("words") == n - 1)))
        names = [f"w{i}" for i in range(n)]
        each = split.select("lang", "times", F.explode(F.arrays_zip(*[F.slice("split", i + 1, F.size("split")).alias(w) for i, w in enumerate(names)])).alias("at"))
        each = each.where(F.col("at")[names[-1]].isNotNull()).select("lang", "times", *[F.col("at")[w].alias(w) for w in names])
        each = _may_be(each.withColumn("start", F.concat_ws(" ", *names[:-1])), "start", bits)
        each = _may_be(each.withColumn("end", F.concat_ws(" ", *names[1:])), "end", bits)
        runs = each.groupBy("lang", F.concat_ws(" ", "start", names[-1]).alias("phrase")).agg(F.sum("times").alias("f"))
        found.append(stored(runs.where(enough).select("lang", "phrase", F.lit(n).alias("words"), "f"), "phrases"))
        discard(bits)
    discard(pieces)
    return functools.reduce(DataFrame.unionByName, found)


def _cuts(candidates: DataFrame, longest: int) -> DataFrame:
    """A row for each way to cut a candidate in two: lang, phrase, words, a, k, first and rest."""
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    first = F.expr("substring_index(phrase, ' ', k)")
    return cut.withColumn("first", first).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))


def collocations(counts: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` candidates that stay. counts: stored tables, from counted()."""
    sizes = counts.where(F.col("words") == 1).groupBy(F.col("lang").alias("of")).agg(F.sum("f").alias("n"))
    candidates = counts.where((F.col("words") > 1) & (F.col("f") >= least)).withColumnRenamed("f", "a")
    parts = counts.where((F.col("words") < longest) & (F.col("f") >= least))
    left = parts.select(F.col("lang").alias("l_lang"), F.col("phrase").alias("l_phrase"), F.col("f").alias("l"))
    right = parts.select(F.col("lang").alias("r_lang"), F.col("phrase").alias("r_phrase"), F.col("f").alias("r"))
    cut = _cuts(candidates, longest)
    cut = cut.join(left, (F.col("lang") == F.col("l_lang")) & (F.col("first") == F.col("l_phrase")))
    cut = cut.join(right, (F.col("lang") == F.col("r_lang")) & (F.col("rest") == F.col("r_phrase")))
    # Decimal division that keeps the whole part alone: nothing is rounded, and products have 38 digits.
    score = F.expr(f"(CAST(a AS DECIMAL(20, 0)) * CAST({SCALE} AS DECIMAL(10, 0))) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    weakest = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # What a longer candidate says about the two runs that lack its last or first word.
    longer = candidates.where(F.col("words") > 2)
    without = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))
    within = longer.select(F.col("lang").alias("in_lang"), F.explode(without).alias("within"), F.col("a").alias("longer_a"))
    within = within.groupBy("in_lang", "within").agg(F.max("longer_a").alias("longer_a"))
    many = F.expr(f"CAST(longer_a AS DECIMAL(20, 0)) * 100 >= CAST(a AS DECIMAL(20, 0)) * {share}")
    stay = weakest.join(within, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("within")) & many, "left_anti")
    stay = stay.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    few = stay.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return few.join(sizes, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(docs: DataFrame) -> DataFrame:
    return collocations(counted(docs.select("text", "lang")))


def run(spark, sf_dir: str) -> DataFrame:
    return query(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
runs AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM split, range(1, 5) t(k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM runs GROUP BY ALL),
sizes AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, a, words, c, array_to_string(w[1:c], ' ') AS first, array_to_string(w[c + 1:], ' ') AS rest FROM cand, range(1, 4) t(c) WHERE c < words),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, words, c, x.f AS l, y.f AS r, (2000000 * a) // (x.f + y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
stay AS (
  SELECT * FROM weakest p WHERE NOT EXISTS (
    SELECT 1 FROM cand q WHERE q.lang = p.lang AND q.words > p.words AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ') AND 100 * q.a >= 80 * p.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
