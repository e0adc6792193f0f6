"""Importance resampling towards a target distribution over hashed n-grams.

A document's n-grams fall into buckets by a checksum; a bucket's gain says how much more frequent it
is in the target texts than in the documents. A document weighs the mean gain of its n-grams, and
Gumbel noise from a hash of its key makes the highest scores a sample without replacement in
proportion to exp(weight / 1000). All of it is Spark SQL: the gains are a table of BUCKETS rows at
most, the draw one distributed sort whose ranks are a partition's offset and the place in it.

Null texts have no words and no n-grams, weight 0; rows that are equal are drawn each on its own,
their order being that of the stored input; rows with a null key share one hash and stand after
others of their score. Columns of any name may stand beside: none but key and text is read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, table

#: What stands between words, once A to Z are lower-cased: all of ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, LONGEST, SEED, PERCENT, LEAST_WORDS = 10_000, 2, 7, 25, 20
#: Rows of a partition, at most: monotonically_increasing_id() has the partition above these bits.
ROW_BITS = 33


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    return F.filter(F.split(lowered(text), BETWEEN), lambda w: w != "")


def grams(rows: DataFrame, words_: str, longest: int = LONGEST) -> DataFrame:
    """rows with a row for each run of 1 to ``longest`` words of the array ``words_``, as ``gram`` (joined by a space); rows without words have one with a null gram."""
    names = [f"w{i}" for i in range(longest)]
    at = F.explode_outer(F.arrays_zip(*[F.slice(words_, i + 1, F.size(words_)).alias(n) for i, n in enumerate(names)]))
    kept = [F.col(c) for c in rows.columns if c != words_]
    each = rows.select(*kept, at.alias("at")).select(*[c for c in rows.columns if c != words_], *[F.col("at")[n].alias(n) for n in names])
    # A run that passes the last word is null, as concat is of nulls; one null stays for rows without words.
    runs = F.stack(F.lit(longest), *[F.concat(*[x for n in names[: k + 1] for x in (F.lit(" "), F.col(n))][1:]) for k in range(longest)])
    out = each.select(*[c for c in rows.columns if c != words_], F.col("w0").isNull().alias("bare"), runs.alias("gram"))
    return out.where(F.col("gram").isNotNull() | F.col("bare")).drop("bare")


def bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int")


def bucket_counts(texts: DataFrame, text: str, buckets: int, longest: int) -> DataFrame:
    """bucket and n, the n-grams of texts in it: ``buckets`` rows at most."""
    each = grams(texts.select(words(F.col(text)).alias("words")), "words", longest)
    return each.where(F.col("gram").isNotNull()).groupBy(bucket(F.col("gram"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket and gain, a row for each of the buckets: floor(1000 ln of the smoothed share in the target over that in docs)."""
    spark = docs.sparkSession
    mine, theirs = (stored(bucket_counts(d, c, buckets, longest), n) for d, c, n in ((docs, text, "bucket-counts"), (target, target_text, "target-counts")))
    total = lambda d, name: d.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(name))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(mine.withColumnRenamed("n", "s"), "bucket", "left").join(theirs.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.crossJoin(F.broadcast(total(mine, "all_s"))).crossJoin(F.broadcast(total(theirs, "all_t")))  # a row each
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") + 1.0
    share = count("t") * (F.col("all_s") + float(buckets)) / (count("s") * (F.col("all_t") + float(buckets)))
    found = stored(both.select("bucket", F.floor(1000.0 * F.log(share)).cast("long").alias("gain")), "gains")
    discard(mine, theirs)
    return found


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and key."""
    first = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(first, 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, gain: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """key (long), place (unique), n_words, n_features, weight and score of each row of docs. gain: from gains(), broadcast; it has ``buckets`` rows."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.monotonically_increasing_id().alias("place"), words(F.col(text)).alias("words"))
    rows = rows.select("key", "place", F.size("words").cast("long").alias("n_words"), "words")
    each = grams(rows, "words", longest).withColumn("of", bucket(F.col("gram"), buckets))
    met = each.join(F.broadcast(gain), F.col("of") == F.col("bucket"), "left")
    sums = met.groupBy("place", "key", "n_words").agg(F.count("gram").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    return sums.withColumn("weight", mean).withColumn("score", F.col("weight") + noise(F.col("key"), seed)).select("key", "place", "n_words", "n_features", "weight", "score")


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows of scored() with rank: 1, 2, 3 and so on for the ``percent`` of those with ``least_words`` or more that have the highest scores, ties to the smaller key; null for the others."""
    fits = F.col("n_words") >= least_words
    ordered = rows.orderBy(F.desc(fits), F.desc("score"), F.col("key").asc_nulls_last(), "place")
    # The sort's partitions follow one another; the number says which partition a row is in, and which row of it.
    ordered = stored(ordered.withColumn("number", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("number", ROW_BITS)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count(F.when(fits, 1)).alias("fit")).orderBy("part").collect()  # a row for each task of the sort
    offsets, start = [], 0
    for r in sizes:
        offsets.append((r.part, start))
        start += r.n
    most = sum(r.fit for r in sizes) * percent // 100
    offsets = rows.sparkSession.createDataFrame(offsets, "part long, start long")
    placed = ordered.join(F.broadcast(offsets), part == F.col("part"))
    rank = F.col("start") + F.col("number").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    return placed.withColumn("rank", F.when(rank <= most, rank).cast("long")).select(*rows.columns, "rank")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    gain = gains(docs.select("text"), benchmark.select("text"))
    scores = stored(scored(docs.select("doc_id", "text"), gain), "scores")
    found = drawn(scores).select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")
    discard(gain, scores)
    return found


def run(spark, sf_dir: str) -> DataFrame:
    return query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
#: CRC-32 bit by bit, over the distinct n-grams.
ORACLE_SQL = f"""
WITH RECURSIVE lookup(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM lookup WHERE k < 8),
of_byte AS (SELECT list(c ORDER BY i) AS cs FROM lookup WHERE k = 8),
docs AS (SELECT row_number() OVER () AS place, doc_id, {_WORDS} AS w FROM documents),
marks AS (SELECT {_WORDS} AS w FROM benchmark),
both_words AS (SELECT place, w FROM docs UNION ALL SELECT NULL, w FROM marks),
features AS (
  SELECT place, unnest(w) AS f FROM both_words
  UNION ALL SELECT place, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM both_words),
distinct_features AS (SELECT DISTINCT f FROM features),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(hex(encode(f))) // 2 + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::UBIGINT)),
    lambda c, b: xor(c // 256, cs[(xor(c % 256, b))::BIGINT + 1])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM distinct_features, of_byte),
counts AS (SELECT bucket, count(place) AS s, count(*) - count(place) AS t FROM features JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM counts),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM counts, totals),
sums AS (SELECT place, count(*) AS n_features, sum(gain)::BIGINT AS total FROM features JOIN hashed USING (f) JOIN gain USING (bucket) WHERE place IS NOT NULL GROUP BY place),
weighed AS (
  SELECT d.place, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
    CASE WHEN n_features > 0 THEN ((total - (total % n_features + n_features) % n_features) // n_features)::BIGINT ELSE 0 END AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE AS h
  FROM docs d LEFT JOIN sums USING (place)),
scores AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM weighed),
ranked AS (SELECT *, row_number() OVER (ORDER BY n_words >= 20 DESC, score DESC, doc_id NULLS LAST) AS r, count(*) FILTER (WHERE n_words >= 20) OVER () * 25 // 100 AS most FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= most THEN r END AS rank FROM ranked
"""
