"""Scoring texts with a hashed maximum-entropy language model, beside their score by word counts alone.

Spark counts the words of the training texts; the most frequent ones get codes of their own and
classes, all others are of classes by their last two bytes. What a history says is a sum of hashed
weights (see maxent), fitted in ROUNDS updates: in each, every task sums over a part of its training
texts what was seen and what the weights so far expected, Spark adds up the tasks' sums block by
block, and the step up that gradient is taken once for all. Each training text is in one round. A task's sums are as
large as the weights, whatever it reads, and there are as many tasks as the cluster runs at once.

Texts are then scored in batches of sparse rows. A word of a rare class is as likely within it as
its count, for which the words are joined that are not among COMMON ones sent with their counts; a word never seen in
training is one more word of its class, of count 0. So the probabilities of all words, with one unseen
word for each class, sum to 1 after any history.

Null texts are empty and have the end alone; a null key is that of an empty text, so it trains; equal
rows are scored each on its own; without training texts all words are unseen. No column but key and text is read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import maxent
from .common import slices, stored, table
from .resampling import lowered

BETWEEN = r"[\x20\x09-\x0D]+"
FOLDS, HELD = 5, 1
#: Steps of the updates, one for each round; words whose counts are broadcast; tokens scored together; bytes of a text at a time, about; and rows of a block of sums.
STEPS, PRIOR = (0.5, 0.4, 0.3, 0.25, 0.2, 0.15), 1.0
COMMON, BATCH, PART, BLOCK = 65_536, 32_768, 1 << 20, 1024
#: The end of a text; no word is empty.
END = b""


def held_out(key: Column, folds: int = FOLDS, held: int = HELD) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """word and c over texts, the end of each (an empty word) among them."""
    words = texts.select(F.explode(F.concat(F.filter(F.split(lowered(F.col(text)), BETWEEN), lambda w: w != ""), F.array(F.lit("")))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("c"))


def rare_class(word: Column, rare: int) -> Column:
    return F.pmod(F.crc32(F.substring(word.cast("binary"), -2, 2)), F.lit(rare)).cast("int")


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about PART bytes that end between words."""
    start = 0
    while start + PART < len(text):
        end = start + PART
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def _tokens(batches: Iterator[pa.RecordBatch], codes: maxent.Codes) -> Iterator[tuple[pa.RecordBatch, int, list[bytes], np.ndarray, np.ndarray]]:
    """Of each part of each text: the batch and the row in it, its words (the last part with the end), their codes after those of the tokens before, and the places of the words among these."""
    for some in slices(batches):
        for i, text in enumerate(some.column("text")):
            before = np.full(maxent.BACK, -1, np.int64)
            parts = list(_parts((text.as_py() or "").encode().lower()))
            for n, part in enumerate(parts):
                words = part.split()
                if n == len(parts) - 1:
                    words.append(END)
                own = np.concatenate([before, np.fromiter(map(codes.__getitem__, words), np.int64, len(words))])
                before = own[-maxent.BACK :]
                yield some, i, words, own, np.arange(maxent.BACK, len(own))


def _batched(codes: list[np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum([0] + [len(c) for c in codes[:-1]])
    return np.concatenate(codes), np.concatenate([p + s for p, s in zip(places, starts, strict=True)])


class Model:
    """A fitted model: shape, the frequent and the common words in the order of their codes, with their counts, what each rare class weighs, all tokens and distinct words of the training texts, and the weights."""

    def __init__(self, shape: maxent.Shape, frequent: list[tuple[bytes, int]], common: list[tuple[bytes, int]], mass: list[float], tokens: int, distinct: int):
        self.shape, self.mass, self.tokens, self.distinct = shape, mass, tokens, distinct
        self.frequent, counts = (list(x) for x in zip(*frequent, strict=True))
        self.common, self.common_counts = [w for w, _ in common], [c for _, c in common]
        self.counts = counts
        self.weights = maxent.start(shape, np.array(counts) + 0.5, np.array(mass))

    def base(self, count: Column) -> Column:
        return F.log10((count + 0.5) / F.lit(self.tokens + 0.5 * (self.distinct + 1)))


def counted(counts: DataFrame, shape: maxent.Shape) -> tuple[Model, DataFrame]:
    """A model that knows counts (stored; word and c) and no history yet, and counts without its frequent and common words. Words that share the count at which these end are neither."""
    spark = counts.sparkSession
    words, most = counts.where(F.col("word") != ""), shape.frequent - 1 + COMMON
    # The least count that no more words reach: a row for each count there is is looked at, not each word.
    upto = F.sum("n").over(Window.orderBy(F.desc("c")))
    least = words.groupBy("c").agg(F.count("*").alias("n")).withColumn("upto", upto).where(F.col("upto") <= most).agg(F.min("c").alias("c")).collect()[0].c
    reached = words.where(F.col("c") >= least).collect() if least is not None else []  # ``most`` words at most
    top = sorted(((r.word.encode(), r.c) for r in reached), key=lambda x: (-x[1], x[0]))
    all_ = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("c"))), F.lit(0)).alias("ends")).collect()[0]
    frequent = sorted([(END, all_.ends), *top[: shape.frequent - 1]], key=lambda x: (-x[1], x[0]))
    common = top[shape.frequent - 1 :]
    first = spark.createDataFrame([(w.decode(),) for w, _ in frequent], "word string")
    mass = dict.fromkeys(range(shape.rare), 0.5)  # an unseen word's
    for r in counts.join(F.broadcast(first), "word", "left_anti").groupBy(rare_class(F.col("word"), shape.rare).alias("of")).agg(F.sum(F.col("c") + 0.5).alias("mass")).collect():
        mass[r.of] += r.mass
    own = spark.createDataFrame([(w.decode(),) for w, _ in frequent + common], "word string")
    return Model(shape, frequent, common, [mass[i] for i in range(shape.rare)], all_.n, all_.v), counts.join(F.broadcast(own), "word", "left_anti")


def _summed(texts: DataFrame, model: Model) -> list[tuple[np.ndarray, np.ndarray]]:
    """What was seen and what was expected in texts (text), for the class rows and the word rows."""
    context = texts.sparkSession.sparkContext
    sent = context.broadcast(model.weights)  # of a size that the shape sets
    shape, frequent, common = model.shape, model.frequent, model.common
    tables = (model.weights.class_rows.shape, model.weights.word_rows.shape)
    blocks = [(t, half, start) for t, (rows, _) in enumerate(tables) for half in (0, 1) for start in range(0, rows, BLOCK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        sums, codes, waiting, n = maxent.Sums(weights), maxent.Codes(shape, frequent, common), [], 0

        def take() -> None:
            all_codes, at = _batched([c for c, _ in waiting], [p for _, p in waiting])
            for _, parts in maxent.pieces(all_codes, at, weights, shape, True):
                sums.add(parts)

        for _, _, _, own, at in _tokens(batches, codes):
            waiting.append((own, at))
            n += len(at)
            if n >= BATCH:
                take()
                waiting, n = [], 0
        if waiting:
            take()
        if sums.tokens:
            halves = sums.seen, sums.expected
            for i, (t, half, start) in enumerate(blocks):
                part = halves[half][t][start : start + BLOCK].astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "sums"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = None, None
        for batch in parts:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
                x = np.frombuffer(part.as_buffer(), np.float32).astype(float)
                total, of = x if total is None else total + x, block
        yield pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["block", "sums"])

    found = texts.mapInArrow(run, "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary")
    halves = [tuple(np.zeros(s) for _ in range(2)) for s in tables]
    for r in found.toLocalIterator():
        t, half, start = blocks[r.block]
        halves[t][half][start : start + BLOCK] = np.frombuffer(r.sums, np.float32).reshape(-1, tables[t][1])
    sent.destroy()
    return halves


def fit(training: DataFrame, model: Model, key: str = "key", steps: tuple[float, ...] = STEPS, prior: float = PRIOR) -> Model:
    """model after an update for each of ``steps``, each over the training texts (key, text) whose key's hash falls to it."""
    tasks = training.sparkSession.sparkContext.defaultParallelism
    for i, step in enumerate(steps):
        part = training.where(F.pmod(F.xxhash64(key), F.lit(len(steps))) == i).select("text").coalesce(tasks)
        (seen, expected), (word_seen, word_expected) = _summed(part, model)
        model.weights.class_rows = maxent.moved(model.weights.class_rows, seen, expected, step, prior)
        model.weights.word_rows = maxent.moved(model.weights.word_rows, word_seen, word_expected, 1.5 * step, prior)
    return model


def _by_history(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each part of each text of docs (key, held_out, place, text): n_tokens; n_known, base and score, but for what words that are not common say of themselves within their class; and the words that are neither frequent nor common."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("place", pa.int64()), ("key", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        shape, codes = m.shape, maxent.Codes(m.shape, m.frequent, m.common)
        counts = np.array(m.counts + m.common_counts, float)
        base = np.log10((counts + 0.5) / (m.tokens + 0.5 * (m.distinct + 1)))
        within = np.log10((counts[len(m.counts) :] + 0.5) / np.array([m.mass[maxent.rare_class(w, shape.rare)] for w in m.common] or [1.0])[: len(m.common)])

        def take(waiting: list) -> pa.RecordBatch:
            all_codes, at = _batched([w[3] for w in waiting], [w[4] for w in waiting])
            log = np.concatenate([log for log, _ in maxent.pieces(all_codes, at, m.weights, shape)] or [np.zeros(0)]) / math.log(10)
            sizes = np.array([len(w[4]) for w in waiting])
            of, code = np.repeat(np.arange(len(waiting)), sizes), all_codes[at]
            # The place among frequent and common words, in the order of counts.
            place = np.where(code < shape.frequent, code, len(m.counts) + maxent.place_of(code, shape))
            mine, common = place < len(counts), (code >= shape.frequent) & (place < len(counts))
            log[common] += within[place[common] - len(m.counts)]
            add = lambda values, where=slice(None): np.bincount(of[where], values, len(waiting))
            known = add((counts[place[mine]] > 0).astype(float), mine).astype(np.int64)
            ends = np.cumsum(np.concatenate([[0], np.bincount(of[~mine], minlength=len(waiting))])).astype(np.int32)
            starts = np.cumsum(sizes) - sizes
            others = [waiting[k][2][i] for k, i in zip(of[~mine].tolist(), (np.flatnonzero(~mine) - starts[of[~mine]]).tolist(), strict=True)]
            rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(others, pa.binary()))
            columns = {c: pa.array([w[0].column(c)[w[1]].as_py() for w in waiting], t) for c, t in fields[:3]}
            columns |= {"n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(known), "base": pa.array(add(base[place[mine]], mine)), "score": pa.array(add(log)), "rare": rare}
            return pa.RecordBatch.from_arrays([columns[c] for c, _ in fields], names=[c for c, _ in fields])

        waiting, n = [], 0
        for x in _tokens(batches, codes):
            waiting.append(x)
            n += len(x[4])
            if n >= BATCH:
                yield take(waiting)
                waiting, n = [], 0
        if waiting:
            yield take(waiting)

    return docs.mapInArrow(run, "place long, key long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<binary>")


def scored(docs: DataFrame, model: Model, rest: DataFrame) -> DataFrame:
    """key, held_out, n_tokens, n_known, base_score and score of each row of docs (key, held_out, text). rest: words and counts of the training texts that are neither frequent nor common in the model."""
    mass = F.array(*map(F.lit, model.mass))
    parts = stored(_by_history(docs.withColumn("place", F.monotonically_increasing_id()), model), "by-history")
    words = parts.select("place", F.explode("rare").alias("rare")).select("place", F.col("rare").cast("string").alias("word"))
    others = words.join(rest, "word", "left").withColumn("c", F.coalesce(F.col("c"), F.lit(0)))

    def sums(of: DataFrame) -> DataFrame:
        within = F.log10((F.col("c") + 0.5) / F.element_at(mass, rare_class(F.col("word"), model.shape.rare) + 1))
        return of.groupBy("place").agg(F.count(F.when(F.col("c") > 0, 1)).alias("n_known"), F.sum(model.base(F.col("c"))).alias("base"), F.sum(within).alias("score"))

    every = [parts.drop("rare"), sums(others)]
    whole = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), every).groupBy("place")
    found = whole.agg(F.max("key").alias("key"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return found.drop("place")


def model(docs: DataFrame, shape: maxent.Shape, steps: tuple[float, ...] = STEPS) -> tuple[Model, DataFrame]:
    """The model of the rows of docs (key, held_out, text) that are not held out, and the counts of the words that are not frequent in them, a stored table's."""
    training = docs.where(~F.col("held_out"))
    counts = stored(word_counts(training), "word-counts")
    found, rest = counted(counts, shape)
    return fit(training, found, "key", steps), rest


def query(documents: DataFrame, shape: maxent.Shape = maxent.Shape()) -> DataFrame:  # noqa: B008
    docs = documents.select(F.col("doc_id").cast("long").alias("key"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    fitted, rest = model(docs, shape)
    found = scored(docs, fitted, rest)
    return found.select(F.col("key").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(fitted.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def run(spark, sf_dir: str) -> DataFrame:
    return query(table(spark, sf_dir, "documents"))
