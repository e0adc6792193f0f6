"""Toxicity as an ordinal grade: a cumulative-link model over sparse word features.

P(grade > k) = sigmoid(score - theta_k), with one weight per word shared by all ordered
thresholds theta_0 < theta_1 < ... The expected severity is the sum of these probabilities.
Features are words and beginnings of words, by how often they occur. Those that are not clearly
more widespread in rows graded above 0 are left out before the fit, so that neither rare words
are learned by heart nor long documents gather noise. The model is fitted by accelerated
proximal gradient steps with an L1 penalty. Fitting takes a sample of labelled rows of bounded size;
scoring takes every row and its whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored

_WORD = re.compile(r"\w+")
#: Labelled rows that a fit takes of each class, about, by which all it gathers is bounded; and how many standard errors a feature's share of positive rows must lie above that of others.
ROWS_PER_CLASS, LEAST_Z = 5_000, 5.0
STEPS, PENALTY = 400, 2e-4
#: Lengths of word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7, 8)


def features(text: str | None, known: dict | None = None) -> dict[str, float]:
    """Words, and beginnings of longer words marked by "^", with log1p of their number per hundred words; of ``known`` ones if given."""
    words = Counter(_WORD.findall((text or "").lower()))
    found: dict[str, int] = {}
    for w, n in words.items():
        if known is None or w in known:
            found[w] = found.get(w, 0) + n
        for k in BEGINNINGS:
            if len(w) > k and (known is None or (b := "^" + w[:k]) in known):
                b = "^" + w[:k]
                found[b] = found.get(b, 0) + n
    per = 100 / (words.total() + 50)
    return {f: math.log1p(n * per) for f, n in found.items()}


@dataclass
class Model:
    weights: dict[str, float]
    thetas: np.ndarray  # rising

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each k; null is the empty text."""
        found = features(text, self.weights)
        score = math.fsum(self.weights[f] * x for f, x in found.items())
        return 1 / (1 + np.exp(np.clip(self.thetas - score, -50, 50)))


def fit_cumulative(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_cols: int, grade_weights: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the L1-penalised likelihood of ``grades`` (0 to K); features in coordinate form.

    Grade g has probability S(g - 1) - S(g), with S(k) = sigmoid(score - theta_k) between S(-1) = 1
    and S(K) = 0. Thresholds are kept in order as a first one and logs of gaps.
    """
    k, n = int(grades.max()), len(grades)
    scale = np.maximum(1e-9, np.sqrt(np.bincount(cols, values**2, n_cols) / n))
    values = values / np.maximum(scale, 0.02)[cols]
    case = grade_weights / grade_weights.sum()
    i = np.arange(n)

    def loss(w: np.ndarray, raw: np.ndarray, with_gradient: bool = True):
        thetas = np.cumsum(np.concatenate([raw[:1], np.exp(np.clip(raw[1:], -20, 20))]))
        score = np.bincount(rows, w[cols] * values, n)
        s = 1 / (1 + np.exp(np.clip(thetas[None, :] - score[:, None], -50, 50)))
        s = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], axis=1)
        up, down = s[i, grades], s[i, grades + 1]
        p = np.maximum(up - down, 1e-12)
        f = -(case * np.log(p)).sum()
        if not with_gradient:
            return f
        d_up, d_down = up * (1 - up), down * (1 - down)
        d_score = -case * (d_up - d_down) / p
        d_theta = np.bincount(grades, case * d_up / p, k + 1)[1:] - np.bincount(grades, case * d_down / p, k + 1)[:-1]
        tail = np.cumsum(d_theta[::-1])[::-1]
        return f, np.bincount(cols, d_score[rows] * values, n_cols), np.concatenate([tail[:1], tail[1:] * np.exp(np.clip(raw[1:], -20, 20))])

    w, raw = np.zeros(n_cols), np.concatenate([[1.0], np.zeros(k - 1)])
    at_w, at_raw, t, curve, last = w, raw, 1.0, 1.0, np.inf
    for _ in range(steps):
        f, d_w, d_raw = loss(at_w, at_raw)
        while True:  # the step shortens until the quadratic bound holds
            new = at_w - d_w / curve
            new = np.sign(new) * np.maximum(0, np.abs(new) - penalty / curve)
            new_raw = at_raw - d_raw / curve
            dw, dr = new - at_w, new_raw - at_raw
            f_new = loss(new, new_raw, with_gradient=False)
            if f_new <= f + d_w @ dw + d_raw @ dr + curve / 2 * (dw @ dw + dr @ dr) + 1e-12 or curve > 1e12:
                break
            curve *= 2
        whole = f_new + penalty * np.abs(new).sum()
        if whole > last:  # momentum overshot: start it anew from the best point
            at_w, at_raw, t, last = w, raw, 1.0, np.inf
            continue
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at_w, at_raw = new + (t - 1) / t_new * (new - w), new_raw + (t - 1) / t_new * (new_raw - raw)
        w, raw, t, last, curve = new, new_raw, t_new, whole, curve * 0.95
    return w / np.maximum(scale, 0.02), np.cumsum(np.concatenate([raw[:1], np.exp(np.clip(raw[1:], -20, 20))]))


def fit(labelled: DataFrame) -> Model:
    """labelled: a sample of bounded size, text and grade (int from 0; null takes no part).

    Grades are those of the labels: there is a threshold for each but the lowest (labels of 0 and 1 have one). A grade
    that no row has shares the threshold of the next. Without rows of both a grade 0 and one above, the model finds nothing.
    """
    rows = labelled.where(F.col("grade").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), (F.col("grade") > 0).alias("positive"), F.col("grade").cast("int").alias("grade"))
    rows = stored(rows, "sample")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {False: Counter(), True: Counter()}
            for x, positive in zip(batch.column("text").to_pylist(), batch.column("positive").to_pylist(), strict=True):
                found[positive].update(features(x).keys())
            for positive, c in found.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([positive] * len(c), pa.bool_()), pa.array(list(c.values()), pa.int64())], names=["feature", "positive", "n"])

    totals = rows.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q")).first()
    if not totals.p or not totals.q:
        return Model({}, np.array([50.0]))
    counts = rows.select("text", "positive").mapInArrow(spread, "feature string, positive boolean, n long")
    counts = counts.groupBy("feature").agg(*[F.sum(F.when(F.col("positive") == x, F.col("n")).otherwise(0)).alias(c) for x, c in ((True, "a"), (False, "b"))])
    all_of = (F.col("a") + F.col("b")) / float(totals.p + totals.q)
    error = F.sqrt(all_of * (1 - all_of) * (1 / totals.p + 1 / totals.q))
    z = F.when(error > 0, (F.col("a") / float(totals.p) - F.col("b") / float(totals.q)) / error)
    clear = counts.withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature")
    words = [r.feature for r in clear.select("feature", "z").collect()]  # of the sample, as bounded as it is
    at = {w: i for i, w in enumerate(words)}

    def known_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [features(x, at) for x in batch.column("text").to_pylist()]
            cols = [np.array([at[f] for f in x], dtype=np.int32).tobytes() for x in each]
            values = [np.array(list(x.values()), dtype=float).tobytes() for x in each]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(cols, pa.binary()), pa.array(values, pa.binary())], names=["grade", "cols", "x"])

    got = rows.select("grade", "text").mapInArrow(known_features, "grade int, cols binary, x binary").collect()  # bounded as the sample is
    grades = np.array([r.grade for r in got], dtype=np.int64)
    if not words or not (grades == 0).any() or not (grades > 0).any():
        return Model({}, np.array([50.0]))
    each = [np.frombuffer(r.cols, np.int32) for r in got]
    rows_at = np.repeat(np.arange(len(got)), [len(x) for x in each])
    cols = np.concatenate(each)
    values = np.concatenate([np.frombuffer(r.x, float) for r in got])
    present, grades = np.unique(np.maximum(grades, 0), return_inverse=True)
    sizes = np.bincount(grades)
    w, thetas = fit_cumulative(rows_at, cols, values, grades, len(words), np.where(grades > 0, 0.35 / max(1, sizes[1:].sum()), 0.65 / sizes[0]))
    # Grade g is above threshold k if its rank among those present is.
    thetas = thetas[np.searchsorted(present[1:], np.arange(1, present[-1] + 1))]
    return Model({words[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-6)}, thetas)


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False, cutoff: float = 0.5) -> DataFrame:
    """The rows of docs as a struct ``row`` (without their text unless keep_text), with severity (expected grade), grade (the likeliest at or above ``cutoff``) and toxic (P(grade > 0) >= cutoff)."""
    kept = [c for c in docs.columns if keep_text or c != text]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(text).alias("text"))
    fields = [rows.schema["row"], T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            above = np.array([model.above(x) for x in batch.column("text").to_pylist()]).reshape(-1, len(model.thetas))
            over = above >= cutoff
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(above.sum(axis=1)), pa.array(over.sum(axis=1).astype(np.int32)), pa.array(over[:, 0])], names=["row", "severity", "grade", "toxic"])

    return rows.mapInArrow(run, T.StructType(fields))


def labelled_texts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """text and grade of about per_class rows at most with a grade of 0 and as many above, taken by a hash of their key.

    A key that is labelled twice has its highest grade; of rows that share a labelled key, one is taken (the first text in
    order). The keys are sampled before they meet the documents, so that their number is bounded and only their texts leave the scan.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("labelled_key")).agg(F.max(label).cast("int").alias("grade"))
    marks = stored(marks, "labels")
    sizes = marks.agg(F.count_if(F.col("grade") > 0).alias("p"), F.count_if(F.col("grade") <= 0).alias("q")).first()
    share = F.when(F.col("grade") > 0, F.lit(per_class / max(1, sizes.p))).otherwise(F.lit(per_class / max(1, sizes.q)))
    sample = stored(marks.where(F.pmod(F.xxhash64("labelled_key"), F.lit(1 << 30)) < share * float(1 << 30)), "sampled-labels")
    found = docs.select(F.col(key).alias("own_key"), F.col("text").alias("labelled_text")).join(F.broadcast(sample), F.col("own_key") == F.col("labelled_key"))
    return found.groupBy("own_key").agg(F.min("labelled_text").alias("text"), F.first("grade").alias("grade")).select("text", "grade")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return score(docs, fit(labelled_texts(docs, labels))).select("row.doc_id", "severity", "grade", "toxic")
