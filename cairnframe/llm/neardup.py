"""Near-duplicates by ProbMinHash over weighted word shingles.

A text is the multiset of its shingles of five words; similarity is the probability Jaccard index
of the counts. Each shingle is a Poisson process whose rate is its count; its arrivals fall on
random registers, and a register holds the shingle that arrives first. A text's processes stop once
they are past its latest register. Texts whose registers agree in a band are candidates and are
verified on the shingles themselves.

Equal texts count once. As only classes are asked for, the texts of a bucket are first verified
against one centre, that with most candidates. What is then still apart is not compared pair by
pair: two texts that are alike share either enough of their centre, which the sizes of what each
has of it bound, or shingles that the centre lacks. The first is a join on the centre of the few texts whose
bound leaves them open, the second one on those shingles, rarest first, as far as a link needs them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, sifted, slices, stored
from cairnframe.operators.components import components

WORDS, LEAST = 5, 0.8
#: At 0.8, all of 25 bands of 5 miss a pair once in 20,000.
BANDS, ROWS = 25, 5
_WORD = re.compile(r"\w+")
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, width: int = WORDS) -> tuple[bytes | None, np.ndarray, np.ndarray]:
    """A digest of the text's words (lower case, without punctuation; None if it has none), its distinct shingles and their counts. A shorter text is one shingle."""
    found = _WORD.findall((text or "").lower())
    if not found:
        return None, np.zeros(0, _U), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), _U, len(found))
    n = max(1, len(h) - width + 1)
    rolled = np.full(n, min(len(h), width), _U)
    for i in range(min(width, len(h))):
        rolled = _mix(rolled ^ h[i : i + n]) + _U(0x9E3779B97F4A7C15)
    values, counts = np.unique(rolled, return_counts=True)
    return blake2b(h.tobytes(), digest_size=16).digest(), values, counts


def signatures(texts: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """ProbMinHash of (shingles, counts): texts x registers, the shingle (uint64) that arrives first in each. All texts step together; a process ends once past its text's latest register."""
    n = len(texts)
    of = np.repeat(np.arange(n), [len(v) for v, _ in texts])
    element = np.concatenate([v for v, _ in texts])
    weight = np.concatenate([c for _, c in texts]).astype(float)
    first, owner = np.full(n * registers, np.inf), np.zeros(n * registers, _U)
    state, time = _mix(element ^ _U(0x5851F42D4C957F2D)), np.zeros(len(element))
    with np.errstate(over="ignore"):
        while len(of):
            state = _mix(state + _U(0x9E3779B97F4A7C15))
            time = time - np.log1p(-((state >> _U(11)).astype(float) * 2.0**-53)) / weight
            slot = of * registers + ((_mix(state ^ _U(0xD1B54A32D192ED03)) >> _U(32)) * _U(registers) >> _U(32)).astype(np.int64)
            sooner = np.flatnonzero(time < first[slot])
            at = slot[sooner]
            np.minimum.at(first, at, time[sooner])
            won = sooner[first[at] == time[sooner]]
            owner[slot[won]] = element[won]
            latest = first.reshape(n, registers).max(axis=1)
            on = time < latest[of]
            of, element, weight, state, time = of[on], element[on], weight[on], state[on], time[on]
    return owner.reshape(n, registers)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash per band of each signature, different between bands."""
    n, m = signature.shape
    grouped = signature.reshape(n, m // rows, rows)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(m // rows, dtype=_U), (n, m // rows)).copy()
        for i in range(rows):
            h = _mix(h ^ grouped[:, :, i]) + _U(0x9E3779B97F4A7C15)
    return h.view(np.int64)


def similarity(a: np.ndarray, x: np.ndarray | None, b: np.ndarray, y: np.ndarray | None) -> float:
    """Probability Jaccard of distinct sorted elements a, b with counts x, y (None: all are 1)."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if x is None and y is None:
        return len(common) / (len(a) + len(b) - len(common))
    x = np.ones(len(a)) if x is None else x.astype(float)
    y = np.ones(len(b)) if y is None else y.astype(float)
    # For a common d at ratio t = x_d / y_d, the sum over all e of max(x_e / x_d, y_e / y_d): those of larger ratio count by x, the rest by y.
    only_x, only_y = x.sum() - x[i].sum(), y.sum() - y[j].sum()
    x, y = x[i], y[j]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    above = x.sum() - np.cumsum(x) + only_x
    below = np.cumsum(y) + only_y
    return float((1 / (above / x + below / y)).sum())


def _packed(counts: np.ndarray) -> bytes:
    return b"" if (counts == 1).all() else np.minimum(counts, 0x7FFFFFFF).astype(np.int32).tobytes()


def _mark(text: str) -> Column:
    """A number that equal texts share."""
    return F.xxhash64(F.col(text))


def signed(docs: DataFrame, text: str, key: str, n_bands: int, rows: int, width: int, place: str | None = None) -> DataFrame:
    """A row per document: id, place (of the column ``place``, if there is one), mark, and the digest of its words and the bands, null where it has none."""
    source = docs.select(F.col(key).alias("id"), (F.monotonically_increasing_id() if place is None else F.col(place)).alias("place"), _mark(text).alias("mark"), F.col(text).alias("text"))
    schema = T.StructType([source.schema["id"], *T._parse_datatype_string("place long, mark long, digest binary, bands array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 512):
                batch = whole.slice(start, 512)
                with np.errstate(over="ignore"):
                    each = [shingles(x, width) for x in batch.column("text").to_pylist()]
                full = [i for i, e in enumerate(each) if e[0] is not None]
                found: list = [None] * len(each)
                if full:
                    for i, row in zip(full, bands(signatures([each[i][1:] for i in full], n_bands * rows), rows), strict=True):
                        found[i] = row
                columns = [*[batch.column(c) for c in ("id", "place", "mark")], pa.array([e[0] for e in each], pa.binary()), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def _texts(docs: DataFrame, text: str, width: int, nodes: DataFrame) -> DataFrame:
    """node, elements (sorted shingles) and counts, as bytes, of nodes (node, digest, mark), from the documents that have a node's words."""
    source = sifted(docs.select(_mark(text).alias("mark"), F.col(text).alias("text")), F.col("mark"), nodes, "mark")[0].select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 512):
                with np.errstate(over="ignore"):
                    each = [e for x in whole.slice(start, 512).column("text").to_pylist() if (e := shingles(x, width))[0] is not None]
                columns = [pa.array(x, pa.binary()) for x in ([e[0] for e in each], [e[1].tobytes() for e in each], [_packed(e[2]) for e in each])]
                yield pa.RecordBatch.from_arrays(columns, names=["words", "elements", "counts"])

    once = source.mapInArrow(run, "words binary, elements binary, counts binary").groupBy("words").agg(F.first("elements").alias("elements"), F.first("counts").alias("counts"))
    return stored(once.join(nodes.hint("merge"), F.col("words") == F.col("digest")).select("node", "elements", "counts"), "candidate-texts")


def _pairs(met: DataFrame, texts: DataFrame, one: str, two: str) -> DataFrame:
    side = lambda s: texts.select(F.col("node").alias(s), F.col("elements").alias(f"{s}_elements"), F.col("counts").alias(f"{s}_counts"))
    return met.select(one, two).join(side(one).hint("merge"), one).join(side(two).hint("merge"), two)


def _of(batch: pa.RecordBatch, name: str) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Elements and counts (None: all 1) of the texts of one side."""
    both = zip(batch.column(f"{name}_elements").to_pylist(), batch.column(f"{name}_counts").to_pylist(), strict=True)
    return [(np.frombuffer(e, _U), np.frombuffer(c, np.int32) if c else None) for e, c in both]


#: Of a text and its centre: weight, the sum of its counts; distinct, the number of its shingles; common and shared, the same of those that the centre has; most, its largest count; top, the weight of shared ones of that count; lacking, the largest count of a shingle that the centre lacks.
STATS = ("weight", "distinct", "common", "shared", "most", "top", "lacking")


def judged(met: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """met (node, centre) with ``alike``, whether the texts are similar enough, STATS of the node, and its shingles that the centre lacks with their counts, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            alike, stats, beside, times = [], [], [], []
            for (a, x), (b, y) in zip(_of(batch, "node"), _of(batch, "centre"), strict=True):
                alike.append(similarity(a, x, b, y) >= least - 1e-12)
                count = np.ones(len(a), np.int64) if x is None else x.astype(np.int64)
                there = np.isin(a, b, assume_unique=True)
                most = count.max()
                stats.append((count.sum(), len(a), count[there].sum(), there.sum(), most, count[there & (count == most)].sum(), count[~there].max(initial=0)))
                beside.append(a[~there].tobytes())
                times.append(_packed(count[~there]))
            found = np.array(stats, dtype=np.int64).reshape(-1, len(STATS))
            columns = [batch.column("node"), batch.column("centre"), pa.array(alike, pa.bool_()), *[pa.array(found[:, i]) for i in range(len(STATS))], pa.array(beside, pa.binary()), pa.array(times, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "centre", "alike", *STATS, *LACKED])

    return _pairs(met, texts, "node", "centre").mapInArrow(run, "node long, centre long, alike boolean, " + ", ".join([f"{s} long" for s in STATS] + [f"{c} binary" for c in LACKED]))


LACKED = ("beside", "times")


def lacked(open_: DataFrame) -> DataFrame:
    """node, centre, label, shingle and count: a row per shingle of the node that its centre lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            elements = [np.frombuffer(e, np.int64) for e in batch.column("beside").to_pylist()]
            counts = [np.frombuffer(c, np.int32) if c else np.ones(len(e), np.int32) for c, e in zip(batch.column("times").to_pylist(), elements, strict=True)]
            which = pa.array(np.repeat(np.arange(len(batch)), [len(e) for e in elements]))
            flat = [pa.array(np.concatenate([np.zeros(0, t), *x])) for t, x in ((np.int64, elements), (np.int32, counts))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(which) for c in ("node", "centre", "label")], *flat], names=["node", "centre", "label", "shingle", "count"])

    return open_.select("node", "centre", "label", *LACKED).mapInArrow(run, "node long, centre long, label long, shingle long, count int")


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ok = [similarity(*p, *q) >= least - 1e-12 for p, q in zip(_of(batch, "a"), _of(batch, "b"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return _pairs(pairs, texts, "a", "b").mapInArrow(run, "a long, b long")


def _most_alike(x: str, others_distinct: Column, others_most: Column, shared: Column, extra: Column) -> Column:
    """A bound of the similarity of a text (STATS prefixed with ``x``) to one of which at most ``shared`` of its shingles are: those of its centre, and ``extra`` that the centre lacks.

    For a shingle d of both, with counts x_d and y_d, its term of the index is at most x_d / (weight + n * x_d / y_d), with n, at least,
    the number of the other's shingles that the text has not.
    """
    c = lambda name: F.col(f"{x}{name}")
    n = F.greatest(F.lit(0), others_distinct - shared)
    part = F.least(c("weight"), c("common") + extra * c("lacking"))
    top = F.least(part, c("top"))
    return top / (c("weight") + n * c("most") / others_most) + (part - top) / (c("weight") + n / others_most)


def _pair_bound(extra: Column) -> Column:
    """Of nodes a and b that met one centre (STATS prefixed with a_ and b_) and share ``extra`` shingles that it lacks."""
    shared = F.least("a_shared", "b_shared") + extra
    return F.least(_most_alike("a_", F.col("b_distinct"), F.col("b_most"), shared, extra), _most_alike("b_", F.col("a_distinct"), F.col("a_most"), shared, extra))


def _open(table: DataFrame, labels: DataFrame) -> DataFrame:
    """Of table (of judged()), the nodes of centres whose class doesn't hold all that met them, with label, outside (not in the centre's class), and of the centre's nodes fewest (the least ``distinct``) and largest (``most``)."""
    of = lambda c: labels.select(F.col("node").alias(f"{c}_of"), F.col("label").alias(f"{c}_label"))
    named = table.join(of("node").hint("merge"), F.col("node") == F.col("node_of"), "left").join(of("centre").hint("merge"), F.col("centre") == F.col("centre_of"), "left")
    named = named.withColumn("label", F.coalesce("node_label", "node")).withColumn("outside", F.col("label") != F.coalesce("centre_label", "centre"))
    named = stored(named.select("node", "centre", "label", "outside", *STATS, *LACKED), "labelled")
    ends = named.groupBy(F.col("centre").alias("of")).agg(F.min("distinct").alias("fewest"), F.max("most").alias("largest"), F.max("outside").alias("any"), F.count("*").alias("n")).where(F.col("any") & (F.col("n") > 1))
    return stored(named.join(ends.hint("merge"), F.col("centre") == F.col("of")).drop("of", "any", "n"), "open")


def _apart(rows: DataFrame, on: list[str], extra: Column, least: float) -> DataFrame:
    """Pairs (a, b) of rows that agree in ``on``, are of different classes, one or both of them outside their centre's, and within the bound."""
    side = lambda s: rows.select(*on, *[F.col(c).alias(f"{s}_{c}") for c in rows.columns if c not in on])
    once = ~F.col("b_outside") | (F.col("a_node") < F.col("b_node"))
    both = side("a").where("a_outside").join(side("b").hint("merge"), on)
    return both.where((F.col("a_label") != F.col("b_label")) & once & (_pair_bound(extra) >= least - 1e-9)).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


def cross_pairs(open_: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes of open_ that may be alike although their centre did not unite them."""
    rest = F.col("fewest") - F.col("shared")
    by_size = open_.where(_most_alike("", F.col("fewest"), F.col("largest"), F.col("shared"), F.lit(0)) >= least - 1e-9)
    by_size = _apart(by_size.select("centre", "node", "label", "outside", *STATS), ["centre"], F.lit(0), least)

    # Shingles beside the centre's that two classes or more have.
    beside = lacked(open_)
    known = beside.groupBy(F.col("centre").alias("of"), F.col("shingle").alias("s")).agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").drop("x", "y")
    lists = beside.join(known.hint("merge"), (F.col("centre") == F.col("of")) & (F.col("shingle") == F.col("s"))).groupBy(F.col("node").alias("n_"), F.col("centre").alias("c_")).agg(F.array_sort(F.collect_list(F.struct("n", "shingle", "count"))).alias("list"))
    some = open_.drop(*LACKED).join(lists.hint("merge"), (F.col("node") == F.col("n_")) & (F.col("centre") == F.col("c_"))).drop("n_", "c_")
    # A link needs so much weight of them; a pair is met at the first that both have, which has that much from it on.
    need = (least * (F.col("weight") + rest / F.col("largest")) - F.col("common")) / (1 + least / F.col("largest"))
    step = lambda acc, x: F.struct((acc["left"] - x["count"]).alias("left"), F.when(acc["left"] >= F.col("need"), acc["keep"] + 1).otherwise(acc["keep"]).alias("keep"))
    total = F.aggregate("list", F.lit(0).cast("long"), lambda a, x: a + x["count"])
    prefix = F.aggregate("list", F.struct(F.col("total").alias("left"), F.lit(0).alias("keep")), step)["keep"]
    some = some.withColumn("need", need - 1e-6).withColumn("total", total).withColumn("others", F.transform("list", lambda x: x["shingle"])).withColumn("prefix", prefix)
    some = stored(some.select("centre", "node", "label", "outside", *STATS, "others", F.explode(F.slice("others", 1, F.col("prefix"))).alias("shingle")), "beside-index")
    both = F.array_intersect("a_others", "b_others")
    by_shingle = _apart(some.withColumn("first", F.col("shingle")), ["centre", "shingle"], F.when(both[0] == F.col("a_first"), F.size(both)), least)
    found = stored(by_size.unionByName(by_shingle).distinct(), "cross")
    discard(some)
    return found


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = LEAST, n_bands: int = BANDS, rows: int = ROWS, width: int = WORDS, place: str | None = None) -> DataFrame:
    """A row per row of docs: id, place (the column of that name, unique and never null; None: a number given here), class_place, class_id and kept.

    A class is a connected component of rows linked by a similarity of ``least`` or more; rows
    with the same words are alike. Its id is that of its first row by id (nulls last), then
    place, which alone is kept. Rows whose text is null or holds no words are classes of their own. docs is read
    twice and must give the same texts.
    """
    table = stored(signed(docs, text, key, n_bands, rows, width, place), "signed")
    # A node per distinct text, named by its first place.
    head = F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("place").alias("place"))).alias("head")
    heads = table.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("place").alias("node"), head, F.count("*").alias("n"), F.first("bands").alias("bands"), F.min("mark").alias("mark"))
    heads = stored(heads, "heads")
    bucketed = heads.select("node", F.explode("bands").alias("band"))
    buckets = bucketed.groupBy("band").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    members = stored(bucketed.join(buckets.hint("merge"), "band"), "members")
    # A bucket's centre is the text that meets most others over all buckets: among copies of one text, that is the text itself.
    degrees = stored(members.groupBy(F.col("node").alias("of")).agg(F.sum("size").alias("degree")), "degrees")
    ranked = stored(members.join(degrees.hint("merge"), F.col("node") == F.col("of")).select("band", "node", "degree"), "ranked-members")
    centres = ranked.groupBy("band").agg((-F.max(F.struct("degree", (-F.col("node")).alias("node")))["node"]).alias("centre"))
    met = stored(ranked.join(centres.hint("merge"), "band").where(F.col("node") != F.col("centre")).select("node", "centre").distinct(), "met")
    nodes = stored(heads.select("node", "digest", "mark").join(degrees.hint("merge"), F.col("node") == F.col("of"), "left_semi"), "candidates")
    discard(members, ranked, degrees)
    texts = _texts(docs, text, width, nodes)
    tried = stored(judged(met, texts, least), "judged")
    links = tried.where("alike").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    labels = components(links)
    open_ = _open(tried, labels)
    more = stored(verified(cross_pairs(open_, least), texts, least), "more-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    named = stored(heads.join(labels.withColumnRenamed("node", "of").hint("merge"), F.col("node") == F.col("of"), "left").select("digest", "head", "n", F.coalesce("label", "node").alias("label")), "named")
    discard(heads, met, nodes, texts, tried, open_, more)
    tops = named.groupBy(F.col("label").alias("of")).agg(F.min("head").alias("top"), F.sum("n").alias("size")).where(F.col("size") > 1)
    classes = stored(named.join(tops.hint("merge"), F.col("label") == F.col("of")).select(F.col("digest").alias("of"), "top"), "classes")
    discard(named)
    out = table.select("id", "place", "digest").join(classes.hint("merge"), F.col("digest") == F.col("of"), "left")
    head_place = F.coalesce(F.col("top.place"), F.col("place"))
    return out.select("id", "place", head_place.alias("class_place"), F.when(F.col("top").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("class_id"), (head_place == F.col("place")).alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "class_id", "kept")
