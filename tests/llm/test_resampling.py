import hashlib
import math
import re
import string
import zlib
from collections import Counter

from cairnframe.llm import resampling

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, words string, gram int, place int, bucket string, rank string"


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(docs, benchmark):
    of = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(of(f) for x in texts for f in features(x)[1]) for texts in ([d[1] for d in docs], benchmark))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000.0) / ((s[b] + 1.0) * (T + 10000.0))))
    out = []
    for doc_id, text in docs:
        w, f = features(text)
        weight = sum(gain(of(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= 20])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))[: 25 * sum(r[4] for r in out) // 100]
    ranks = {id(r): i for i, r in enumerate(order, 1)}
    return sorted(map(str, ((*r[:4], ranks.get(id(r))) for r in out)))


def got(spark, docs, benchmark):
    rows = [(*d, "x", 1, 2, "y", "z") for d in docs]
    found = resampling.query(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame([(1, x) for x in benchmark], "item_id long, text string"))
    return sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in found.collect())


def test_rows_are_those_of_brute_force(spark):
    body = [" ".join(f"W{(i * j) % 37}é-x{j % 11}" for j in range(1, 9 + i % 17)) for i in range(200)]
    docs = list(enumerate(body)) + [(500, None), (501, ""), (502, " \n--"), (503, "One"), (504, "a\x00b Á"), (505, "long word " * 30_000), (None, body[3]), (7, body[7]), (7, body[7])]
    benchmark = [body[16], body[33], "unseen words here", None, ""]
    assert got(spark, docs, benchmark) == brute(docs, benchmark)


def test_empty_tables(spark):
    assert got(spark, [], ["a b"]) == []
    docs = [(i, "one two three " * 7) for i in range(9)]
    assert got(spark, docs, []) == brute(docs, [])


def test_ties_go_to_the_smaller_key_over_many_partitions(spark):
    rows = [(i % 400, i, 20, 3, 0, (i * 7919) % 10) for i in range(800)] + [(None, 900 + i, 25, 3, 0, 5) for i in range(50)] + [(1000 + i, 2000 + i, 19, 3, 0, 99) for i in range(50)]
    df = spark.createDataFrame(rows, "key long, place long, n_words long, n_features long, weight long, score long").repartition(7)
    found = [r for r in resampling.drawn(df, percent=50).collect() if r["rank"]]
    assert [r["rank"] for r in sorted(found, key=lambda r: r["rank"])] == list(range(1, 426))
    want = sorted((r for r in rows if r[2] >= 20), key=lambda r: (-r[5], r[0] is None, r[0] or 0, r[1]))[:425]
    assert [r[1] for r in want] == [r.place for r in sorted(found, key=lambda r: r["rank"])]
