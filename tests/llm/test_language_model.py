import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cairnframe.llm import language_model, maxent

SMALL = maxent.Shape(frequent=40, width=8, rare=5, class_bits=9, word_bits=8)


def texts():
    r = random.Random(3)
    tongues = [[a + b for a in x for b in "aeiou"] for x in ("bdg", "ptk", "mnr")]
    rows = []
    for i in range(400):
        words = tongues[i % 3]
        rows.append((i, " ".join(r.choice(words) + r.choice(["", "", "X", "é,"]) for _ in range(r.randrange(5, 60)))))
    return rows + [(900, None), (901, ""), (902, " \t\x0b\x0c\r\n"), (903, "one\x1ctwo\xa0three"), (904, "never seen words"), (None, "BA de"), (7, "BA de"), (7, "BA de"), (908, "ba " * 600_000)]


def lowered(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [""]


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 1


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, place int").repartition(3)


@pytest.mark.parametrize("common", [language_model.COMMON, 30, 0])
def test_counts_and_base_scores(spark, monkeypatch, common):
    monkeypatch.setattr(language_model, "COMMON", common)
    rows = texts()
    c = Counter(w for k, t in rows if not held(k) for w in lowered(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(k), held(k), len(lowered(t)), sum(c[w] > 0 for w in lowered(t)), n, pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in lowered(t)), rel=1e-9)) for k, t in rows)
    got = language_model.query(documents(spark, rows), SMALL).collect()
    assert sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=lambda x: x[:4]) == sorted(want, key=lambda x: x[:4])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    # Which words stand together is learned: held-out texts are likelier than by their words alone.
    mine = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.score for r in mine) > 0.93 * sum(r.base_score for r in mine)
    alike = {round(r.score, 9) for r in got if r.doc_id in (None, 7) and r.n_tokens == 3}
    assert len(alike) == 1


@pytest.mark.parametrize("common", [language_model.COMMON, 20])
def test_scores_are_log_probabilities_of_one_distribution(spark, monkeypatch, common):
    monkeypatch.setattr(language_model, "COMMON", common)
    rows = [r for r in texts() if r[0] is not None and r[0] < 300]
    docs = documents(spark, rows).selectExpr("doc_id AS key", "false AS held_out", "text")
    fitted, rest = language_model.model(docs, SMALL)
    c = Counter(w for _, t in rows for w in lowered(t))
    # All words, and an unseen one for each rare class, after one history.
    unseen = {}
    for a in range(20_000):
        w = f"zz{a:05d}"
        unseen.setdefault(maxent.rare_class(w.encode(), SMALL.rare), w)
    vocabulary = [w for w in c if w] + list(unseen.values())
    asked = spark.createDataFrame([(i, False, f"ba da {w}") for i, w in enumerate(vocabulary)] + [(-1, False, "ba da")], "key long, held_out boolean, text string")
    base = {r.key: r.score for r in language_model.scored(asked, fitted, rest).collect()}
    codes = maxent.Codes(SMALL, fitted.frequent, fitted.common)
    own = lambda words: np.array([-1] * 3 + [codes[w.encode()] for w in words])
    ends = lambda words: maxent.batch(own([*words, ""]), np.array([len(words) + 3]), fitted.weights, SMALL)[0][0] / math.log(10)
    start = base[-1] - ends(["ba", "da"])
    total = sum(10 ** (base[i] - start - ends(["ba", "da", w])) for i, w in enumerate(vocabulary)) + 10 ** ends(["ba", "da"])
    assert total == pytest.approx(1, rel=1e-4)


def test_seen_less_expected_is_the_gradient():
    r = np.random.default_rng(1)
    w = maxent.start(SMALL, r.integers(1, 9, 40) + 0.5, r.random(5) * 20)
    w.class_rows += r.normal(0, 0.3, w.class_rows.shape).astype(np.float32)
    w.word_rows += r.normal(0, 0.3, w.word_rows.shape).astype(np.float32)
    codes = np.concatenate([[-1] * 3, r.integers(0, 200, 500)])
    at = np.arange(3, len(codes))
    sums = maxent.Sums(w)
    sums.add(maxent.batch(codes, at, w, SMALL, True)[1])
    for table, seen, expected in zip((w.class_rows, w.word_rows), sums.seen, sums.expected, strict=True):
        gradient = seen - expected
        assert abs(gradient.sum()) < 1e-2
        for cell in zip(*np.unravel_index(np.argsort(-np.abs(gradient), axis=None)[:5], gradient.shape), strict=True):
            was, log = table[cell], []
            for by in (-0.05, 0.05):
                table[cell] = was + np.float32(by)
                log.append(maxent.batch(codes, at, w, SMALL)[0].sum())
            table[cell] = was
            assert (log[1] - log[0]) / 0.1 == pytest.approx(gradient[cell], rel=0.02, abs=0.02)


def test_long_texts_are_read_in_parts(monkeypatch):
    text = " ".join(f"w{i}é" for i in range(3000)).encode()
    monkeypatch.setattr(language_model, "PART", 1000)
    assert b"".join(language_model._parts(text)) == text
    assert [w for p in language_model._parts(text) for w in p.split()] == text.split()


def test_no_training_texts_and_no_texts(spark):
    held_key = next(k for k in range(100) if held(k))
    (r,) = language_model.query(documents(spark, [(held_key, "a b")]), SMALL).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert language_model.query(documents(spark, []), SMALL).count() == 0
