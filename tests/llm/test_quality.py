import math
import re
from collections import Counter

from cairnframe.llm import quality

TEXTS = [None, "", "  \n\t ", "one two three", "a b c d e f g h " * 6, "same line\nsame line\n\n\nother\nsame line", "##$$ %% && << x|y", "nbsp inside\x1cword é\n" * 30, "w" * 100_000, " ".join(f"w{i}" for i in range(40)), " ".join(str(i % 9) for i in range(100))]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(inside)


def test_measures():
    for t in TEXTS:
        assert quality.measures(t) == brute(t)


def test_binomial_bound_is_exact():
    for n, p in ((10, 0.3), (200, 0.01), (57, 0.5)):
        for k in range(n + 1):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert abs(quality.binomial_cdf(k, n, p) - want) < 1e-9


def test_cutoffs_against_brute_force(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "en", good + " #" * (i % 3)) for i in range(2500)] + [(3000 + i, "en", good + "#" * 60) for i in range(60)] + [(4000 + i, None, t) for i, t in enumerate(TEXTS)] + [(1, "en", good), (None, "en", good)]
    docs = spark.createDataFrame([(i, lang, t, 1, 2) for i, lang, t in rows], "doc_id long, lang string, text string, stratum int, measured int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2500)] + [(3000 + i, 0, 0) for i in range(60)] + [(4003, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.query(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id >= 4000:
            want = brute(TEXTS[r.doc_id - 4000])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (want[0], want[1], want[2], want[4], want[5])
            assert r.base_failed == (want[0] < 20 or 100 * want[5] > 30 * want[0])
            assert r.kept == (not r.base_failed)  # a stratum without labels has no learned cutoffs
        elif r.doc_id is None or r.doc_id < 2500:
            assert r.kept and not r.base_failed
        else:
            assert not r.kept and not r.base_failed


def test_few_labels_prove_nothing(spark):
    good = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, "en", good + "#" * (30 * (i > 20))) for i in range(30)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, int(i <= 20)) for i in range(30)], "doc_id long, quality int")
    assert all(r.kept for r in quality.query(docs, labels).collect())
    assert all(r.kept for r in quality.query(docs, labels.where("false")).collect())
    assert quality.query(docs.where("false"), labels).count() == 0
