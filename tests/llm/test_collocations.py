import re
import string
from collections import Counter

from cairnframe.llm import collocations

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= 30}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = []
    for lang in {x[0] for x in candidates}:
        mine = {p: a for (x, p), a in candidates.items() if x == lang}
        found = []
        for p, a in mine.items():
            if any(len(q) > len(p) and inside(p, q) and 100 * b >= 80 * a for q, b in mine.items()):
                continue
            score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(found)[:2000], 1)]
    return sorted(out)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "text string, lang string, phrase string, f int, times int").repartition(3)
    return sorted(map(tuple, collocations.query(df).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_rows_are_those_of_brute_force(spark):
    rows = [(" ".join(f"w{(i * i + j * (1 + i % 3)) % 9}" + ("," if (i + j) % 7 == 0 else "") for j in range(40)), ["en", "de", None][i % 3]) for i in range(90)]
    rows += [("New York City hall is there", "en")] * 40 + [("new\tyork  city; not York City", "en")] * 7 + [("a a a a a a", "xx")] * 12 + [(None, "en"), ("", None), (" \t., ", "en"), ("é ü. É ü", "fr"), ("one. two", "und")]
    rows += [("very long text " * 20_000, "long"), ("\x0bform\x0cfeed in\xa0side in\xa0side" * 31, "nb")]
    want = brute(rows)
    assert got(spark, rows) == want
    assert {r[0] for r in want} >= {"en", "de", "und", "xx", "long"}


def test_whole_phrases_give_way_to_longer_ones_only_at_the_share(spark):
    rows = [("alpha beta gamma", "en")] * 80 + [("alpha beta", "en")] * 20 + [("delta beta gamma", "en")] * 21
    found = {r[2] for r in got(spark, rows)}
    assert "alpha beta gamma" in found and "alpha beta" not in found and "beta gamma" in found
    assert got(spark, rows) == brute(rows)


def test_products_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 7)], "lang string, phrase string, words int, f long")
    r = collocations.collocations(counts).collect()[0]
    assert (r.score, r.n) == (2000000 * (big - 7) // (2 * big - 1), 2 * big - 1)


def test_empty_table(spark):
    assert got(spark, []) == []
