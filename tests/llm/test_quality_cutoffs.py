"""Learned cutoffs against the same tests written out in plain Python, with exact binomials."""

import math
import random
from fractions import Fraction

from cairnframe.llm import quality

VALUES = {
    "symbols_per_word": lambda m: m["n_symbols"] / m["n_words"], "dup_line_share": lambda m: m["n_dup_lines"] / max(m["n_lines"], 1), "repeat_share": lambda m: m["n_repeat_words"] / m["n_words"],
    "long_words": lambda m: m["word_chars"] / m["n_words"], "short_words": lambda m: m["n_words"] / m["word_chars"],
}
GRIDS = {name: grid for name, (_, grid) in quality.RULES.items()}


def proven(k, n, share, level):
    p = Fraction(share)
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) <= Fraction(level)


def best_of(walk):
    """Of (place, good lost, poor caught) up to the first that is not proven: the place of the largest gain, the loosest of several."""
    gains = [(caught - quality.PRICE * k, -at) for at, k, caught in walk]
    return -max(gains)[1] if gains else None


def brute(rows, alpha=0.02, delta=0.05):
    rows = [(s, m, g) for s, m, g in rows if g is not None and not (m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"])]
    strata = sorted({s for s, _, _ in rows})
    level = delta / 2 / len(strata)
    lost = lambda s, rule, step, good: sum(VALUES[rule](m) > GRIDS[rule][step] for t, m, g in rows if t == s and g is good)
    n = {s: sum(g for t, _, g in rows if t == s) for s in strata}
    k = {(s, r, i): lost(s, r, i, True) for s in strata for r in GRIDS for i in range(len(GRIDS[r]))}
    out = {}
    for s in strata:
        ways = {}
        found = {}
        for r in GRIDS:
            walk = []
            for i in range(len(GRIDS[r])):
                if not proven(k[s, r, i], n[s], alpha / len(GRIDS), level / len(GRIDS)):
                    break
                walk.append((i, k[s, r, i], lost(s, r, i, False)))
            if walk:
                found[r] = GRIDS[r][best_of(walk)]
        if found:
            ways[1] = found
        others = [t for t in strata if t != s]
        cost = lambda r, i: sum(k[t, r, i] for t in others) / max(1, sum(n[t] for t in others))
        path = sorted((cost(r, i), i, r) for r in GRIDS for i in range(len(GRIDS[r])))
        first = [(next((at for at, (_, i, r) in enumerate(path, 1) if VALUES[r](m) > GRIDS[r][i]), None), g) for t, m, g in rows if t == s]
        walk = []
        for at in sorted({a for a, _ in first if a is not None}):
            hit = [g for a, g in first if a is not None and a <= at]
            if not proven(sum(hit), n[s], alpha, level):
                break
            walk.append((at, sum(hit), len(hit) - sum(hit)))
        if walk:
            until = best_of(walk)
            ways[0] = {r: GRIDS[r][max(i for _, i, q in path[:until] if q == r)] for r in GRIDS if any(q == r for _, _, q in path[:until])}
        gain = lambda c: sum((-quality.PRICE if g else 1) for t, m, g in rows if t == s and any(VALUES[r](m) > x for r, x in c.items()))
        if ways:
            out[s] = max((gain(c), w, c) for w, c in ways.items())[2] if len({gain(c) for c in ways.values()}) == len(ways) else ways[max(ways)]
    return out


def test_cutoffs_are_those_of_the_tests_written_out(spark):
    r = random.Random(7)
    rows = []
    for s, good, poor in (("de", 420, 60), ("en", 900, 90), ("fr", 90, 40)):
        for g, count in ((True, good), (False, poor)):
            for _ in range(count):
                w = r.randrange(15, 120)
                rows.append((s, {"n_words": w, "word_chars": int(w * r.uniform(3, 8 if g else 14)), "n_symbols": int(w * r.choice([0, 0, 0, 0.01, 0.05] if g else [0, 0.1, 0.6])), "n_lines": 10, "n_dup_lines": r.choice([0, 0, 0, 1] if g else [0, 4, 8]), "n_repeat_words": int(w * r.choice([0, 0, 0.05] if g else [0, 0.2, 0.28, 0.5]))}, g))
    rows += [("de", {**rows[0][1]}, None)]
    df = spark.createDataFrame([(s, tuple(m[c] for c in quality.MEASURES), g) for s, m, g in rows], "stratum string, measured struct<" + ",".join(f"{m}:long" for m in quality.MEASURES) + ">, good boolean")
    got = {x.stratum: {name: x[name] for name in GRIDS if x[name] is not None} for x in quality.cutoffs(df).collect()}
    want = brute(rows)
    assert set(got) == set(want) and "de" in want and "en" in want
    for s in want:
        assert got[s].keys() == want[s].keys() and all(abs(got[s][x] - want[s][x]) < 1e-12 for x in want[s]), s
