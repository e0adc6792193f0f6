import random
import re

from cairnframe.llm import license_scan as scan

MIT = next(t for n, t in scan.TEMPLATES if n == "MIT" and len(t) > 200)
MPL, ISC = (next(t for n, t in scan.TEMPLATES if n == name) for name in ("MPL-2.0", "ISC"))
TEXTS = [None, "", "word", "Nothing here.", "Some text.\nReleased under the MIT license!\nMore.", MIT, MIT.replace(" and ", " & ").upper(), MIT.replace("without", "with"), "Intro. All rights reserved. Outro.", "rights reserved all", "x " * 50_000 + "\n\n" + MIT.replace(" ", "\n"),
         "license software copyright " * 30, "Licensed under CC BY-NC 4.0.", "We wrote this over the years. This work is licensed under the GNU General\nPublic License, version 3.  The rest of it is about other things.", "Before it all. " + MPL.replace(" of ", " of\n") + " After it all.", "Much to say here. " * 40 + ISC.replace(". ", ".\n\n") + "\nAnd so on. " * 30]


def brute(text, least=scan.LEAST):
    found = {}
    sentences = re.split(scan.UNITS["sentence"], text)
    most = max(len(re.split(scan.UNITS["sentence"], t)) for _, t in scan.TEMPLATES)
    passages = [" ".join(sentences[i : i + n]) for i in range(len(sentences)) for n in range(2, most + 1) if i + n <= len(sentences)]
    for k, kind in enumerate([*scan.UNITS, scan.PASSAGE]):
        parts = scan.UNITS.get(kind)
        for unit in passages if kind == scan.PASSAGE else [text] if parts is None else re.split(parts, text):
            w = [x for x in re.split(r"[\W_]+", unit.lower()) if x]
            grams = {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
            scores = {}
            for name, t in scan.TEMPLATES:
                b = set(scan.bigrams(t))
                scores[name] = max(scores.get(name, 0), 2 * len(grams & b) / (len(grams) + len(b)))
            top = max(scores.values())
            for name, s in scores.items():
                if s == top >= least - 1e-12:
                    best, n = found.get(name, ((0, 0), 0))
                    found[name] = max(best, (s, -k)), n + 1
    return {name: (round(s, 9), n, [*scan.UNITS, scan.PASSAGE][-k]) for name, ((s, k), n) in found.items()}


def test_agrees_with_brute_force(spark):
    df = spark.createDataFrame([(i, t, "own", 1) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "own", 1), (None, TEXTS[5], "own", 1)], "doc_id long, text string, license string, kind int")
    got: dict = {}
    for r in scan.query(df).collect():
        got.setdefault(r.doc_id, []).append((r.license, round(r.score, 9), r.units, r.kind))
    for i, t in enumerate(TEXTS):
        want = sorted((n, *x) for n, x in brute(t or "").items())
        assert sorted(got.get(i, [])) == sorted(want * (2 if i == 4 else 1))
    assert got[None]


def test_notices_in_wrapped_paragraphs_are_found(spark):
    got = {(r.doc_id, r.license): (round(r.score, 9), r.kind) for r in scan.query(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()}
    at = len(TEXTS) - 3
    assert got[at, "GPL-3.0"] == (1.0, "sentence") and got[at + 1, "MPL-2.0"] == (1.0, "passage") and got[at + 2, "ISC"] == (1.0, "passage")


def test_anchors_lose_no_match():
    rng, found = random.Random(0), scan.anchors(scan.TEMPLATES, scan.LEAST)
    for _, t in scan.TEMPLATES:
        b = scan.bigrams(t)
        for _ in range(300):
            kept = rng.sample(b, scan.fewest(len(b), scan.LEAST))
            assert any(a in kept for a in found)


def test_empty_table(spark):
    assert scan.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0
