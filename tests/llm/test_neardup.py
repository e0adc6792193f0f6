import random

import numpy as np

from cairnframe.llm import neardup


def text(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghij") + str(r.randrange(400)) for _ in range(n))


def edited(base, seed, edits):
    r, w = random.Random(seed), base.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def brute(rows, least=0.8):
    """Class of each row: the first row by (id is null, id, place) of its component."""
    with np.errstate(over="ignore"):
        made = [neardup.shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if made[i][0] is not None and made[j][0] is not None:
                a, b = dict(zip(made[i][1].tolist(), made[i][2].tolist(), strict=True)), dict(zip(made[j][1].tolist(), made[j][2].tolist(), strict=True))
                j_p = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
                if j_p >= least - 1e-12:
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id long, text string, node int, band int").coalesce(1)
    got = {r.place: r for r in neardup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    want = brute(rows)
    groups: dict = {}
    for i, c in enumerate(want):
        groups.setdefault(c, []).append(i)
    for members in groups.values():
        first = min(members, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
        for i in members:
            assert (got[i].class_place, got[i].class_id, got[i].kept) == (first, rows[first][0], i == first)


def test_classes_agree_with_brute_force(spark):
    rows = [(100 - i, text(i)) for i in range(12)]
    rows += [(200 + i, edited(text(3), i, 2)) for i in range(8)] + [(300 + i, edited(text(5), i, 4)) for i in range(8)]  # near copies, nearer to their original than to one another
    rows += [(400 + i, edited(text(6), i, 30)) for i in range(4)]  # too far
    rows += [(500, text(7).upper() + "!"), (501, text(7)), (502, text(7)), (None, text(8)), (None, text(9)), (None, text(9))]
    rows += [(600, None), (601, ""), (602, " .,! "), (603, None), (604, "two words"), (605, "Two, words."), (606, "word"), (607, "word word word word word word word word")]
    rows += [(700, "a b c d e f " * 300), (701, "a b c d e f " * 299), (702, text(40, 2_000)), (703, edited(text(40, 2_000), 1, 5))]
    check(spark, rows)


def test_large_group_of_near_copies(spark):
    rows = [(i, edited(text(1, 200), i, 3)) for i in range(150)] + [(1000, text(1, 200))] + [(2000 + i, text(50)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = {r.doc_id: r.class_id for r in neardup.query(df).collect()}
    assert {classes[i] for i in range(150)} == {0} and classes[1000] == 0
    assert {classes[2000 + i] for i in range(150)} == {2000}


def test_links_that_no_centre_makes(spark):
    """Chains of copies, families that share a line or a passage, deletions: what a bucket's centre does not unite."""
    r = random.Random(4)
    base, passage, words = text(1, 150), text(2, 16), text(3, 140).split()
    rows = []
    for i in range(40):  # a family of edits, each with a nearer copy of its own
        x = edited(base, i, r.randrange(1, 9))
        rows += [(i, x), (100 + i, edited(x, 1000 + i, r.randrange(1, 4)))]
    for i in range(40):  # a repeated line and a common passage beside text of their own
        x = " ".join([text(500 + i, 20), *["is on here"] * 60, passage])
        rows += [(200 + i, x), (300 + i, edited(x, i, 1))]
    for i in range(40):  # parts left out
        at = r.randrange(120)
        rows.append((400 + i, " ".join(words[:at] + words[at + r.randrange(4, 24) :])))
    check(spark, rows)


def test_registers_agree_as_often_as_texts_are_alike():
    a, b = text(1, 300), edited(text(1, 300), 2, 20) + " " + text(1, 300)[:300]
    with np.errstate(over="ignore"):
        (_, v, x), (_, w, y) = neardup.shingles(a), neardup.shingles(b)
    s = neardup.signatures([(v, x), (w, y)], 4000)
    want = neardup.similarity(v, x, w, y)
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_empty_table(spark):
    assert neardup.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0
