import random

import numpy as np

from cairnframe.llm import toxicity


def text(seed, bad):
    r = random.Random(seed)
    w = [r.choice("abcdefgh") + str(r.randrange(2000)) for _ in range(r.randrange(20, 200))]
    for _ in range(bad):
        w[r.randrange(len(w))] = r.choice(["vile", "rotten", "nasty", "grim"])
    return " ".join(w)


def rows(n, offset=0):
    return [(offset + i, text(offset + i, 4 if i % 5 == 0 else 0), int(i % 5 == 0)) for i in range(n)]


def test_held_out_accuracy(spark):
    train, held = rows(1000), rows(300, 5000)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t, _ in train + held], "doc_id long, text string, grade int, row string")
    labels = spark.createDataFrame([(i, None, g) for i, _, g in train] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.query(docs, labels).collect()}
    assert len(got) == 1300
    assert np.mean([got[i].toxic == bool(g) for i, _, g in held]) > 0.98
    assert all((r.severity >= 0.5) == r.toxic or abs(r.severity - 0.5) < 0.5 for r in got.values())


def test_cumulative_link_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (3000, 3)).astype(float)
    score = x @ np.array([1.5, -0.5, 0.0])
    grades = (score + rng.logistic(size=3000) > 1.0).astype(int) + (score + rng.logistic(size=3000) > 4.0).astype(int)
    r, c = np.nonzero(x)
    w, thetas = toxicity.fit_cumulative(r, c, x[r, c], grades, 3, np.ones(3000), steps=1500, penalty=1e-5)
    assert w[0] > 1.0 > 0 > w[1] and abs(w[2]) < 0.15 and thetas[0] < thetas[1]


def test_fit_is_the_least_of_its_penalised_likelihood():
    """Against the likelihood written out row by row: no step of a weight or threshold lowers it."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (120, 4)).astype(float)
    grades = np.clip((x @ np.array([1.0, 0.5, 0.0, -1.0]) + rng.logistic(size=120)).round().astype(int), 0, 2)
    r, c = np.nonzero(x)
    w, thetas = toxicity.fit_cumulative(r, c, x[r, c], grades, 4, np.ones(120), steps=20_000, penalty=1e-3)
    scale = np.maximum(0.02, np.sqrt((x**2).mean(axis=0)))

    def loss(w, thetas):
        total = 0.0
        for row, g in zip(x, grades, strict=True):
            above = [1.0, *[1 / (1 + np.exp(t - row @ w)) for t in thetas], 0.0]
            total -= np.log(above[g] - above[g + 1]) / len(x)
        return total + 1e-3 * np.abs(w * scale).sum()

    best = loss(w, thetas)
    for step in (1e-2, -1e-2, 1e-3, -1e-3):
        for i in range(4):
            assert loss(w + step * np.eye(4)[i], thetas) > best - 1e-7
        for k in range(2):
            assert loss(w, thetas + step * np.eye(2)[k]) > best - 1e-7


def test_rows_of_one_labelled_key_count_once(spark):
    docs = spark.createDataFrame([(1, "a b")] * 500 + [(2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.labelled_texts(docs, labels).collect())) == [("a b", 1), ("c", 0)]


def test_grades_are_those_of_the_labels(spark):
    texts = [(text(i, 0) + " vile" * (4 * (i % 3)), 2 * (i % 3)) for i in range(900)]
    model = toxicity.fit(spark.createDataFrame(texts, "text string, grade int"))
    assert len(model.thetas) == 4 and (np.diff(model.thetas) >= 0).all() and model.thetas[0] == model.thetas[1] < model.thetas[2]
    assert np.mean([int((model.above(t) >= 0.5).sum()) == g for t, g in texts]) > 0.8


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "vile"), (3, "vile " * 50_000), (3, "x"), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.query(docs, labels).collect()
    assert len(got) == 6 and not any(r.toxic for r in got)
    assert toxicity.query(docs.where("false"), labels).count() == 0
    model = toxicity.fit(spark.createDataFrame([(t, g) for _, t, g in rows(400)] + [(None, 0), ("", None)], "text string, grade int"))
    long = toxicity.score(docs, model).collect()
    assert [r.toxic for r in long if r.row.doc_id is None] == [True]
    assert all(r.severity >= 1 for r in long if r.row.doc_id == 3 and r.toxic)
