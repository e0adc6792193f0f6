from cairnframe.llm import quality


def test_stratum_of_few_hundred_labels_gets_rules(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "en", good + " #" * (i % 3), 1) for i in range(400)] + [(1000 + i, "de", good + " #" * (i % 3), 1) for i in range(400)]
    rows += [(2000 + i, "de", good + "#" * 60, 0) for i in range(30)] + [(3000 + i, "de", good + "#" * 60, None) for i in range(5)]
    rows += [(4000 + i, "fr", good + " #" * (i % 3), 1) for i in range(100)] + [(5000 + i, "fr", good + "#" * 60, 0) for i in range(30)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.query(docs, labels).collect()}
    assert {i: k for i, k in kept.items() if i < 2000} == {r[0]: True for r in rows if r[0] < 2000}
    assert not any(kept[i] for i in [*range(2000, 2030), *range(3000, 3005)])
    assert all(kept[i] for i in [*range(4000, 4100), *range(5000, 5030)])  # 100 good labels cannot prove 2 %
