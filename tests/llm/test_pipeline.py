import corpus_pipeline
from tests_llm_texts import documents, labels


def test_stages_take_effect(spark, tmp_path):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels(), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert out.columns == at.columns and [f.dataType for f in out.schema] == [f.dataType for f in at.schema]
        out.write.parquet(str(tmp_path / name))
        seen[name] = (at.collect(), spark.read.parquet(str(tmp_path / name)).collect())
        at = spark.read.parquet(str(tmp_path / name))
    ids = lambda rows: sorted(r.doc_id for r in rows if r.doc_id is not None)
    before, after = seen["toxicity"]
    assert set(ids(before)) - set(ids(after)) == {i for i, *_ in documents() if i is not None and 100 <= i < 160}
    before, after = seen["near_dedup"]
    assert set(ids(before)) - set(ids(after)) == {501, 502} and ids(after).count(500) == 1
    before, after = seen["secret_scans"]
    texts = {r.doc_id: r for r in after}
    assert len(before) == len(after) and "hunter2hunter2" not in texts[600].text and texts[600].n_chars == len(texts[600].text)
    assert [r for r in before if r.doc_id not in (600,)].__len__() == len([r for r in after if r in before])
    before, after = seen["mixing"]
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    words = sum(len((r.text or "").split()) for r in before)
    assert abs(sum(len((r.text or "").split()) for r in after) - 1.5 * words) < 0.1 * words
    before, after = seen["packing"]
    assert sum(r.length for r in after if r.start == 0) > 0 and {r.doc_id for r in after} == {r.doc_id for r in before}


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
