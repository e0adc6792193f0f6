import corpus_pipeline
from tests_llm_texts import labels, text

EXTRA = ("gone", "taken", "copies", "copy", "row", "place", "text_", "copies_", "node", "size", "spans", "masked", "toxic", "source_size", "rate", "label", "kept", "word", "there")


def test_columns_that_bear_the_stages_own_names(spark, tmp_path):
    rows = [(i, None if i == 7 else "" if i == 8 else text(i // 2, 60), "en", "ab"[i % 2], i, *[f"{c}{i}" for c in EXTRA]) for i in range(40)]
    rows += [rows[3], (None, text(900, 50), None, None, None, *[None] * len(EXTRA)), (50, text(901, 12_000), "en", "a", 9, *EXTRA)]
    at = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA))
    spark.createDataFrame(labels(), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kinds = [(f.name, f.dataType) for f in at.schema]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            break
        assert [(f.name, f.dataType) for f in at.schema] == kinds
        for r in at.where("doc_id IS NOT NULL AND doc_id < 50").collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in EXTRA)
    assert at.count() > 0
