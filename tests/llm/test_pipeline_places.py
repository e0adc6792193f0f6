import corpus_pipeline
import pytest
from tests_llm_texts import text


@pytest.mark.parametrize("stage", ["near_dedup", "mixing"])
def test_decisions_find_their_rows_when_files_are_split_otherwise(spark, tmp_path, stage):
    rows = [(i, text(i // 2) if i % 2 and i < 40 else "" if i % 3 == 0 else text(1000 + i), "en", "ab"[i % 2], i) for i in range(80)]
    rows += [(100 + i, text(i // 2), "en", "a", i) for i in range(40) if i % 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(9, "doc_id").write.parquet(str(tmp_path / "docs"))
    at = spark.read.parquet(str(tmp_path / "docs"))
    run = dict(corpus_pipeline.STAGES)[stage]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        out = run(spark, at, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    got = out.collect()
    if stage == "near_dedup":
        first = {}
        for i, t, *_ in rows:
            first.setdefault(t or i, i)
        assert sorted(r.doc_id for r in got) == sorted(first.values())
    else:
        words = lambda found: sum(len(r[1].split()) for r in found)
        assert all(r.text for r in got) and abs(words(got) - 1.5 * words(rows)) < 0.1 * words(rows)
