import os

import corpus_pipeline
from quarry.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))


def write(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_empty(spark, tmp_path):
    found = corpus_pipeline.run(spark, write(spark, tmp_path, []))
    assert found.columns == ["doc_id", "source", "lang", "token_ids", "n_tokens"] and found.collect() == []


def test_without_labels(spark, tmp_path):
    rows = [(1, LONG, None, "a", 1), (2, LONG, None, "a", 1), (3, "12 34", None, "a", 5), (None, LONG, None, None, None), (None, None, None, None, None)]
    docs = common.documents(spark, write(spark, tmp_path, rows))
    kept = corpus_pipeline.keep_identified(spark, docs, "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None"]
    left = corpus_pipeline.keep_representatives(spark, kept, "")
    assert [r.doc_id for r in left.collect()] == [1]


def test_clashing_columns_repeats_and_folders(spark, tmp_path):
    rows = [(i % 40, f"{LONG} {i % 40} " * (1 + i % 3), "aa", f"s{i % 3}", 7, "x", i, None, "y") for i in range(60)]
    folder = write(spark, tmp_path, rows, f"{SCHEMA}, size string, copies int, key string, lines string")
    there = lambda: set(os.listdir(common.shared_dir(spark).removeprefix("file://")))
    stored, folders = list(common.STORED), there()
    assert corpus_pipeline.run(spark, folder).count() > 0
    left = [p for p in common.STORED if p not in stored]
    assert len(left) == 1 and "stage-mixing" in left[0]
    assert {p for p in there() - folders if p.startswith("stage-")} == {os.path.basename(left[0])}
