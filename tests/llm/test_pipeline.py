"""The pipeline's stages in turn, on planted documents, and on an empty table."""

import random

import corpus_pipeline
from tests.llm.test_operators import words


def planted(tmp_path, spark, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(0, " ".join(f"bench{k}" for k in range(30)))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return items


def test_pipeline(spark, tmp_path):
    rnd = random.Random(12)
    rows = [(k, " ".join(words(rnd, 80, 5000)), "en", "s", 0) for k in range(30)]
    near = rows[0][1].split()
    near[40] = "changed"
    item = " ".join(f"bench{k}" for k in range(30))
    rows += [
        (100, " ".join(near), "en", "s", 0), (101, rows[1][1] + " " + item, "en", "s", 0), (102, "12 34", None, "s", 0), (103, None, "en", None, None),
        (104, "one line here\nand another there\nthird and last", "en", "s", 0), (105, "its own start\none line here\nand another there\nthird and last", "en", "s", 0),
    ]
    planted(tmp_path, spark, rows)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    after = stage["language_id"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in after.collect()} == {r[0] for r in rows} - {102, 103} and after.columns == docs.columns
    after = stage["line_dedup"](spark, docs, str(tmp_path))
    assert after.count() == len(rows) and {r.doc_id: r.text for r in after.collect()}[105] == "its own start"
    after = stage["near_dedup"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in after.collect()} == {r[0] for r in rows} - {100} and after.columns == docs.columns
    after = stage["decontaminate"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in after.collect()} == {r[0] for r in rows} - {101}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows} - {100, 101, 102, 103} and all(len(r.ids) == r.n_tokens for r in out)


def test_pipeline_of_nothing(spark, tmp_path):
    planted(tmp_path, spark, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
