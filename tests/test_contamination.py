"""Passages from anywhere in a benchmark text are found, and short items."""

from millrace.plans import curation_queries as C


def test_any_passage_is_found(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(30))
    texts = ["x " + " ".join(f"w{i}" for i in range(12, 20)) + " y", "x " + " ".join(f"W{i}" for i in range(22, 30)), "a w3 w4 w5 w6 w7 w8 w9 b", "so Five\nwords in all here it is", "five words in all", "", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, "five words in all here"), (2, ""), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id for r in C.contamination_semi(spark, str(tmp_path)).collect()) == [0, 1, 3]
