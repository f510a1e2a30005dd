"""Documents that hold a benchmark item, whatever their length."""

from quillspark.plans import catalogue


def test_documents_are_read(spark, tmp_path):
    item = "alpha beta gamma delta epsilon"
    docs = [(1, " ".join(f"w{i}" for i in range(500)) + " Alpha, BETA gamma delta! epsilon"), (2, "nothing of it"), (3, None), (4, "alpha beta"), (5, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item), (8, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {tuple(r) for r in catalogue.QUERIES["token_overlap_contamination"](spark, str(tmp_path)).collect()}
    assert got == {(1, 7, round(5 / 505, 6), 1.0), (4, 7, 0.4, 0.4)}
