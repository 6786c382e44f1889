"""Chunks that a model's input holds."""

from millrace.operators import indexing as I


def test_fitting_chunks_makes_its_input_once(spark):
    files = spark.createDataFrame([("p", "a.txt", "word " * 3000), ("p", "b.txt", "short")], "project_id string, path string, text string")
    cut = I.fitting_chunks(I.build_chunks(files))
    assert cut._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = cut.orderBy("path").collect()
    assert len(rows) == 5 and "".join(r["content"] for r in rows if r["path"] == "a.txt") == "word " * 3000
