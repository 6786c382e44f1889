"""Question files."""

from pyspark.sql import functions as F

from millrace.plans.indexes import read_question_files


def test_groups_of_questions_that_share_a_partition(spark, tmp_path):
    rows = spark.range(230).select(F.col("id").alias("item_id"), F.concat(F.lit("what is "), F.col("id").cast("string")).alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = read_question_files(spark, str(tmp_path)).collect()
    wanted = [(f"what is {i}", 0 if i % 3 == 0 else 2, i % 3 == 0) for i in range(230)]
    assert sorted(map(tuple, got)) == sorted(wanted)
