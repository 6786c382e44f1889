"""What applying a batch to the versioned index moves and writes."""

import random

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import snapshots as S


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()


def test_texts_are_shuffled_once_and_kept_ones_not_at_all(spark, tmp_path):
    folder, r = f"file://{tmp_path}/index", random.Random(1)
    rows = [("p", f"f{i}.txt", "\n".join(r.randbytes(40).hex() for _ in range(250))) for i in range(200)]
    size = sum(len(t) for _, _, t in rows)
    batch = spark.createDataFrame(rows, "project_id string, path string, text string")
    at = shuffled(spark)
    S.apply_batch(spark, folder, batch, buckets=4)
    assert shuffled(spark) - at < 1.5 * size
    at = shuffled(spark)
    S.apply_batch(spark, folder, batch.filter("path LIKE '%7.txt'").withColumn("text", F.concat("text", F.lit("\nmore"))))
    assert shuffled(spark) - at < 0.5 * size
    chunks = S.read_snapshot(spark, folder, "chunks")
    assert chunks.filter(~F.col("search_text").eqNullSafe(T.search_text(F.col("content")))).count() == 0
    written = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/data")
    assert "search_text" not in written.columns
    assert chunks.groupBy("path").count().count() == 200
