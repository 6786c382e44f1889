import pytest
from pyspark.sql import functions as F

from millrace.llm import shared
from millrace.llm.shared import lowest_hashes


def lowest(rows, n, seed):
    hashed = rows.select("id", F.xxhash64(F.lit(seed), "id").bitwiseAND((1 << 63) - 1).alias("h")).distinct().collect()
    return {r.id for r in sorted(hashed, key=lambda r: (r.h, r.id is not None, r.id))[:n]}


@pytest.mark.parametrize("count", [None, 10**6, 3 * 10**9, 10**13])
def test_samples_are_exact_whatever_the_size_is_said_to_be(spark, count):
    rows = spark.range(50_000).union(spark.range(100)).repartition(6)
    got = [r.id for r in lowest_hashes(rows, 300, ["id"], 4, count).collect()]
    assert len(got) == 300 and set(got) == lowest(rows, 300, 4)


def test_samples_of_few_hot_and_no_rows(spark):
    hot = spark.range(7).union(spark.range(5_000).select(F.lit(None).cast("long").alias("id")))
    assert {r.id for r in lowest_hashes(hot, 20, ["id"]).collect()} == {*range(7), None}
    assert len(lowest_hashes(hot, 5, ["id"]).collect()) == 5
    assert lowest_hashes(hot.limit(0), 5, ["id"]).count() == 0


def test_one_folder_for_a_run(spark):
    assert shared.shared_folder(spark).startswith(shared.shared_root(spark) + "/")
    assert shared.shared_folder(spark) != shared.shared_folder(spark)
