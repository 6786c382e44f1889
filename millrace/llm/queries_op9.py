"""op9_near_dedup over the whole of documents."""

from pyspark.sql import DataFrame, SparkSession

from .hyperminhash import near_duplicates
from .shared import table


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
