"""op1_quality_rules over the whole of documents."""

from pyspark.sql import DataFrame, SparkSession

from .quality_rules import apply_rules, train
from .shared import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs, train(docs, table(spark, sf_dir, "labels")))
