"""op3_nearest over the whole of embeddings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kmeans_tree import TreeIndex
from .shared import table


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return TreeIndex(vectors).search(vectors.filter(F.col("vec_id") % 100 == 0))
