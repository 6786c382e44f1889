"""op13_fair_toxicity over the whole of documents."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fair_toxicity import PREDICT_FROM, score_documents, train
from .shared import table


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op13_fair_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"), "n_sentences", "top_sentence")
