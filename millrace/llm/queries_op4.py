"""op4_secret_scan over the whole of documents."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .secrets import BASE_RULES, digest, scan_secrets
from .shared import table


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = tuple(r.kind for r in BASE_RULES)
    return found.select("doc_id", *map(_count, base), F.sha2(digest(F.col("spans"), base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
