"""op8_mixing over the whole of documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import SEED, mixing_plan
from .shared import table


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = {
    "op8_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM totals),
summed AS (
  SELECT *, sum(source_size) OVER () AS all_size,
    coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left
  FROM weighed),
levelled AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * all_size - CAST(2.0 AS DOUBLE) * before) / weights_left AS level FROM summed),
owned AS (SELECT *, CASE WHEN level * weight < CAST(2.0 AS DOUBLE) * source_size THEN level END AS own FROM levelled),
placed AS (
  SELECT source, source_size, weight, first_value(own IGNORE NULLS) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fixed FROM owned),
targets AS (
  SELECT source, source_size, coalesce(least(fixed * weight, CAST(2.0 AS DOUBLE) * source_size), CAST(2.0 AS DOUBLE) * source_size) AS target FROM placed),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, CAST(2.0 AS DOUBLE)) ELSE CAST(0.0 AS DOUBLE) END AS rate,
    CAST(CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || coalesce(d.text, '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated"""
}
