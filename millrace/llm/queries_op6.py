"""op6_warc over the whole of pages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .warc import page_digests, write_warc


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_digests(spark, write_warc(table(spark, sf_dir, "pages")))
    return found.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


SQL = {
    "op6_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM g"""
}
