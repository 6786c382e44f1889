"""Tables of the library's shapes, derived from the driver's tables, in Spark and in SQL alike.

Projects are document sources; files are documents, broken after sentence ends so that they have lines; chunks of a file
are windows of its lines, or the whole file where a query says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("text", r"([.!?]) ", "$1\n")
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.col("source").alias("project_id"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "lang", text.alias("text"))


FILES = r"""files AS (
  SELECT doc_id, source AS project_id, lang || '/' || doc_id || '.txt' AS path, lang,
    regexp_replace(text, '([.!?]) ', '\1' || chr(10), 'g') AS text FROM documents)"""


def whole_chunks(spark: SparkSession, sf_dir: str, project: str | None = None) -> DataFrame:
    """One chunk for each file; in one project, if given."""
    from ..functions.text import search_text

    f = files(spark, sf_dir)
    return f.select(F.col("path").alias("chunk_id"), (F.lit(project) if project else F.col("project_id")).alias("project_id"), "path", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(0).alias("ord"), F.lit(None).cast("string").alias("symbol"), F.col("text").alias("content"), search_text(F.col("text")).alias("search_text"))


SPLIT = r"array_to_string(regexp_extract_all(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), ' ')"
LEXEMES = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
SEARCH_TEXT = "{0} || chr(10) || " + SPLIT
LINES = "CASE WHEN {0} = '' THEN [] ELSE string_split(regexp_replace({0}, '\\n$', ''), chr(10)) END"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a citation marker, a list of markers and a fenced one appended, by their turn."""
    t = F.col("turn").cast("string")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conversation_id"), F.concat_ws("-", F.col("conv_id").cast("string"), t).alias("message_id"), F.col("turn").alias("pos"), "role",
        F.concat("text", F.lit(" ["), (F.col("turn") % 4).cast("string"), F.lit("] and ["), (F.col("turn") % 3 + 1).cast("string"), F.lit(", 2]\n```\narr[9]\n```")).alias("content"),
    )


MESSAGES = """messages AS (
  SELECT conv_id AS conversation_id, conv_id || '-' || turn AS message_id, turn AS pos, role,
    text || ' [' || (turn % 4) || '] and [' || (turn % 3 + 1) || ', 2]' || chr(10) || '```' || chr(10) || 'arr[9]' || chr(10) || '```' AS content FROM conversations)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 50).alias("embed_requests"))


JOBS = "jobs AS (SELECT o_orderkey AS job_id, o_custkey AS project_id, o_orderdate AS created_at, o_orderstatus AS status, o_orderkey % 50 AS embed_requests FROM orders)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("project_id"), F.col("event_type").alias("phase"), F.col("value").alias("done"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("src/f"), (F.col("event_id") % 10).cast("string"), F.lit(".ts")).alias("path"))


EVENTS = "ev AS (SELECT event_id, user_id AS project_id, event_type AS phase, value AS done, ts, 'src/f' || (event_id % 10) || '.ts' AS path FROM events)"
