"""The corpus pipeline: documents in, token ids of the cleaned and mixed corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of docs.

1. quality_classifier: documents that score below QUALITY_FROM go. Learned from `labels` (quality), a bounded sample.
2. near_dedup: of each group of near-duplicates (shingles of five words, similarity of 0.8 or more) one document stays:
   the one with the smallest id; of rows with that id, one. Rows with one id and different texts are documents of their
   own. Rows without id stay.
3. secret_scan: found secrets are masked in the texts; n_chars follows. No document goes.
4. mixing: each document is repeated, kept once or left out, so that sources near their targets.
5. bpe: each row of the mix is encoded and decoded; ids as digests, with the number of tokens.

Empty tables, nulls, ties and repeated rows: as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import round_trip
from millrace.llm.hyperminhash import BROADCAST_ROWS, near_duplicates, with_sets
from millrace.llm.mixing import mix
from millrace.llm.passage_attention import keep_good, train
from millrace.llm.secrets import redact, scan_secrets
from millrace.llm.shared import shared_folder, table, written

QUALITY_FROM = 0.5
#: Stages on word shingles: five words, 80 % or more.
SHINGLE, PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")), QUALITY_FROM)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = written(near_duplicates(docs, PERCENT, SHINGLE, sets=True))
    # Only the ids that go are joined.
    gone = found.filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone")).distinct()
    again = written(found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__again")))
    if again.isEmpty():
        return docs.join(_small(written(gone)), docs["doc_id"] == F.col("__gone"), "left_anti")
    # Rows that share an id are told apart by the hash of their set of shingles, those without shingles by that of their text.
    again = _small(again)
    gone = _small(written(gone.join(again, gone["__gone"] == again["__again"], "left_anti")))
    once = docs.join(again, docs["doc_id"] == again["__again"], "left_anti")
    once = once.join(gone, once["doc_id"] == gone["__gone"], "left_anti")
    rows = with_sets(docs.join(again, docs["doc_id"] == again["__again"], "left_semi"), SHINGLE)
    best = found.filter("chosen AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("set").alias("__of")).distinct()
    best = best.join(again, best["__id"] == again["__again"], "left_semi")
    chosen = rows.filter("__set IS NOT NULL").join(best, (rows["doc_id"] == best["__id"]) & (rows["__set"] == best["__of"]), "left_semi")
    empty = rows.filter("__set IS NULL").withColumn("__set", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    kept = chosen.unionByName(empty).dropDuplicates(["doc_id", "__set"]).drop("__set")
    return once.unionByName(kept)


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids  # 16 bytes a row


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = redact(docs, scan_secrets(docs))
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mixing), ("bpe", bpe)]
#: The first stage's model can't be told in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), shared_folder(spark))
    return STAGES[-1][1](spark, docs, sf_dir)
