"""Evaluation of retrieval and answers: recall, reciprocal rank, stability of top rows, verdict rates, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks that a snapshot keeps of each query: what agreement is measured on.
SNAPSHOT_RANKS = 10


def evaluate_retrieval(retrieved: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, mode, recall_5, recall_10, rr. retrieved: query_id, mode, rank, path; questions: query_id, expected (array)."""
    expected = questions.select("query_id", F.explode("expected").alias("path"))
    return evaluate_rows(retrieved, expected, questions)


def evaluate_rows(retrieved: DataFrame, expected: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, mode, recall_5, recall_10, rr: as evaluate_retrieval, expected paths being rows (query_id, path).

    recall: share of the different expected paths among ranks up to 5 and 10 (ranks count from 1); 1 if nothing is expected.
    rr: 1 by the rank of the first expected path, 0 without any. Every question has a row for every mode that occurs. Hits
    are counted by joins and partial sums, so neither a query with very many rows nor one with very many expected paths
    is gathered in one place.
    """
    modes = [r["mode"] for r in retrieved.select("mode").distinct().collect()]  # a handful
    asked = questions.select("query_id", F.explode(F.array(*map(F.lit, modes)).cast("array<string>")).alias("mode"))
    wanted = expected.select("query_id", "path").distinct()
    found = retrieved.groupBy("query_id", "mode", "path").agg(F.min("rank").alias("rank")).join(wanted, ["query_id", "path"])
    within = [F.count_if(F.col("rank") <= k).alias(f"in_{k}") for k in (5, 10)]
    hits = found.groupBy("query_id", "mode").agg(*within, F.min("rank").alias("first"))
    counts = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    rows = asked.join(counts, "query_id", "left").join(hits, ["query_id", "mode"], "left")
    recalls = [F.when(F.col("wanted").isNull(), 1.0).otherwise(F.coalesce(f"in_{k}", F.lit(0)) / F.col("wanted")).alias(f"recall_{k}") for k in (5, 10)]
    return rows.select("query_id", "mode", *recalls, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def retrieval_scorecard(evaluated: DataFrame) -> DataFrame:
    """mode, questions, recall_5, recall_10, mrr."""
    return evaluated.groupBy("mode").agg(F.count(F.lit(1)).alias("questions"), *[F.round(F.avg(c), 6).alias(n) for c, n in (("recall_5", "recall_5"), ("recall_10", "recall_10"), ("rr", "mrr"))])


def verdict_rates(verdicts: DataFrame, flags: tuple[str, ...]) -> DataFrame:
    """Mean of each flag over parsed verdicts, and how many were parsed and failed. verdicts: verdict (struct or null)."""
    rates = [F.round(F.avg(F.col(f"verdict.{f}").cast("int")), 6).alias(f) for f in flags]
    return verdicts.agg(F.count("verdict").alias("parsed"), F.count_if(F.col("verdict").isNull()).alias("failed"), *rates)


def latency_summary(samples: DataFrame) -> DataFrame:
    """label, n, p50, p95 (nearest rank), least, most, mean. samples: label, ms."""
    disc = [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY ms)").alias(f"p{p}") for p in (50, 95)]
    return samples.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *disc, F.min("ms").alias("least"), F.max("ms").alias("most"), F.round(F.avg("ms"), 6).alias("mean"))


def snapshot_topk(retrieved: DataFrame, k: int = SNAPSHOT_RANKS) -> DataFrame:
    """query_id, keys: `path:start-end` of the ranks up to k, in order of rank."""
    key = F.format_string("%s:%d-%d", "path", "start_line", "end_line")
    return retrieved.filter(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", key.alias("key")))), lambda x: x["key"]).alias("keys"))


def topk_agreement(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """questions, recall_5, recall_10, same_first: how far the candidate's lists keep the baseline's. Both: query_id, keys."""
    both = baseline.select("query_id", F.col("keys").alias("a")).join(candidate.select("query_id", F.col("keys").alias("b")), "query_id", "left")
    b = F.coalesce("b", F.array().cast("array<string>"))
    share = lambda k: F.when(F.size("a") == 0, 1.0).otherwise(F.size(F.array_intersect(F.slice("a", 1, k), F.slice(b, 1, k))) / F.least(F.lit(k), F.size("a")))
    same = F.get("a", F.lit(0)).eqNullSafe(F.get(b, F.lit(0)))
    return both.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(share(5)), 6).alias("recall_5"), F.round(F.avg(share(10)), 6).alias("recall_10"), F.count_if(same).alias("same_first"))
