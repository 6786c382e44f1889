"""The stored index beside the scan."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import postings as P
from millrace.operators import retrieval as R


def corpus(spark, n=900):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["the"] * 40 + ["rateLimit", "rate", "limit", "XMLHttpRequest", "é", "or"]
    rows = [(f"c{rng.randrange(10**9)}-{i}", f"p{i % 3}", f"f{i // 4}.txt", i % 4, i % 4 + 9, " ".join(rng.choice(words) for _ in range(rng.choice((3, 20, 200))))) for i in range(n)]
    rows += [(f"hot{i}", "p0", f"h{i}.txt", 1, 2, "the " * 300) for i in range(300)]
    rows += [("empty", "p0", "e.txt", 1, 1, ""), ("null", "p0", "n.txt", 1, 1, None), (None, "p0", "n.txt", 1, 1, "rate"), ("lost", None, "n.txt", 1, 1, "rate")]
    chunks = spark.createDataFrame(rows, "chunk_id string, project_id string, path string, start_line int, end_line int, content string")
    return chunks.withColumn("search_text", T.search_text(F.col("content"))).withColumn("segment", F.lit("x")).withColumn("folder", F.lit(3))


def asked(spark):
    rows = [(1, "p0", "rate limit of w3"), (2, "p0", "the"), (3, "p1", "rate-limit w5"), (4, "p2", "XMLHttpRequest or w1 w2"), (5, "p2", "nowhere"), (6, "p9", "the"), (7, "p0", "the the-the é"), (8, "p1", None), (9, "p1", ""), (10, "p1", "or"), (1, "p1", "w7 w8 w9")]
    return spark.createDataFrame(rows, "query_id int, project_id string, text string")


@pytest.mark.parametrize("segment", [256, 16])
def test_search_equals_the_scan(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(P, "SEGMENT", segment)
    chunks, queries = corpus(spark), asked(spark).filter("NOT (query_id = 1 AND project_id = 'p1')")
    P.build_postings(chunks.repartition(3), f"{tmp_path}/index")
    for k in (3, 20):
        want = sorted(map(tuple, R.fulltext_search(chunks.filter("chunk_id IS NOT NULL AND project_id IS NOT NULL AND content IS NOT NULL"), queries, k).select("query_id", "rank", "chunk_id", "score").collect()))
        got = sorted(map(tuple, R.fulltext_search(chunks, queries, k, index=f"{tmp_path}/index").select("query_id", "rank", "chunk_id", "score").collect()))
        assert got == want and {q for q, *_ in got} == {1, 2, 3, 4, 7}


def test_references_equal_the_scan(spark, tmp_path):
    chunks = corpus(spark)
    P.build_postings(chunks, f"{tmp_path}/index")
    rows = [(1, "p0", "rateLimit"), (2, "p1", "XMLHttpRequest"), (3, "p2", "w1 w2 w3"), (4, "p0", "the"), (5, "p0", "nowhere w1"), (6, "p0", ""), (7, "p0", None)]
    symbols = spark.createDataFrame(rows, "query_id int, project_id string, symbol string")
    columns = ["query_id", "rank", "chunk_id", "path", "start_line", "end_line"]
    scanned = chunks.filter("chunk_id IS NOT NULL AND project_id IS NOT NULL AND content IS NOT NULL")
    want = sorted(map(tuple, R.find_references(scanned, symbols).select(columns).collect()))
    assert sorted(map(tuple, P.indexed_references(spark, f"{tmp_path}/index", symbols).select(columns).collect())) == want and want


def test_blocks_that_cannot_matter_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "SEGMENT", 16)
    chunks = corpus(spark)
    P.build_postings(chunks.coalesce(1), f"{tmp_path}/index")
    seen = []
    live = P._live
    monkeypatch.setattr(P, "_live", lambda *a: seen.append(live(*a)) or seen[-1])
    queries = asked(spark).filter("query_id = 2")
    R.fulltext_search(chunks, queries, 5, index=f"{tmp_path}/index").collect()
    segments = spark.read.parquet(f"{tmp_path}/index").filter("folder = -1 AND project_id = 'p0'").count()
    # Only segments in which `the` is as frequent as in the fifth best chunk are scored.
    assert 0 < seen[0].count() < segments / 2
    sizes = P.read_bytes(spark, f"{tmp_path}/index", asked(spark).filter("query_id = 4")).first()
    assert 0 < sizes["bytes"] < sizes.all_bytes / 10


def test_an_empty_index(spark, tmp_path):
    chunks = corpus(spark, 1).limit(0)
    P.build_postings(chunks, f"{tmp_path}/index")
    assert R.fulltext_search(chunks, asked(spark), 5, index=f"{tmp_path}/index").count() == 0


def test_a_row_for_each_folder_of_a_segment(spark, tmp_path):
    chunks = corpus(spark).filter("chunk_id IS NOT NULL AND project_id IS NOT NULL AND content IS NOT NULL")
    calls = spark.sparkContext.accumulator(0)

    def noted(text):
        calls.add(1)
        return text

    P.build_postings(chunks.withColumn("search_text", F.udf(noted)("search_text")).coalesce(1), f"{tmp_path}/index")
    rows = spark.read.parquet(f"{tmp_path}/index")
    segments = rows.filter("folder = -1").count()
    # A row for each word of a segment would be more than these.
    assert segments < rows.count() <= (P.FOLDERS + 1) * segments
    # Search texts are made once.
    assert calls.value == chunks.count()


@pytest.mark.parametrize("few", [True, False])
def test_long_chunks_and_many_words(spark, tmp_path, monkeypatch, few):
    rows = [("long", "a b " * 35_000 + "c d", 0), ("short", "c d c", 1), ("null", None, 2), ("ends", "b a c d", 3), ("empty", " . ", 4)]
    chunks = spark.createDataFrame(rows, "chunk_id string, search_text string, start_line int")
    chunks = chunks.select("*", F.lit(7).alias("project_id"), F.col("chunk_id").alias("path"), F.col("start_line").alias("end_line")).coalesce(1)
    P.build_postings(chunks, f"{tmp_path}/index")
    wanted = P._wanted
    if not few:
        monkeypatch.setattr(P, "_wanted", lambda asked: (wanted(asked)[0], asked.select("project_id", "lexeme").distinct()))
    queries = spark.createDataFrame([(1, 7, "c-d"), (2, 7, "b-a"), (3, 7, "a"), (4, 7, "c"), (5, 8, "c")], "query_id int, project_id int, text string")
    got = P.indexed_search(spark, f"{tmp_path}/index", queries).select("query_id", "rank", "chunk_id", "score").collect()
    one = [(1, 1, "ends", 0.1), (1, 2, "long", 0.1), (1, 3, "short", 0.1), (2, 1, "long", 25.6), (2, 2, "ends", 0.1), (3, 1, "long", 25.6), (3, 2, "ends", 0.1)]
    assert sorted(map(tuple, got)) == [*one, (4, 1, "short", 0.2), (4, 2, "ends", 0.1), (4, 3, "long", 0.1)]
    symbols = queries.select("query_id", "project_id", F.col("text").alias("symbol"))
    found = P.indexed_references(spark, f"{tmp_path}/index", symbols).groupBy("query_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("ids"))
    assert {r.query_id: r.ids for r in found.collect()} == {1: ["ends", "long", "short"], 2: ["ends", "long"], 3: ["ends", "long"], 4: ["ends", "long", "short"]}


def test_nothing_asked(spark, tmp_path):
    P.build_postings(corpus(spark, 20), f"{tmp_path}/index")
    assert R.fulltext_search(corpus(spark, 1), asked(spark).filter("query_id = 9"), 5, index=f"{tmp_path}/index").count() == 0
    assert P.indexed_references(spark, f"{tmp_path}/index", asked(spark).filter("query_id = 9").withColumnRenamed("text", "symbol")).count() == 0
