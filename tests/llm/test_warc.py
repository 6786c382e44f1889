import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from millrace.llm.queries_op6 import op6_warc
from millrace.llm.warc import chunked, page_records, parse, read_pages, read_records, reassembled, unchunked, write_warc


def test_query_against_brute_force(spark, tmp_path):
    big = "é<p>word</p>" * 20_000
    rows = [(1, "http://a/", "x" * 99), (2, "http://b/", "x" * 99), (3, "http://c/", "y" * 100), (4, "u\r\nv", "y" * 100), (9, None, big), (5, "d", big), (5, "d", big), (6, "e", None), (7, "f", ""), (8, "g", big + "1"), (None, "n", "y" * 100), (None, "m", "alone" * 50)]
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("page_id", "url", "html", "1 AS id", "2 AS digest", "3 AS payload").write.parquet(f"{tmp_path}/pages.parquet")
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        again = len(data) >= 100 and first is not None and i != first
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(tuple, op6_warc(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_payloads_come_back_whole(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("html", F.when(F.col("page_id") % 7 == 0, F.repeat("html", 30)).otherwise(F.col("html")))
    back = read_pages(spark, write_warc(pages, f"file://{tmp_path}/w"))
    assert back.filter("error is not null").count() == 0
    got = back.filter("type = 'response'").select(F.col("page_id").cast("long"), F.col("payload").cast("string").alias("html"))
    assert got.exceptAll(pages.select("page_id", "html")).count() == 0 and got.count() + back.filter("type = 'revisit'").count() == pages.count()
    assert read_records(spark, f"file://{tmp_path}/w", segments=True).count() > 10


def test_damage_is_told(spark):
    parts = [(h["warc-record-id"], h.get("warc-segment-origin-id", h["warc-record-id"]), int(h["warc-segment-number"]), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, block) for r in page_records("1", "u", b"q" * 100_000, "d", None) for h, block in parse(gzip.open(io.BytesIO(r)))]
    rows = spark.createDataFrame([(r, "response", "1", "u", None, o, n, t, bytearray(b), None, None) for r, o, n, t, b in parts], "record_id string, type string, page_id string, uri string, refers_to string, origin string, segment int, total long, part binary, payload binary, error string")
    assert bytes(reassembled(rows).first().payload) == b"q" * 100_000
    assert reassembled(rows.filter("segment <> 2")).first().error == "segments are missing"
    short = rows.withColumn("part", F.when(F.col("segment") == 2, F.expr("substring(part, 1, 9)")).otherwise(F.col("part")))
    assert "stated" in reassembled(short).first().error


def test_chunked_framing():
    for size in (0, 1, 8191, 8192, 8193, 50_000):
        assert unchunked(chunked(b"z" * size)) == b"z" * size
    assert unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            unchunked(broken)


def test_empty(spark, tmp_path):
    assert read_pages(spark, write_warc(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
