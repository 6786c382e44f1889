"""Ranges of lines beside plain loops."""

import random

from pyspark.sql import functions as F

from millrace.operators import ranges as G

RANGES = "project_id string, path string, start_line int, end_line int, chunk_id string"


def test_chunks_that_overlap(spark):
    draw = random.Random(2)
    chunks = [("p", f"f{draw.randrange(4)}", a, a + draw.randrange(300), f"c{n}") for n, a in enumerate(draw.choices(range(1, 2_000), k=150))]
    chunks += [("p", "f0", 1, 1_000_000, "whole"), ("p", "f0", 5, 4, "none"), ("p", "f0", None, 3, "null"), (None, "f1", 1, 9, "nobody")]
    asked = [("p", f"f{draw.randrange(5)}", a, a + draw.randrange(-2, 500), "clash") for a in draw.choices(range(-20, 2_200), k=80)]
    asked += [("p", "f0", 3, 2_147_483_647, "x"), ("p", "f1", 1, None, "x"), (None, "f1", 1, 9, "x"), asked[0]]
    got = G.overlapping_chunks(spark.createDataFrame(asked, RANGES), spark.createDataFrame(chunks, RANGES), 16).collect()
    want = {
        (p, f, a, b, c)
        for p, f, a, b, _ in asked for q, g, s, e, c in chunks
        if p and (p, f) == (q, g) and None not in (a, b, s, e) and s <= e and max(a, 1) <= b and max(a, 1) <= e and s <= b
    }
    assert len(got) == len(want) and {(r.project_id, r.path, r.start_line, r.end_line, r.chunk_id) for r in got} == want


def test_texts_of_ranges(spark):
    texts = {"long": "\n".join(map(str, range(1, 5_001))), "short": "a\nb\n", "empty": ""}
    files = spark.createDataFrame([("p", n, t) for n, t in texts.items()] + [("p", "null", None)], "project_id string, path string, text string")
    asked = [("p", n, a, b, "") for n in (*texts, "null", "gone") for a, b in ((1, 1), (-3, 2), (250, 1_030), (4_999, 9_000), (6_000, 6_001), (3, 2), (1, 2_147_483_647), (2, None))]
    got = {(r.path, r.start_line, r.end_line): r.content for r in G.range_texts(spark.createDataFrame(asked + asked, RANGES), G.line_blocks(files, 64), 64).collect()}
    assert got == {(n, a, b): "\n".join(texts[n].split("\n")[max(a, 1) - 1 : max(b, 0)]) for _, n, a, b, _ in asked if n in texts and b is not None}
    assert G.range_texts(spark.createDataFrame(asked, RANGES).limit(0), G.line_blocks(files)).count() == 0


def test_a_million_lines_are_many_rows(spark):
    file = spark.range(1).select(F.lit("p").alias("project_id"), F.lit("f").alias("path"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: i.cast("string")), "\n").alias("text"))
    blocks = G.line_blocks(file)
    assert blocks.agg(F.count("*"), F.max(F.size("lines"))).first()[:] == (3_907, 256)
    cited = spark.createDataFrame([("p", "f", 999_990, 1_000_005, "")], RANGES)
    assert G.range_texts(cited, blocks).first().content == "\n".join(map(str, range(999_990, 1_000_001)))
