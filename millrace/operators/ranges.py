"""Ranges of lines: the chunks that they overlap, and their text from files that are stored in blocks of lines.

Ranges, chunks and blocks meet by file and bin of lines, so a long file, or one that a third of all ranges cite, is many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a bin in which ranges and chunks meet, and lines of a block of a file.
BIN_LINES, BLOCK_LINES = 64, 256
FILE = ["project_id", "path"]
RANGE = [*FILE, "start_line", "end_line"]


def _bins(first: Column, last: Column, size: int) -> tuple[Column, Column]:
    """First and last bin of lines `first` to `last`, both counted from 1."""
    return F.floor((first - 1) / size).cast("long"), F.floor((last - 1) / size).cast("long")


def _placed(ranges: DataFrame, ends: DataFrame) -> DataFrame:
    """Each distinct range that isn't null, with __first and __last: its lines as far as the file goes (ends: project_id, path, __end)."""
    once = ranges.select(*RANGE).distinct().filter("start_line IS NOT NULL AND end_line IS NOT NULL")
    first = F.greatest(F.lit(1), F.col("start_line")).cast("long")
    return once.join(ends, FILE).withColumn("__first", first).withColumn("__last", F.least(F.col("end_line").cast("long"), F.col("__end").cast("long")))


def overlapping_chunks(ranges: DataFrame, chunks: DataFrame, bin_lines: int = BIN_LINES) -> DataFrame:
    """project_id, path, start_line, end_line (of the range), chunk_id, chunk_start, chunk_end: the chunks that have a line of the range.

    Each distinct range and chunk meet once. Ranges that end before they start, with a null, or in files without chunks give
    nothing; lines before the first are left out. Chunks with null lines take no part. ranges: project_id, path, start_line,
    end_line; chunks: the same and chunk_id.
    """
    held = chunks.select(*FILE, "chunk_id", F.col("start_line").alias("chunk_start"), F.col("end_line").alias("chunk_end")).filter("chunk_start <= chunk_end")
    placed = _placed(ranges, held.groupBy(*FILE).agg(F.max("chunk_end").alias("__end"))).filter("__first <= __last")
    low, high = _bins(F.col("__first"), F.col("__last"), bin_lines)
    asked = placed.withColumn("__low", low).withColumn("__bin", F.explode(F.sequence(low, high)))
    low, high = _bins(F.col("chunk_start"), F.col("chunk_end"), bin_lines)
    given = held.withColumn("__from", low).withColumn("__bin", F.explode(F.sequence(low, high)))
    met = asked.join(given, [*FILE, "__bin"]).filter("__first <= chunk_end AND chunk_start <= __last")
    # Both may share many bins; the first of those speaks for all.
    return met.filter(F.col("__bin") == F.greatest("__low", "__from")).select(*RANGE, "chunk_id", "chunk_start", "chunk_end")


def line_blocks(files: DataFrame, size: int = BLOCK_LINES) -> DataFrame:
    """project_id, path, block (from 0), lines: a file's lines, `size` a block. An empty text is one empty line; a null one is no file. files: project_id, path, text."""
    lines = files.filter("text IS NOT NULL").select(*FILE, F.split("text", "\n", -1).alias("lines"))
    starts = F.sequence(F.lit(0), F.ceil(F.size("lines") / size).cast("int") - 1)
    blocks = lines.select(*FILE, F.explode(F.transform(starts, lambda b: F.struct(b.alias("block"), F.slice("lines", b * size + 1, F.lit(size)).alias("lines")))).alias("b"))
    return blocks.select(*FILE, "b.block", "b.lines")


def range_texts(ranges: DataFrame, blocks: DataFrame, size: int = BLOCK_LINES) -> DataFrame:
    """project_id, path, start_line, end_line, content: the text of each distinct range. blocks: as line_blocks gives them, of the same size.

    Lines before the first and after the last are left out, so a range outside its file is an empty text. Ranges with a null or in
    files that aren't there give nothing.
    """
    ends = blocks.groupBy(*FILE).agg(F.max(F.col("block") * F.lit(size) + F.size("lines")).alias("__end"))
    placed = _placed(ranges, ends)
    low, high = _bins(F.col("__first"), F.col("__last"), size)
    # The first block stands for the file where a range lies outside of it.
    wanted = F.when(F.col("__first") <= F.col("__last"), F.sequence(low, high)).otherwise(F.array(F.lit(0).cast("long")))
    asked = placed.withColumn("__block", F.explode(wanted))
    met = asked.join(blocks.select(*FILE, F.col("block").cast("long").alias("__block"), "lines"), [*FILE, "__block"])
    start = F.greatest(F.lit(1), F.col("__first") - F.col("__block") * size)
    length = F.greatest(F.lit(0), F.col("__last") - F.col("__block") * size - start + 1)
    parts = met.withColumn("__part", F.slice("lines", start.cast("int"), length.cast("int")))
    joined = parts.groupBy(*RANGE).agg(F.array_sort(F.collect_list(F.struct("__block", "__part"))).alias("__parts"))
    return joined.select(*RANGE, F.array_join(F.flatten(F.col("__parts.__part")), "\n").alias("content"))
