"""Connected components of an edge table by contraction, and groups of rows streamed through a task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame) -> DataFrame:
    """v, label for every vertex that has an edge; vertices of one component share a label, one of them.

    edges: a, b (numbers). In each round every vertex is merged into its smallest neighbour; the edges between merged
    vertices make up the next, smaller graph (half the vertices at most). Each round is written to the shared folder.
    """
    left = written(edges.select("a", "b").filter("a <> b").distinct())
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        merged = written(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("to")))
        if labels is None:
            labels = merged.select("v", F.col("to").alias("label"))
        else:
            labels = labels.join(merged.select(F.col("v").alias("label"), "to"), "label", "left").select("v", F.coalesce("to", "label").alias("label"))
        labels = written(labels)
        moved = left.join(merged.select(F.col("v").alias("a"), F.col("to").alias("a2")), "a").join(merged.select(F.col("v").alias("b"), F.col("to").alias("b2")), "b")
        left = written(moved.filter("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    return labels if labels is not None else left.select(F.col("a").alias("v"), F.col("b").alias("label"))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition sorted by keys, one after the other, wherever the batches end."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        columns = [table.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        start = 0
        for i in range(1, len(rows)):
            if rows[i] != rows[i - 1]:
                yield table.slice(start, i - start)
                start = i
        held = table.slice(start)
    if held is not None and held.num_rows:
        yield held


class Sets:
    """Disjoint sets of the numbers below n."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """False if they were together already."""
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j
