"""Hard-negative mining: slots of scores between the positives' upper limits.

Vectors become whole numbers (scale times each part, rounded down), and a row's score for an anchor is their inner product,
exact. Each anchor has its `positives` best other rows of its own label. A positive with score p wants the best `k` rows
of other labels whose score lies from low% to high% of p. These windows overlap, so rows aren't searched window by window:
the distinct upper limits, falling, cut the scores into disjoint slots, a window is a run of slots down from its own,
and its best k are among the best k of each of these. So tasks keep, while they read rows once, the k best of each slot
(nothing below the lowest limit); slots are then merged from the lowest up, the merge at a slot being the best k at
or below its limit, and each positive reads its own and drops what is below its lower limit.

Anchors are a stated set; they are broadcast in blocks of ANCHORS, and each block is one pass over the rows for the positives
and one for the negatives. Vectors are never shuffled: what leaves a task is bounded by k rows a slot, whatever the sizes of labels.

Defined results: rows without label or id, and vectors that are null, hold null or non-finite parts, or parts that a
score can't safely hold (after scaling, above the square root of 2^55 / parts: 90,000 with 64 parts and scale 256) take no part; an anchor meets vectors of its
own length only; empty vectors score 0. An id that several rows share: as an anchor once (the smallest vector, then the
smallest label), as other rows as often as they occur, never for an anchor of that id. Positives below 0 have empty windows.
Empty tables give empty results. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Fixed values of the production query: positives of an anchor, negatives of a positive, window in percent, scale of the parts.
POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
#: Anchors of one pass (about 10 MB of vectors with 64 parts), and scores that a task computes at a time.
ANCHORS, BLOCK_SCORES = 16_384, 1 << 20
_LEAST = np.iinfo(np.int64).min


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, label, v (whole numbers): the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    most = F.sqrt(F.lit(float(1 << 55)) / F.greatest(F.size("v"), F.lit(1))) / float(scale)
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < most))
    kept = own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & good)
    return kept.select("id", "label", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("v"))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where they can't lose a digit."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(x.shape[1], 1)
    if most < 2**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


class Slots:
    """The k best rows of each slot so far: score down, id up. Slot s of an anchor: scores from limits[s] down to above limits[s + 1]."""

    def __init__(self, k: int):
        self.k = k
        self.held = [np.zeros(0, np.int64) for _ in range(4)]  # anchor, slot, score, id
        self.rows = 0

    def add(self, scores: np.ndarray, numbers: np.ndarray, limits: np.ndarray, ids: np.ndarray) -> None:
        """scores: rows x anchors, rows in order of id, _LEAST for those that don't count; limits: anchors x (slots + 1), falling."""
        order = np.argsort(-np.where(scores == _LEAST, _LEAST + 1, scores), axis=0, kind="stable")
        ranked = np.take_along_axis(scores, order, 0)
        first = (ranked > limits[None, :, 0]).sum(0)
        for slot in range(limits.shape[1] - 1):
            end = (ranked > limits[None, :, slot + 1]).sum(0)
            place = first[None] + np.arange(min(self.k, len(scores)))[:, None]
            rank, column = np.nonzero(place < end[None])
            at = place[rank, column]
            new = numbers[column], np.full(len(at), slot), ranked[at, column], ids[order[at, column]]
            self.held = [np.concatenate([a, b]) for a, b in zip(self.held, new, strict=True)]
            first = end
        if len(self.held[0]) > 2 * self.rows + 500_000:
            self.cut()

    def cut(self) -> list[np.ndarray]:
        anchor, slot, score, ids = self.held
        order = np.lexsort((ids, -score, slot, anchor))
        anchor, slot = anchor[order], slot[order]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (slot[1:] != slot[:-1])])[: len(order)])
        place = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
        self.held = [c[place < self.k] for c in (anchor, slot, score[order], ids[order])]
        self.rows = len(self.held[0])
        return self.held


def best_of_slots(rows: DataFrame, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
    """anchor_id, slot, score, id: each task's k best of each slot of each anchor. rows: id, label, v; anchors, written: id, label, v, limits.

    Blocks of ANCHORS anchors are broadcast one after the other; each is a pass over the rows.
    """
    blocks = max(1, -(-anchors.count() // ANCHORS))
    dealt, out = anchors.select("id", "label", "v", "limits", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")), None
    for block in range(blocks):
        own = dealt.filter(F.col("block") == block).drop("block").toArrow()  # ANCHORS rows or so
        shared = rows.sparkSession.sparkContext.broadcast(own)
        part = rows.mapInArrow(_scorer(shared, k, same_label), "anchor_id long, slot int, score long, id long")
        out = part if out is None else out.unionByName(part)
    return out


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), length)


def _scorer(shared, k: int, same_label: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.combine_chunks()
        lengths = table.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, np.int64)
        label, own_id = (table.column(c).to_numpy() for c in ("label", "id"))
        limits = table.column("limits").to_pylist()
        # Anchors whose vectors have one length and that have equally many slots are scored together.
        groups: dict[tuple[int, int], list[int]] = {}
        for i, (length, own) in enumerate(zip(lengths.tolist(), limits, strict=True)):
            groups.setdefault((length, len(own)), []).append(i)
        made = []
        for (length, _), own in groups.items():
            numbers = np.array(own)
            made.append((length, numbers, _matrix(table.column("v").combine_chunks().take(pa.array(numbers)), length), np.array([limits[i] for i in own], np.int64)))
        slots = Slots(k)
        for batch in batches:
            batch = batch.sort_by("id") if batch.num_rows else batch
            own_lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0, np.int64)
            for length, numbers, y, bounds in made:
                part = batch.filter(pa.array(own_lengths == length))
                x, ids, labels = _matrix(part.column("v"), length), part.column("id").to_numpy(), part.column("label").to_numpy()
                step = max(1, BLOCK_SCORES // len(numbers))
                for at in range(0, len(ids), step):
                    end = at + step
                    scores = products(x[at:end], y)
                    same = labels[at:end, None] == label[numbers][None]
                    counts = (same if same_label else ~same) & (ids[at:end, None] != own_id[numbers][None])
                    slots.add(np.where(counts, scores, _LEAST), numbers, bounds, ids[at:end])
        anchor, slot, score, ids = slots.cut()
        yield pa.RecordBatch.from_arrays([pa.array(own_id[anchor]), pa.array(slot, pa.int32()), pa.array(score), pa.array(ids)], ["anchor_id", "slot", "score", "id"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def suffix_merges(found: Column, slots: Column, k: int) -> Column:
    """For each slot, the k best of it and all lower ones: merged from the lowest up. found: array of struct(down, id, slot), down = -score."""
    none = F.filter(found, lambda f: F.lit(False))

    def step(done: Column, slot: Column) -> Column:
        below = F.coalesce(F.get(done, F.lit(0)), none)
        merged = F.slice(F.array_sort(F.concat(below, F.filter(found, lambda f: f["slot"] == slot))), 1, k)
        return F.concat(F.array(merged), done)

    return F.aggregate(F.sequence(slots - 1, F.lit(0), F.lit(-1)), F.filter(F.array(found), lambda f: F.lit(False)), step)


def mine(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES, k: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchors: which rows (a condition on id_col) are anchors."""
    rows = usable(vectors, id_col, label_col, vector_col, scale)
    once = usable(vectors.filter(anchors), id_col, label_col, vector_col, scale).groupBy("id").agg(F.min(F.struct("v", "label")).alias("own"))
    # One slot, of all scores, for the positives.
    every = F.array(F.lit((1 << 63) - 1), F.lit(-(1 << 63)))
    asked = written(once.select("id", "own.label", "own.v", every.alias("limits")))
    best = _best(best_of_slots(rows, asked, positives, True), positives).filter("score >= 0")
    best = written(best.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.expr(f"score * {high} div 100").alias("upper")))
    least = F.expr(f"min((positive_score * {low} + 99) div 100) - 1")
    cuts = best.groupBy("anchor_id").agg(F.reverse(F.array_sort(F.collect_set("upper"))).alias("uppers"), least.alias("least"))
    limited = asked.drop("limits").join(cuts, asked["id"] == cuts["anchor_id"]).select("id", "label", "v", F.concat("uppers", F.array("least")).alias("limits"))
    found = _best(best_of_slots(rows, written(limited), k, False), k)
    gathered = found.groupBy("anchor_id").agg(F.collect_list(F.struct(F.negative("score").alias("down"), "id", "slot")).alias("found"))  # k rows a slot
    merged = gathered.join(cuts.select("anchor_id", "uppers"), "anchor_id").select("anchor_id", "uppers", suffix_merges(F.col("found"), F.size("uppers"), k).alias("merges"))
    pairs = best.join(merged, "anchor_id").select("anchor_id", "positive_id", "positive_score", F.element_at("merges", F.array_position("uppers", F.col("upper")).cast("int")).alias("near"))
    inside = F.filter("near", lambda f: F.lit(-100) * f["down"] >= F.lit(low) * F.col("positive_score"))
    out = pairs.select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "n"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.negative("n.down").alias("negative_score"))
