"""Approximate nearest rows by cosine: inverted lists of product-quantized vectors, exact scores for a fixed number of rows a query.

Rows move as a list number and one byte for each PART components; vectors are read again for RERANK rows of a query, however
large the table. Copies of a vector are one row with its smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import Best, finite, top_k, vector_search
from .storage import stored

#: What the lists and the code books are fitted on at most: rows, and bytes of single precision.
FIT_ROWS, FIT_BYTES = 32_768, 64 << 20
#: Lists at most (the square root of the rows below that), components of a part, code words of a part, rounds of k-means.
MOST_LISTS, PART, WORDS, ROUNDS = 4_096, 2, 256, 8
#: Vectors of a query that are scored exactly, and the lists whose rows bound what further lists give, in multiples of that.
RERANK, BOUND = 64, 4
#: Rows that are asked to find how many lists a query visits, and the share of their neighbours that lies in those.
CALIBRATION_ROWS, LIST_RECALL = 200, 0.97
#: Rows and queries of a list in one task.
MEET_ROWS, MEET_QUERIES = 4_096, 512
#: Distances computed at a time.
BLOCK = 1 << 22


def closest(x: np.ndarray, centres: np.ndarray, count: int = 1) -> np.ndarray:
    """rows x count: the nearest centres by Euclidean distance, nearest first, ties to the smaller number."""
    out = np.empty((len(x), count), np.int32)
    half = (centres**2).sum(1) / 2
    step = max(1, BLOCK // len(centres))
    for at in range(0, len(x), step):
        far = half - x[at : at + step] @ centres.T
        out[at : at + step] = far.argmin(1)[:, None] if count == 1 else far.argsort(1, kind="stable")[:, :count]
    return out


def k_means(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """k centres at most, begun at rows drawn without repeats; a centre without rows stays where it was."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = closest(x, centres)[:, 0]
        size = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, d], len(centres)) for d in range(x.shape[1])], 1)
        centres[size > 0] = (sums / np.maximum(size, 1)[:, None])[size > 0]
    return centres


@dataclass
class Quantizer:
    """Centres of the lists, and a book of code words for each part of what is left of a row without its centre."""

    centres: np.ndarray
    books: list[np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list of each row, rows x parts bytes)."""
        own = closest(x, self.centres)[:, 0]
        rest = x - self.centres[own]
        codes = [closest(rest[:, j * PART : (j + 1) * PART], book)[:, 0] for j, book in enumerate(self.books)]
        return own, np.stack(codes, 1).astype(np.uint8)

    def decode(self, own: int, codes: np.ndarray) -> np.ndarray:
        """The rows of one list, as far as their codes tell."""
        return self.centres[own] + np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], 1)


def fitted(sample: np.ndarray, lists: int) -> Quantizer:
    centres = k_means(sample, lists)
    rest = sample - centres[closest(sample, centres)[:, 0]]
    return Quantizer(centres, [k_means(rest[:, at : at + PART], WORDS) for at in range(0, sample.shape[1], PART)])


def _units(column: pa.Array, rows: int, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(rows, dim)
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def _usable(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return rows.filter(F.col("id").isNotNull() & (F.size("v") == dim) & finite("v")).filter((length > 0) & (length < float("inf")))


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """key, v, ids: each vector once, with its `ids` smallest ids in order. Copies are reduced in the tasks that read them."""
    number = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.distinct().withColumn("__n", number).filter(F.col("__n") <= ids)
    once = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return once.select(F.xxhash64("v").alias("key"), "v", "ids")


def _sample(rows: DataFrame, count: int, most: int, seed: int) -> DataFrame:
    """`most` rows or somewhat fewer, those with the lowest hashes; few more are sorted."""
    order = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 31))
    share = min(1.0, 1.25 * most / max(count, 1)) + 20.0 / max(count, 1)
    return rows.withColumn("__o", order).filter(F.col("__o") < int(min(1.0, share) * (1 << 31))).orderBy("__o", "key").limit(most).drop("__o")


def visited_lists(rows: DataFrame, count: int, dim: int, k: int, quantizer: Quantizer, recall: float = LIST_RECALL) -> int:
    """The fewest lists, nearest first, that hold `recall` of the true neighbours of CALIBRATION_ROWS rows."""
    some = stored(_sample(rows, count, CALIBRATION_ROWS, 1).select(F.col("key").alias("query_id"), F.lit("all").alias("project_id"), F.col("v").alias("vector")))
    near = vector_search(rows.select(F.lit("all").alias("project_id"), F.col("key").alias("chunk_id"), F.col("v").alias("embedding")), some, k + 1)
    near = near.filter(F.col("chunk_id") != F.col("query_id")).select("query_id", "chunk_id")
    pairs = near.join(some, "query_id").join(rows.select(F.col("key").alias("chunk_id"), "v"), "chunk_id").select("vector", "v").toArrow()  # k a calibration row
    if not pairs.num_rows:
        return len(quantizer.centres)
    q, x = (_units(pairs.column(c).combine_chunks(), pairs.num_rows, dim) for c in ("vector", "v"))
    at = (closest(q, quantizer.centres, len(quantizer.centres)) == closest(x, quantizer.centres)).argmax(1)
    return int(np.sort(at)[max(0, int(np.ceil(recall * len(at))) - 1)]) + 1


def quantized_search(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, dim: int, k: int = 10, rerank: int = RERANK, visits: int | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: the k best rows by exact cosine (six digits, ties to the smaller id) of the `rerank` vectors
    whose codes come nearest to the query's, in the lists that it visits. Both tables: id_col, vector_col.

    visits: calibrated to LIST_RECALL unless given. Rows of another length, without id, zero, or with null or non-finite parts
    take no part, on either side; no row is its own neighbour; an id that several rows have counts once, at its best score;
    queries that share an id ask together. rerank must exceed k.
    """
    if rerank <= k:
        raise ValueError("rerank must exceed k")
    candidates, classes, asked = quantized_candidates(vectors, queries, id_col, vector_col, dim, k, rerank, visits)
    return exact_top(candidates, classes, asked, dim, k)


def quantized_candidates(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, dim: int, k: int = 10, rerank: int = RERANK, visits: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(query_id, key of the vectors to be scored; key, v, ids; id, v of the queries)."""
    spark = vectors.sparkSession
    classes = stored(distinct_vectors(_usable(vectors, id_col, vector_col, dim), k + 1))
    asked = stored(_usable(queries, id_col, vector_col, dim).distinct())
    count = classes.count()
    fit_on = _sample(classes, count, max(1, min(FIT_ROWS, FIT_BYTES // (4 * dim))), 0).select("v").toArrow()
    if not fit_on.num_rows:
        return asked.select(F.col("id").alias("query_id"), F.lit(0).cast("long").alias("key")).limit(0), classes, asked
    quantizer = fitted(_units(fit_on.column("v").combine_chunks(), fit_on.num_rows, dim), min(MOST_LISTS, max(1, round(count**0.5))))
    lists = len(quantizer.centres)
    visits = min(lists, visits or visited_lists(classes, count, dim, k, quantizer))
    shared = spark.sparkContext.broadcast(quantizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, codes = shared.value.encode(_units(batch.column("v"), batch.num_rows, dim))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(own), pa.array([c.tobytes() for c in codes], pa.binary())], ["key", "list", "code"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _units(batch.column("v"), batch.num_rows, dim)
            near = closest(x, shared.value.centres, visits)
            of = lambda a, width: pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * width, a.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("id"), of(x, dim), of(near, visits)], ["id", "v", "lists"])

    id_kind = asked.schema["id"].dataType.simpleString()
    coded = stored(classes.select("key", "v").mapInArrow(encode, "key bigint, list int, code binary"))
    wanted = stored(asked.mapInArrow(visit, f"id {id_kind}, v array<float>, lists array<int>")).select("id", "v", F.posexplode("lists").alias("at", "list"))
    first_lists = min(visits, max(1, int(np.ceil(BOUND * rerank * lists / count))))
    none = F.lit(float("-inf"))
    found = _best_of_lists(coded, wanted.filter(F.col("at") < first_lists).withColumn("least", none), shared, rerank)
    if first_lists < visits:
        # What the first lists give bounds what the others do.
        found = stored(found)
        floors = found.groupBy("id").agg(F.when(F.count(F.lit(1)) >= rerank, F.min("score")).alias("least"))
        later = wanted.filter(F.col("at") >= first_lists).join(floors, "id", "left").withColumn("least", F.coalesce("least", none))
        found = _first(found.unionByName(_best_of_lists(coded, later, shared, rerank)), rerank)
    return stored(found.select(F.col("id").alias("query_id"), "key")), classes, asked


def _first(found: DataFrame, rerank: int) -> DataFrame:
    """id, key, score: the `rerank` best vectors of each query."""
    once = found.groupBy("id", "key").agg(F.max("score").alias("score"))
    number = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "key"))
    return once.withColumn("__n", number).filter(F.col("__n") <= rerank).drop("__n")


def _best_of_lists(coded: DataFrame, wanted: DataFrame, shared, rerank: int) -> DataFrame:
    """id, key, score (by the codes): the `rerank` best vectors of each query, at `least` or above, in its lists.

    Rows and queries meet by list, both cut into blocks, so that a list of any size is dealt over many tasks. A block's
    codes are looked up in the books once for all its queries. coded: key, list, code; wanted: id, v, list, least.
    """
    sizes = coded.groupBy("list").agg(F.count(F.lit(1)).alias("rows")).join(wanted.groupBy("list").agg(F.count(F.lit(1)).alias("asked")), "list")
    cuts = F.broadcast(sizes.select("list", F.ceil(F.col("rows") / MEET_ROWS).cast("int").alias("rbs"), F.ceil(F.col("asked") / MEET_QUERIES).cast("int").alias("qbs")))  # MOST_LISTS rows
    part = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = coded.join(cuts, "list").select("key", "code", "list", part("key", F.col("rbs")).alias("rb"), every("qbs").alias("qb"))
    asked = wanted.join(cuts, "list").select("id", "v", "least", "list", every("rbs").alias("rb"), part("id", F.col("qbs")).alias("qb"))

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        best = Best(queries.num_rows, rerank, pa.int64())
        if rows.num_rows and queries.num_rows:
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            x = shared.value.decode(rows.column("list")[0].as_py(), codes)
            q = queries.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(queries.num_rows, -1)
            best.floor = queries.column("least").to_numpy().copy()
            scores = (x @ q.T).astype(np.float64)
            best.add(scores, np.ones(scores.shape, bool), np.arange(len(q)), rows.column("key").combine_chunks())
        out = best.cut()
        return pa.table({"id": queries.column("id").combine_chunks().take(out.column("q").combine_chunks()), "key": out.column("id"), "score": out.column("score")})

    kind = f"id {wanted.schema['id'].dataType.simpleString()}, key bigint, score double"
    return _first(held.groupBy("list", "rb", "qb").cogroup(asked.groupBy("list", "rb", "qb")).applyInArrow(meet, kind), rerank)


def exact_top(candidates: DataFrame, classes: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank from exact cosines of the candidates."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, q = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim) for c in ("v", "q"))
            found = (x * q).sum(1) / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(q, axis=1), 1e-300)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("ids"), pa.array(np.copysign(np.floor(np.abs(found) * 1e6 + 0.5) / 1e6, found))], ["query_id", "ids", "score"])

    kinds = f"query_id {asked.schema['id'].dataType.simpleString()}, ids {classes.schema['ids'].dataType.simpleString()}, score double"
    pairs = candidates.join(classes, "key").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    scored = pairs.select("query_id", "ids", "v", "q").mapInArrow(score, kinds).select("query_id", F.explode("ids").alias("chunk_id"), "score")
    once = scored.filter(F.col("chunk_id") != F.col("query_id")).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return top_k(once.withColumn("score", F.round("score", 6)), k)
