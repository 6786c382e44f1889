"""Approximate nearest neighbours: hierarchical k-means tree with best-bin-first search.

The tree's centres are fitted on a bounded sample (FIT_ROWS, by the hash of id and vector); every row is then put into a
leaf by walking down to the nearest child. A leaf of more than SPLIT_ROWS rows gets a tree of its own below it, fitted where
its sample meets (one task a leaf, about FIT_ROWS rows at most), and so on, so leaves stay small in tables of any size; only
the top tree is broadcast, the trees below are a table that rows and queries meet by leaf. A leaf that cannot be split
(copies of one vector) stays whole.

A query's search keeps the tree's nodes that it has met in a priority queue by distance to their centres, opens the nearest
first, and lists leaves until enough are visited. Through several levels a node's place in that order is the greatest
distance on the way to it, as it is in one queue over all levels; each tree gives its first `beam` leaves. How many visits
are enough is calibrated: for a bounded set of rows the true neighbours are found by scanning all rows, and beam and leaf
visits are widened until the wanted share of those neighbours lies in visited leaves.

Queries and rows meet by leaf. Leaves are cut into blocks of rows and blocks of queries, so a leaf of any size, and a
vector of any number of copies, is dealt out over many tasks; each gives its queries' nearest, and the nearest of those
remain. A query's first leaves are looked at before the others: a later leaf gives only what is no farther than the k-th
row found by then.

Defined results: vectors that are null, all zero, of another length than most, or hold null or non-finite parts take no
part, nor do rows without id. Distances are Euclidean, in double precision; ties go to the smaller id; repeated ids are
candidates as often as they occur, never of their own query, and one query (the smallest of their vectors). With fewer
than k candidates all are found. Empty tables give empty results. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import lowest_hashes, written

FIT_ROWS, BRANCHES, LEAF_ROWS, MOST_LEAVES = 16_384, 8, 200, 1_024
CALIBRATION_ROWS, RECALL = 200, 0.97
BLOCK_ROWS, BLOCK_QUERIES = 2_048, 256
#: A leaf above SPLIT_ROWS gets a tree below it; LEAF_BITS number a tree's leaves, fewer than its sample's rows.
SPLIT_ROWS, LEAF_BITS, MOST_LEVELS = 4_096, 15, 4
#: Rows of one leaf that meet its tree in one task; the widest beam exceeds the leaves of any tree.
WALK_ROWS, FIRST_BEAM, WIDEST_BEAM = 16_384, 16, 1 << LEAF_BITS
#: Rows up to which a table of one row per leaf is broadcast (some 50 MB); beyond, it is joined by shuffle.
BROADCAST_LEAVES = 1_000_000
#: Leaves that a query visits first; what it finds there bounds what later leaves give.
FIRST_LEAVES = 2


@dataclass
class Tree:
    """children[i]: node numbers below node i, none for a leaf; centres[i]: its centre; leaf[i]: number among leaves, or -1."""

    children: list[list[int]]
    centres: np.ndarray
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf[node]
                continue
            nearest = squared(x[rows], self.centres[below]).argmin(1)
            todo += [(c, rows[nearest == k]) for k, c in enumerate(below) if (nearest == k).any()]
        return out

    def visits(self, q: np.ndarray, least: int, sizes: np.ndarray, rows: int) -> list[int]:
        """Leaves in best-bin-first order: at least `least`, and until they hold `rows` rows."""
        return [leaf for _, leaf in self.walk(q, least, sizes, rows)]

    def walk(self, q: np.ndarray, least: int, sizes: np.ndarray, rows: int) -> list[tuple[float, int]]:
        """(greatest squared distance opened so far, leaf), in the order of visits."""
        queue, found, held, far = [(0.0, 0)], [], 0, 0.0
        while queue and (len(found) < least or held < rows):
            d, node = heapq.heappop(queue)
            far, below = max(far, d), self.children[node]
            if below:
                for c, d in zip(below, ((self.centres[below] - q) ** 2).sum(1).tolist(), strict=True):
                    heapq.heappush(queue, (d, c))
            else:
                found.append((far, self.leaf[node]))
                held += int(sizes[self.leaf[node]])
        return found


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None], 0)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centres that have rows, centre of each row)."""
    centres = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(rounds):
        near = squared(x, centres).argmin(1)
        used = np.unique(near)
        centres = np.stack([x[near == c].mean(0) for c in used])
    return centres, squared(x, centres).argmin(1)


def fit_tree(x: np.ndarray, leaf_rows: int, branches: int = BRANCHES, seed: int = 7) -> Tree:
    rng = np.random.default_rng(seed)
    children, centres, leaf, todo, leaves = [[]], [x.mean(0)], [-1], [(0, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop(0)
        if len(rows) > leaf_rows:
            middle, near = k_means(x[rows], branches, rng)
            if len(np.unique(near)) > 1:
                for c in np.unique(near):
                    children[node].append(len(children))
                    children.append([])
                    centres.append(middle[c])
                    leaf.append(-1)
                    todo.append((len(children) - 1, rows[near == c]))
                continue
        leaf[node] = leaves
        leaves += 1
    return Tree(children, np.stack(centres), leaf)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long vectors without nulls as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: the rows that take part."""
    v = F.col("v")
    good = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, _finite) & F.exists(v, lambda x: x != 0))
    common = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.filter(F.size("v") == (common.d if common else 0))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def nearest_in(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, most: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's row, rows of x, exact distances): its k nearest in x, no farther than `most`, by distance and id. A product finds who may be near; differences decide."""
    rough = squared(q, x)
    for i in range(len(q)):
        row = np.where(x_ids == q_ids[i], np.inf, rough[i])
        bound = 0 if not len(row) else np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1]
        if most is not None:
            bound = min(bound, most[i] ** 2)
        slack = 1e-9 * (1 + (q[i] * q[i]).sum() + (0 if np.isinf(bound) else bound))
        rows = np.flatnonzero((row <= bound + slack) & np.isfinite(row))
        exact = np.sqrt(((x[rows] - q[i]) ** 2).sum(1))
        if most is not None:
            rows, exact = rows[exact <= most[i]], exact[exact <= most[i]]
        order = np.lexsort((x_ids[rows], exact))[:k]
        yield i, rows[order], exact[order]


def beside(table: DataFrame) -> DataFrame:
    """A table of one row per leaf, to be joined: broadcast up to BROADCAST_LEAVES rows."""
    table = written(table)
    return F.broadcast(table) if table.count() <= BROADCAST_LEAVES else table


class TreeIndex:
    """A fitted tree, the trees below its leaves, the table of all rows with their leaves, and the number of leaves to visit.

    rows: id, v, leaf. A leaf's number is its parent's, LEAF_BITS to the left, and its own in its tree, from 1.
    below: by level, tables of leaf, tree (pickled), sizes (rows of each of the tree's leaves).
    """

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, recall: float = RECALL, split_rows: int = SPLIT_ROWS, most_leaves: int = MOST_LEAVES):
        self.id_col, self.k, self.split_rows = id_col, k, split_rows
        rows = written(usable(vectors, id_col, vector_col).withColumn("id", F.col("id").cast("long")))
        self.spark, self.rows, self.count = rows.sparkSession, rows, rows.count()
        self.tree, self.visits, self.measured, self.beam, self.below = None, 0, None, 0, []
        if self.count:
            sample = self._some(rows, FIT_ROWS, 1)
            leaves = min(most_leaves, max(1, self.count // LEAF_ROWS))
            self.tree = fit_tree(np.array([r.v for r in sample]), max(4, len(sample) // leaves))
            tree = self.spark.sparkContext.broadcast(self.tree)

            def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    leaf = tree.value.assign(matrix(batch.column("v"))).astype(np.int64) + 1
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(leaf)], ["id", "v", "leaf"])

            self.rows = written(rows.mapInArrow(assign, "id long, v array<double>, leaf long"))
            self.sizes = np.zeros(self.tree.leaves, np.int64)
            for r in self.rows.groupBy("leaf").count().collect():  # one row per leaf of the top tree
                self.sizes[r["leaf"] - 1] = r["count"]
            self._deepen()
            self._calibrate(recall)

    def _some(self, rows: DataFrame, n: int, seed: int) -> list:
        """The n rows with the lowest hashes of id and vector (all, if there are fewer), in order of id."""
        return sorted(lowest_hashes(rows, n, ["id", "v"], seed, self.count).collect(), key=lambda r: (r.id, r.v))

    def _deepen(self) -> None:
        """Trees below large leaves, level by level."""
        for level in range(MOST_LEVELS - 1):
            # Leaves of earlier levels that are still large couldn't be split.
            newest = self.rows.filter(F.col("leaf") >= 1 << LEAF_BITS * level)
            large = written(newest.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > self.split_rows))
            if large.isEmpty():
                return
            trees = written(self._fit_below(large))
            if trees.isEmpty():
                return

            def assign(rows: pa.Table, tree: pa.Table) -> pa.Table:
                if not len(rows) or not len(tree):
                    return rows.select(["id", "v", "leaf"]).slice(0, 0)
                own = pickle.loads(tree.column("tree")[0].as_py())
                leaf = own.assign(matrix(rows.column("v").combine_chunks())).astype(np.int64) + 1
                leaf += rows.column("leaf").to_numpy() << LEAF_BITS
                return pa.table({"id": rows.column("id"), "v": rows.column("v"), "leaf": pa.array(leaf)})

            moved = self._through(self.rows, trees, assign, "id long, v array<double>, leaf long")
            stayed = self.rows.join(beside(trees.select("leaf")), "leaf", "left_anti").select("id", "v", "leaf")
            self.rows = written(stayed.unionByName(moved))
            # At most 2^LEAF_BITS numbers a tree.
            own = F.struct((F.col("leaf").bitwiseAND((1 << LEAF_BITS) - 1) - 1).alias("own"), F.col("n"))
            counts = self.rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
            sizes = counts.groupBy(F.shiftright("leaf", LEAF_BITS).alias("leaf")).agg(F.collect_list(own).alias("sizes"))
            self.below.append(written(trees.join(sizes, "leaf")))

    def _fit_below(self, large: DataFrame) -> DataFrame:
        """leaf, tree: for each large leaf that can be split. large: leaf, n."""
        leaves = F.least(F.lit(MOST_LEAVES), F.ceil(F.col("n") / LEAF_ROWS))
        share = F.least(F.lit(1.0), F.least(F.lit(FIT_ROWS), leaves * (FIT_ROWS // MOST_LEAVES)) / F.col("n"))
        wanted = beside(large.select("leaf", share.alias("share"), leaves.alias("leaves")))
        # About FIT_ROWS different rows of a leaf at most, by their hashes.
        hashed = self.rows.join(wanted, "leaf").withColumn("h", F.xxhash64(F.lit(3), "id", "v"))
        some = hashed.filter(F.col("h").bitwiseAND((1 << 63) - 1) < F.col("share") * float(1 << 63)).dropDuplicates(["leaf", "h", "id", "v"])

        def fit(sample: pa.Table) -> pa.Table:
            sample = sample.sort_by([("h", "ascending"), ("id", "ascending")])
            x, leaf = matrix(sample.column("v").combine_chunks()), sample.column("leaf")[0].as_py()
            tree = fit_tree(x, max(4, len(x) // sample.column("leaves")[0].as_py()))
            found = [(leaf, pickle.dumps(tree))] if tree.leaves > 1 else []
            return pa.table({"leaf": pa.array([a for a, _ in found], pa.int64()), "tree": pa.array([b for _, b in found], pa.binary())})

        return some.groupBy("leaf").applyInArrow(fit, "leaf long, tree binary")

    def _through(self, rows: DataFrame, trees: DataFrame, step, schema: str) -> DataFrame:
        """step(rows, tree) over the rows whose leaf has a tree, at most about WALK_ROWS rows of a leaf in a task."""
        sizes = rows.groupBy("leaf").count().join(trees.select("leaf"), "leaf")
        cuts = beside(sizes.select("leaf", F.ceil(F.col("count") / WALK_ROWS).cast("int").alias("cuts")))
        left = rows.join(cuts, "leaf").withColumn("block", F.pmod(F.xxhash64("id", "v"), "cuts").cast("int")).drop("cuts")
        right = trees.join(cuts, "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")
        return left.groupBy("leaf", "block").cogroup(right.groupBy("leaf", "block")).applyInArrow(step, schema)

    def _walk(self, asked: DataFrame, least: int, beam: int) -> DataFrame:
        """id, v, leaf, turn: each query's first leaves, `least` of them and more until they hold k rows besides its own.

        asked: id (not repeated), v; written. Each tree on the way gives its first `beam` leaves.
        """
        tree, sizes, k = self.spark.sparkContext.broadcast(self.tree), self.sizes, self.k
        top = beam if self.below else least

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [tree.value.walk(q, top, sizes, k + 1) for q in matrix(batch.column("v"))]
                met = [[{"far": far, "leaf": leaf + 1, "held": int(sizes[leaf])} for far, leaf in own] for own in found]
                kind = pa.list_(pa.struct([("far", pa.float64()), ("leaf", pa.int64()), ("held", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(met, kind)], ["id", "v", "met"])

        walked = asked.mapInArrow(walk, "id long, v array<double>, met array<struct<far: double, leaf: long, held: long>>")
        found = walked.select("id", "v", F.posexplode("met").alias("turn", "met")).select("id", "v", "turn", "met.*")
        if not self.below:
            return found.select("id", "v", "leaf", "turn")

        def descend(rows: pa.Table, tree: pa.Table) -> pa.Table:
            found = []
            if len(rows) and len(tree):
                own = pickle.loads(tree.column("tree")[0].as_py())
                inside = np.zeros(own.leaves, np.int64)
                for s in tree.column("sizes")[0].as_py():
                    inside[s["own"]] = s["n"]
                queries = zip(rows.column("id").to_pylist(), rows.column("far").to_pylist(), matrix(rows.column("v").combine_chunks()), strict=True)
                above = rows.column("leaf")[0].as_py() << LEAF_BITS
                for i, far, q in queries:
                    for turn, (d, leaf) in enumerate(own.walk(q, beam, inside, k + 1)):
                        found.append((i, turn, max(far, d), above + leaf + 1, int(inside[leaf])))
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            return pa.table({n: pa.array(c, t) for n, c, t in zip(("id", "turn", "far", "leaf", "held"), columns, kinds, strict=True)})

        order = Window.partitionBy("id").orderBy("far", "turn", "leaf")
        before = F.coalesce(F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = found.drop("v")
        for level, trees in enumerate(self.below):
            met = written(found)
            inner = met.join(asked, "id")
            schema = "id long, turn int, far double, leaf long, held long"
            outer = met.join(beside(trees.select("leaf")), "leaf", "left_anti").select("id", "turn", "far", "leaf", "held")
            found = outer.unionByName(self._through(inner, trees, descend, schema))
            most = least if level == len(self.below) - 1 else beam
            ranked = found.withColumn("at", F.row_number().over(order) - 1).withColumn("before", before)
            found = ranked.filter((F.col("at") < most) | (F.col("before") <= k)).select("id", F.col("at").alias("turn"), "far", "leaf", "held")
        return found.join(asked, "id").select("id", "v", "leaf", "turn")

    def _calibrate(self, recall: float) -> None:
        """True neighbours of a bounded set of rows, from a scan of all rows in blocks; then the fewest leaf visits that reach the recall."""
        own = self._some(self.rows.select("id", "v"), CALIBRATION_ROWS, 2)
        q, q_ids, k = np.array([r.v for r in own]), np.array([r.id for r in own]), self.k

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x_ids, leaf = batch.column("id").to_numpy(), batch.column("leaf").to_numpy()
                found = [(i, leaf[r], d) for i, r, d in nearest_in(q, q_ids, matrix(batch.column("v")), x_ids, k)]
                of = np.repeat([i for i, _, _ in found], [len(d) for _, _, d in found])
                columns = [of, np.concatenate([a for _, a, _ in found]), np.concatenate([d for _, _, d in found])]
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["q", "leaf", "score"])

        near = self.rows.mapInArrow(scan, "q long, leaf long, score double")
        nearest = F.row_number().over(Window.partitionBy("q").orderBy("score", "leaf"))
        true = written(near.withColumn("rank", nearest).filter(F.col("rank") <= k).select("q", "leaf"))
        asked = written(self.spark.createDataFrame([(i, r.v) for i, r in enumerate(own)], "id long, v array<double>"))
        self.beam = FIRST_BEAM if self.below else self.tree.leaves
        while True:
            met = self._walk(asked, self.beam, self.beam).select(F.col("id").alias("q"), "leaf", "turn")
            turns = [r.turn for r in true.join(met, ["q", "leaf"], "left").select("turn").collect()]  # k a calibration row
            needed = np.sort([np.inf if t is None else t + 1.0 for t in turns])
            wanted = needed[max(0, int(np.ceil(recall * len(needed))) - 1)] if len(needed) else self.beam
            if np.isfinite(wanted) or self.beam >= WIDEST_BEAM:
                break
            self.beam *= 2
        self.visits = int(wanted) if np.isfinite(wanted) else self.beam
        self.measured = float((needed <= self.visits).mean()) if len(needed) else 1.0

    def search(self, queries: DataFrame, id_col: str | None = None, vector_col: str = "embedding") -> DataFrame:
        """query_id, rank, id (under the index's name), score: each query's k nearest found."""
        id_col, k = id_col or self.id_col, self.k
        out = f"query_id long, {self.id_col} long, score double"
        if not self.count:
            return self.spark.createDataFrame([], T._parse_datatype_string(out)).selectExpr("query_id", "1 AS rank", self.id_col, "score")
        asked = usable(queries, id_col, vector_col).groupBy(F.col("id").cast("long").alias("id")).agg(F.min("v").alias("v"))
        asked = asked.filter(F.size("v") == self.tree.centres.shape[1])
        visiting = written(self._walk(written(asked) if self.below else asked, self.visits, self.beam))
        first = written(self._top(self._meet(visiting.filter(F.col("turn") < FIRST_LEAVES).withColumn("most", F.lit(float("inf"))))))
        bounds = first.groupBy(F.col("query_id").alias("of")).agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("most"))
        later = visiting.filter(F.col("turn") >= FIRST_LEAVES).join(bounds, F.col("id") == F.col("of"), "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
        return self._top(first.drop("rank").unionByName(self._meet(written(later)))).select("query_id", "rank", self.id_col, "score")

    def _top(self, found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy("score", self.id_col)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.k)

    def _meet(self, visiting: DataFrame) -> DataFrame:
        """query_id, id, score: of every visited leaf, the query's nearest in each block. visiting: id, v, leaf, most."""
        k, name = self.k, self.id_col
        # One row per leaf: into how many blocks its rows and its queries are cut.
        cuts = visiting.groupBy("leaf").count().join(self.rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows")), "leaf")
        rbs, qbs = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int"), F.ceil(F.col("count") / BLOCK_QUERIES).cast("int")
        cuts = beside(cuts.select("leaf", rbs.alias("rbs"), qbs.alias("qbs")))
        left = self.rows.join(cuts, "leaf").select("id", "v", "leaf", F.pmod(F.xxhash64("id", "v"), "rbs").cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)).alias("qb"))
        right = visiting.join(cuts, "leaf").select("id", "v", "most", "leaf", F.explode(F.sequence(F.lit(0), F.col("rbs") - 1)).alias("rb"), F.pmod(F.xxhash64("id"), "qbs").cast("int").alias("qb"))

        def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
            ids, q_ids = rows.column("id").to_numpy(), asked.column("id").to_numpy()
            found = list(nearest_in(matrix(asked.column("v").combine_chunks()), q_ids, matrix(rows.column("v").combine_chunks()), ids, k, asked.column("most").to_numpy())) if len(ids) and len(q_ids) else []
            columns = [np.repeat([q_ids[i] for i, _, _ in found], [len(d) for _, _, d in found]), np.concatenate([ids[r] for _, r, _ in found] or [[]]), np.concatenate([d for _, _, d in found] or [[]])]
            return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", name, "score"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

        return left.groupBy("leaf", "rb", "qb").cogroup(right.groupBy("leaf", "rb", "qb")).applyInArrow(meet, f"query_id long, {name} long, score double")
