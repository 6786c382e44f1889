"""Near-duplicates by HyperMinHash: compressed registers, bands of registers, corrected estimates, exact verification.

A text's set is its distinct shingles of words. Each of 128 registers keeps the smallest hash that falls into its bucket,
compressed to 5 bits of leading-zero count and 9 bits of mantissa, besides 2 bits that say in which round the bucket got
its hash: buckets left empty are filled by hashing the set anew, so that small sets fill all registers, and two sets
agree in a register with a probability of their Jaccard similarity.

1. Texts with equal sets form a class; only classes go on.
2. 32 bands of 4 registers: classes that share a band meet in its bucket. At similarity 0.8 two sets share none with
   probability 4e-8. Buckets with the same members in several bands are looked at once.
3. In a bucket, registers are compared. A pair goes on if its estimate, corrected for registers that agree by chance of
   compression, isn't more than five deviations below the threshold. A spanning forest of these pairs leaves the task.
4. The forests' components are the candidate groups: every link is inside one. Full sets of their members are made from
   the texts again and compared exactly; again only forests leave.
5. Components of the verified links, and the smallest id in each.

Buckets and groups beyond one block (of members, for groups also of shingles) are compared within chunks that share some
hub members; then members outside the main component, if any, are compared with all others (in_blocks). Near-copies of
one text thus cost a constant number of blocks each, however many they are. What stays quadratic is a bucket or group
of more than a block whose members are mostly not linked to each other.

No task holds more than two chunks of a bucket or group; no pairs are listed; nothing of the corpus goes to the driver.

Defined results: null and empty texts have empty sets and are linked with nothing; texts with fewer words than a shingle
have the whole sequence as their one shingle; rows with one id are rows of their own and may be linked to each other;
rows without id belong to groups but never name them (a group of such rows alone has a null name, and all its rows are
kept); empty tables give empty results. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .components import Sets, components, grouped
from .shared import slices, texts_of, written

SHINGLE, LEAST_PERCENT = 4, 80
REGISTERS, BANDS = 128, 32
ZEROS, MANTISSA, ROUNDS = 5, 9, 3
#: Members of a bucket, and of a candidate group, that one side of a block holds.
BUCKET_BLOCK, GROUP_BLOCK, HUBS = 512, 256, 16
#: Shingles of all sets on one side of a block, on average (8 bytes each); a longer set is there alone or with few others.
BLOCK_SHINGLES = 1 << 20
#: A table of candidate members is broadcast up to so many rows (16 bytes each); beyond, Spark joins it by shuffling.
BROADCAST_ROWS = 500_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """The set of each text: sorted distinct 64-bit hashes of its shingles. Words are lower-cased in A-Z only."""
    split = [t.lower().split() for t in texts]
    ends = np.cumsum([len(w) for w in split], dtype=np.int64)
    coded = pa.array([w for own in split for w in own], pa.large_binary()).dictionary_encode()
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(coded.dictionary))
    word = word[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    n = max(0, len(word) - shingle + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(shingle):
        rolled = mixed(rolled + word[k : k + n] + np.uint64(k + 1))
    for own, end in zip(split, ends.tolist(), strict=True):
        if not own:
            yield np.zeros(0, np.uint64)
        elif len(own) < shingle:
            yield np.array([xxhash.xxh3_64_intdigest(b"\n".join(own), seed=len(own))], np.uint64)
        else:
            yield np.unique(rolled[end - len(own) : end - shingle + 1])


_BOUNDS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(57)
_SEEDS = mixed(np.arange(1, REGISTERS + ROUNDS + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def registers(own: np.ndarray) -> np.ndarray:
    """The compressed registers of a non-empty set."""
    out = np.zeros(REGISTERS, np.uint16)
    empty = np.arange(REGISTERS)
    for turn in range(ROUNDS):
        hashes = np.sort(mixed(own ^ _SEEDS[turn]))
        first = np.searchsorted(hashes, _BOUNDS[empty])
        inside = np.minimum(first, len(hashes) - 1)
        hit = (first < len(hashes)) & (hashes[inside] >> np.uint64(57) == empty.astype(np.uint64))
        out[empty[hit]] = compressed(hashes[inside[hit]] << np.uint64(7), turn)
        empty = empty[~hit]
        if not len(empty):
            return out
    # What is still empty takes the smallest of a hash of its own.
    least = np.array([mixed(own ^ _SEEDS[ROUNDS + 1 + e]).min() for e in empty], np.uint64)
    out[empty] = compressed(least, ROUNDS)
    return out


def compressed(values: np.ndarray, turn: int) -> np.ndarray:
    """Round, leading zeros (31 at most) and the bits after the first one."""
    top = np.floor(np.log2(np.maximum(values >> np.uint64(11), 1).astype(np.float64))).astype(np.int64)
    zeros = np.minimum(52 - top, (1 << ZEROS) - 1)
    shifted = values << (zeros + 1).astype(np.uint64)
    return ((turn << (ZEROS + MANTISSA)) | (zeros << MANTISSA) | (shifted >> np.uint64(64 - MANTISSA)).astype(np.int64)).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One number for each row of registers and band."""
    wide = np.ascontiguousarray(regs).view(np.uint64).reshape(len(regs), BANDS)
    return mixed(mixed(wide) + _SEEDS[:BANDS][None]).view(np.int64)


def chance(sizes: np.ndarray) -> np.ndarray:
    """For sets of these sizes, the chance that registers of two different smallest hashes agree: same zeros, same mantissa."""
    rate = np.maximum(sizes / REGISTERS, 1.0)[:, None]
    edges = 2.0 ** -np.arange(0, 33)[None]
    share = np.exp(-rate * edges[:, 1:]) - np.exp(-rate * edges[:, :-1])
    return (share @ share.T) / (1 << MANTISSA)


def estimates(regs: np.ndarray, others: np.ndarray, by_chance: np.ndarray) -> np.ndarray:
    """Similarity of one row of registers with others, corrected for agreement by chance."""
    agree = (others == regs).mean(1)
    return (agree - by_chance) / (1 - by_chance)


def least_estimate(percent: int) -> float:
    """Five deviations below the threshold."""
    p = percent / 100
    return p - 5 * (p * (1 - p) / REGISTERS) ** 0.5


def sketches(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row (hash of the text), n (size of the set), set (hash of the whole set; null if empty), regs (128 registers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, hashes, regs = [], [], []
                for own in shingle_sets(texts_of(part, "text"), shingle):
                    sizes.append(len(own))
                    hashes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    regs.append(registers(own).tobytes() if len(own) else None)
                columns = [part.column("id"), part.column("row"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(regs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "row", "n", "set", "regs"])

    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, row long, n long, set binary, regs binary")


def _regs(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def bands(classes: DataFrame) -> DataFrame:
    """key, cid: one row for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(_regs(batch.column("regs"))) if batch.num_rows else np.zeros((0, BANDS), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("cid").to_numpy(), BANDS))], ["key", "cid"])

    return classes.select("cid", "regs").mapInArrow(run, "key long, cid long")


def candidate_edges(classes: DataFrame, percent: int) -> DataFrame:
    """a, b: forests of the pairs that share a bucket and pass the estimate."""
    h = F.xxhash64("cid")
    rows = bands(classes)
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.bit_xor(h).alias("sum")).filter("m > 1")
    once = written(buckets.groupBy("m", "lo", "hi", "sum").agg(F.min("key").alias("key")).select("key", "m"))
    small = F.broadcast(once) if once.count() <= BROADCAST_ROWS else once
    members = rows.join(small, "key").withColumnRenamed("key", "g").withColumn("chunks", F.ceil(F.col("m") / BUCKET_BLOCK).cast("int"))
    members = members.join(classes.select("cid", "n", "regs"), "cid")
    least = least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in grouped(batches, ["g", "i", "j"]):
            cid, n, regs, label = group.column("cid").to_numpy(), group.column("n").to_numpy(), _regs(group.column("regs")), group.column("label").to_numpy()
            sets, by_chance = Sets(len(cid)), chance(np.minimum(n, 1 << 40))
            for x in range(len(cid) - 1):
                rest = slice(x + 1, None)
                good = (estimates(regs[x], regs[rest], by_chance[x, rest]) >= least) & (100 * np.minimum(n[x], n[rest]) >= percent * np.maximum(n[x], n[rest])) & (label[rest] != label[x])
                for y in (np.flatnonzero(good) + x + 1).tolist():
                    if sets.join(x, y):
                        a.append(int(cid[x]))
                        b.append(int(cid[y]))
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def compared(blocks: DataFrame) -> DataFrame:
        return dealt(blocks.select("g", "i", "j", "cid", "label", "n", "regs")).mapInArrow(run, "a long, b long")

    return in_blocks(members, compared, not once.filter(F.col("m") > BUCKET_BLOCK).isEmpty())


def dealt(blocks: DataFrame) -> DataFrame:
    """Blocks in partitions, each block in one piece."""
    return blocks.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")


def in_blocks(members: DataFrame, compared: Callable[[DataFrame], DataFrame], any_large: bool) -> DataFrame:
    """a, b: forests of the links inside groups, found by comparing blocks of members. members: g, cid, m (members of g), chunks, more.

    Groups of one chunk are one block each. The others are compared within chunks that share about HUBS of their members
    (one chunk's worth at most); then members outside the group's main component, if any, are compared with all others,
    block by block: two members of one component needn't be compared. `compared` gives the links of g, i, j (one block's
    keys), cid, label; pairs of one label needn't be found.
    """
    placed = members.withColumn("own", F.pmod(F.xxhash64("cid"), "chunks").cast("int")).withColumn("label", F.col("cid"))
    hub = F.pmod(F.xxhash64(F.lit(1), "cid"), F.greatest(F.ceil(F.col("m") / HUBS), "chunks")) == 0
    at = F.when(hub, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("own"))
    first = written(compared(placed.withColumn("i", F.explode(at)).withColumn("j", F.lit(0))))
    if not any_large:
        return first
    large = written(placed.filter("chunks > 1"))
    joined = components(first).withColumnRenamed("label", "found")
    labelled = large.drop("label").join(joined, large["cid"] == joined["v"], "left").withColumn("label", F.coalesce("found", "cid")).drop("v", "found")
    labelled = written(labelled)
    parts = labelled.groupBy("g", "label").agg(F.count(F.lit(1)).alias("k"))
    most = parts.groupBy("g").agg(F.max(F.struct("k", "label")).alias("most"), F.sum("k").alias("all"))
    main = written(most.select("g", F.col("most.label").alias("main"), (F.col("all") - F.col("most.k")).alias("others")).filter("others > 0"))
    # Members outside the main component meet all members, block by block.
    rest = written(labelled.join(main, "g").withColumn("blocks", F.ceil(F.col("others") * F.col("chunks") / F.col("m")).cast("int")))
    asked = rest.filter("label <> main").withColumn("i", F.pmod(F.xxhash64(F.lit(2), "cid"), "blocks").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = rest.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("j", F.col("own"))
    return first.unionByName(written(compared(asked.unionByName(met))))


def links_in(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """A forest of the linked pairs whose labels differ. Intersections of all pairs come from products of slices of the membership matrix."""
    size = np.array([len(s) for s in sets])
    together = Sets(len(sets))
    if len(sets) <= 4:
        for x in range(len(sets)):
            for y in range(x + 1, len(sets)):
                if labels[x] != labels[y]:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= percent * (size[x] + size[y] - both) and together.join(x, y):
                        yield x, y
        return
    value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = count[column] > 1
    column, row = (np.cumsum(count > 1) - 1)[column[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both, step = np.zeros((len(sets), len(sets)), np.float32), 8192
    for base in range(0, int((count > 1).sum()), step):
        a, b = np.searchsorted(column, [base, base + step])
        part = np.zeros((len(sets), step), np.float32)
        part[row[a:b], column[a:b] - base] = 1
        both += part @ part.T
    both = both.astype(np.int64)  # counts below 2^24, so exact
    linked = np.triu((100 * both >= percent * (size[:, None] + size[None] - both)) & (labels[:, None] != labels[None]), 1)
    for x, y in np.argwhere(linked).tolist():
        if together.join(x, y):
            yield x, y


def verified(blocks: DataFrame, percent: int) -> DataFrame:
    """a, b: forests of exact links. blocks: g, i, j (one block's keys), cid, label, shingles; pairs of one label needn't be found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["g", "i", "j"]):
            cid = group.column("cid").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            found = list(links_in(sets, group.column("label").to_numpy(), percent))
            yield pa.RecordBatch.from_arrays([pa.array([int(cid[x]) for x, _ in found], pa.int64()), pa.array([int(cid[y]) for _, y in found], pa.int64())], ["a", "b"])

    return dealt(blocks.select("g", "i", "j", "cid", "label", "shingles")).mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, members: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """cid, g, n, shingles: the whole sets of candidate classes, made from one text each. members: cid, g, rep, row.

    Texts are asked for by id and hash of 64 bits; of rows that are alike in both, each task makes the first one's set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[int] = set()  # classes whose text the task has seen: a part of its rows
        for batch in batches:
            first = []
            for row, cid in enumerate(batch.column("cid").to_pylist()):
                if cid not in made:
                    made.add(cid)
                    first.append(row)
            for part in slices(batch.take(pa.array(first, pa.int64())), "text"):
                own = list(shingle_sets(texts_of(part, "text"), shingle))
                columns = [part.column("cid"), part.column("g"), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["cid", "g", "n", "shingles"])

    few = members.select("cid", "g", F.col("rep").alias("of"), F.col("row").alias("of_row"))
    few = F.broadcast(few) if members.count() <= BROADCAST_ROWS else few
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    picked = texts.join(few, texts["id"].eqNullSafe(F.col("of")) & (texts["row"] == F.col("of_row"))).select("text", "cid", "g")
    return picked.mapInArrow(run, "cid long, g long, n long, shingles binary").dropDuplicates(["cid"])


def links(docs: DataFrame, classes: DataFrame, percent: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """a, b: exact links between classes; their components are those of all links."""
    groups = components(candidate_edges(classes, percent))
    members = written(groups.join(classes.select(F.col("cid").alias("v"), "rep", "row"), "v").select(F.col("v").alias("cid"), F.col("label").alias("g"), "rep", "row"))
    sets = written(full_sets(docs, members, shingle, id_col, text_col))
    # A block has so many members, and so many shingles together, on average at most.
    chunks = F.greatest(F.ceil(F.col("m") / (GROUP_BLOCK - HUBS)), F.ceil(F.col("total") / BLOCK_SHINGLES))
    whole = (F.col("m") <= GROUP_BLOCK) & (F.col("total") <= 2 * BLOCK_SHINGLES) | (F.col("m") <= 2)
    sizes = sets.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    sizes = written(sizes.select("g", "m", F.when(whole, 1).otherwise(F.least("m", chunks)).cast("int").alias("chunks")))
    return in_blocks(sets.join(sizes, "g"), lambda blocks: verified(blocks, percent), not sizes.filter("chunks > 1").isEmpty())


def with_sets(docs: DataFrame, shingle: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """docs plus __set: the hash of each row's whole set, as sketches has it; null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                hashes = [hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None for own in shingle_sets(texts_of(part, text_col), shingle)]
                yield part.append_column("__set", pa.array(hashes, pa.binary()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__set", BinaryType())]))


def near_duplicates(docs: DataFrame, percent: int = LEAST_PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", sets: bool = False) -> DataFrame:
    """id, n_shingles, component_id, kept (whether the row's id names its component).

    sets: also set (hash of the row's whole set; null if empty) and chosen (whether id and set are those that represent the component).
    """
    rows = written(sketches(docs, shingle, id_col, text_col))
    # A class is represented by its smallest row with an id, if it has one.
    named = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "row")))
    classes = rows.filter("n > 0").groupBy("set").agg(F.coalesce(named, F.min(F.struct("id", "row"))).alias("best"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = classes.select("set", F.col("best.id").alias("rep"), F.col("best.row").alias("row"), "n", "regs")
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()))
    linked = components(links(docs, classes, percent, shingle, id_col, text_col))
    named = classes.select("cid", "set", "rep").join(linked.withColumnRenamed("v", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    names = named.groupBy("label").agg(F.min(F.when(F.col("rep").isNotNull(), F.struct("rep", F.col("set").alias("of")))).alias("name"))
    of_set = written(named.join(names, "label").select("set", F.col("name.rep").alias("component_id"), F.col("set").eqNullSafe(F.col("name.of")).alias("best")))
    placed = rows.select("id", "n", "set").join(of_set, "set", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    kept = F.col("id").eqNullSafe(component)
    more = [F.col("set"), (kept & F.coalesce("best", F.lit(False))).alias("chosen")] if sets else []
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), *more)
