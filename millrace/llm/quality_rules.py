"""Quality rules: counting rules, then a calibrated logistic regression on hashed word and character n-grams.

A text's features are the shares of its word n-grams (1 and 2) and of its character n-grams (2 and 3 bytes) that fall
into each of 2^15 buckets per group. The weights are learned from a bounded sample of labelled documents, a part of which
is held back to turn the linear score into a probability. Scoring looks weights up for a block of texts at a time.

Defined results: null and empty texts have no words, fail the base rules and aren't kept; an unlabelled or empty label
table leaves the base rules alone to decide; repeated rows are judged alike; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, lowest_hashes, slices, texts_of, written

#: A text has few words below this; repeated words fail it above this share (%); kept from this probability of good quality.
FEW_WORDS, REPEATED, KEEP_FROM = 50, 50, 0.5
#: So many labelled documents are learned from, chosen by the hash of their id; of these, so large a part calibrates.
TRAINING_ROWS, CALIBRATION = 6_000, 0.3
BUCKETS = 1 << 15
GROUPS = ("word 1", "word 2", "char 2", "char 3")
_SYMBOLS = b"#*$%&|<>"


@dataclass
class Block:
    """The words of some texts as numbers: ids into `distinct`, text i has ids[starts[i]:starts[i + 1]]."""

    texts: list[bytes]
    ids: np.ndarray = field(init=False)
    starts: np.ndarray = field(init=False)
    distinct: list[bytes] = field(init=False)

    def __post_init__(self):
        split = [t.split() for t in self.texts]
        self.starts = np.zeros(len(split) + 1, np.int64)
        np.cumsum([len(w) for w in split], out=self.starts[1:])
        coded = pa.array([w for own in split for w in own], pa.large_binary()).dictionary_encode()
        self.ids, self.distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def repeated_words(block: Block) -> list[int]:
    """Words of each text that lie in a 3-word window found twice or more in it, the first included."""
    ids, starts, n = block.ids, block.starts, max(len(block.distinct), 1)
    if len(ids) < 3:
        return [0] * len(block.texts)
    if n < 1 << 21:
        keys = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:  # too many distinct words for one number: number the pairs first
        pairs = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)[1]
        keys = pairs * n + ids[2:]
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        own = keys[a : max(a, b - 2)]
        ordered = np.sort(own)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            out.append(0)
            continue
        hit = np.isin(own, twice)
        covered = np.zeros(b - a, bool)
        for k in range(3):
            covered[k : k + len(own)] |= hit
        out.append(int(covered.sum()))
    return out


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def grams(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of GROUPS: buckets of all n-grams, and where each text's begin and end."""
    hashes = np.fromiter(map(zlib.crc32, block.distinct), np.uint64, len(block.distinct))[block.ids] if len(block.ids) else np.zeros(0, np.uint64)
    shift, mask = np.uint64(17), np.uint64(BUCKETS - 1)
    mixed = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    begin, end = block.starts[:-1], block.starts[1:]
    yield (mixed & mask).astype(np.int32), begin, end
    yield (((mixed[:-1] * np.uint64(31) + mixed[1:]) >> np.uint64(3)) & mask).astype(np.int32), begin, np.maximum(begin, end - 1)
    flat = np.frombuffer(b"".join(block.texts), np.uint8).astype(np.uint32)
    ends = np.cumsum([len(t) for t in block.texts], dtype=np.int64)
    starts = ends - np.array([len(t) for t in block.texts], np.int64)
    pair = (flat[:-1] << np.uint32(8)) | flat[1:]
    yield ((pair * np.uint32(0x9E3779B1)) >> np.uint32(shift)).astype(np.int32), starts, np.maximum(starts, ends - 1)
    triple = (pair[:-1] << np.uint32(8)) | flat[2:]
    yield ((triple * np.uint32(0x85EBCA6B)) >> np.uint32(shift)).astype(np.int32), starts, np.maximum(starts, ends - 2)


def linear_scores(block: Block, weights: np.ndarray, bias: float) -> np.ndarray:
    """bias plus, for each group, the mean weight of the text's n-grams."""
    out = np.full(len(block.texts), bias)
    for group, (buckets, begin, end) in enumerate(grams(block)):
        sums = np.concatenate([[0.0], np.cumsum(weights[group][buckets], dtype=np.float64)])
        begin, end = np.minimum(begin, len(buckets)), np.minimum(end, len(buckets))
        out += (sums[end] - sums[begin]) / np.maximum(end - begin, 1)
    return out


def features(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text; groups follow each other in one space of 4 x BUCKETS."""
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in block.texts]
    for group, (buckets, begin, end) in enumerate(grams(block)):
        for i, (a, b) in enumerate(zip(begin, end, strict=True)):
            found, counts = np.unique(buckets[a:b], return_counts=True)
            parts[i].append((found.astype(np.int32) + group * BUCKETS, (counts / max(b - a, 1)).astype(np.float32)))
    return [(np.concatenate([x for x, _ in p]), np.concatenate([y for _, y in p])) for p in parts]


@dataclass(frozen=True)
class Model:
    """weights: one row per group. The probability of good quality is the logistic of slope * score + offset."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probabilities(self, block: Block) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * linear_scores(block, self.weights, self.bias) + self.offset, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, held: np.ndarray, steps: int = 60, l2: float = 1e-4) -> tuple[np.ndarray, float, float, float]:
    """Weights and bias by accelerated gradient steps (Adam) on all rows but `held`, both labels weighing alike; slope and offset by Newton's method on `held`."""
    train = ~held
    use = [r for r, t in zip(rows, train, strict=True) if t]
    y = labels[train].astype(np.float64)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    index, value = np.concatenate([a for a, _ in use]), np.concatenate([b for _, b in use]).astype(np.float64)
    lengths = np.array([len(a) for a, _ in use])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    w, m, v, bias, mb, vb = np.zeros(4 * BUCKETS), np.zeros(4 * BUCKETS), np.zeros(4 * BUCKETS), 0.0, 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.add.reduceat(w[index] * value, starts) * (lengths > 0) + bias
        r = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * balance
        g = np.bincount(index, value * np.repeat(r, lengths), 4 * BUCKETS) + l2 * w / len(w)
        gb = r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.5 * (m / fix1) / (np.sqrt(v / fix2) + 1e-9)
        bias -= 0.05 * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-9)
    z = np.array([w[a] @ b.astype(np.float64) + bias for (a, b), h in zip(rows, held, strict=True) if h])
    slope, offset = platt(z, labels[held].astype(np.float64))
    return w.reshape(4, BUCKETS), bias, slope, offset


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the held-back scores, with targets drawn in by one count for each label."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(z.std(), 1e-9)
    x = np.stack([z / scale, np.ones_like(z)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0]))
        theta -= np.clip(step, -2, 2)
    return float(theta[0] / scale), float(theta[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """id, text, label of `rows` labelled documents (all, if there are fewer): those with the lowest hashes of their ids. The ids are broadcast.

    An id that several rows share counts once for the sample, and once among the texts: the smallest text by its hash.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("of")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    chosen = written(lowest_hashes(written(marked), rows, ["of"], seed))
    found = own.join(F.broadcast(chosen), F.col("id") == F.col("of"))
    return found.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))


def bounded_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, most_bytes: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """id, text, label: labelled documents by the hashes of their ids, `rows` and `most_bytes` of text at most."""
    sample = written(labelled_sample(docs, labels, label_col, rows, id_col, text_col, seed))
    # One narrow row for each row of the sample.
    order = Window.orderBy(F.xxhash64(F.lit(seed), "id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    sized = sample.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).withColumn("held", F.sum("n").over(order))
    return sample.join(F.broadcast(sized.filter(F.col("held") <= most_bytes).select("id")), "id")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS) -> Model | None:
    """Features are made where the texts lie; the bounded sample's features meet in one task that fits the model. None without both labels."""
    sample = labelled_sample(docs, labels, label_col, rows, id_col, text_col)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own = features(Block(texts_of(part, "text")))
                columns = [part.column("id").cast(pa.string()), part.column("label"), pa.array([a.tobytes() for a, _ in own], pa.binary()), pa.array([b.tobytes() for _, b in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "buckets", "shares"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, rows_ = [], [], []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            marks += batch.column("label").to_pylist()
            rows_ += [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for a, b in zip(batch.column("buckets").to_pylist(), batch.column("shares").to_pylist(), strict=True)]
        order = np.argsort(np.array(ids, dtype=object)) if ids else []
        y = np.array(marks)[order] if ids else np.zeros(0)
        held = np.array([zlib.crc32(f"calibrate:{ids[k]}".encode()) % 1000 < 1000 * CALIBRATION for k in order], bool)
        if len(y) and 0 < y[~held].mean() < 1:
            w, bias, slope, offset = fit([rows_[k] for k in order], y, held)
            yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), *[pa.array([x], pa.float64()) for x in (bias, slope, offset)]], ["weights", "bias", "slope", "offset"])

    made = sample.mapInArrow(extract, "id string, label int, buckets binary, shares binary").repartition(1)
    got = made.mapInArrow(learn, "weights binary, bias double, slope double, offset double").collect()
    return Model(np.frombuffer(got[0].weights, np.float32).reshape(4, BUCKETS), got[0].bias, got[0].slope, got[0].offset) if got else None


def apply_rules(docs: DataFrame, model: Model | None, keep_from: float = KEEP_FROM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability (null without a model)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 512 KB of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                block = Block(texts_of(part, "text"))
                words = np.diff(block.starts)
                repeats = np.array(repeated_words(block), np.int64)
                failed = (words < FEW_WORDS) | (100 * repeats > REPEATED * words)
                p = shared.value.probabilities(block) if shared.value else None
                columns = [
                    part.column("id"),
                    pa.array(words, pa.int64()),
                    pa.array([len(t.translate(None, SPACES).decode()) for t in block.texts], pa.int64()),
                    pa.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in block.texts], pa.int64()),
                    pa.array([duplicate_lines(t) for t in block.texts], pa.int64()),
                    pa.array(repeats, pa.int64()),
                    pa.array(failed),
                    pa.array(~failed if p is None else ~failed & (p >= keep_from)),
                    pa.array(np.full(len(words), np.nan) if p is None else p, pa.float64(), from_pandas=True),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    rows = narrow.mapInArrow(run, f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")
    return rows.withColumnRenamed("id", id_col)
