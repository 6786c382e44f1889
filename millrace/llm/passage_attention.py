"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE_WORDS words; all of it is read. Each passage is encoded: square roots of the
shares of its byte pairs and words in hashed buckets, and a few measures of its words, through one hidden layer. Gated
attention, tanh(Vh) * sigmoid(Uh) weighed by w and made to sum to one over the document's passages, says how much each
passage counts; the weighted sum of the encodings is scored. All layers are learned together, from the labels of
documents alone, by gradient steps on a bounded sample (TRAINING_ROWS, TRAINING_BYTES) that is left aside from what is judged.
A text longer than a block is encoded part by part; of its parts only a running maximum and sums of the attention are kept.

Defined results: null and empty texts are one passage without words and get a score as others do; repeated rows are
scored alike; without both labels in the sample there is no model, and scores are 0.5. Empty tables give empty results.
Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import Block, bounded_sample
from .shared import slices, texts_of

PASSAGE_WORDS, PAIRS, WORDS, MEASURES = 128, 512, 256, 6
HIDDEN, GATE = 32, 16
#: So many labelled documents are learned from, with so many bytes of text together.
TRAINING_ROWS, TRAINING_BYTES = 4_000, 32 << 20
PREDICT_FROM = 0.7
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Texts whose passages are encoded at a time: about 60 bytes of features and their making for each byte.
BLOCK_BYTES = 512 << 10


def passages(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, where each text's passages begin)."""
    words = np.diff(block.starts)
    per_text = np.maximum(1, -(-words // PASSAGE_WORDS))
    first = np.cumsum(per_text) - per_text
    n = int(per_text.sum())
    within = np.arange(len(block.ids)) - np.repeat(block.starts[:-1], words)
    passage = np.repeat(first, words) + within // PASSAGE_WORDS
    count = np.bincount(passage, minlength=n)
    lengths = np.fromiter(map(len, block.distinct), np.int64, len(block.distinct))
    hashes = np.fromiter(map(zlib.crc32, block.distinct), np.int64, len(block.distinct))
    upper = np.fromiter((w[:2].isupper() for w in block.distinct), np.float64, len(block.distinct))
    marked = np.fromiter((not w[-1:].isalnum() and w[-1:] < b"\x80" and w[-1:] not in b".,;:!?" for w in block.distinct), np.float64, len(block.distinct))
    ids = block.ids
    x = np.zeros((n, PAIRS + WORDS + MEASURES), np.float32)
    share = np.maximum(count, 1)[:, None]
    x[:, PAIRS : PAIRS + WORDS] = np.sqrt(np.bincount(passage * WORDS + hashes[ids] % WORDS, minlength=n * WORDS).reshape(n, WORDS) / share)
    flat = np.frombuffer(b" ".join([block.distinct[i] for i in ids.tolist()]) + b" ", np.uint8).astype(np.int64)
    own = np.repeat(passage, lengths[ids] + 1)
    pair = ((flat[:-1] * 256 + flat[1:]) * 40503 >> 7) % PAIRS
    inside = own[:-1] == own[1:]
    pairs = np.bincount(own[:-1][inside] * PAIRS + pair[inside], minlength=n * PAIRS).reshape(n, PAIRS)
    x[:, :PAIRS] = np.sqrt(pairs / np.maximum(pairs.sum(1), 1)[:, None])
    # Measures: words, distinct words, words like the one before, length of words, upper-case words, words that end in a sign.
    keys = np.unique(passage * (len(block.distinct) + 1) + ids)
    same = np.zeros(len(ids))
    same[1:] = (ids[1:] == ids[:-1]) & (passage[1:] == passage[:-1])
    c = np.maximum(count, 1)
    x[:, -6] = np.log1p(count) / 5
    x[:, -5] = np.bincount(keys // (len(block.distinct) + 1), minlength=n) / c
    x[:, -4] = np.bincount(passage, same, n) / c
    x[:, -3] = np.bincount(passage, lengths[ids], n) / c / 10
    x[:, -2] = np.bincount(passage, upper[ids], n) / c
    x[:, -1] = np.bincount(passage, marked[ids], n) / c
    return x, first


@dataclass
class Model:
    """w, b: encoder; v, u, a: gated attention; c, d: score of the weighted encoding."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        bag = np.repeat(np.arange(len(first)), np.diff([*first, len(x)]))
        h = np.maximum(x @ self.w + self.b, 0)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-h @ self.u))
        attended = (t * g) @ self.a
        e = np.exp(attended - np.maximum.reduceat(attended, first)[bag])
        attention = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(attention[:, None] * h, first)
        return {"bag": bag, "h": h, "t": t, "g": g, "attended": attended, "attention": attention, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ self.c + self.d, -30, 30)))}

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss, in the order of the fields."""
        f = self.forward(x, first)
        out = (f["score"] - y) / len(y)
        dz = out[:, None] * self.c
        per_passage = dz[f["bag"]]
        da = (per_passage * f["h"]).sum(1)
        de = f["attention"] * (da - np.add.reduceat(f["attention"] * da, first)[f["bag"]])
        dt = de[:, None] * self.a * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * self.a * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["attention"][:, None] * per_passage + dt @ self.v.T + dg @ self.u.T) * (f["h"] > 0)
        return [x.T @ dh, dh.sum(0), f["h"].T @ dt, f["h"].T @ dg, (f["t"] * f["g"]).T @ de, f["z"].T @ out, out.sum(keepdims=True)]

    def parts(self) -> list[np.ndarray]:
        return [self.w, self.b, self.v, self.u, self.a, self.c, self.d]


def start(seed: int = 3) -> Model:
    rng, n = np.random.default_rng(seed), PAIRS + WORDS + MEASURES
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    return Model(draw(n, HIDDEN) * 4, np.zeros(HIDDEN, np.float32), draw(HIDDEN, GATE), draw(HIDDEN, GATE), draw(GATE), draw(HIDDEN), np.zeros(1, np.float32))


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 200, rate: float = 3e-3, decay: float = 1e-4, seed: int = 4) -> Model:
    """Adam over about `steps` mini-batches of documents, the rate falling to a tenth."""
    model, rng, step = start(), np.random.default_rng(seed), 0
    last = np.append(first[1:], len(x))
    m, v = [np.zeros_like(p) for p in model.parts()], [np.zeros_like(p) for p in model.parts()]
    epochs = max(1, round(steps / -(-len(y) // batch)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            docs = order[at : at + batch]
            sizes = last[docs] - first[docs]
            begin = np.cumsum(sizes) - sizes
            rows = np.repeat(first[docs] - begin, sizes) + np.arange(sizes.sum())
            step += 1
            pace = rate * (1 - 0.9 * epoch / epochs) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for i, (p, g) in enumerate(zip(model.parts(), model.gradients(x[rows], begin, y[docs]), strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p -= (pace * (m[i] / (np.sqrt(v[i]) + 1e-8) + decay * p)).astype(p.dtype)
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS, most_bytes: int = TRAINING_BYTES) -> Model | None:
    """Passages are encoded where the texts lie; those of the bounded sample meet in one task that fits the model. None without both labels."""
    sample = bounded_sample(docs, labels, label_col, rows, most_bytes, id_col, text_col, seed=5)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                x, first = passages(Block(texts_of(part, "text")))
                own = np.split(x.astype(np.float16), first[1:])
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.string()), part.column("label"), pa.array([o.tobytes() for o in own], pa.binary())], ["id", "label", "passages"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_ = sorted((i, y, p) for b in batches for i, y, p in zip(*(b.column(c).to_pylist() for c in ("id", "label", "passages")), strict=True))
        y = np.array([r[1] for r in rows_], np.float32)
        if len(y) and 0 < y.mean() < 1:
            own = [np.frombuffer(p, np.float16).reshape(-1, PAIRS + WORDS + MEASURES) for _, _, p in rows_]
            sizes = np.array([len(o) for o in own])
            model = fit(np.concatenate(own).astype(np.float32), np.cumsum(sizes) - sizes, y)
            yield pa.RecordBatch.from_arrays([pa.array([p.astype(np.float32).tobytes() for p in model.parts()], pa.binary())], ["part"])

    made = sample.select("id", "label", "text").mapInArrow(encode, "id string, label int, passages binary").repartition(1)
    got = made.mapInArrow(learn, "part binary").collect()
    return Model(*[np.frombuffer(r.part, np.float32).reshape(p.shape) for r, p in zip(got, start().parts(), strict=True)]) if got else None


def scores(texts: list[bytes], model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, passages, passage that counts most) of each text."""
    x, first = passages(Block(texts))
    n = np.diff([*first, len(x)])
    if model is None:
        return np.full(len(texts), 0.5), n, np.zeros(len(texts), np.int64)
    f = model.forward(x, first)
    best = [int(a.argmax()) for a in np.split(f["attention"], first[1:])]
    return f["score"].astype(np.float64), n, np.array(best)


def word_parts(text: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about `size` bytes whose passages, in order, are those of the whole."""
    held, at, given = b"", 0, False
    while len(text) - at > 2 * size and (space := _SPACE.search(text, at + size)):
        words = (held + b" " + text[at : space.start()]).split()
        whole = len(words) - len(words) % PASSAGE_WORDS
        if whole:
            yield b" ".join(words[:whole])
            given = True
        held, at = b" ".join(words[whole:]), space.start()
    rest = held + b" " + text[at:] if held else text[at:]
    if not given or rest.strip():
        yield rest


def score_long(text: bytes, model: Model | None, size: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As scores, for one text, part by part."""
    top, weight, z, n, best = -np.inf, 0.0, np.zeros(HIDDEN), 0, 0
    for part in word_parts(text, size):
        x, first = passages(Block([part]))
        if model is not None:
            f = model.forward(x, first)
            e = f["attended"].astype(np.float64)
            if e.max() > top:
                best = n + int(e.argmax())
                weight, z, top = weight * np.exp(top - e.max()), z * np.exp(top - e.max()), float(e.max())
            own = np.exp(e - top)
            weight, z = weight + own.sum(), z + own @ f["h"]
        n += len(x)
    score = 0.5 if model is None else 1 / (1 + np.exp(-np.clip(z / weight @ model.c + model.d, -30, 30)))[0]
    return np.array([score], np.float64), np.array([n]), np.array([best])


def judged(texts: list[bytes], model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return score_long(texts[0], model) if len(texts) == 1 else scores(texts, model)


def score_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (probability of label 1), n_passages, top_passage (from 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 100 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                score, n, best = judged(texts_of(part, "text"), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score), pa.array(n, pa.int64()), pa.array(best, pa.int64())], ["id", "score", "n_passages", "top_passage"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, score double, n_passages long, top_passage long").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model | None, keep_from: float, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches keep_from, with the columns they came with; all without a model."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, BLOCK_BYTES):
                yield part.filter(pa.array(judged(texts_of(part, text_col), shared.value)[0] >= keep_from))

    return docs.mapInArrow(run, docs.schema)
