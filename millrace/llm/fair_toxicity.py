"""Toxicity: a classifier of sentences, regularised by counterfactuals, pooled over whole documents.

A document is cut into sentences (words up to one that ends in . ! or ?, SENTENCE_WORDS at most). A sentence's score is a
bias plus the sum, over its distinct words and word pairs, of learned weights: of the word, of its character runs of
RUNS bytes (the word's ends marked), and of the pair, all hashed. A document's score is that of its worst sentence, so that
one toxic sentence counts alike in a short and in a very long text. A weight is the feature's shrunken log-odds times a
factor; the factors are learned together from the labels of documents (a bounded sample), the worst sentence of each
passing the error on.

Counterfactuals: each sentence of the sample that names a group (IDENTITY_TERMS) is written anew once for every other
term of its set, and the squared change of its score is added to the loss. A name's own weights, and those of the pairs
it stands in, are so drawn to those of the other names and of the neutral words of its set: what remains toxic is
what the sentence says, not whom it names.

Defined results: null and empty texts, and those without words, are one sentence without words and get the score of the
bias. Repeated rows are scored alike. Without both labels in the sample there is no model, and scores are 0.5. Empty
tables give empty results. Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import bounded_sample
from .shared import slices, texts_of

SENTENCE_WORDS, RUNS, BUCKETS = 40, (4, 6, 8), 1 << 18
#: Labelled documents that are learned from, and the bytes of text that they have together at most.
TRAINING_ROWS, TRAINING_BYTES = 4_000, 12 << 20
PREDICT_FROM = 0.5
#: Features of fewer documents of the sample than this keep weight 0.
LEAST_DOCUMENTS = 4
#: Documents of the sample whose features are counted at a time.
COUNT_DOCUMENTS = 100
#: Documents that a feature's log-odds are drawn to the average by.
SHRINK = 100.0
#: Weight of all toxic documents together beside that of the others.
BALANCE = 0.7
#: Weight of the squared changes of score under swaps.
FAIRNESS = 1.0
#: Texts that are scored at a time.
BLOCK_BYTES = 512 << 10
#: Sets of terms for groups of people, each with neutral words at its end. Single words in lower case.
IDENTITY_TERMS = (
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "believers", "people"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "religious", "other"),
    ("women", "men", "girls", "boys", "transgender", "everyone", "people"),
    ("woman", "man", "girl", "boy", "person"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "single", "other"),
    ("black", "white", "asian", "african", "latino", "european", "american", "arab", "other"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens", "neighbours", "people"),
    ("disabled", "deaf", "blind", "old", "young", "other"),
    ("frauen", "männer", "mädchen", "jungen", "menschen"),
    ("muslime", "christen", "juden", "ausländer", "flüchtlinge", "nachbarn", "menschen"),
    ("femmes", "hommes", "filles", "garçons", "gens"),
    ("musulmans", "chrétiens", "juifs", "étrangers", "réfugiés", "voisins", "gens"),
    ("mujeres", "hombres", "chicas", "chicos", "personas"),
    ("musulmanes", "cristianos", "judíos", "extranjeros", "refugiados", "vecinos", "personas"),
)
_EDGES = b".,;:!?\"'()[]{}<>*_#$%&|-"
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Sentences:
    """Sentences of some texts: word numbers `ids` into `distinct`, sentence s has ids[starts[s]:starts[s + 1]], text t begins with sentence first[t]."""

    ids: np.ndarray
    distinct: list[bytes]
    starts: np.ndarray
    first: np.ndarray


def cut(texts: list[bytes]) -> Sentences:
    words = [t.split() for t in texts]
    coded = pa.array([w for own in words for w in own], pa.large_binary()).dictionary_encode()
    raw, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    counts = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(counts) - counts
    last = np.zeros(len(ids), bool)
    if len(ids):
        last = np.fromiter((w[-1:] in b".!?" for w in raw), bool, len(raw))[ids]
        last[begin[counts > 0] + counts[counts > 0] - 1] = True
    # A sentence begins after a last word, and after each SENTENCE_WORDS words of it.
    at = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(ids) else np.zeros(0, np.int64)
    length = np.diff(np.append(at, len(ids)))
    within = np.arange(len(ids)) - np.repeat(at, length)
    opens = np.flatnonzero(within % SENTENCE_WORDS == 0)
    text_of = np.repeat(np.arange(len(texts)), counts)[opens]
    own = np.bincount(text_of, minlength=len(texts))
    per_text = np.maximum(own, 1)  # texts without words have one sentence, and no word
    first = np.cumsum(per_text) - per_text
    starts = np.zeros(int(per_text.sum()) + 1, np.int64)
    starts[:-1] = np.repeat(begin, per_text)
    starts[first[text_of] + np.arange(len(opens)) - (np.cumsum(own) - own)[text_of]] = opens
    starts[-1] = len(ids)
    bare = [w.lower().strip(_EDGES) for w in raw]
    again = pa.array(bare, pa.large_binary()).dictionary_encode()
    return Sentences(again.indices.to_numpy().astype(np.int64)[ids], again.dictionary.to_pylist(), starts, first)


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about `size` bytes that have the same sentences, in order, as the whole."""
    held, at, given = b"", 0, False
    while len(text) - at > 2 * size and (space := _SPACE.search(text, at + size)):
        words = (held + b" " + text[at : space.start()]).split()
        last = next((i + 1 for i in range(len(words) - 1, -1, -1) if words[i][-1:] in b".!?"), 0)
        whole = len(words) - (len(words) - last) % SENTENCE_WORDS
        if whole:
            yield b" ".join(words[:whole])
            given = True
        held, at = b" ".join(words[whole:]), space.start()
    rest = held + b" " + text[at:] if held else text[at:]
    if not given or rest.strip():
        yield rest


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, where each word's begin): of the word itself, then of its character runs."""
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    flat = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(flat))  # bytes from here to the word's end
    of = np.repeat(np.arange(len(words)), lengths)
    hashes = np.array([hash_bytes(w) for w in words], np.uint64)
    parts, owners = [bucket(hashes)], [np.arange(len(words))]
    run = flat.copy()
    for n in range(2, min(max(RUNS), len(flat)) + 1):
        run[: len(flat) - n + 1] = run[: len(flat) - n + 1] * np.uint64(257) + flat[n - 1 :]
        if n in RUNS:
            whole = np.flatnonzero(left >= n)
            parts.append(bucket(run[whole] * np.uint64(2 * n + 1)))
            owners.append(of[whole])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order], np.searchsorted(owner[order], np.arange(len(words)))


def hash_bytes(word: bytes) -> int:
    return zlib.crc32(word) | zlib.adler32(word) << 32


def bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * _MIX) >> np.uint64(64 - 18)).astype(np.int32)


def units(s: Sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, distinct word) and (sentence, bucket of a word pair), each once."""
    sentence = np.repeat(np.arange(len(s.starts) - 1), np.diff(s.starts))
    n = max(len(s.distinct), 1)
    own = np.unique(sentence * n + s.ids)
    hashes = np.array([hash_bytes(w) for w in s.distinct], np.uint64)[s.ids] if len(s.ids) else np.zeros(0, np.uint64)
    inside = np.flatnonzero(sentence[1:] == sentence[:-1])
    pair = bucket(hashes[inside] * np.uint64(31) + hashes[inside + 1] + np.uint64(7))
    pairs = np.unique(sentence[inside] * BUCKETS + pair)
    return own // n, own % n, pairs // BUCKETS, pairs % BUCKETS


@dataclass
class Model:
    words: np.ndarray
    pairs: np.ndarray
    bias: float

    def sentence_scores(self, s: Sentences) -> np.ndarray:
        sentence, word, pair_sentence, pair = units(s)
        n = len(s.starts) - 1
        value = np.zeros(0)
        if s.distinct:
            buckets, begin = word_features(s.distinct)
            value = np.add.reduceat(self.words[buckets].astype(np.float64), begin)
        return self.bias + np.bincount(sentence, value[word], n) + np.bincount(pair_sentence, self.pairs[pair], n)

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of the worst sentence, sentences, first of the worst ones) of each text."""
        s = cut(texts)
        z = self.sentence_scores(s)
        top = np.maximum.reduceat(z, s.first)
        n = np.diff(np.append(s.first, len(z)))
        hit = np.flatnonzero(z == np.repeat(top, n))
        return top, n, hit[np.unique(np.repeat(np.arange(len(n)), n)[hit], return_index=True)[1]] - s.first

    def judge_long(self, text: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As judge, for one text, part by part."""
        top, sentences, worst = -np.inf, 0, 0
        for piece in pieces(text, size):
            z, n, at = (x[0] for x in self.judge([piece]))
            if z > top:
                top, worst = z, sentences + at
            sentences += n
        return np.array([top]), np.array([sentences]), np.array([worst])

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return logistic(self.judge(texts)[0])


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def swaps(s: Sentences, terms: tuple[tuple[str, ...], ...]) -> tuple[Sentences, np.ndarray, list[tuple[int, int]]]:
    """(sentences that name a group, written anew with every other term of the set; the sentence each comes from; words taken out and put in)."""
    code = {w: i for i, w in enumerate(s.distinct)}
    distinct, sets = list(s.distinct), {}
    for own in terms:
        for t in own:
            sets.setdefault(t.encode(), []).extend(o.encode() for o in own if o != t)
    named = {code[t]: others for t, others in sets.items() if t in code}
    ids, starts, of, pairs = [], [0], [], []
    hits = np.flatnonzero(np.isin(s.ids, list(named))) if named else []
    for at in hits:
        k = int(np.searchsorted(s.starts, at, "right")) - 1
        for other in named[int(s.ids[at])]:
            if other not in code:
                code[other] = len(distinct)
                distinct.append(other)
            line = s.ids[s.starts[k] : s.starts[k + 1]].copy()
            line[at - s.starts[k]] = code[other]
            ids.append(line)
            starts.append(starts[-1] + len(line))
            of.append(k)
            pairs.append((int(s.ids[at]), code[other]))
    joined = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    return Sentences(joined, distinct, np.array(starts, np.int64), np.zeros(1, np.int64)), np.array(of, np.int64), pairs


def fit(texts: list[bytes], y: np.ndarray, terms: tuple = IDENTITY_TERMS, fairness: float = FAIRNESS, steps: int = 200, rate: float = 1.0, decay: float = 1e-4) -> Model:
    """Gradient steps with momentum on the mean logistic loss of the documents plus `fairness` times the mean squared change under swaps."""
    s = cut(texts)
    other, of, exchanged = swaps(s, terms)
    s = Sentences(s.ids, other.distinct, s.starts, s.first)
    n, n_docs = len(s.starts) - 1, len(texts)
    sentence, word, pair_sentence, pair = units(s)
    o_sentence, o_word, o_pair_sentence, o_pair = units(other)
    buckets, begin = word_features(s.distinct)
    width = np.diff(np.append(begin, len(buckets)))
    doc = np.repeat(np.arange(n_docs), np.diff(np.append(s.first, n)))

    # Log-odds of each bucket over the documents that have it, drawn to those of all documents; rare ones are 0. Weights are
    # these times a factor that is learned, so that what is rare or says little moves slowly.
    share = y.mean()
    weigh = np.where(y == 1, BALANCE / share, 1 / (1 - share)) / (1 + BALANCE) / n_docs

    def odds(documents: np.ndarray, features: Callable[[int, int], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """documents: of each item, in order; features(a, b): (item's place from a, bucket) of the items from a to b."""
        seen = np.zeros((2, BUCKETS))
        for of in range(0, n_docs, COUNT_DOCUMENTS):
            a, b = np.searchsorted(documents, [of, of + COUNT_DOCUMENTS])
            place, own = features(a, b)
            once = np.unique(own.astype(np.int64) * n_docs + documents[a:b][place])
            for k in (0, 1):
                seen[k] += np.bincount((once // n_docs)[y[once % n_docs] == k], minlength=BUCKETS)
        ratio = np.log((seen[1] + SHRINK * share) / (seen[0] + SHRINK * (1 - share))) - np.log(share / (1 - share))
        return np.where(seen.sum(0) >= LEAST_DOCUMENTS, ratio, 0.0)

    at_word = np.unique(doc[sentence] * max(len(s.distinct), 1) + word)
    w_doc, w_word = at_word // max(len(s.distinct), 1), at_word % max(len(s.distinct), 1)

    def of_words(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        own, size = begin[w_word[a:b]], width[w_word[a:b]]
        return np.repeat(np.arange(b - a), size), buckets[np.repeat(own - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    of_pairs = lambda a, b: (np.arange(b - a), pair[a:b])
    scale = [odds(w_doc, of_words), odds(doc[pair_sentence], of_pairs), np.ones(1)]
    factors = [np.full(BUCKETS, 0.1), np.full(BUCKETS, 0.1), np.array([np.log(share / (1 - share))])]
    pace = [np.zeros_like(p) for p in factors]
    # No step is longer than the curvature allows: at most a quarter of the mean squared length of a document's longest sentence,
    # and twice that of the swaps' changes.
    squares = np.add.reduceat(scale[0][buckets] ** 2, begin) if len(buckets) else np.zeros(0)
    size = 1 + np.bincount(sentence, squares[word], n) + np.bincount(pair_sentence, scale[1][pair] ** 2, n)
    curved = (np.maximum.reduceat(size, s.first) * weigh).sum() / 4
    if len(of) and fairness:
        named = np.array([max(squares[i], squares[j]) for i, j in exchanged], np.float64)
        curved += 4 * fairness * (2 * named.mean() + 8 * (scale[1] ** 2).max())
    rate = min(rate, 1 / curved)
    for _ in range(steps):
        params = [f * r for f, r in zip(factors, scale, strict=True)]
        value = np.add.reduceat(params[0][buckets], begin) if len(buckets) else np.zeros(0)
        z = params[2][0] + np.bincount(sentence, value[word], n) + np.bincount(pair_sentence, params[1][pair], n)
        top = np.maximum.reduceat(z, s.first)
        # The worst sentence of a document, the first of equals, passes its error on.
        hit = np.flatnonzero(z == top[doc])
        worst = hit[np.unique(doc[hit], return_index=True)[1]]
        d = np.zeros(n)
        d[worst] = (logistic(top) - y) * weigh
        slope = d.sum()
        by_word = np.bincount(word, d[sentence], len(s.distinct))
        by_pair = np.bincount(pair, d[pair_sentence], BUCKETS)
        if len(of) and fairness:
            swapped = params[2][0] + np.bincount(o_sentence, value[o_word], len(of)) + np.bincount(o_pair_sentence, params[1][o_pair], len(of))
            change = 2 * fairness * (swapped - z[of]) / len(of)
            back = np.bincount(of, change, n)
            by_word += np.bincount(o_word, change[o_sentence], len(s.distinct)) - np.bincount(word, back[sentence], len(s.distinct))
            by_pair += np.bincount(o_pair, change[o_pair_sentence], BUCKETS) - np.bincount(pair, back[pair_sentence], BUCKETS)
        grads = [np.bincount(buckets, np.repeat(by_word, width), BUCKETS), by_pair, np.array([slope])]
        for i, g in enumerate(grads):
            pace[i] = 0.9 * pace[i] - rate * (g * scale[i] + decay * (factors[i] if i < 2 else 0))
            factors[i] = factors[i] + pace[i]
    params = [f * r for f, r in zip(factors, scale, strict=True)]
    return Model(params[0].astype(np.float32), params[1].astype(np.float32), float(params[2][0]))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS, most_bytes: int = TRAINING_BYTES, terms: tuple = IDENTITY_TERMS, fairness: float = FAIRNESS) -> Model | None:
    """The texts of the bounded sample meet in one task that fits the model. None without both labels."""
    sample = bounded_sample(docs, labels, label_col, rows, most_bytes, id_col, text_col, seed=13)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_ = sorted((i, y, t or "") for b in batches for i, y, t in zip(*(b.column(c).to_pylist() for c in ("id", "label", "text")), strict=True))
        y = np.array([r[1] for r in rows_], np.float64)
        if len(y) and 0 < y.mean() < 1:
            model = fit([r[2].encode() for r in rows_], y, terms, fairness)
            yield pa.RecordBatch.from_arrays([pa.array([model.words.tobytes()], pa.binary()), pa.array([model.pairs.tobytes()], pa.binary()), pa.array([model.bias])], ["words", "pairs", "bias"])

    made = sample.select(F.col("id").cast("string").alias("id"), F.col("label").cast("int").alias("label"), "text").repartition(1)
    got = made.mapInArrow(learn, "words binary, pairs binary, bias double").collect()
    return Model(np.frombuffer(got[0].words, np.float32), np.frombuffer(got[0].pairs, np.float32), got[0].bias) if got else None


def score_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (probability of label 1), n_sentences, top_sentence (from 0)."""
    none = Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model or none)  # 2 MB of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                texts = texts_of(part, "text")
                top, n, worst = own.judge_long(texts[0], BLOCK_BYTES) if len(texts) == 1 else own.judge(texts)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(logistic(top)), pa.array(n, pa.int64()), pa.array(worst, pa.int64())], ["id", "score", "n_sentences", "top_sentence"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, score double, n_sentences long, top_sentence long").withColumnRenamed("id", id_col)
