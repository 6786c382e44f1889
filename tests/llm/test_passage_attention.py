import zlib

import numpy as np

from millrace.llm.passage_attention import MEASURES, PAIRS, PASSAGE_WORDS, WORDS, Model, passages, score_documents, score_long, scores, start, train
from millrace.llm.quality_rules import Block
from millrace.llm.queries_op5 import op5_quality_classifier


def test_held_out_accuracy(spark):
    rows = op5_quality_classifier(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p for y, p in held if y) >= 0.98 * sum(y for y, _ in held)
    assert sum(not p for y, p in held if not y) >= 0.9 * sum(not y for y, _ in held)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "w " * 10_000), (None, "x y"), (4, "w " * 10_000)], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS id")
    model = start()
    got = score_documents(docs, model).collect()
    assert len(got) == 6 and len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1 and len({r.score for r in got if r.doc_id == 4}) == 1
    assert {r.n_passages for r in got if r.doc_id == 4} == {-(-10_000 // PASSAGE_WORDS)}
    assert score_documents(docs.limit(0), model).count() == 0
    none = spark.createDataFrame([(4, 1), (1, None), (None, 0)], "doc_id long, quality int")
    assert train(docs, none) is None
    assert {r.score for r in score_documents(docs, None).collect()} == {0.5}


def test_gradients_are_those_of_the_loss():
    x, first = passages(Block([b"a few words " * 90, b"", b"### $$$ more && words", b"THE! SAME! " * 200]))
    y, model, rng = np.array([1.0, 0.0, 0.0, 1.0]), Model(*[p.astype(np.float64) for p in start().parts()]), np.random.default_rng(0)
    x = x.astype(np.float64)
    model.b += rng.normal(0, 0.3, len(model.b))  # off the kink of a passage without words

    def loss():
        s = model.forward(x, first)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for part, gradient in zip(model.parts(), model.gradients(x, first, y), strict=True):
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in part.shape)
            old, e = part[at], 1e-5
            part[at] = old + e
            up = loss()
            part[at] = old - e
            down = loss()
            part[at] = old
            assert abs((up - down) / (2 * e) - gradient[at]) < 1e-6


def plain_score(text, model):
    """One document, passage by passage, without numbers of words: features in dictionaries, then the layers one after the other."""
    words = text.split()
    hidden, weights = [], []
    for at in range(0, max(1, len(words)), PASSAGE_WORDS):
        own = words[at : at + PASSAGE_WORDS]
        n, x = max(1, len(own)), np.zeros(PAIRS + WORDS + MEASURES)
        for w in own:
            x[PAIRS + zlib.crc32(w) % WORDS] += 1 / n
        line = b" ".join(own) + b" " if own else b""
        for a, b in zip(line, line[1:]):
            x[((a * 256 + b) * 40503 >> 7) % PAIRS] += 1 / (len(line) - 1)
        x = np.sqrt(x)
        x[-6:] = [np.log1p(len(own)) / 5, len(set(own)) / n, sum(a == b for a, b in zip(own, own[1:])) / n, sum(map(len, own)) / n / 10, sum(w[:2].isupper() for w in own) / n, sum(not w[-1:].isalnum() and w[-1:] < b"\x80" and w[-1:] not in b".,;:!?" for w in own) / n]
        h = np.maximum(x @ model.w + model.b, 0)
        hidden.append(h)
        weights.append(float((np.tanh(h @ model.v) / (1 + np.exp(-h @ model.u))) @ model.a))
    share = np.exp(np.array(weights) - max(weights))
    return float(1 / (1 + np.exp(-(share / share.sum() @ np.array(hidden) @ model.c + model.d[0]))))


def test_scores_are_those_of_a_plain_pass(spark, sf_dir):
    docs, model = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), start(7)
    got = {r.doc_id: r.score for r in score_documents(docs, model).collect()}
    for r in docs.collect():
        assert abs(got[r.doc_id] - plain_score((r.text or "").encode(), model)) < 2e-5


def test_long_texts_in_parts():
    rng, model = np.random.default_rng(2), start(9)
    text = b" ".join(f"{'W' if rng.random() < 0.1 else 'w'}{i}".encode() for i in rng.integers(0, 900, 4_000)) + b" \n "
    want = scores([text], model)
    for size in (300, 5_000, 1 << 20):
        got = score_long(text, model, size)
        assert abs(got[0][0] - want[0][0]) < 1e-5 and got[1][0] == want[1][0] and got[2][0] == want[2][0]
    for text in (b"", b"  ", b"a" * 5_000):
        assert abs(score_long(text, model, 100)[0][0] - scores([text], model)[0][0]) < 1e-6
