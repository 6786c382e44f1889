import zlib

import numpy as np

from millrace.llm import fair_toxicity as M
from millrace.llm.queries_op13 import op13_fair_toxicity


def plain_score(text: bytes, model: M.Model) -> float:
    """One document, word by word, without numbers of words and without blocks."""
    sentences, line = [], []
    for w in text.split():
        line.append(w)
        if w[-1:] in b".!?" or len(line) == M.SENTENCE_WORDS:
            sentences.append(line)
            line = []
    if line or not sentences:
        sentences.append(line)

    def of_word(w: bytes) -> float:
        marked, out = b"^" + w + b"$", float(model.words[M.bucket(np.array([M.hash_bytes(w)], np.uint64))[0]])
        for n in M.RUNS:
            for i in range(len(marked) - n + 1):
                h = 0
                for b in marked[i : i + n]:
                    h = (h * 257 + b + 1) % 2**64
                out += float(model.words[M.bucket(np.array([h * (2 * n + 1) % 2**64], np.uint64))[0]])
        return out

    best = -np.inf
    for line in sentences:
        bare = [w.lower().strip(M._EDGES) for w in line]
        pairs = {int(M.bucket(np.array([(M.hash_bytes(a) * 31 + M.hash_bytes(b) + 7) % 2**64], np.uint64))[0]) for a, b in zip(bare, bare[1:])}
        best = max(best, model.bias + sum(map(of_word, set(bare))) + sum(float(model.pairs[p]) for p in pairs))
    return float(M.logistic(np.array([best]))[0])


def random_model(seed=1):
    rng = np.random.default_rng(seed)
    return M.Model(rng.normal(0, 0.1, M.BUCKETS).astype(np.float32), rng.normal(0, 0.1, M.BUCKETS).astype(np.float32), -0.5)


def test_scores_are_those_of_a_plain_pass(spark, sf_dir):
    model = random_model()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.score for r in M.score_documents(docs, model).collect()}
    for r in docs.collect():
        assert abs(got[r.doc_id] - plain_score((r.text or "").encode(), model)) < 1e-5


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "w. " * 300_000), (None, "x y"), (4, "w. " * 300_000), (5, "... !"), (6, "é" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS id", "0 AS toxic")
    model = random_model()
    got = M.score_documents(docs, model).collect()
    assert len(got) == len(rows)
    assert {round(r.score, 9) for r in got if r.doc_id in (1, 2, 3)} == {round(float(M.logistic(np.array([model.bias]))[0]), 9)}
    assert len({r.score for r in got if r.doc_id == 4}) == 1 and {r.n_sentences for r in got if r.doc_id == 4} == {300_000}
    assert M.score_documents(docs.limit(0), model).count() == 0
    none = spark.createDataFrame([(4, 1), (1, None), (None, 0)], "doc_id long, toxic int")
    assert M.train(docs, none) is None
    assert {r.score for r in M.score_documents(docs, None).collect()} == {0.5}


def test_long_texts_in_pieces():
    rng, model = np.random.default_rng(5), random_model()
    for ends in (0.1, 0.0, 0.004):
        words = [f"w{i}".encode() + (b"." if rng.random() < ends else b"") for i in rng.integers(0, 500, 5_000)]
        text = b" ".join(words) + b" \n "
        whole = [x.item() for x in model.judge([text])]
        for size in (50, 700, 9_000):
            assert [x.item() for x in model.judge_long(text, size)] == whole
    for text in (b"", b"   ", b"a" * 4_000, b" " * 4_000):
        assert [x.item() for x in model.judge_long(text, 100)] == [x.item() for x in model.judge([text])]


def biased(rng, n):
    """Toxic lines often name one group; half of the harmless lines name the neutral words of its set."""
    filler = [f"word{i}" for i in range(60)]
    texts, y = [], []
    for i in range(n):
        toxic = i % 4 == 0
        line = list(rng.choice(filler, 12))
        if toxic:
            line[3] = str(rng.choice(["vile", "filthy", "rotten"]))
            if rng.random() < 0.8:
                line[4] = "muslims"
        elif rng.random() < 0.5:
            line[4] = str(rng.choice(["people", "believers"]))
        texts.append((" ".join(line) + ".").encode())
        y.append(float(toxic))
    return texts, np.array(y)


def test_swaps_draw_neutral_mentions_down():
    texts, y = biased(np.random.default_rng(2), 1_200)
    rng = np.random.default_rng(3)
    neutral = [(" ".join([*rng.choice([f"word{i}" for i in range(60)], 6), "muslims", "word3", "word9"]) + ".").encode() for _ in range(200)]
    fair, unfair = M.fit(texts, y), M.fit(texts, y, fairness=0)
    assert (unfair.probabilities(neutral) >= 0.5).mean() > (fair.probabilities(neutral) >= 0.5).mean() + 0.3
    assert (fair.probabilities(neutral) >= 0.5).mean() < 0.05
    # What the sentence says stays toxic, whomever it names.
    for who in (b"people", b"muslims", b"jews"):
        hostile = [b"word1 word2 word3 vile " + who + b" word5 word6." for _ in range(5)]
        assert (fair.probabilities(hostile) >= 0.5).all()
    gap = lambda m: abs(m.probabilities([b"word1 muslims word2."])[0] - m.probabilities([b"word1 people word2."])[0])
    assert gap(fair) < 0.3 * gap(unfair)


def test_swapped_sentences():
    s = M.cut([b"Some jews live here. Nobody else", b"", b"gay bars"])
    other, of, exchanged = M.swaps(s, (("jews", "hindus", "people"), ("gay", "other")))
    lines = [b" ".join(other.distinct[i] for i in other.ids[a:b]) for a, b in zip(other.starts, other.starts[1:])]
    assert lines == [b"some hindus live here", b"some people live here", b"other bars"]
    assert of.tolist() == [0, 0, 3] and [(other.distinct[i], other.distinct[j]) for i, j in exchanged] == [(b"jews", b"hindus"), (b"jews", b"people"), (b"gay", b"other")]


def test_held_out_accuracy(spark):
    rows = op13_fair_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p for y, p in held if y) >= 0.85 * sum(y for y, _ in held)
    assert sum(not p for y, p in held if not y) >= 0.99 * sum(not y for y, _ in held)
