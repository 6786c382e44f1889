"""The registered searches with all arms beside a plain version of each arm."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import indexing as I
from millrace.operators import retrieval as R
from millrace.operators.indexing import hashing_embedder
from millrace.operators.retrieval import word_similarity
from millrace.plans import registry

WORDS = "alpha beta gamma delta rate limit cache index queue token parse graph".split()


def lexemes(text):
    return re.findall(r"[^\W_]+", text.lower())


def searched(text):
    return text + "\n" + " ".join(re.findall(T.IDENTIFIER_PART, text))


def grams(text):
    return [g for w in lexemes(text) for p in [f"  {w} "] for g in (p[i : i + 3] for i in range(len(p) - 2))]


def places(scores, k):
    return [c for c, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]]


def chunk_id(project, path):
    return hashlib.sha256(f"{project}\0{path}\0000".encode()).hexdigest()


def hybrid(question, chunks, project="all"):
    """(chunk, score) of the ten best by the three arms. chunks: path -> content; ids are hashes. The questions have single terms only."""
    chunks = {chunk_id(project, p): (p, content) for p, content in chunks.items()}
    embed, fts, vector, fuzzy = hashing_embedder(64), {}, {}, {}
    asked = embed([("search_query: " + question)[: T.MODEL_CHARS]])[0].astype(float)
    terms = {t for w in question.split() for t in lexemes(w)} - {"or"}
    probe = list(dict.fromkeys(grams(" ".join(dict.fromkeys(re.findall(T.IDENTIFIER_TOKEN, question))))))
    for c, (path, content) in chunks.items():
        count = Counter(lexemes(searched(content)))
        if n := sum(min(count[t], 256) for t in terms):
            fts[c] = round(0.1 * n, 6)
        v = embed([f"search_document: // {path} lines 1-1\n{content}"[: T.MODEL_CHARS]])[0].astype(float)
        vector[c] = round(float(asked @ v / max(np.linalg.norm(asked) * np.linalg.norm(v), 1e-300)), 6)
        if probe and (s := round(word_similarity(probe, grams(searched(content))), 6)) >= 0.6:
            fuzzy[c] = s
    total, first = defaultdict(float), {}
    for arm, (scores, k, weight) in enumerate(((vector, 50, 1.0), (fts, 50, 1.0), (fuzzy, 25, 0.5))):
        for rank, c in enumerate(places(scores, k), 1):
            total[c] += weight / (60 + rank)
            first.setdefault(c, (arm, rank))
    best = sorted(total, key=lambda c: (-total[c], first[c], c))[:10]
    return [(chunks[c][0], round(total[c], 6)) for c in best], (set(vector) - set(fts), set(fuzzy) - set(fts))


def corpus(spark, folder):
    rng, rows = random.Random(5), []
    for i in range(90):
        name = f" call validateUserName{i % 9}" if i % 15 == 4 else ""
        rows.append((i, " ".join(rng.choices(WORDS, k=rng.randint(3, 25))) + name, "en", f"src{i % 6}"))
    questions = [(1, "rate limit of the cache"), (2, "where is validateUserNam4 defined"), (3, "graph or queue"), (4, "nothing known")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(questions, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {f"en/{i}.txt": (source, text) for i, text, _, source in rows}, questions


def test_hybrid_search_with_all_arms(spark, tmp_path):
    files, questions = corpus(spark, tmp_path)
    got = {(r.query_id, r.rank): (r.path, r.score) for r in registry.queries()["hybrid_search_all_arms"](spark, str(tmp_path)).collect()}
    want, only = {}, []
    for q, text in questions:
        best, lost = hybrid(text, {c: t for c, (_, t) in files.items()})
        want |= {(q, rank): row for rank, row in enumerate(best, 1)}
        only.append(lost)
    assert got == want
    assert any(v for v, _ in only) and any(f for _, f in only)  # rows that the full-text arm alone doesn't find


def test_multi_project_search_in_all_sources(spark, tmp_path):
    files, questions = corpus(spark, tmp_path)
    got = {(r.query_id, r.rank): (r.chunk_id, r.score, r.project_id) for r in registry.queries()["multi_project_search"](spark, str(tmp_path)).collect()}
    want = {}
    for q, text in questions:
        total, first = {}, {}
        for source in sorted({s for s, _ in files.values()}):
            for rank, (c, _) in enumerate(hybrid(text, {c: t for c, (s, t) in files.items() if s == source}, source)[0], 1):
                total[c], first[c] = 1 / (60 + rank), (source, rank)
        best = sorted(total, key=lambda c: (-total[c], first[c], c))[:10]
        want |= {(q, rank): (chunk_id(files[c][0], c), round(total[c], 6), files[c][0]) for rank, c in enumerate(best, 1)}
    assert got == want
    assert {p for _, _, p in got.values()} > {"src0", "src1", "src2"}


def recall(rows, found, k=10):
    """Share of the exact k nearest rows of each query, itself left out. found: (query, id)."""
    x = {r.vec_id: np.array(r.embedding, float) for r in rows}
    ids = np.array(sorted(x))
    m = np.array([x[i] / np.linalg.norm(x[i]) for i in ids])
    hits, n = 0, 0
    for q in {q for q, _ in found}:
        s = m @ x[q]
        s[ids == q] = -9
        hits += len(set(ids[np.argsort(-s)[:k]].tolist()) & {i for a, i in found if a == q})
        n += k
    return hits / n


def test_registered_ann_search(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    found = [(r.query_id, r.chunk_id) for r in registry.queries()["ann_search"](spark, sf).collect()]
    assert {q for q, _ in found} == {r.vec_id for r in rows if r.vec_id % 20 == 0}
    assert recall(rows, found) >= 0.9


def test_vector_search_of_every_twentieth_row(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in registry.queries()["vector_search_20"](spark, sf).collect()}
    want = {}
    for q in rows:
        if q.vec_id % 20 == 0:
            a = np.array(q.embedding, float)
            near = sorted((-round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 6), r.vec_id) for r in rows if r.label == q.label for b in [np.array(r.embedding, float)])[:20]
            want |= {(q.vec_id, rank): (c, -s) for rank, (s, c) in enumerate(near, 1)}
    assert {k: c for k, (c, _) in got.items()} == {k: c for k, (c, _) in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_quality_of_each_arm(spark, tmp_path):
    files, _ = corpus(spark, tmp_path)
    texts = {p: text for p, (_, text) in files.items()}
    long = [p for p, text in texts.items() if len(text.split()) >= 12]
    questions = [(i, " ".join(texts[p].split()[2:11])) for i, p in enumerate(long[:6])] + [(90, "no such words in any file of this corpus at all"), (91, "short one")]
    spark.createDataFrame(questions, "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    runs = lambda text: {tuple(text.split()[i : i + 8]) for i in range(len(text.split()) - 7)}
    want = {q: {p for p in texts if runs(texts[p]) & runs(asked)} for q, asked in questions}
    want = {q: paths for q, paths in want.items() if paths}
    assert set(want) == set(range(6))
    r5, r10, mrr = [], [], []
    for q, paths in want.items():
        best = [c for c, _ in hybrid(dict(questions)[q], texts)[0]]
        r5.append(len(paths & set(best[:5])) / len(paths))
        r10.append(len(paths & set(best)) / len(paths))
        mrr.append(next((1 / n for n, c in enumerate(best, 1) if c in paths), 0))
    got = {r.mode: r for r in registry.queries()["retrieval_quality"](spark, str(tmp_path)).collect()}
    assert set(got) == {"fts", "vector", "trigram", "hybrid"} or set(got) == {"fts", "vector", "hybrid"}
    h = got["hybrid"]
    assert h.questions == 6
    assert [h.recall_5, h.recall_10, h.mrr] == [round(sum(x) / 6, 6) for x in (r5, r10, mrr)]
    # Whole files instead of chunks: the same rows here, but ties by path.
    assert registry.queries()["fulltext_quality"](spark, str(tmp_path)).first().questions == 6


def test_vectors_that_are_no_numbers_take_no_place(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])]
    bad = [(4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, None), (8, [-inf, nan])]
    kind = "id int, v array<double>"
    chunks = spark.createDataFrame(good + bad, kind).selectExpr("id AS chunk_id", "'p' AS project_id", "v AS embedding").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), *bad], kind).selectExpr("id AS query_id", "'p' AS project_id", "v AS vector")
    assert [(r.query_id, r.chunk_id) for r in R.vector_search(chunks, queries, 2).orderBy("rank").collect()] == [(1, 1), (1, 2)]
    table = spark.createDataFrame(good + bad, kind)
    for tables in (1, 16):
        found = R.ann_search(table, table, "id", "v", 2, 2, tables, 1, 4)
        assert {(r.query_id, r.chunk_id) for r in found.collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}


def test_whole_texts_are_embedded(spark):
    text = " ".join(f"word{i}" for i in range(3_000)) + " " + "x" * 9_000 + " end"
    files = spark.createDataFrame([("p", "a.txt", text), ("p", "b.txt", "short"), ("p", "c.txt", "")], "project_id string, path string, text string")
    whole = I.build_chunks(files)
    parts = I.fitting_chunks(whole)
    assert parts.columns == whole.columns and parts.filter("char_length(content) > 4000").isEmpty()
    for path, t in (("a.txt", text), ("b.txt", "short")):
        own = [r.content for r in parts.filter(F.col("path") == path).collect()]
        assert sum(map(len, own)) == len(t) and all(c in t for c in own)
    assert parts.select("chunk_id").distinct().count() == parts.count() and whole.join(parts, "chunk_id").count() == whole.count()


@pytest.mark.parametrize("bits, probes", [(3, 1), (4, 11)])
def test_ann_search_looks_into_its_buckets_and_no_others(spark, monkeypatch, bits, probes):
    """Blocks of a few rows, copies, ties, a zero vector, odd lengths, null ids and parts, beside a plain version."""
    monkeypatch.setattr(R, "MEET_ROWS", 20)
    monkeypatch.setattr(R, "MEET_QUERIES", 5)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(120, 8)), 1)
    x[60:90], x[5] = x[59], 0  # a hot bucket
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(200, [1.0]), (201, None), (None, x[0].tolist()), (202, [None, *x[0, 1:].tolist()])]
    table = spark.createDataFrame(rows + odd, "id int, vec array<double>").withColumn("v", F.lit("extra")).withColumn("bucket", F.lit(1))
    asked = table.filter("id % 10 = 0 OR id = 5 OR id IS NULL")
    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in R.ann_search(table, asked, "id", "vec", 8, 4, 5, bits, probes).collect()}
    planes, want = R.hyperplanes(8, 5, bits), {}
    own, met = R.bucket_keys(x, planes)[:, :, 0], R.bucket_keys(x, planes, probes)
    for q in [*range(0, 120, 10), 5]:
        near = [i for i in range(120) if i != q and any(own[i, t] in met[q, t] for t in range(5))]
        cos = {i: float(x[i] @ x[q] / max(np.linalg.norm(x[i]) * np.linalg.norm(x[q]), 1e-300)) for i in near}
        best = sorted(near, key=lambda i: (-round(cos[i], 6) + 0.0, i))[:4]
        want |= {(q, rank): (i, round(cos[i], 6)) for rank, i in enumerate(best, 1)}
    assert {k: c for k, (c, _) in got.items()} == {k: c for k, (c, _) in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_ann_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "id int, vec array<float>")
    assert R.ann_search(none, none, "id", "vec", 8).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id int, vec array<float>")
    assert R.ann_search(one, one, "id", "vec", 2).count() == 0


def test_blocks_of_trigrams_lose_no_run():
    rng = random.Random(6)
    names = ["validateUser", "rateLimitOfCache", "aaaa", "parseGraphNode", "ab"]
    probes = [list(dict.fromkeys(grams(n))) for n in names]
    texts = []
    for i in range(60):
        words = [rng.choice(WORDS + ["aaaaaaaaaaaa", "abab", "valid", "user", "rate", "limit"]) for _ in range(rng.choice((0, 3, 150, 400)))]
        for n in names:
            if rng.random() < 0.4:
                at = rng.randrange(len(n))
                words.insert(rng.randint(0, len(words)), n[:at] + n[at + 1 :])
        texts.append(words + ["a" * 600] * (i % 7 == 0) + ["no no no"] * (100 * (i % 11 == 0)))
    texts = [[w for x in t for w in lexemes(x)] for t in texts]
    made = R.Probes(probes, 0.6)
    got, scored = made.scores(pa.array(texts, pa.list_(pa.string())))
    for i, t in enumerate(texts):
        whole = [g for w in t for p in [f"  {w} "] for g in (p[j : j + 3] for j in range(len(p) - 2))]
        for q, p in enumerate(probes):
            want = word_similarity(p, whole)
            assert got[i, q] == pytest.approx(round(want, 6) if want >= 0.6 else got[i, q], abs=2e-6) and (got[i, q] >= 0.6) == (want >= 0.6)
    assert (got >= 0.6).sum() > 50
    blocks = sum(max(1, sum(len(w) + 1 for w in t) // made.reach) for t in texts)
    assert scored < 0.2 * blocks * len(probes)


def test_queries_in_blocks_of_their_projects(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"p{i % 12}", f"c{i:04}", f"word{i % 7} word{i % 5} other") for i in range(600)], "project_id string, chunk_id string, search_text string")
    asked = [(f"q{i}", f"p{i % 11}", f"word{i % 7} other") for i in range(55)] + [(f"h{i}", "p11", f"word{i % 6}") for i in range(60)] + [("gone", "no chunks", "other"), ("null", None, "other")]
    queries = spark.createDataFrame(asked, "query_id string, project_id string, text string")
    want = sorted(R.fulltext_search(chunks, queries, 3).collect())
    monkeypatch.setattr(R, "BROADCAST_QUERIES", 20)
    blocks = {}
    for r in R.query_blocks(queries, len(asked)).collect():
        blocks.setdefault(r.project_id, set()).add(r["__block"])
    assert all(len(b) == 1 for p, b in blocks.items() if p != "p11") and 1 < len(blocks["p11"]) <= 6
    assert len({b for own in blocks.values() for b in own}) > 6
    assert sorted(R.fulltext_search(chunks, queries, 3).collect()) == want


def test_repeated_query_ids_end(spark, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_QUERIES", 5)
    monkeypatch.setattr(R, "MOST_LEVELS", 2)
    chunks = spark.createDataFrame([("p", "c", "a b")], "project_id string, chunk_id string, search_text string")
    queries = spark.createDataFrame([("q", "p", "a")] * 12, "query_id string, project_id string, text string")
    assert {r.chunk_id for r in R.fulltext_search(chunks, queries, 3).collect()} == {"c"}
