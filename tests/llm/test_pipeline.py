"""run() beside a plain version of each stage on one machine."""

import base64
import hashlib
from collections import defaultdict

import public_tokenizers
import tiktoken
from test_hyperminhash import brute
from test_secrets import KINDS

import corpus_pipeline
from millrace.llm.mixing import MOST, SEED, SHARE, WEIGHTS
from millrace.llm.passage_attention import scores, train


def masked(text):
    spans = sorted((a, b) for f in KINDS.values() for a, b in f(text or ""))
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], "[REDACTED]"]
        at = max(at, b)
    return "".join([*out, (text or "")[at:]])


def copies(rows):
    """Targets by sharing out again and again what lies above the bound."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), SHARE * sum(sizes.values())
    while left > 1e-6 and free:
        total, over = sum(weight[s] for s in free), 0.0
        for s in list(free):
            target[s] += left * weight[s] / total
            if target[s] >= MOST * sizes[s]:
                over += target[s] - MOST * sizes[s]
                target[s] = MOST * sizes[s]
                free.remove(s)
        left = over
    out = []
    for r in rows:
        rate = target[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        rate = 2.0 if abs(rate - 2) < 1e-9 else rate
        u = int(hashlib.sha256(f"{SEED}:{'' if r['doc_id'] is None else r['doc_id']}:{r['text'] or ''}".encode()).hexdigest()[:13], 16) / 2**52
        out += [r] * (int(rate) + (u < rate - int(rate)))
    return out


def test_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    score = scores([(r["text"] or "").encode() for r in rows], model)[0]
    good = [r for r, s in zip(rows, score, strict=True) if s >= corpus_pipeline.QUALITY_FROM]
    assert 0.7 * len(rows) < len(good) < len(rows)
    keep = {i for i, _, _, k in brute([(r["doc_id"], r["text"]) for r in good], 5) if k}
    unique = [r | {"text": masked(r["text"])} for r in good if r["doc_id"] in keep]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    want = []
    for r in copies(unique):
        ids = library.encode_ordinary(r["text"])
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(want)


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    rows = [(1, "w " * 40, "en", "a", 80, "x"), (1, "w " * 40, "en", "a", 80, "x"), (1, "other text of this id " * 9, "en", "a", 9, "y"), (None, None, None, None, None, None), (None, "", "", "", 0, ""), (2, "token = abcdefgh12345", "en", None, 21, "z"), (3, "q" * 70_000, "en", "b", 70_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string")
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, str(tmp_path))
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out.collect()
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 0, 1, 1, 2, 3]
    assert [r.text for r in corpus_pipeline.secret_scan(spark, docs, "").filter("doc_id = 2").collect()] == ["[REDACTED]"]
    assert corpus_pipeline.quality_classifier(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    a, b = text("a"), text("b")
    near_a, near_b = a + " more", b + " more"
    kept = lambda rows: sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert kept([(1, a), (5, near_a), (1, b), (0, near_b)]) == [(0, near_b), (1, a)]
    assert kept([(1, text("c")), (1, text("d")), (2, text("e"))]) == sorted([(1, text("c")), (1, text("d")), (2, text("e"))])
    assert [i for i, _ in kept([(1, a), (1, near_a), (1, a), (7, a)])] == [1]
    assert kept([(3, ""), (3, ""), (3, b), (4, near_b)]) == [(3, ""), (3, b)]
