import re
from collections import Counter

from millrace.llm.queries_op1 import op1_quality_rules
from millrace.llm.quality_rules import Block, apply_rules, repeated_words, train


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def test_counts_against_brute_force(spark, tmp_path):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [None, "", "a b", "a a a a a", "x y z\nx y z\n\n \n \nx y z", "é\x1cé ü\x85ü nb\xa0sp", "w " * 60, "\n\n", "# $ <>" * 100, " ".join(map(str, range(30_000)))]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, texts[2])]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS kept", "2 AS id", "3 AS label").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = op1_quality_rules(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert not any(r.kept for r in got if r.base_failed)


def test_held_out_accuracy(spark):
    """Learned from three fifths of the labels, judged on the rest."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = train(docs, labels.filter("doc_id % 5 < 3"), rows=2500)
    rest = apply_rules(docs, model).join(labels.filter("doc_id % 5 >= 3"), "doc_id")
    rows = rest.selectExpr("quality", "kept", "base_failed", "probability").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in bad) > 0.85 * len(bad)
    assert sum(r.kept for r in good if not r.base_failed) > 0.97 * sum(not r.base_failed for r in good)
    assert abs(sum(r.probability for r in rows) / len(rows) - len(good) / len(rows)) < 0.03  # calibrated


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "w " * 60)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert train(docs, none) is None
    assert apply_rules(docs.limit(0), None).count() == 0
    assert [r.probability for r in apply_rules(docs, None).collect()] == [None]
    one = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert train(docs, one) is None


def test_windows_that_recur():
    assert repeated_words(Block([b"a b c d a b c e f g", b"a a a a", b"x y z", b""])) == [6, 4, 0, 0]
