import datetime
import hashlib
import io
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import answers as N
from millrace.operators import analytics as A
from millrace.operators import conversations as C
from millrace.operators import evaluation as E
from millrace.operators import indexing as I
from millrace.operators import retrieval as R
from millrace.operators.chunking import LEAST, OVERLAP, TARGET, chunk_files, line_windows, structural
from millrace.sources.files import read_archives, read_questions, read_tree

LINE = st.sampled_from(["", "  x = 1", "def f():", "}", "class A:", "const a = 1", "text", "export x", "　", "} // no"])


@given(st.lists(LINE, max_size=400))
@settings(max_examples=150, deadline=None)
def test_windows_cover_all_lines(lines):
    parts = line_windows(lines)
    assert [i for p in parts for i in range(p.start, p.end)] == sorted(i for p in parts for i in range(p.start, p.end)) or len(parts) > 1
    assert {i for p in parts for i in range(p.start, p.end)} == set(range(len(lines)))
    for a, b in zip(parts, parts[1:]):
        assert a.start < b.start <= a.end and b.start == max(a.start + 1, a.end - OVERLAP) and a.end - a.start >= LEAST


@given(st.lists(LINE, max_size=300), st.sampled_from(["py", "ts", None]))
@settings(max_examples=100, deadline=None)
def test_structural_chunks_cover_all_lines(lines, lang):
    assert {i for p in structural(lines, lang) for i in range(p.start, p.end)} == set(range(len(lines)))


def test_window_boundaries():
    plain = ["x"] * 100
    assert [(p.start, p.end) for p in line_windows(plain)] == [(0, 60), (45, 100)]
    plain[57] = ""  # ends after the blank line: 58, nearer than the declaration at 64
    plain[64] = "function f() {"
    assert line_windows(plain)[0].end == 58
    plain[62] = "}"
    plain[57] = "x"
    assert line_windows(plain)[0].end == 63
    tie = ["x"] * 100
    tie[58], tie[61] = "def a():", ""  # 58 and 62: the first of equally near ones
    assert line_windows(tie)[0].end == 58
    assert [p.end for p in line_windows(["x"] * TARGET)] == [TARGET]


def test_structure_of_python_and_typescript():
    code = ["import os", ""] + ["def long_one():"] + ["    x = 1"] * 34 + [""] + ["class A:"] + [f"    y{i} = 1" for i in range(40)] + ["    def m(self):"] + ["        pass"] * 30 + ["@deco", "def d():", "    pass"]
    names = [p.symbol for p in structural(code, "py")]
    assert "long_one" in names and "A.m" in names and "d" not in names
    ts = ["import a from './a'", "", "export class Shape {"] + ["  x = 1;"] * 35 + ["}", "", "export function area() {"] + ["  y();"] * 31 + ["}"]
    assert [p.symbol for p in structural(ts, "ts") if p.symbol] == ["Shape", "area"]
    assert structural(["def broken(:"], "py") == line_windows(["def broken(:"])


def test_chunk_rows(spark):
    lines = [f"line {i}" for i in range(200)]
    df = spark.createDataFrame([("p", "a.txt", lines), ("p", "b.txt", []), ("p", "c.txt", None)], "project_id string, path string, lines array<string>")
    rows = chunk_files(df, ["project_id", "path"]).orderBy("ord").collect()
    assert {r.path for r in rows} == {"a.txt"} and all(r.content == "\n".join(lines[r.start_line - 1 : r.end_line]) for r in rows)


@pytest.mark.parametrize(("rules", "path", "ignored"), [("*.log", "a/b.log", True), ("/x.txt", "a/x.txt", False), ("/x.txt", "x.txt", True), ("tmp/", "a/tmp/f", True), ("tmp/", "tmp", False), ("a/*.ts", "a/b.ts", True), ("a/*.ts", "z/a/b.ts", False), ("*.log\n!keep.log", "keep.log", False), ("# c\n\n*.x", "c", False), ("dir", "dir/sub/f", True)])
def test_ignore_rules(spark, rules, path, ignored):
    df = spark.createDataFrame([(path, [("", rules)])], "p string, l array<struct<dir:string,rules:string>>")
    assert df.select(I.gitignored("p", "l")).first()[0] is ignored


def test_walk_decisions(spark):
    rows = [("p", "src/a.ts", b"let a"), ("p", "node_modules/x.ts", b"x"), ("p", "src/gen/b.ts", b"x"), ("p", "src/gen/keep.ts", b"x"), ("p", "a.png", b"x"), ("p", "bin.ts", b"a\0b"), ("p", "min.ts", b"x" * 2001), ("p", "Makefile", b"all:"), ("p", "empty.ts", b""), ("p", "big.ts", b"y\n" * 131_073)]
    df = spark.createDataFrame(rows, "project_id string, path string, content binary").withColumn("size", F.octet_length("content"))
    ignore = spark.createDataFrame([("p", "", "gen/"), ("p", "src/gen", "!keep.ts")], "project_id string, dir string, rules string")
    got = {r.path: r.skip_reason for r in I.decide(df, ignore).collect()}
    assert got == {"src/a.ts": None, "src/gen/b.ts": "gitignored", "src/gen/keep.ts": "gitignored", "a.png": "extension", "bin.ts": "binary", "min.ts": "minified", "Makefile": None, "empty.ts": None, "big.ts": "too_large"}
    tally = I.skip_tally(I.decide(df, ignore)).first()
    assert tally.skip_reasons == {"gitignored": 2, "extension": 1, "binary": 1, "minified": 1, "too_large": 1} and tally.files_skipped == 6


def test_index_is_incremental(spark, tmp_path):
    old = spark.createDataFrame([("p", "a.py", "x = 1\n"), ("p", "b.py", "y = 2\n"), ("q", "c.py", "z\n")], "project_id string, path string, text string")
    none = spark.createDataFrame([], "project_id string, path string, content_hash string")
    files, chunks = I.build_index(old, none, I.build_chunks(old.limit(0)))
    vectors = chunks.select("chunk_id", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("vector"))
    embedded = I.set_embeddings(chunks, vectors, 2)
    new = spark.createDataFrame([("p", "a.py", "x = 1\n"), ("p", "b.py", "y = 3\n"), ("q", "d.py", "w\n")], "project_id string, path string, text string")
    _, now = I.build_index(new, files, embedded)
    assert {(r.path, r.embedding is not None) for r in now.collect()} == {("a.py", True), ("b.py", False), ("d.py", False)}
    I.write_index(now, f"{tmp_path}/chunks")
    I.write_index(now.filter("project_id = 'q'").withColumn("path", F.lit("e.py")), f"{tmp_path}/chunks")
    assert {(r.project_id, r.path) for r in spark.read.parquet(f"{tmp_path}/chunks").collect()} == {("p", "a.py"), ("p", "b.py"), ("q", "e.py")}
    with pytest.raises(Exception, match="wrong length"):
        I.set_embeddings(chunks, vectors, 3).collect()


def test_embedding_uses_the_cache(spark):
    files = spark.createDataFrame([("p", f"{i}.py", "same\n" if i < 3 else f"t{i}\n") for i in range(6)], "project_id string, path string, text string")
    chunks = I.build_chunks(files)
    cache = spark.createDataFrame([], "model_id string, text_hash string, embedding array<float>")
    done, fresh = I.embed_pending(chunks, cache, "m", 16, lambda: I.hashing_embedder(16))
    assert done.filter("size(embedding) = 16").count() == 6 and fresh.count() == 6

    def broken():
        raise RuntimeError("the model isn't needed")

    again, more = I.embed_pending(chunks, fresh.unionByName(fresh.limit(1).withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>"))), "m", 16, broken)
    assert again.filter("size(embedding) = 16").count() == 6


@given(st.lists(st.integers(0, 4500), max_size=60))
@settings(max_examples=100, deadline=None)
def test_batches_partition_the_rows(lengths):
    batches = I.batches_of(lengths)
    assert sorted(i for b in batches for i in b) == list(range(len(lengths)))
    assert all(len(b) == 1 or len(b) * max(lengths[i] for i in b) ** 2 <= I.BATCH_COST for b in batches)


def test_twelve_longest_inputs():
    assert [len(b) for b in I.batches_of([4500] * 12)] == [4, 4, 4]


def test_rank_fusion(spark):
    arms = spark.createDataFrame([(1, 0, 1.0, "x", 1), (1, 0, 1.0, "y", 2), (1, 0, 1.0, "z", 3), (1, 1, 1.0, "x", 1), (1, 1, 1.0, "z", 2), (2, 0, 1.0, "p", 1), (2, 0, 1.0, "q", 2), (2, 1, 0.5, "q", 1)], "query_id int, arm_no int, weight double, chunk_id string, rank int")
    got = {(r.query_id, r.chunk_id): r.score for r in R.fuse(arms, constant=1).collect()}
    assert got == {(1, "x"): 1.0, (1, "z"): 0.583333, (1, "y"): 0.333333, (2, "p"): 0.5, (2, "q"): 0.583333}


def test_canonical_chunks(spark):
    arms = spark.createDataFrame([(1, 0, 1, "v1", "a"), (1, 0, 2, "v2", "b"), (1, 1, 1, "f1", "b"), (1, 1, 2, "f2", "a")], "query_id int, arm_no int, rank int, chunk_id string, path string")
    assert {(r.path, r.canonical_id) for r in R.canonical(arms).collect()} == {("a", "v1"), ("b", "v2")}


def chunk_table(spark, texts):
    from millrace.functions.text import search_text

    df = spark.createDataFrame([("p", f"c{i:03d}", f"f{i}.ts", 1, 9, t) for i, t in enumerate(texts)], "project_id string, chunk_id string, path string, start_line int, end_line int, content string")
    return df.withColumn("search_text", search_text(F.col("content")))


def test_text_arms(spark):
    texts = ["function validateUser(u) {}", "revalidateUserToken()", "rate limit and limit", "rate, a limit", "x-y z"] + [f"filler {i}" for i in range(100)]
    chunks = chunk_table(spark, texts)
    refs = R.find_references(chunks, spark.createDataFrame([(1, "p", "validateUser"), (2, "other", "validateUser")], "query_id int, project_id string, symbol string")).collect()
    assert [(r.query_id, r.chunk_id) for r in refs] == [(1, "c000")]
    asked = spark.createDataFrame([(1, "p", "rate or limit limit"), (2, "p", "x-y"), (3, "p", "y-x"), (4, "p", "")], "query_id int, project_id string, text string")
    found = [(r.query_id, r.chunk_id, r.score) for r in R.fulltext_search(chunks, asked).orderBy("query_id", "rank").collect()]
    assert found == [(1, "c002", 0.6), (1, "c003", 0.4), (2, "c004", 0.2)]
    fuzzy = R.trigram_search(chunks, spark.createDataFrame([(1, "p", "who calls validateUsr here"), (2, "p", "plain words")], "query_id int, project_id string, text string")).collect()
    assert fuzzy and fuzzy[0].chunk_id == "c000" and {r.query_id for r in fuzzy} == {1}


def test_vector_arm_and_hybrid(spark):
    chunks = chunk_table(spark, ["alpha", "beta", "gamma"]).withColumn("embedding", F.when(F.col("chunk_id") != "c002", F.array(*[(F.col("chunk_id") == c).cast("float") for c in ("c000", "c001")])))
    asked = spark.createDataFrame([(1, "p", "beta", [0.1, 1.0]), (2, "q", "beta", [1.0, 0.0])], "query_id int, project_id string, text string, vector array<float>")
    got = [(r.query_id, r.chunk_id, r.rank) for r in R.vector_search(chunks, asked).orderBy("query_id", "rank").collect()]
    assert got == [(1, "c001", 1), (1, "c000", 2)]
    best = R.hybrid_search(chunks, asked, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.path) for r in best] == [("c001", "f1.ts"), ("c000", "f0.ts")]
    scopes = spark.createDataFrame([(1, "p"), (1, "missing")], "query_id int, project_id string")
    assert R.multi_project_search(chunks, asked, scopes).first().chunk_id == "c001"


def test_ann_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = rows.filter("vec_id % 50 = 0")
    near = R.ann_search(rows, asked, "vec_id", "embedding", 64, tables=32).collect()
    x = {r.vec_id: np.array(r.embedding) for r in rows.collect()}
    hits = sum(r.chunk_id in sorted((i for i in x if i != r.query_id), key=lambda i: -(x[i] @ x[r.query_id]))[:10] for r in near)
    assert hits >= 0.9 * 10 * asked.count()


def test_ranking_and_imports(spark):
    rows = [("p", "src/index.ts", "import { a } from './a'\nimport b from \"../lib/b\"\nimport r from 'react'"), ("p", "src/a.ts", "const x = require('./a.js'); from './a'"), ("p", "lib/b/index.ts", "from '../../src/a'"), ("p", "README.md", "# x"), ("p", "package.json", "{}")]
    files = spark.createDataFrame(rows, "project_id string, path string, content string")
    assert {(r.path, r.imports) for r in A.inbound_imports(files).collect()} == {("src/a.ts", 2), ("lib/b/index.ts", 1)}
    assert [(r.path, r.score) for r in A.rank_files(files).orderBy("rank").collect()] == [("lib/b/index.ts", 107), ("src/index.ts", 104), ("README.md", 60), ("package.json", 40), ("src/a.ts", 14)]


def test_digest(spark):
    files = spark.createDataFrame([("p", "src/a/x.ts", "ts"), ("p", "src/a/y.tsx", "tsx"), ("p", "z.py", "py")], "project_id string, path string, lang string")
    manifest = spark.createDataFrame([("p", '{"name": "n", "dependencies": {"react": "^17.0.1", "express": "x"}, "devDependencies": {"react": "^18.2.0", "jest": "~29"}, "scripts": {"build": "b", "test": "t"}}')], "project_id string, content string")
    readme = spark.createDataFrame([("p", "# N\n\nLead text.")], "project_id string, content string")
    assert A.repo_digest(files, manifest, readme).first().digest == "n — TypeScript. 3 files.\nTop dirs: src/a (2).\nDetected: React 18, Express, Jest 29.\nScripts: build, test.\n\nLead text."


def test_change_evidence(spark):
    chunks = chunk_table(spark, ["function alpha() {}", "uses alpha", "also alpha"]).withColumn("ord", F.lit(0)).withColumn("symbol", F.when(F.col("chunk_id") == "c000", "alpha"))
    changed = spark.createDataFrame([("c1", "p", "f0.ts", 0, False), ("c1", "p", "x.png", 1, True)], "change_id string, project_id string, path string, pos int, binary boolean")
    asked = A.changed_symbols(changed, chunks).withColumn("query_id", F.struct("change_id", "file_no"))
    refs = R.find_references(chunks, asked).select(F.col("query_id.change_id").alias("change_id"), F.col("query_id.file_no").alias("file_no"), "chunk_id", "path", "start_line", "end_line", "rank")
    got = A.change_evidence(changed, chunks, refs).orderBy("marker").collect()
    assert [(r.marker, r.path) for r in got] == [(1, "f0.ts"), (2, "f1.ts"), (3, "f2.ts")]
    lines = A.references_by_file(refs.withColumn("query_id", F.col("change_id"))).orderBy("path").collect()
    assert lines[0].line == "f0.ts: 1-9"


def test_exchanges_and_watermarks(spark):
    roles = ["user", "assistant", "system", "user", "user", "assistant", "user", "assistant", "user"]
    m = spark.createDataFrame([("c", f"m{i}", i, r, r) for i, r in enumerate(roles)], "conversation_id string, message_id string, pos int, role string, content string")
    pairs = C.exchanges(m)
    assert [(r.n, r.user_id) for r in pairs.orderBy("n").collect()] == [(1, "m0"), (2, "m4"), (3, "m6")]
    assert [r.n for r in C.recent_window(pairs, 2).orderBy("n").collect()] == [2, 3] and C.recent_window(pairs, 0).count() == 0
    mark = lambda a: spark.createDataFrame([("c", a)], "conversation_id string, assistant_id string")
    assert [r.n for r in C.evicted_exchanges(pairs, mark("m1"), 1).collect()] == [2] and C.evicted_exchanges(pairs, mark("gone"), 1).count() == 2
    times = m.withColumn("created_at", F.col("pos"))
    marks = spark.createDataFrame([("c", "m6")], "conversation_id string, message_id string")
    assert C.messages_after(times, marks).count() == 2 and C.messages_after(times, marks.withColumn("message_id", F.lit("?"))).count() == 9
    doc = C.export_conversations(spark.createDataFrame([("c", "A Title: " + "x" * 80)], "conversation_id string, title string"), m.limit(2)).first()
    assert doc.file_name == ("a-title-" + "x" * 80)[:60] + ".md" and doc.document.startswith("# A Title") and "## User\n\nuser\n\n## Assistant" in doc.document


def test_trees_archives_and_questions(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    for name, data in (("src/a.ts", b"x"), (".dot", b""), ("_u.md", b"y")):
        (root / name).write_bytes(data)
    got = read_tree(spark.createDataFrame([("p", f"file://{root}")], "project_id string, root string")).collect()
    assert {(r.path, r.size, bytes(r.content)) for r in got} == {("src/a.ts", 1, b"x"), (".dot", 0, b""), ("_u.md", 1, b"y")}

    def packed(names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, "data")
        return bytearray(out.getvalue())

    archives = spark.createDataFrame([("good", packed(["a/b.ts", "c"])), ("up", packed(["ok", "../x"])), ("abs", packed(["/etc/x"])), ("drive", packed(["C:/x"])), ("junk", bytearray(b"no zip"))], "project_id string, content binary")
    rows = read_archives(archives).collect()
    assert {(r.project_id, r.path) for r in rows if r.error is None} == {("good", "a/b.ts"), ("good", "c")} and {r.project_id for r in rows if r.error} == {"up", "abs", "drive", "junk"}
    (tmp_path / "q.json").write_text('[{"q": "a", "expectedFiles": ["x"]}, {"q": "b", "expectedFiles": [], "expectUnanswerable": true}]')
    assert {(r.q, tuple(r.expected), r.unanswerable) for r in read_questions(spark, str(tmp_path / "q.json")).collect()} == {("a", ("x",), False), ("b", (), True)}


def test_tree_hash_streams_sorted_lines(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [(p, f"{d}/{i}.py", None if i % 50 == 7 else f"h{i % 3}", "x") for p in ("a", "b", None) for d in ("src", "lib/x") for i in range(120)] + [("c", "only.py", None, "x")]
    files = spark.createDataFrame(rows, "project_id string, path string, content_hash string, tree_hash string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {r.project_id: r.tree_hash for r in I.tree_hash(files.repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for p in ("a", "b", None):
        own = {d: sorted((path, h) for q, path, h, _ in rows if q == p and h and path.rsplit("/", 1)[0] == d) for d in ("src", "lib/x")}
        want[p] = sha("\n".join(f"{d}:" + sha("\n".join(f"{a}:{b}" for a, b in own[d])) for d in sorted(own)))
    assert got == want | {"c": sha(":" + sha(""))}
    assert I.tree_hash(files.limit(0)).count() == 0


def test_evaluation_by_rows(spark):
    got = spark.createDataFrame([(1, "m", 1, "x"), (1, "m", 6, "a"), (1, "m", 11, "b"), (1, "m", 2, "x"), (2, "n", 1, "c"), (2, "n", 3, "c"), (1, "m", 3, None)], "query_id int, mode string, rank int, path string")
    asked = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, []), (4, None)], "query_id int, expected array<string>")
    rows = {(r.query_id, r.mode): (r.recall_5, r.recall_10, round(r.rr, 4)) for r in E.evaluate_retrieval(got, asked).collect()}
    assert rows[1, "m"] == (0.0, 0.5, 0.1667) and rows[2, "n"] == (1.0, 1.0, 1.0)
    assert rows[1, "n"] == (0.0, 0.0, 0.0) and rows[3, "m"] == rows[4, "n"] == (1.0, 1.0, 0.0)
    assert len(rows) == 8


def test_prompts_of_the_family(spark):
    pieces = "array(named_struct('marker', 1, 'path', 'p', 'start', 2, 'end', 3, 'content', 'code'))"
    turns = "array(named_struct('question', 'q1', 'answer', 'a1'), named_struct('question', 'q2', 'answer', 'a2'))"
    none = turns.replace("array(", "slice(array(", 1) + ", 1, 0)"
    diffs = "array(named_struct('path', 'p', 'insertions', 1, 'deletions', 0, 'patch', '+x'))"
    row = spark.range(1).selectExpr(f"{pieces} AS e", f"{turns} AS t", f"{none} AS none", f"{diffs} AS d", "'' AS empty", "cast(null AS string) AS nothing", "'Q?' AS q")
    c = F.col
    got = row.select(
        N.answer_prompt(c("empty"), F.lit("s"), c("t"), c("e"), c("q")), N.answer_prompt(c("nothing"), c("nothing"), c("none"), c("e"), c("q")),
        N.change_prompt(F.lit("abc"), F.lit("m"), c("d"), c("e")), N.tour_summary_prompt(F.array(F.lit("x"), F.lit("y"))), N.tool_block(c("e")), N.tool_block(c("e"), 9),
    ).first()
    block, said = "[1] p:2-3\ncode", "Q: q1\nA: a1\n\nQ: q2\nA: a2"
    assert got[0] == f"EARLIER IN THIS CONVERSATION:\ns\n\nRECENT TURNS:\n{said}\n\nCONTEXT:\n{block}\n\nQUESTION:\nQ?"
    assert got[1] == f"CONTEXT:\n{block}\n\nQUESTION:\nQ?"
    assert got[2] == f"COMMIT abc: m\n\nDIFF:\n--- p (+1/-0) ---\n+x\n\nCONTEXT ({N.CHANGE_CONTEXT}):\n{block}\n\n{N.CHANGE_REQUEST}"
    assert got[3] == "GROUP SUMMARIES:\nGroup 1:\nx\n\nGroup 2:\ny"
    assert got[4] == "[1] p:2-3\n```\ncode\n```"
    assert got[5] == "[1] p:2-3\n... [truncated]"


def test_jobs_of_projects(spark):
    at = lambda day, hour: datetime.datetime(2024, 1, day, hour)
    jobs = spark.createDataFrame([("p", 1, at(1, 5), "old", 7), ("p", 2, at(2, 5), "done", 3), ("p", 3, at(2, 5), "queued", 4), ("p", 4, at(2, 9), "later", 9)], "project_id string, job_id int, created_at timestamp, status string, embed_requests int")
    projects = spark.createDataFrame([("p", "ready"), ("q", "new")], "project_id string, status string")
    now = F.lit(at(2, 6))
    assert I.embed_requests_today(jobs, now).first().requests == 7
    assert I.embed_requests_today(jobs, F.lit(at(9, 6))).first().requests == 0
    got = {r.project_id: (r.status, r.job_status) for r in I.projects_with_latest_job(projects, jobs.filter("job_id < 4")).collect()}
    assert got == {"p": ("ready", "queued"), "q": ("new", None)}
    assert {(r.job_id, r.place) for r in I.newest_jobs(jobs, 2).collect()} == {(4, 1), (3, 2)}
