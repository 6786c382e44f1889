"""Queries on walks, chunk boundaries, caches, snapshots and written indexes; their inputs are made from the rows' numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import evaluation as E
from ..operators import indexing as I
from ..operators import ranges as G
from ..operators import retrieval as R
from ..operators.snapshots import apply_batch, read_snapshot
from ..operators.storage import shared_root, stored
from ..sources.files import read_questions
from .corpus import _BEFORE, _STATE, _before, named
from .derive import FILES, LINES, files, jobs, table, whole_chunks
from .questions import _TEXT_HITS, passages

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# One path in eight for each way in which a walk may leave a file out, and one that it takes.
_WALKED = ("src/a{}.ts", "gen/a{}.ts", "src/tmp/x{}.ts", "src/keep{}.log.ts", "node_modules/x{}.ts", "src/b{}.exe", "src/c{}.ts", "src/d{}/yarn.lock")
_RULES = (("", "# made files\n/gen/\n*.log.ts\n"), ("src", "tmp/\n!keep*.log.ts\n"))


@query(f"""WITH w AS (SELECT source AS project_id, doc_id % 8 AS shape, replace(({list(_WALKED)})[1 + doc_id % 8], '{{}}', doc_id::VARCHAR) AS path,
  CASE WHEN doc_id % 8 = 6 THEN 'x' || chr(0) ELSE '' END || text AS body FROM documents WHERE doc_id % 8 <> 4),
n AS (SELECT *, CASE WHEN contains(replace(body, chr(13) || chr(10), chr(10)), chr(10)) THEN replace(body, chr(13) || chr(10), chr(10)) ELSE replace(body, chr(13), chr(10)) END AS t FROM w)
SELECT project_id, path, CASE WHEN shape IN (1, 2, 3) THEN 'gitignored' WHEN shape = 7 THEN 'filename' WHEN shape = 5 THEN 'extension' WHEN strlen(body) > 262144 THEN 'too_large'
  WHEN shape = 6 THEN 'binary' WHEN list_max(list_transform(string_split(t, chr(10)), lambda x: length(x))) > 2000 THEN 'minified' END AS skip_reason FROM n""")
def walk_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filter of a walk in its order: ignore files of two levels, names, extensions, sizes, bytes and lines."""
    d = table(spark, sf_dir, "documents")
    path = F.replace(F.get(F.array(*map(F.lit, _WALKED)), (F.col("doc_id") % 8).cast("int")), F.lit("{}"), F.col("doc_id").cast("string"))
    body = F.concat(F.when(F.col("doc_id") % 8 == 6, "x\x00").otherwise(""), "text").cast("binary")
    walked = d.select(F.col("source").alias("project_id"), path.alias("path"), body.alias("content")).withColumn("size", F.octet_length("content"))
    rules = F.explode(F.array(*[F.struct(F.lit(a).alias("dir"), F.lit(b).alias("rules")) for a, b in _RULES])).alias("r")
    ignore_files = d.select(F.col("source").alias("project_id")).distinct().select("project_id", rules).select("project_id", "r.*")
    return I.decide(walked, ignore_files).select("project_id", "path", "skip_reason")



def _window_end(a: str) -> str:
    """Where the window that starts after line `a` ends: at the mark nearest to its full length, the first of equally near ones."""
    near = f"list_filter(list_transform(marks[{a} + 41 : least(n, {a} + 80)], lambda m, i: [abs(m - {a} - 60), i, m]), lambda c: c[3] > {a})"
    return f"CAST(CASE WHEN {a} + 60 >= n THEN n ELSE coalesce(list_sort({near})[1][3], {a} + 60) END AS BIGINT)"


_DECLARATION, _ENDING = r"^\s*(export |function |class |def |const \w+ = )", r"^(\}\s*|\s*)$"
_WINDOWS = f"""{FILES}, lined AS (SELECT project_id, path, {LINES.format("text")} AS l FROM files WHERE text IS NOT NULL),
marked AS (SELECT project_id, path, len(l) AS n, CAST(0 AS BIGINT) AS b,
  list_transform(l, lambda x, i: CASE WHEN regexp_matches(x, '{_DECLARATION}') THEN i - 1 WHEN regexp_matches(x, '{_ENDING}') THEN i END) AS marks FROM lined),
steps AS (WITH RECURSIVE s AS (SELECT project_id, path, n, marks, 0 AS ord, b AS a, {_window_end("b")} AS e FROM marked WHERE n > 0
  UNION ALL SELECT project_id, path, n, marks, ord + 1, b, {_window_end("b")} FROM (SELECT *, greatest(a + 1, e - 15) AS b FROM s WHERE e < n)) SELECT * FROM s),
chunks AS (SELECT s.project_id, s.path, CAST(ord AS INTEGER) AS ord, CAST(a + 1 AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line,
  array_to_string(l[a + 1 : e], chr(10)) AS content FROM steps s JOIN lined USING (project_id, path))"""


@query(f"WITH {_WINDOWS} SELECT project_id, path, ord, start_line, end_line, sha256(content) AS content_hash FROM chunks")
def line_windows(spark, sf_dir):
    """Windows of lines over all files, beside a recursion over their ends."""
    return I.build_chunks(files(spark, sf_dir)).select("project_id", "path", "ord", "start_line", "end_line", "content_hash")


_CITED = "(1 + doc_id % 40)::INTEGER AS range_start, (1 + doc_id % 40 + doc_id % 90)::INTEGER AS range_end"


@query(f"""WITH {_WINDOWS}, cited AS (SELECT project_id, path, {_CITED} FROM files)
SELECT project_id, path, range_start, range_end, ord, start_line, end_line FROM cited JOIN chunks USING (project_id, path) WHERE range_start <= end_line AND start_line <= range_end""")
def overlapping_chunks(spark, sf_dir):
    """A cited range of every file, and all chunks that have a line of it."""
    chunks = I.build_chunks(files(spark, sf_dir)).select("project_id", "path", F.col("ord").alias("chunk_id"), "start_line", "end_line")
    met = G.overlapping_chunks(_cited(spark, sf_dir), chunks)
    return met.toDF("project_id", "path", "range_start", "range_end", "ord", "start_line", "end_line")


@query(f"""WITH {FILES}, cited AS (SELECT project_id, path, {_CITED}, string_split(text, chr(10)) AS l FROM files WHERE text IS NOT NULL)
SELECT project_id, path, range_start, range_end, array_to_string(l[range_start : range_end], chr(10)) AS content FROM cited""")
def range_texts(spark, sf_dir):
    """The text of a cited range of every file, from blocks of lines."""
    texts = G.range_texts(_cited(spark, sf_dir), stored(G.line_blocks(files(spark, sf_dir))))
    return texts.toDF("project_id", "path", "range_start", "range_end", "content")


def _cited(spark, sf_dir):
    first = 1 + F.col("doc_id") % 40
    return files(spark, sf_dir).select("project_id", "path", first.cast("int").alias("start_line"), (first + F.col("doc_id") % 90).cast("int").alias("end_line"))


@query(f"WITH {_WINDOWS} SELECT project_id, path, ord, start_line, end_line, sha256(content) AS content_hash FROM chunks")
def next_index(spark, sf_dir):
    """The chunks of an index that lacked, had changed and had kept files: those of all files as they are now, none of files gone since."""
    now = files(spark, sf_dir)
    _, before = _before(spark, sf_dir)
    gone = before.filter("startswith(path, 'gone/')").select("project_id", "path", F.lit("x").alias("text"))
    old = I.build_chunks(now.filter("doc_id % 11 <> 0").select("project_id", "path", "text").unionByName(gone))
    state = I.build_index(now.select("project_id", "path", "text"), before, old)[1]
    return state.select("project_id", "path", "ord", "start_line", "end_line", "content_hash")


_CHANGED = f"""{FILES.replace("files AS", "all_files AS", 1)},
files AS (SELECT doc_id, project_id, path, lang, CASE WHEN doc_id % 10 = 3 THEN text || chr(10) || 'changed' ELSE text END AS text FROM all_files WHERE project_id IS DISTINCT FROM 'src0')"""
_SNAPSHOT = f"WITH {_WINDOWS.replace(FILES, _CHANGED)} SELECT project_id, path, ord, start_line, end_line, sha256(content) AS content_hash FROM chunks WHERE project_id IS NOT NULL"


def _batches(spark, sf_dir):
    """(all files, some with other texts, one project's files gone)."""
    now = files(spark, sf_dir)
    changed = now.filter("doc_id % 10 = 3").withColumn("text", F.concat("text", F.lit("\nchanged")))
    gone = now.filter("project_id = 'src0'").withColumn("text", F.lit(None).cast("string"))
    return [b.select("project_id", "path", "text") for b in (now, changed, gone)]


def _snapshot(spark, folder):
    return read_snapshot(spark, folder, "chunks").select("project_id", "path", "ord", "start_line", "end_line", "content_hash")


@query(_SNAPSHOT)
def versioned_index(spark, sf_dir):
    """Chunks of the third snapshot: after all files, changed ones, and a project that was emptied."""
    folder = f"{shared_root(spark)}/index-{uuid.uuid4().hex}"
    for batch in _batches(spark, sf_dir):
        apply_batch(spark, folder, batch)
    return _snapshot(spark, folder)


@query(_SNAPSHOT)
def continuous_index(spark, sf_dir):
    """The same by a stream's batches, of which each comes twice, the second time with other texts: what was applied stays."""
    folder = f"{shared_root(spark)}/index-{uuid.uuid4().hex}"
    for number, batch in enumerate(_batches(spark, sf_dir)):
        apply_batch(spark, folder, batch, "files", number)
        apply_batch(spark, folder, batch.withColumn("text", F.lit("replayed")), "files", number)
    return _snapshot(spark, folder)


@query(f"WITH {_WINDOWS} SELECT project_id, path, end_line, sha256(content) AS h FROM chunks WHERE ord = 0")
def first_chunks(spark, sf_dir):
    return I.first_chunks(I.build_chunks(files(spark, sf_dir))).select("project_id", "path", "end_line", T.sha256(F.col("content")).alias("h"))


@query("""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ts' ELSE 'py' END AS lang, 10 + doc_id % 70 AS n FROM documents)
SELECT 'p' || doc_id AS path, 0 AS ord, 1 AS start_line, CAST(n + 2 AS INTEGER) AS end_line, 'f' || doc_id AS symbol FROM c WHERE n < 30
UNION ALL SELECT 'p' || doc_id, 0, 1, 2, NULL FROM c WHERE n >= 30
UNION ALL SELECT 'p' || doc_id, 1, 3, CAST(CASE WHEN lang = 'ts' THEN n + 2 ELSE least(n + 2, 62) END AS INTEGER), 'f' || doc_id FROM c WHERE n >= 30
UNION ALL SELECT 'p' || doc_id, 2, 48, CAST(n + 2 AS INTEGER), 'f' || doc_id FROM c WHERE n > 60 AND lang = 'py'""")
def structural_chunks(spark, sf_dir):
    """A function of 10 to 79 lines after two others, in two languages: short ones join what is before them, long ones are cut into
    windows, of which the closing brace ends the first in one language."""
    n, lines = F.col("doc_id"), (10 + F.col("doc_id") % 70).cast("int")
    name, script = F.concat(F.lit("f"), n.cast("string")), n % 2 == 0
    head = F.when(script, F.concat(F.lit("export function "), name, F.lit("() {\n"))).otherwise(F.concat(F.lit("def "), name, F.lit("():\n")))
    body = F.when(script, F.concat(F.repeat(F.lit("  y();\n"), lines - 2), F.lit("}"))).otherwise(F.repeat(F.lit("    y()\n"), lines - 1))
    first = F.when(script, "import a from './a'\nimport b from './b'\n").otherwise("import a\nimport b\n")
    rows = table(spark, sf_dir, "documents").select(F.lit("p").alias("project_id"), F.concat(F.lit("p"), n.cast("string")).alias("path"), F.when(script, "ts").otherwise("py").alias("lang"), F.concat(first, head, body).alias("text"))
    return I.build_chunks(rows, "lang").select("path", "ord", "start_line", "end_line", "symbol")


# A class of 66 lines or more: a head with a field, a long method, a decorated one and a short one.
_CLASS = """import {{ a }} from './a'
export class C{0} extends Base<{{ x: 1 }}> {{
  field = {{ text: `}} ${{a ? '}}' : `{{`}}` }}
  long(b: {{ c: string }} = {{ c: '}}' }}): {{ d: number }} {{
{1}
  }}
  @Get('/{{')
  async other<T>(x: T): Promise<T> {{
    return x // }}
  }}
  last() {{ return /[}}]/.test('') }}
}}"""


@query("""WITH c AS (SELECT doc_id, 52 + doc_id % 5 AS n FROM documents)
SELECT 'p' || doc_id AS path, o AS ord, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line, 'C' || doc_id || s AS symbol
FROM c, unnest([{'o': 0, 'a': 1, 'b': 3, 's': ''}, {'o': 1, 'a': 4, 'b': n + 4, 's': '.long'}, {'o': 2, 'a': n + 5, 'b': n + 5, 's': ''},
  {'o': 3, 'a': n + 6, 'b': n + 8, 's': '.other'}, {'o': 4, 'a': n + 9, 'b': n + 9, 's': '.last'}, {'o': 5, 'a': n + 10, 'b': n + 10, 's': ''}]) u(r), (SELECT r.o AS o, r.a AS a, r.b AS b, r.s AS s)""")
def class_methods(spark, sf_dir):
    """Methods of a class of more than 60 lines; braces in strings, templates, comments, types and expressions count for nothing."""
    n = (52 + F.col("doc_id") % 5).cast("int")
    head, tail = _CLASS.split("{1}")
    name = F.col("doc_id").cast("string")
    parts = [F.lit(p.replace("{{", "{").replace("}}", "}")) for p in (*head.split("{0}"), tail)]
    text = F.concat(parts[0], name, parts[1], F.array_join(F.array_repeat(F.lit("    y({"), n - 1), "})\n"), F.lit("})"), parts[2])
    rows = table(spark, sf_dir, "documents").select(F.lit("p").alias("project_id"), F.concat(F.lit("p"), name).alias("path"), F.lit("ts").alias("lang"), text.alias("text"))
    return I.build_chunks(rows, "lang").select("path", "ord", "start_line", "end_line", "symbol")


@query(r"""WITH t AS (SELECT path, text || ' ' || regexp_extract(text, '([a-z]+) ([a-z]+)', 1) || upper(substr(regexp_extract(text, '([a-z]+) ([a-z]+)', 2), 1, 1)) || substr(regexp_extract(text, '([a-z]+) ([a-z]+)', 2), 2) || ' XMLHttpRequest RATE_LIMIT_MS svc.call(' AS t FROM files)
SELECT path, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\b[a-z]+[A-Z][A-Za-z0-9_]*|\b[A-Z_]{3,}\b|\b[A-Za-z0-9_]+\.[A-Za-z0-9_]+\('))), ' ') AS tokens FROM t""".replace("WITH t AS", f"WITH {FILES}, t AS", 1))
def identifier_tokens(spark, sf_dir):
    """Words shaped like identifiers; the look-arounds are ASCII word boundaries in SQL."""
    tokens = T.identifier_tokens(named(F.col("text")))
    return files(spark, sf_dir).select("path", F.array_join(F.array_sort(tokens), " ").alias("tokens"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 NOT IN (1, 2) AND e.vec_id IS NOT NULL THEN len(e.embedding) END AS dim, doc_id % 5 NOT IN (1, 2) AND e.vec_id IS NOT NULL AS hit
FROM documents LEFT JOIN embeddings e ON doc_id = e.vec_id""")
def cached_vectors(spark, sf_dir):
    """A cache in which vectors of another length, and another model's, are misses."""
    number = F.col("vec_id")
    model = F.when(number % 5 == 2, "other").otherwise("m")
    vector = F.when(number % 5 == 1, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    cache = table(spark, sf_dir, "embeddings").select(model.alias("model_id"), number.cast("string").alias("text_hash"), vector.alias("embedding"))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("text_hash"))
    found = I.cached_vectors(texts, cache, "m", 64)
    return found.select("doc_id", F.when(F.col("vector").isNotNull(), F.size("vector")).cast("long").alias("dim"), F.col("vector").isNotNull().alias("hit"))


@query("SELECT vec_id::VARCHAR AS text_hash, CASE WHEN vec_id % 5 = 2 THEN 'other' ELSE 'm' END AS model_id FROM embeddings WHERE vec_id % 5 <> 1")
def purged_cache(spark, sf_dir):
    """The cache without one model's vectors of another length."""
    number = F.col("vec_id")
    vector = F.when(number % 5 == 1, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    cache = table(spark, sf_dir, "embeddings").select(F.when(number % 5 == 2, "other").otherwise("m").alias("model_id"), number.cast("string").alias("text_hash"), vector.alias("embedding"))
    return I.purged_cache(cache, "m", 64).select("text_hash", "model_id")


@query("""SELECT doc_id::VARCHAR AS project_id, CASE doc_id % 4 WHEN 0 THEN 'React ' || (CASE WHEN doc_id % 3 = 0 THEN 19 ELSE doc_id % 20 END) || ', PostgreSQL 8'
  WHEN 1 THEN 'Vitest' WHEN 2 THEN 'React 17, Next.js ' || (doc_id % 20) END AS found FROM documents WHERE doc_id % 4 < 3""")
def frameworks(spark, sf_dir):
    """Manifests of four shapes: the development range wins, no number in the range, two names of one label, nothing known."""
    n = F.col("doc_id")
    major = (n % 20).cast("string")
    first = F.format_string('{"dependencies": {"pg": "8", "react": "^%s.2.0"}, "devDependencies": {%s}}', major, F.when(n % 3 == 0, '"react": "19.0"').otherwise(""))
    third = F.format_string('{"dependencies": {"next": "~%s.1", "react-dom": "18", "react": ">=17"}}', major)
    content = F.when(n % 4 == 0, first).when(n % 4 == 1, '{"devDependencies": {"vitest": "latest", "left-pad": "1"}}').when(n % 4 == 2, third).otherwise("{not json")
    rows = table(spark, sf_dir, "documents").select(n.cast("string").alias("project_id"), content.alias("content"))
    return A.frameworks(rows).select("project_id", F.array_join("frameworks", ", ").alias("found"))


@query(f"WITH {_TEXT_HITS}, r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fts QUALIFY rank <= 10) SELECT query_id, string_agg(chunk_id || ':1-1', ' ' ORDER BY rank) AS keys FROM r GROUP BY query_id")
def snapshot_topk(spark, sf_dir):
    """The ten best files of every passage, as a snapshot keeps them."""
    chunks = whole_chunks(spark, sf_dir, "all")
    found = R.fulltext_search(chunks, passages(spark, sf_dir)).join(chunks.select("chunk_id", "path", "start_line", "end_line"), "chunk_id")
    return E.snapshot_topk(found).select("query_id", F.array_join("keys", " ").alias("keys"))


@query("SELECT text AS q, CASE WHEN item_id % 3 = 0 THEN 0 ELSE 2 END AS expected, item_id % 3 = 0 AS unanswerable FROM benchmark")
def read_question_files(spark, sf_dir):
    """Files of questions, an array in each, some without what may be left out."""
    n = F.col("item_id")
    known = F.struct(F.col("text").alias("q"), F.when(n % 3 != 0, F.array(F.lit("a.ts"), F.lit("b.ts"))).alias("expectedFiles"), F.when(n % 3 == 0, F.lit(True)).alias("expectUnanswerable"))
    path = f"{shared_root(spark)}/questions-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "benchmark").groupBy(F.floor(n / 50).alias("file")).agg(F.to_json(F.collect_list(known)).alias("value"))
    # A file holds one array: groups that share a partition are written one by one.
    rows.select("value").write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    return read_questions(spark, path).select("q", F.size("expected").alias("expected"), "unanswerable")


@query(f"WITH {FILES}, {_BEFORE}, {_STATE} SELECT b.project_id, b.path, b.content_hash FROM before b WHERE b.project_id NOT IN (SELECT project_id FROM files WHERE doc_id % 2 = 0) UNION ALL SELECT project_id, path, content_hash FROM walked WHERE project_id IN (SELECT project_id FROM files WHERE doc_id % 2 = 0)")
def write_index(spark, sf_dir):
    """Yesterday's index of all projects, then today's of those with a file of even number: they are replaced whole, the others stay."""
    walked, before = _before(spark, sf_dir)
    path = f"{shared_root(spark)}/index-{uuid.uuid4().hex}"
    I.write_index(before.select("project_id", "path", "content_hash"), path)
    again = walked.filter("doc_id % 2 = 0").select("project_id").distinct()
    I.write_index(walked.join(again, "project_id", "left_semi").select("project_id", "path", "content_hash"), path)
    return spark.read.schema("path string, content_hash string, project_id string").parquet(path).select("project_id", "path", "content_hash")


@query("SELECT CAST(sum(o_orderkey % 50) AS BIGINT) AS requests FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def embed_requests_today(spark, sf_dir):
    """As of noon of the last day that has jobs."""
    j = jobs(spark, sf_dir)
    last = j.agg(F.max("created_at").alias("t")).first()["t"]
    return I.embed_requests_today(j, F.lit(last) + F.expr("INTERVAL 12 HOURS"))
