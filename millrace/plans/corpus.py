"""Queries on files, chunks and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import analytics as A
from ..operators import indexing as I
from ..operators.storage import spread, stored
from .derive import FILES, JOBS, LINES, SEARCH_TEXT, SPLIT, files, jobs, table, whole_chunks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"WITH {FILES} SELECT path, len(l) AS n_lines, l[1] AS first_line, l[-1] AS last_line FROM (SELECT path, {LINES.format('text')} AS l FROM files)")
def to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.to_lines(F.col("text"))
    return files(spark, sf_dir).select("path", F.size(lines).cast("long").alias("n_lines"), F.get(lines, F.lit(0)).alias("first_line"), F.try_element_at(lines, F.lit(-1)).alias("last_line"))


@query(f"WITH {FILES} SELECT path, sha256(text) AS content_hash, sha256('2' || chr(10) || text) AS file_hash FROM files")
def content_hashes(spark, sf_dir):
    return files(spark, sf_dir).select("path", T.sha256(F.col("text")).alias("content_hash"), T.file_content_hash(F.col("text")).alias("file_hash"))


_NAMED = r"text || ' ' || regexp_extract(text, '([a-z]+) ([a-z]+)', 1) || upper(substr(regexp_extract(text, '([a-z]+) ([a-z]+)', 2), 1, 1)) || substr(regexp_extract(text, '([a-z]+) ([a-z]+)', 2), 2) || ' XMLHttpRequest RATE_LIMIT_MS svc.call('"


def named(text):
    """Texts get a camelCase word of their own and fixed identifiers."""
    a, b = (F.regexp_extract(text, "([a-z]+) ([a-z]+)", i) for i in (1, 2))
    return F.concat(text, F.lit(" "), a, F.upper(F.substring(b, 1, 1)), F.substr(b, F.lit(2)), F.lit(" XMLHttpRequest RATE_LIMIT_MS svc.call("))


@query(f"WITH {FILES} SELECT path, sha256({SPLIT.format('n')}) AS split_hash FROM (SELECT path, {_NAMED} AS n FROM files)")
def split_identifiers(spark, sf_dir):
    return files(spark, sf_dir).select("path", T.sha256(T.split_identifiers(named(F.col("text")))).alias("split_hash"))


@query(f"WITH {FILES} SELECT path, length(s) AS n, sha256(s) AS h FROM (SELECT path, {SEARCH_TEXT.format('text')} AS s FROM files)")
def search_texts(spark, sf_dir):
    s = T.search_text(F.col("text"))
    return files(spark, sf_dir).select("path", F.char_length(s).cast("long").alias("n"), T.sha256(s).alias("h"))


@query(r"SELECT lex AS lexeme, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS lex FROM documents) GROUP BY lex")
def lexeme_counts(spark, sf_dir):
    return A.lexeme_counts(spread(table(spark, sf_dir, "documents")), "doc_id")


@query(f"WITH {FILES} SELECT path, sha256(substr('search_document: // ' || path || ' (s) lines 1-' || doc_id || chr(10) || text, 1, 4500)) AS h FROM files")
def embedding_inputs(spark, sf_dir):
    t = T.embedding_text(F.col("path"), F.lit("s"), F.lit(1), F.col("doc_id"), F.col("text"))
    return files(spark, sf_dir).select("path", T.sha256(T.model_input(t)).alias("h"))


@query(r"""SELECT doc_id, regexp_replace(text, 'token = "[0-9a-f]+"', '[REDACTED]', 'g') AS redacted, text LIKE '%token = "%' AS had FROM documents""")
def redact_secrets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text"), (r'token = "[0-9a-f]+"',)).alias("redacted"), F.contains("text", F.lit('token = "')).alias("had"))


@query("SELECT doc_id, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 2000 AS minified, strlen(text) > 20000 AS too_large FROM documents")
def minified_and_large(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.minified(F.col("text")).alias("minified"), (F.octet_length("text") > 20_000).alias("too_large"))


_EXT = "['.ts','.lock.json','.min.js','','.PY','.exe','.generated.ts','.md']"


@query(f"""WITH p AS (SELECT page_id, 'src/f' || page_id || ({_EXT})[1 + page_id % 8] AS path FROM pages),
e AS (SELECT page_id, path, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext FROM p)
SELECT path, CASE WHEN ext = '' THEN 'unknown' WHEN ext IN ({", ".join(f"'{x}'" for x in P.ALLOWED)}) THEN 'allowed' ELSE 'denied' END AS kind,
 regexp_matches(path, '\\.min\\.js$|\\.generated\\.') AS name_denied, nullif(substr(ext, 2), '') AS lang FROM e""")
def classify_paths(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in (".ts", ".lock.json", ".min.js", "", ".PY", ".exe", ".generated.ts", ".md")])
    path = F.concat(F.lit("src/f"), F.col("page_id").cast("string"), F.get(ends, (F.col("page_id") % 8).cast("int")))
    rows = table(spark, sf_dir, "pages").select(path.alias("path"))
    return rows.select("path", P.classify_extension(F.col("path")).alias("kind"), P.filename_denied(F.col("path")).alias("name_denied"), P.lang_from_path(F.col("path")).alias("lang"))


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), m AS (SELECT path FROM u WHERE regexp_matches(path, '^(?:.*/)?en/[^/]*\\.html$'))
SELECT path, row_number() OVER (ORDER BY path) AS rank, (SELECT count(*) FROM m) AS matching FROM m QUALIFY rank <= 200""")
def list_files(spark, sf_dir):
    """Files that match a glob: the first 200 and how many there are in all."""
    rows = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).filter(P.matches_glob(F.col("path"), "**/en/*.html"))
    total = rows.count()
    first = rows.orderBy("path").limit(200).withColumn("rank", F.row_number().over(Window.orderBy("path")))
    return first.select("path", "rank", F.lit(total).cast("long").alias("matching"))


_DECIDED = f"""d AS (SELECT project_id, path, CASE WHEN doc_id % 17 = 0 THEN 'gitignored' WHEN strlen(text) > 20000 THEN 'too_large'
  WHEN list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 2000 THEN 'minified' END AS reason FROM files)"""


def _decided(spark, sf_dir):
    reason = P.skip_reason(F.col("path"), F.octet_length("text"), F.col("doc_id") % 17 == 0, F.lit(False), T.minified(F.col("text")), 20_000)
    return files(spark, sf_dir).withColumn("skip_reason", reason)


@query(f"WITH {FILES}, {_DECIDED} SELECT project_id, reason AS skip_reason, count(*) AS n FROM d WHERE reason IS NOT NULL GROUP BY ALL")
def skip_tally(spark, sf_dir):
    return I.skip_tally(_decided(spark, sf_dir)).select("project_id", F.explode("skip_reasons").alias("skip_reason", "n")).withColumn("n", F.col("n").cast("long"))


# The index of yesterday: every eleventh file is missing, every seventh has other contents, and some files are gone since.
_BEFORE = """walked AS (SELECT project_id, path, doc_id, sha256('2' || chr(10) || text) AS content_hash FROM files),
before AS (SELECT project_id, path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE content_hash END AS content_hash FROM walked WHERE doc_id % 11 <> 0
  UNION ALL SELECT project_id, 'gone/' || path, content_hash FROM walked WHERE doc_id % 13 = 0)"""
_STATE = "state AS (SELECT coalesce(w.project_id, b.project_id) AS project_id, coalesce(w.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN w.path IS NULL THEN 'stale' WHEN w.content_hash = b.content_hash THEN 'unchanged' ELSE 'changed' END AS state FROM walked w FULL JOIN before b ON w.project_id = b.project_id AND w.path = b.path)"


def _before(spark, sf_dir):
    walked = files(spark, sf_dir).select("project_id", "path", "doc_id", T.file_content_hash(F.col("text")).alias("content_hash"))
    old = walked.filter("doc_id % 11 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("content_hash")))
    gone = walked.filter("doc_id % 13 = 0").withColumn("path", F.concat(F.lit("gone/"), "path"))
    return walked, old.unionByName(gone)


@query(f"WITH {FILES}, {_BEFORE}, {_STATE} SELECT * FROM state")
def diff_files(spark, sf_dir):
    return I.diff_files(*_before(spark, sf_dir))


@query(f"WITH {FILES}, {_BEFORE} SELECT project_id, path FROM before ANTI JOIN walked USING (project_id, path)")
def stale_files(spark, sf_dir):
    return I.stale_files(*_before(spark, sf_dir)).select("project_id", "path")


@query(f"WITH {FILES}, {_BEFORE}, {_STATE} SELECT f.project_id, f.path, sha256(f.text) AS h FROM files f SEMI JOIN (SELECT * FROM state WHERE state = 'unchanged') s ON f.project_id = s.project_id AND f.path = s.path")
def unchanged_chunks(spark, sf_dir):
    walked, before = _before(spark, sf_dir)
    return I.unchanged_chunks(whole_chunks(spark, sf_dir), I.diff_files(walked, before)).select("project_id", "path", T.sha256(F.col("content")).alias("h"))


@query(f"""WITH {FILES}, {_BEFORE}, {_STATE},
c AS (SELECT f.project_id, s.state, f.doc_id % 3 = 0 AS hit FROM files f JOIN state s USING (project_id, path)),
a AS (SELECT project_id, count(*) FILTER (state = 'unchanged') AS unchanged_chunks, count(*) FILTER (state <> 'unchanged' AND hit) AS cached_chunks, count(*) FILTER (state <> 'unchanged' AND NOT hit) AS to_embed_chunks FROM c GROUP BY project_id)
SELECT *, CAST(ceil(to_embed_chunks / 64) AS BIGINT) AS requests, CAST(round(100 * ceil(to_embed_chunks / 64) / 900) AS BIGINT) AS percent_of_day FROM a""")
def cost_estimate(spark, sf_dir):
    walked, before = _before(spark, sf_dir)
    rows = files(spark, sf_dir).select("project_id", "path", "doc_id", F.col("path").alias("text_hash"))
    cache = rows.filter("doc_id % 3 = 0").select(F.lit("m").alias("model_id"), "text_hash")
    return I.cost_estimate(I.diff_files(walked, before), rows, cache, "m")


@query(f"WITH {FILES} SELECT project_id, count(*) AS file_count, count(*) FILTER (doc_id % 5 <> 0) AS chunk_count FROM files GROUP BY project_id")
def project_counts(spark, sf_dir):
    f = files(spark, sf_dir)
    return I.project_counts(f, f.filter("doc_id % 5 <> 0"))


@query("SELECT source AS project_id, count(*) AS chunk_count, CAST(sum(strlen(text)) AS BIGINT) AS content_bytes, CAST(sum(CASE WHEN e.vec_id IS NULL THEN 0 ELSE 2 * len(e.embedding) END) AS BIGINT) AS vector_bytes, round(100 * (sum(strlen(text)) + sum(CASE WHEN e.vec_id IS NULL THEN 0 ELSE 2 * len(e.embedding) END)) / 536870912, 6) AS percent FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id GROUP BY source")
def storage_report(spark, sf_dir):
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return I.storage_report(d.join(e, d.doc_id == e.vec_id, "left").select(F.col("source").alias("project_id"), F.col("text").alias("content"), "embedding"))


@query("SELECT d.source AS project_id, count(*) AS chunks, count(e.embedding) AS embedded, count(*) - count(e.embedding) AS missing, min(len(e.embedding)) AS min_dim, max(len(e.embedding)) AS max_dim FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id GROUP BY d.source")
def embedding_coverage(spark, sf_dir):
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return I.embedding_coverage(d.join(e, d.doc_id == e.vec_id, "left").select(F.col("source").alias("project_id"), "embedding"))


@query(f"""WITH {FILES}, h AS (SELECT project_id, path, sha256(text) AS content_hash, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files),
p AS (SELECT project_id, dir, sha256(string_agg(path || ':' || content_hash, chr(10) ORDER BY path, content_hash)) AS h FROM h GROUP BY ALL)
SELECT project_id, sha256(string_agg(dir || ':' || h, chr(10) ORDER BY dir, h)) AS tree_hash FROM p GROUP BY project_id""")
def tree_hash(spark, sf_dir):
    return I.tree_hash(files(spark, sf_dir).withColumn("content_hash", T.sha256(F.col("text"))))


@query()
def chunk_files(spark, sf_dir):
    """Windows of lines over all files."""
    return I.build_chunks(files(spark, sf_dir)).select("project_id", "path", "ord", "start_line", "end_line", "content_hash")


@query()
def build_index(spark, sf_dir):
    """The next state of an index whose last state lacks, changes and keeps files."""
    now = files(spark, sf_dir)
    walked, before = _before(spark, sf_dir)
    old = I.build_chunks(now.filter("doc_id % 11 <> 0"))
    return I.build_index(now.select("project_id", "path", "text"), before, old)[1].select("project_id", "path", "ord", "start_line", "end_line", "content_hash")


@query()
def embed_pending(spark, sf_dir):
    """Vectors for all chunks, with a cache that holds none."""
    chunks = stored(I.fitting_chunks(I.build_chunks(files(spark, sf_dir))))
    cache = spark.createDataFrame([], "model_id string, text_hash string, embedding array<float>")
    return I.embed_pending(chunks, cache, "hash-64", 64)[0].select("chunk_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 4).alias("norm"))


@query("SELECT vec_id AS chunk_id, CASE WHEN label = 3 THEN list_transform(embedding, lambda x: CAST(x * 2 AS FLOAT)) ELSE embedding END AS embedding FROM embeddings")
def set_embeddings(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    new = rows.filter("label = 3").select("chunk_id", F.transform("embedding", lambda x: (x * 2).cast("float")).alias("vector"))
    return I.set_embeddings(rows.drop("label"), new, 64)


@query(f"WITH {JOBS} SELECT project_id, job_id, created_at, status FROM jobs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, job_id DESC) = 1")
def latest_job(spark, sf_dir):
    return I.latest_job(jobs(spark, sf_dir)).select("project_id", "job_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "status")


@query(f"WITH {JOBS}, l AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, job_id DESC) = 1) SELECT c_custkey AS project_id, job_id, status FROM customer LEFT JOIN l ON c_custkey = l.project_id")
def projects_with_latest_job(spark, sf_dir):
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"))
    return I.projects_with_latest_job(projects, jobs(spark, sf_dir)).select("project_id", "job_id", "status")


@query(f"WITH {JOBS} SELECT date_trunc('day', created_at)::DATE AS day, CAST(sum(embed_requests) AS BIGINT) AS requests FROM jobs GROUP BY 1")
def embed_requests_by_day(spark, sf_dir):
    return I.embed_requests_by_day(jobs(spark, sf_dir))


@query(f"WITH {FILES}, c AS (SELECT project_id, lang, count(*) AS n, min(path) AS first FROM files GROUP BY ALL) SELECT project_id, upper(lang) AS language FROM c QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY n DESC, first) = 1")
def top_language(spark, sf_dir):
    return A.top_language(files(spark, sf_dir), labels={x: x.upper() for x in ("en", "de", "fr", "es")})


@query(f"WITH {FILES}, p AS (SELECT project_id, lang || '/' || (doc_id % 9) || '/' || path AS path FROM files), c AS (SELECT project_id, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS dir, count(*) AS n FROM p GROUP BY ALL) SELECT project_id, dir, n, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, dir) AS rank FROM c QUALIFY rank <= 6")
def dir_counts(spark, sf_dir):
    f = files(spark, sf_dir)
    return A.dir_counts(f.withColumn("path", F.concat_ws("/", "lang", (F.col("doc_id") % 9).cast("string"), "path")))


def code_files(spark, sf_dir):
    """A source tree out of the documents: each imports the one with half its number, and some configuration and documents."""
    half = F.floor(F.col("doc_id") / 2).cast("string")
    name = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/index.ts"))).when(F.col("doc_id") % 50 == 1, F.concat(F.lit("docs/r"), F.col("doc_id").cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(".ts")))
    content = F.concat(F.lit("import a from './f"), half, F.lit("'\nconst b = require('../src/f"), half, F.lit("')\n"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select(F.lit("p").alias("project_id"), name.alias("path"), content.alias("content"))


_CODE = """code AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'd' || doc_id || '/index.ts' WHEN doc_id % 50 = 1 THEN 'docs/r' || doc_id || '.md' ELSE 'src/f' || doc_id || '.ts' END AS path, doc_id // 2 AS half FROM documents),
tried AS (SELECT path, split_part(path, '/', 1) || '/f' || half || '.ts' AS target FROM code UNION ALL SELECT path, 'src/f' || half || '.ts' FROM code),
links AS (SELECT t.* FROM tried t SEMI JOIN code c ON t.target = c.path WHERE t.path <> t.target),
inbound AS (SELECT target AS path, count(*) AS imports FROM links GROUP BY 1)"""


@query(f"WITH {_CODE} SELECT 'p' AS project_id, path, imports FROM inbound")
def inbound_imports(spark, sf_dir):
    return A.inbound_imports(code_files(spark, sf_dir))


@query(f"""WITH {_CODE}, near AS (SELECT split_part(path, '/', 1) AS dir, count(*) AS near FROM code GROUP BY 1),
s AS (SELECT c.path, CAST(CASE WHEN path LIKE '%/index.ts' THEN 100 ELSE 0 END + CASE WHEN path LIKE '%.md' THEN 20 ELSE 0 END + least(5 * coalesce(imports, 0), 50) + least(2 * near, 20) AS BIGINT) AS score
  FROM code c LEFT JOIN inbound USING (path) JOIN near ON near.dir = split_part(c.path, '/', 1))
SELECT 'p' AS project_id, path, score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM s QUALIFY rank <= 30""")
def rank_files(spark, sf_dir):
    return A.rank_files(code_files(spark, sf_dir))


@query(rf"""WITH {FILES}, sized AS (SELECT project_id, count(*) AS n, arg_min(text, path) AS readme FROM files GROUP BY 1),
langs AS (SELECT project_id, arg_min(upper(lang), (-n, first)) AS language FROM (SELECT project_id, lang, count(*) AS n, min(path) AS first FROM files GROUP BY ALL) GROUP BY 1),
dirs AS (SELECT project_id, string_agg(lang || ' (' || n || ')', ', ' ORDER BY n DESC, lang) AS dirs FROM (SELECT project_id, lang, count(*) AS n FROM files GROUP BY ALL) GROUP BY 1),
led AS (SELECT *, regexp_replace(list_filter(list_transform(regexp_split_to_array(regexp_replace(readme, '^#+\s[^\n]*(\n|$)', ''), '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')),
  lambda p: p <> '' AND NOT regexp_matches(p, '^#+\s'))[1], '\s+', ' ', 'g') AS p FROM sized)
SELECT project_id, concat_ws(chr(10) || chr(10), project_id || ' — ' || language || '. ' || n || ' files.' || chr(10) || 'Top dirs: ' || dirs || '.' || chr(10) || 'Detected: React 18.' || chr(10) || 'Scripts: build.',
  CASE WHEN length(p) > {T.PARAGRAPH_CHARS} THEN substr(p, 1, {T.PARAGRAPH_CHARS}) || '…' ELSE p END) AS digest FROM led JOIN langs USING (project_id) JOIN dirs USING (project_id)""")
def repo_digest(spark, sf_dir):
    f = files(spark, sf_dir)
    manifest = f.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).select("project_id", F.format_string('{"name": "%s", "dependencies": {"react": "^18.2.0"}, "scripts": {"build": "x"}}', "project_id").alias("content"))
    return A.repo_digest(f, manifest, f.groupBy("project_id").agg(F.min_by("text", "path").alias("content")), {x: x.upper() for x in ("en", "de", "fr", "es")})


@query(f"WITH {FILES}, l AS (SELECT path, string_split(text, chr(10)) AS lines FROM files) SELECT path, CASE WHEN len(lines) >= 3 THEN array_to_string(lines[3:302], chr(10)) END AS view FROM l")
def read_range(spark, sf_dir):
    """A window of lines from the third on; null for files that end before it."""
    return files(spark, sf_dir).select("path", T.read_range(F.split("text", "\n", -1), F.lit(3), F.lit(None).cast("int")).alias("view"))


@query(f"WITH {FILES}, c AS (SELECT project_id, path, 0 AS ord FROM files WHERE doc_id % 4 = 0) SELECT f.project_id, f.path, c.ord FROM files f JOIN c USING (project_id, path)")
def changed_file_chunks(spark, sf_dir):
    chunks = whole_chunks(spark, sf_dir)
    changed = files(spark, sf_dir).filter("doc_id % 4 = 0").select("project_id", "path")
    return I.changed_file_chunks(chunks, changed).select("project_id", "path", "ord")


@query(f"WITH {JOBS} SELECT project_id, job_id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, job_id DESC) AS place FROM jobs QUALIFY place <= 3")
def listings(spark, sf_dir):
    """The newest three jobs of each project."""
    return I.newest_jobs(jobs(spark, sf_dir), 3).select("project_id", "job_id", "place")
