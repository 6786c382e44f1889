"""Queries on sources, paths, citations and texts whose shapes are made from the rows' numbers."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import answers as N
from ..functions import paths as P
from ..functions import text as T
from ..operators import conversations as C
from ..operators import indexing as I
from ..operators.storage import shared_root, spread, stored
from ..sources import files as S
from .derive import FILES, files, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _one_of(values: tuple, number):
    return F.get(F.array(*map(F.lit, values)), F.pmod(number, F.lit(len(values))).cast("int"))


@query(f"""WITH {FILES}, l AS (SELECT project_id, path, string_split(text, chr(10)) AS lines FROM files WHERE length(text) > 200)
SELECT project_id, path, 25 AS start_line, 27 AS end_line, 5 AS context_start, CAST(least(len(lines), 47) AS INTEGER) AS context_end, array_to_string(lines[5:47], chr(10)) AS view FROM l""")
def file_view(spark, sf_dir):
    """Lines 25 to 27 of every file with 20 lines of context; short files aren't indexed."""
    f = files(spark, sf_dir).select("project_id", "path", "text")
    ranges = f.select("project_id", "path", F.lit(25).alias("start_line"), F.lit(27).alias("end_line"))
    indexed = f.filter(F.char_length("text") > 200).select("project_id", "path", F.split("text", "\n", -1).alias("lines"))
    return C.file_view(ranges, indexed).withColumn("view", F.array_join("view", "\n"))


_DIRECTORIES = ("src/", "node_modules/x/", "a/dist/", "distx/", "", "a/.git/b/", "my.git/")


@query(f"""WITH p AS (SELECT ({list(_DIRECTORIES)})[1 + page_id % 7] || 'f' || page_id || '.ts' AS path FROM pages)
SELECT path, list_has_any(string_split(path, '/')[:-2], {list(P.PRUNED)}) AS pruned FROM p""")
def denylisted_paths(spark, sf_dir):
    path = F.concat(_one_of(_DIRECTORIES, F.col("page_id")), F.lit("f"), F.col("page_id").cast("string"), F.lit(".ts"))
    return table(spark, sf_dir, "pages").select(path.alias("path")).select("path", P.denylisted(F.col("path")).alias("pruned"))


_PATHS = ("a/b", "../x", "a/../../b", "/abs", "C:/x", "a/../b", "a\\..\\..\\b", "")


@query("""SELECT page_id, (['a/b', '../x', 'a/../../b', '/abs', 'C:/x', 'a/../b', 'a\\..\\..\\b', ''])[1 + page_id % 8] AS path, (page_id % 8) IN (0, 5) AS safe FROM pages""")
def safe_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", _one_of(_PATHS, F.col("page_id")).alias("path"))
    return rows.select("page_id", "path", P.safe_relative_path(F.col("path")).alias("safe"))


_REFS = ("https://github.com/a/b", "https://GitHub.com/a/b.git/", "http://github.com/a/b", "https://github.com/a", "https://github.com/a/b/c", "https://github.com/a_b/c-d.e")
_BRANCHES = (None, "main", "-x", "a..b", "feature/x.1", "a b")


@query("""SELECT event_id, (event_id % 6) IN (0, 1, 5) AND ((event_id // 6) % 6) IN (0, 1, 4) AS valid FROM events""")
def source_refs(spark, sf_dir):
    number = F.col("event_id")
    url, branch = _one_of(_REFS, number), _one_of(_BRANCHES, F.floor(number / 6))
    return table(spark, sf_dir, "events").select("event_id", P.valid_source_ref(url, branch).alias("valid"))


@query("""SELECT l_orderkey AS message_id, coalesce(string_agg('[' || l_linenumber || '] p' || l_partkey || ':' || l_linenumber || '-' || (l_linenumber + 5), ' · ' ORDER BY l_linenumber, 'p' || l_partkey) FILTER (l_linenumber % 2 = 1), '') AS sources FROM lineitem GROUP BY 1""")
def sources_lines(spark, sf_dir):
    n = F.col("l_linenumber").cast("int")
    one = F.struct(n.alias("marker"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), n.alias("start"), (n + 5).alias("end"), (n % 2 == 1).alias("used"))
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("message_id")).agg(F.collect_list(one).alias("c"))
    return own.select("message_id", N.sources_line(F.col("c")).alias("sources"))


@query("""SELECT page_id, CASE WHEN page_id % 3 <> 0 AND page_id % 5 <> 0 THEN 'https://github.com/a/b/blob/r' || page_id || '/src/f.ts#L' || (page_id % 9) || '-L' || (page_id % 9 + 4) END AS link FROM pages""")
def citation_links(spark, sf_dir):
    n = F.col("page_id")
    kind, ref = _one_of(("upload", "git_url", "git_private"), n), _one_of(("https://github.com/a/b.git", "https://github.com/a/b/", "https://github.com/a/b"), n)
    revision = F.when(n % 5 != 0, F.concat(F.lit("r"), n.cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", N.citation_link(kind, ref, revision, F.lit("src/f.ts"), n % 9, n % 9 + 4).alias("link"))


@query(f"SELECT doc_id, substr(replace(text, chr(0), ''), 1, {T.TITLE_CHARS}) AS title, CAST(ceil(length(text) / 4) + 100 AS BIGINT) AS tokens, ceil(length(text) / 4) + 100 <= 1.1 * 500 AS fits FROM documents")
def titles_and_budgets(spark, sf_dir):
    chars = F.char_length("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.stored_title(F.col("text")).alias("title"), T.estimate_tokens(chars, 100).alias("tokens"), T.fits_budget(chars, 100, 500).alias("fits"))


@query("SELECT source AS project_id, doc_id AS chunk_id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.embedding IS NULL")
def pending_embeddings(spark, sf_dir):
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    chunks = d.join(e, d["doc_id"] == e["vec_id"], "left").select(F.col("source").alias("project_id"), F.col("doc_id").alias("chunk_id"), "embedding")
    return I.pending_embeddings(chunks).drop("embedding")


_FIRST, _SECOND = N.SECTION_TITLES[:2]


@query(f"""WITH s AS (SELECT item_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS body, item_id % 3 AS shape FROM benchmark)
SELECT item_id, '{_FIRST}' AS title, body FROM s WHERE body <> '' UNION ALL SELECT item_id, '{_SECOND}', 'b' || item_id FROM s WHERE shape = 1""")
def answer_sections(spark, sf_dir):
    """A known section, one that is empty or filled, and an unknown one."""
    n = F.col("item_id").cast("string")
    second = F.when(F.col("item_id") % 3 == 1, F.concat(F.lit("b"), n)).otherwise("")
    text = F.concat(F.lit(f"preface\n## {_FIRST}\n\n"), "text", F.lit(f"\n## {_SECOND}  \n"), second, F.lit("\n\n## Of my own\nx\n"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(N.parse_sections(text)).alias("s"))
    return rows.select("item_id", "s.title", "s.body")


@query("""SELECT doc_id AS archive, CASE WHEN doc_id % 10 <> 0 THEN f END AS path, CASE WHEN doc_id % 10 <> 0 THEN strlen(coalesce(text, '')) END AS size, CASE WHEN doc_id % 10 <> 0 THEN sha256(coalesce(text, '')) END AS h,
  CASE WHEN doc_id % 10 = 0 THEN 'path leaves the archive' END AS error FROM documents, unnest(['a.txt', 'd/b.txt']) u(f) WHERE doc_id % 10 <> 0 OR f = 'a.txt'""")
def archive_files(spark, sf_dir):
    """Each document twice in an archive of its own; in every tenth the second entry leaves the archive, so that nothing comes out of it."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("a.txt", text or "")
                    z.writestr("../b.txt" if number % 10 == 0 else "d/b.txt", text or "")
                yield pa.RecordBatch.from_arrays([pa.array([str(number)]), pa.array([held.getvalue()], pa.binary())], ["project_id", "content"])

    archives = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(packed, "project_id string, content binary")
    found = S.read_archives(archives)
    return found.select(F.col("project_id").cast("long").alias("archive"), "path", "size", F.sha2("content", 256).alias("h"), "error")


@query(f"""WITH {FILES}, marked AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN '# Title' || chr(10) || text WHEN doc_id % 3 = 1 THEN '## A' || chr(10) || chr(10) || '## B' || chr(10) || chr(10) || text ELSE text END AS md FROM files),
bodies AS (SELECT path, regexp_replace(md, '^#+\\s[^\\n]*(\\n|$)', '') AS body FROM marked),
parts AS (SELECT path, list_filter(list_transform(regexp_split_to_array(body, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '' AND NOT regexp_matches(p, '^#+\\s')) AS ps FROM bodies),
flat AS (SELECT path, regexp_replace(ps[1], '\\s+', ' ', 'g') AS p FROM parts)
SELECT path, CASE WHEN length(p) > {T.PARAGRAPH_CHARS} THEN substr(p, 1, {T.PARAGRAPH_CHARS}) || '…' ELSE p END AS lead FROM flat""")
def first_paragraphs_all(spark, sf_dir):
    """The first paragraph of every file, under headings or without."""
    head = F.when(F.col("doc_id") % 3 == 0, "# Title\n").when(F.col("doc_id") % 3 == 1, "## A\n\n## B\n\n").otherwise("")
    return files(spark, sf_dir).select("path", T.first_paragraph(F.concat(head, "text")).alias("lead"))


@query("""WITH f AS (SELECT source AS project_id, 'src/' || lang || '/d' || (doc_id % 50) || '/' || CASE WHEN doc_id % 9 = 0 THEN '.' ELSE '' END || doc_id || '.txt' AS path, coalesce(text, '') AS t FROM documents WHERE doc_id % 8 <> 3)
SELECT project_id, path, strlen(t) AS size, sha256(t) AS h FROM f""")
def tree_files(spark, sf_dir):
    """Every document as a file of a tree, some with names that begin with a dot; every eighth lies in a directory that isn't entered."""
    top = f"{shared_root(spark)}/trees-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(top)
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                store.create_dir(f"{folder}/{name}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{folder}/{name}") as f:
                    f.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column("source")], ["project_id"])

    n = F.col("doc_id").cast("string")
    folder = F.concat(F.lit("src/"), F.when(F.col("doc_id") % 8 == 3, "dist/").otherwise(""), "lang", F.lit("/d"), (F.col("doc_id") % 50).cast("string"), F.lit("/"))
    name = F.concat("source", F.lit("/"), folder, F.when(F.col("doc_id") % 9 == 0, ".").otherwise(""), n, F.lit(".txt"))
    projects = spread(table(spark, sf_dir, "documents")).select("source", name.alias("name"), "text").mapInArrow(write, "project_id string")
    roots = stored(projects.filter("project_id IS NOT NULL").distinct().withColumn("root", F.concat(F.lit(f"{top}/"), "project_id")))
    return S.read_tree(roots).select("project_id", "path", "size", F.sha2("content", 256).alias("h"))
