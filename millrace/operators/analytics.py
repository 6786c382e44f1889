"""Corpus analytics: import graph, file ranking, repository digest, change evidence, token usage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as N
from ..functions import paths as P
from ..functions import text as T
from ..functions.answers import split_provider_id
from ..functions.text import first_paragraph
from .retrieval import word_parts
from .storage import stored

#: Labels of languages and of dependencies (in order of precedence), import shapes, weights of the ranking.
LANGUAGES = {"ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "py": "Python", "go": "Go", "rs": "Rust", "java": "Java", "rb": "Ruby", "php": "PHP", "c": "C", "h": "C", "cpp": "C++", "hpp": "C++", "cs": "C#"}
FRAMEWORKS = {"@nestjs/core": "NestJS", "react": "React", "react-dom": "React", "next": "Next.js", "vue": "Vue", "@angular/core": "Angular", "express": "Express", "fastify": "Fastify", "koa": "Koa", "drizzle-orm": "Drizzle ORM", "prisma": "Prisma", "@prisma/client": "Prisma", "typeorm": "TypeORM", "sequelize": "Sequelize", "mongoose": "Mongoose", "pg": "PostgreSQL", "mysql2": "MySQL", "redis": "Redis", "ioredis": "Redis", "graphql": "GraphQL", "@trpc/server": "tRPC", "vite": "Vite", "tailwindcss": "Tailwind CSS", "vitest": "Vitest", "jest": "Jest"}
IMPORT = r"""(?:from\s+|require\(\s*)['"](\.[^'"]+)['"]"""
CANDIDATES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")
ENTRY, ROOT_DOC, NESTED_DOC, CONFIG, PER_IMPORT, MOST_IMPORTS, PER_NEIGHBOUR, MOST_NEIGHBOURS = 100, 60, 20, 40, 5, 50, 2, 20
TOP_DIRS, EVIDENCE_FILES, CALLERS = 6, 20, 5


def top_language(files: DataFrame, lang_col: str = "lang", labels: dict[str, str] | None = None) -> DataFrame:
    """project_id, language: the most frequent label; ties go to the label met first in order of path."""
    known = F.create_map(*[F.lit(x) for pair in (labels or LANGUAGES).items() for x in pair])
    counts = files.select("project_id", "path", F.element_at(known, F.col(lang_col)).alias("language")).filter("language IS NOT NULL").groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))
    return counts.groupBy("project_id").agg(F.min_by("language", F.struct((-F.col("n")).alias("n"), "first")).alias("language"))


def lexeme_counts(texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """lexeme, n, docs: occurrences of each word, and the documents that have it. texts: id_col, text.

    Tasks count the words of a few megabytes of texts at a time, and Spark sums up. Rows that share an id are one document, and
    are counted by word and id; those without id count as occurrences alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lists, ids in word_parts(batch, 1):
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                coded = lists.flatten().dictionary_encode()
                word, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
                pair = np.unique(np.repeat(np.arange(len(lists)), lengths) * max(distinct, 1) + word)
                named = ids.is_valid().to_numpy(zero_copy_only=False)[pair // max(distinct, 1)]
                counts = [np.bincount(w, minlength=distinct) for w in (word, pair[named] % max(distinct, 1))]
                out = pa.RecordBatch.from_arrays([coded.dictionary, *[pa.array(c, pa.int64()) for c in counts]], ["lexeme", "n", "docs"])
                yield out.filter(pc.not_equal(out.column("lexeme"), ""))

    again = stored(texts.groupBy(id_col).agg(F.count(F.lit(1)).alias("c")).filter(f"c > 1 AND `{id_col}` IS NOT NULL").select(F.col(id_col).alias("__id")))
    repeated = again.limit(1).count() > 0
    words = texts.select(F.col(id_col).alias("__id"), T.lexeme_text(F.col("text")).alias("words"))
    own = words.join(again, "__id", "left_anti") if repeated else words
    sums = [F.sum("n").alias("n"), F.sum("docs").alias("docs")]
    part = own.select(F.col("__id").alias("chunk_id"), "words").mapInArrow(run, "lexeme string, n long, docs long")
    counts = part.groupBy("lexeme").agg(*sums)
    if not repeated:
        return counts
    shared = words.join(again, "__id", "left_semi").select("__id", F.explode(F.split("words", " ")).alias("lexeme")).filter("lexeme <> ''")
    each = shared.groupBy("lexeme", "__id").agg(F.count(F.lit(1)).alias("n")).select("lexeme", "n", F.lit(1).cast("long").alias("docs"))
    return counts.unionByName(each).groupBy("lexeme").agg(*sums)


def dir_counts(files: DataFrame, limit: int = TOP_DIRS) -> DataFrame:
    """project_id, dir, n, rank: files by directory of at most two segments; files at the root count nowhere."""
    counts = files.select("project_id", P.two_segment_dir(F.col("path")).alias("dir")).filter("dir IS NOT NULL").groupBy("project_id", "dir").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("project_id").orderBy(F.desc("n"), "dir")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def frameworks(manifests: DataFrame) -> DataFrame:
    """project_id, frameworks: labels of known dependencies, each once, with the major version. manifests: project_id, content (JSON)."""
    kind = "dependencies map<string,string>, devDependencies map<string,string>, name string, scripts map<string,string>"
    parsed = manifests.select("project_id", F.from_json("content", kind).alias("m"))
    none = F.create_map().cast("map<string,string>")
    # Development dependencies come last and so win.
    both = F.concat(F.map_entries(F.coalesce("m.dependencies", none)), F.map_entries(F.coalesce("m.devDependencies", none)))
    rows = parsed.select("project_id", F.posexplode(both).alias("at", "e")).groupBy("project_id", F.col("e.key").alias("dep")).agg(F.max_by("e.value", "at").alias("range")).filter("range <> ''")
    order = {d: i for i, d in enumerate(FRAMEWORKS)}
    labels = F.create_map(*[F.lit(x) for pair in FRAMEWORKS.items() for x in pair])
    places = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    known = rows.select("project_id", F.element_at(labels, F.col("dep")).alias("label"), F.element_at(places, F.col("dep")).alias("place"), "range").filter("label IS NOT NULL")
    once = known.groupBy("project_id", "label").agg(F.min("place").alias("place"), F.min_by("range", "place").alias("range"))
    major = F.regexp_extract("range", r"(\d+)", 1)
    text = F.when(major == "", F.col("label")).otherwise(F.concat_ws(" ", "label", major))
    return once.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("text")))), lambda x: x["text"]).alias("frameworks"))


def normalised(path: Column) -> Column:
    """A relative POSIX path without `.`, `..` and doubled slashes where that can be."""
    step = lambda out, p: F.when(p.isin("", "."), out).when((p == "..") & (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1)) != ".."), F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(F.concat(out, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve_imports(files: DataFrame) -> DataFrame:
    """project_id, path, at (number of the import in its file), target: the first candidate that exists. files: project_id, path, content."""
    found = files.select("project_id", "path", F.posexplode(F.regexp_extract_all("content", F.lit(IMPORT), F.lit(1))).alias("at", "specifier"))
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    base = found.withColumn("base", normalised(F.concat(folder, "specifier")))
    tried = base.select("project_id", "path", "at", F.posexplode(F.array(*[F.concat("base", F.lit(c)) for c in CANDIDATES])).alias("place", "target"))
    known = files.select("project_id", F.col("path").alias("target"))
    return tried.join(known, ["project_id", "target"]).groupBy("project_id", "path", "at").agg(F.min_by("target", "place").alias("target"))


def inbound_imports(files: DataFrame) -> DataFrame:
    """project_id, path, imports: resolved relative imports from other files, every one."""
    links = resolve_imports(files).filter("target <> path")
    return links.groupBy("project_id", F.col("target").alias("path")).agg(F.count(F.lit(1)).alias("imports"))


def rank_files(files: DataFrame, limit: int = 30) -> DataFrame:
    """project_id, path, score, rank: entry points, documents, configuration, imports by others, neighbours in the directory."""
    folders = files.select("project_id", "path", P.two_segment_dir(F.col("path")).alias("dir"))
    around = folders.filter("dir IS NOT NULL").groupBy("project_id", "dir").agg(F.count(F.lit(1)).alias("near"))
    rows = folders.join(inbound_imports(files), ["project_id", "path"], "left").join(around, ["project_id", "dir"], "left")
    path = F.col("path")
    doc = F.when(P.doc_file(path), F.when(F.contains(path, F.lit("/")), NESTED_DOC).otherwise(ROOT_DOC)).otherwise(0)
    score = F.when(P.entry_point(path), ENTRY).otherwise(0) + doc + F.when(P.config_file(path), CONFIG).otherwise(0) + F.least(PER_IMPORT * F.coalesce("imports", F.lit(0)), F.lit(MOST_IMPORTS)) + F.least(PER_NEIGHBOUR * F.coalesce("near", F.lit(0)), F.lit(MOST_NEIGHBOURS))
    scored = rows.select("project_id", "path", score.cast("long").alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("score"), "path"))).filter(F.col("rank") <= limit)


def repo_digest(files: DataFrame, manifests: DataFrame, readmes: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """project_id, digest: name, language, files, directories, frameworks, scripts and the README's first paragraph. files: project_id, path, lang; manifests, readmes: project_id, content."""
    size = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    dirs = dir_counts(files).groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dir", "n"))), lambda d: F.format_string("%s (%d)", d["dir"], d["n"])), ", ").alias("dirs"))
    named = manifests.select("project_id", F.from_json("content", "name string, scripts map<string,string>").alias("m")).groupBy("project_id").agg(F.first("m.name", True).alias("name"), F.first(F.array_join(F.map_keys("m.scripts"), ", "), True).alias("scripts"))
    lead = readmes.groupBy("project_id").agg(F.first(first_paragraph(F.col("content")), True).alias("lead"))
    out = size
    for part in (top_language(files, labels=labels), dirs, frameworks(manifests), named, lead):
        out = out.join(part, "project_id", "left")
    heading = F.concat(F.coalesce("name", "project_id"), F.coalesce(F.concat(F.lit(" — "), "language"), F.lit("")), F.lit(". "), F.col("n").cast("string"), F.lit(" files."))
    line = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(title), c, F.lit(".")))
    body = F.concat_ws("\n", heading, line("Top dirs: ", F.col("dirs")), line("Detected: ", F.array_join("frameworks", ", ")), line("Scripts: ", F.col("scripts")))
    return out.select("project_id", F.concat_ws("\n\n", body, "lead").alias("digest"))


def change_evidence(changed: DataFrame, chunks: DataFrame, references: DataFrame, files: int = EVIDENCE_FILES, callers: int = CALLERS) -> DataFrame:
    """change_id, marker, path, start_line, end_line, chunk_id: chunks of the first changed text files, then callers of each file's first symbol.

    changed: change_id, project_id, path, pos, binary; references: query_id (`change_id`, path and symbol as asked), chunk_id, rank from find_references.
    A file's first `callers` references are taken before those in the file itself are left out. The first of equal ranges stays.
    """
    order = F.row_number().over(Window.partitionBy("change_id").orderBy("pos", "path"))
    first = changed.filter("NOT binary").withColumn("file_no", order).filter(F.col("file_no") <= files)
    own = first.join(chunks, ["project_id", "path"]).select("change_id", "file_no", F.lit(0).alias("kind"), F.col("ord").alias("at"), "path", "start_line", "end_line", "chunk_id")
    called = references.filter(F.col("rank") <= callers).join(first.select("change_id", "file_no", F.col("path").alias("changed_path")), ["change_id", "file_no"]).filter("path <> changed_path")
    theirs = called.select("change_id", "file_no", F.lit(1).alias("kind"), F.col("rank").alias("at"), "path", "start_line", "end_line", "chunk_id")
    both = own.unionByName(theirs)
    place = F.struct("file_no", "kind", "at")
    once = both.groupBy("change_id", "path", "start_line", "end_line").agg(F.min(place).alias("place"), F.min_by("chunk_id", place).alias("chunk_id"))
    return once.withColumn("marker", F.row_number().over(Window.partitionBy("change_id").orderBy("place"))).select("change_id", "marker", "path", "start_line", "end_line", "chunk_id")


def changed_symbols(changed: DataFrame, chunks: DataFrame, files: int = EVIDENCE_FILES) -> DataFrame:
    """change_id, file_no, project_id, symbol: the symbol of the first chunk of each changed text file, to look for its callers."""
    order = F.row_number().over(Window.partitionBy("change_id").orderBy("pos", "path"))
    first = changed.filter("NOT binary").withColumn("file_no", order).filter(F.col("file_no") <= files)
    return first.join(chunks.filter("ord = 0 AND symbol IS NOT NULL"), ["project_id", "path"]).select("change_id", "file_no", "project_id", "symbol")


def references_by_file(references: DataFrame) -> DataFrame:
    """query_id, path, line: `path: a-b, c-d` in the order of the result. references: query_id, path, start_line, end_line, rank."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "start_line", "end_line"))), lambda r: F.format_string("%d-%d", r["start_line"], r["end_line"]))
    return references.groupBy("query_id", "path").agg(F.concat(F.col("path"), F.lit(": "), F.array_join(parts, ", ")).alias("line"))


def usage_rollup(messages: DataFrame) -> DataFrame:
    """provider, model, day, answers, input_tokens, output_tokens. messages: model_id, created_at, input_tokens, output_tokens."""
    who = split_provider_id(F.col("model_id"))
    rows = messages.select(who["provider"].alias("provider"), who["model"].alias("model"), F.date_trunc("day", "created_at").alias("day"), "input_tokens", "output_tokens")
    return rows.groupBy("provider", "model", "day").agg(F.count(F.lit(1)).alias("answers"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def tour_prompts(ranked: DataFrame, size: int = N.BATCH_FILES) -> DataFrame:
    """project_id, batch (from 0), prompt: a project's ranked files, `size` to a prompt; their ranks are the markers throughout.

    ranked: project_id, rank (from 1), path, start, end, content.
    """
    piece = F.struct(F.col("rank").alias("marker"), "path", "start", "end", "content")
    batch = F.floor((F.col("rank") - 1) / size).cast("long").alias("batch")
    groups = ranked.groupBy("project_id", batch).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return groups.select("project_id", "batch", N.tour_prompt(F.col("pieces")).alias("prompt"))
