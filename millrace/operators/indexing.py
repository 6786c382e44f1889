"""Incremental indexing: filters with reasons, diffs by content hash, chunk tables, embeddings with a cache, reports.

Keys are (project_id, path): a project alone may be one huge repository. Diffs move hashes, never texts or vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import paths as P
from ..functions import text as T
from .chunking import chunk_files
from .storage import stored

KEY = ["project_id", "path"]
#: Fixed values of the reports.
STORAGE_BUDGET, REQUEST_SIZE, REQUESTS_A_DAY = 512 * 1024 * 1024, 64, 900
#: Characters of a chunk that a model's input holds beside its heading.
FITTING_CHARS = 4000
#: Bytes of ignore rules that are broadcast.
BROADCAST_RULES = 16 << 20
#: Inputs of an embedding batch are padded to its longest: count * longest^2 stays below this.
BATCH_COST = 4 * 4500 * 4500


def _pattern(rule: str) -> tuple[bool, str] | None:
    """(negated, regular expression over a path relative to the file's directory), or None for blanks and comments."""
    rule = rule.rstrip("\n").rstrip(" ") if not rule.rstrip("\n").endswith("\\ ") else rule.rstrip("\n")
    if not rule.strip() or rule.startswith("#"):
        return None
    negated, rule = rule.startswith("!"), rule.lstrip("!") if rule.startswith("!") else rule.removeprefix("\\")
    folder, rule = rule.endswith("/"), rule.rstrip("/")
    anchored, rule = "/" in rule, rule.removeprefix("/")
    body = P.glob_regex(rule)[1:-1]
    return negated, f"^{'' if anchored else '(?:.*/)?'}{body}(?:/.*)?$" if not folder else f"^{'' if anchored else '(?:.*/)?'}{body}/.*$"


@lru_cache(maxsize=10_000)
def _compiled(rules: str) -> list:
    import re

    return [(n, re.compile(p, re.S)) for n, p in filter(None, map(_pattern, rules.split("\n")))]


@F.pandas_udf(BooleanType())
def gitignored(paths: pd.Series, levels: pd.Series) -> pd.Series:
    """Whether any ignore file on the way ignores the path. levels: array of struct(dir, rules); a deeper file can't take back what one above ignores."""

    def one(path: str | None, files) -> bool | None:
        if path is None:
            return None
        for f in [] if files is None else files:
            folder = f["dir"] or ""
            if folder and not path.startswith(folder + "/"):
                continue
            own, hit = path[len(folder) + 1 :] if folder else path, False
            for negated, pattern in _compiled(f["rules"] or ""):
                if pattern.match(own):
                    hit = not negated
            if hit:
                return True
        return False

    return pd.Series([one(p, f) for p, f in zip(paths, levels, strict=True)], dtype=object)


@F.pandas_udf(BooleanType())
def binary_file(contents: pd.Series) -> pd.Series:
    """A NUL byte, broken UTF-8, or more than a tenth of control bytes in the first 512; texts in UTF-16 with a byte-order mark aren't."""

    def one(data: bytes | None) -> bool | None:
        if data is None:
            return None
        head = bytes(data[:512])
        if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return False
        if b"\0" in head:
            return True
        try:
            head.decode()
        except UnicodeDecodeError as e:
            if e.start < len(head) - 3 or len(data) <= 512:
                return True
        return 10 * sum(b < 32 and b not in b"\t\n\r\f\b\x1b" for b in head) > len(head)

    return pd.Series([one(d) for d in contents], dtype=object)


def decide(walked: DataFrame, ignore_files: DataFrame | None = None) -> DataFrame:
    """walked plus text and skip_reason (null: taken). Pruned directories are dropped silently. walked: project_id, path, size, content.

    ignore_files: project_id, dir, rules. A project's rules are gathered into one row per project. Their bytes are counted;
    up to BROADCAST_RULES they are broadcast, so contents don't move; beyond, the paths alone are shuffled to them, and the
    ignored ones then meet the files by project and path.
    """
    rows = walked.filter(~P.denylisted(F.col("path")))
    if ignore_files is not None:
        levels = ignore_files.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("dir", "rules"))).alias("__levels"))
        held = ignore_files.agg(F.sum(F.coalesce(F.octet_length("rules"), F.lit(0)) + F.coalesce(F.octet_length("dir"), F.lit(0)) + 100).alias("n")).first()["n"]
        if (held or 0) <= BROADCAST_RULES:
            rows = rows.join(F.broadcast(levels), "project_id", "left").withColumn("__ignored", gitignored("path", "__levels")).drop("__levels")
        else:
            paths = rows.select(*KEY).distinct().join(levels, "project_id").withColumn("__ignored", gitignored("path", "__levels")).filter("__ignored")
            rows = rows.join(paths.select(*KEY, "__ignored"), KEY, "left").withColumn("__ignored", F.coalesce("__ignored", F.lit(False)))
    else:
        rows = rows.withColumn("__ignored", F.lit(False))
    text = T.normal_text(F.make_valid_utf8(F.col("content").cast("string")))
    binary = binary_file("content")
    rows = rows.withColumn("__binary", binary).withColumn("text", F.when(~F.col("__binary"), text))
    reason = P.skip_reason(F.col("path"), F.col("size"), F.col("__ignored"), F.col("__binary"), T.minified(F.col("text")))
    return rows.withColumn("skip_reason", reason).drop("__ignored", "__binary")


def skip_tally(decided: DataFrame) -> DataFrame:
    """project_id, skip_reasons (map), files_skipped."""
    counts = decided.filter("skip_reason IS NOT NULL").groupBy("project_id", "skip_reason").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counts.groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("skip_reason", "n")))).alias("skip_reasons"), F.sum("n").cast("long").alias("files_skipped"))


def diff_files(walked: DataFrame, existing: DataFrame) -> DataFrame:
    """project_id, path, state: new, changed, unchanged or stale. Both: project_id, path, content_hash.

    Null keys are keys like any other. A file without a hash (its text is null) is there, and equals another without one.
    """
    a = walked.select(*KEY, F.col("content_hash").alias("now"), F.lit(True).alias("here"))
    b = existing.select(F.col("project_id").alias("p"), F.col("path").alias("f"), F.col("content_hash").alias("was"), F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "stale").when(F.col("now").eqNullSafe(F.col("was")), "unchanged").otherwise("changed")
    both = a.join(b, a["project_id"].eqNullSafe(b["p"]) & a["path"].eqNullSafe(b["f"]), "full_outer")
    own = [F.when(F.col("here"), F.col(c)).otherwise(F.col(d)).alias(c) for c, d in (("project_id", "p"), ("path", "f"))]
    return both.select(*own, state.alias("state"))


def stale_files(walked: DataFrame, existing: DataFrame) -> DataFrame:
    return existing.join(walked.select(*KEY), KEY, "left_anti")


def unchanged_chunks(chunks: DataFrame, diff: DataFrame) -> DataFrame:
    return chunks.join(diff.filter("state = 'unchanged'").select(*KEY), KEY, "left_semi")


def build_chunks(files: DataFrame, lang_col: str | None = None) -> DataFrame:
    """Chunk rows with deterministic ids, hashes and search texts. files: project_id, path, text and maybe a language."""
    cut = chunk_files(files.withColumn("lines", T.to_lines(F.col("text"))), KEY, "lines", lang_col)
    chunk_id = F.sha2(F.concat_ws("\x00", "project_id", "path", F.col("ord").cast("string")), 256)
    return cut.select(chunk_id.alias("chunk_id"), *KEY, "ord", "start_line", "end_line", "symbol", "content", T.sha256(F.col("content")).alias("content_hash"), T.search_text(F.col("content")).alias("search_text"), F.lit(None).cast("array<float>").alias("embedding"))


def fitting_chunks(chunks: DataFrame, chars: int = FITTING_CHARS) -> DataFrame:
    """chunks, those of more than `chars` characters in parts, so that a model's input holds each whole.

    Parts end before white space where there is any, follow each other without loss, and keep the chunk's place and lines; the first
    keeps its id, the others' ids are hashes of it and their number. Hashes and search texts are made anew; vectors of parts are null.
    """
    long = F.coalesce(F.char_length("content") > chars, F.lit(False))
    parts = F.when(long, F.regexp_extract_all("content", F.lit(rf"(?s).{{1,{chars}}}(?=\s|\z)|(?s).{{1,{chars}}}"), F.lit(0))).otherwise(F.array("content"))
    # One pass: chunks are as costly to make as their texts are to cut.
    cut = chunks.select("*", long.alias("__long"), F.posexplode(parts).alias("__n", "__part"))
    own = {
        "chunk_id": F.when(F.col("__n") == 0, F.col("chunk_id")).otherwise(F.sha2(F.concat_ws("\x00", "chunk_id", F.col("__n").cast("string")), 256)),
        "content": F.col("__part"), "content_hash": T.sha256(F.col("__part")), "search_text": T.search_text(F.col("__part")), "embedding": F.lit(None).cast("array<float>"),
    }
    return cut.select(*[F.when(F.col("__long"), own[c]).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in chunks.columns])


def first_chunks(chunks: DataFrame) -> DataFrame:
    """The first chunk of every file that has any."""
    return chunks.filter("ord = 0")


def build_index(walked: DataFrame, files: DataFrame, chunks: DataFrame, lang_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) after indexing: unchanged files keep rows and vectors, new and changed ones are chunked, stale ones go.

    walked: project_id, path, text (taken files only).
    """
    lines = F.size(T.to_lines(F.col("text"))).alias("line_count")
    # Texts are read and hashed once for the narrow table of files; only those of fresh files are read again.
    now = stored(walked.select(*KEY, P.lang_from_path(F.col("path")).alias("lang"), T.file_content_hash(F.col("text")).alias("content_hash"), lines))
    diff = stored(diff_files(now, files))
    fresh = walked.join(diff.filter("state IN ('new', 'changed')").select(*KEY), KEY, "left_semi")
    kept = unchanged_chunks(chunks, diff)
    return now, kept.unionByName(build_chunks(fresh.withColumn("lang", P.lang_from_path(F.col("path"))), lang_col))


def write_index(table: DataFrame, path: str) -> None:
    """Replaces the partitions of the projects in `table`, whole and at once; other projects stay."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def project_counts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    f = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("file_count"))
    c = chunks.groupBy("project_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return f.join(c, "project_id", "left").select("project_id", "file_count", F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"))


def storage_report(chunks: DataFrame, vector_bytes: int = 2, budget: int = STORAGE_BUDGET) -> DataFrame:
    vectors = F.coalesce(F.size("embedding"), F.lit(0)) * vector_bytes
    out = chunks.groupBy("project_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum(F.octet_length("content")).cast("long").alias("content_bytes"), F.sum(F.greatest(vectors, F.lit(0))).cast("long").alias("vector_bytes"))
    return out.withColumn("percent", F.round(100 * (F.col("content_bytes") + F.col("vector_bytes")) / budget, 6))


def embedding_coverage(chunks: DataFrame) -> DataFrame:
    size = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return chunks.groupBy("project_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("embedded"), F.count_if(F.col("embedding").isNull()).alias("missing"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim"))


def tree_hash(files: DataFrame) -> DataFrame:
    """project_id, tree_hash: hash over the sorted `dir:hash` lines of its directories, each hashed over its own `path:hash` lines."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    per_dir = _hash_of_lines(files.select("project_id", folder.alias("dir"), "path", "content_hash"), ["project_id", "dir"], "path", "content_hash", "h")
    return _hash_of_lines(per_dir, ["project_id"], "dir", "h", "tree_hash")


def _hash_of_lines(rows: DataFrame, keys: list[str], name: str, value: str, out: str) -> DataFrame:
    """keys, out: SHA-256 over each group's `name:value` lines in order. Groups stream by, sorted; none is held whole.

    Rows without name or value give no line; a group without lines has the hash of the empty string.
    """
    lines = rows.select(*keys, name, value, F.concat(name, F.lit(":"), value).alias("line"))
    ordered = lines.repartition(*keys).sortWithinPartitions(*keys, name, value).select(*keys, "line")
    schema = rows.select(*keys, F.lit("").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, begun, kinds = None, None, False, []
        for batch in batches:
            done, kinds = [], [batch.schema.field(k).type for k in keys]
            for *own, line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if digest is None or own != key:
                    done += [] if digest is None else [(*key, digest.hexdigest())]
                    key, digest, begun = own, hashlib.sha256(), False
                if line is not None:
                    digest.update((b"\n" if begun else b"") + line.encode())
                    begun = True
            yield finished(done, kinds)
        if digest is not None:
            yield finished([(*key, digest.hexdigest())], kinds)

    def finished(done: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * (len(keys) + 1)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, pa.string()], strict=True)], [*keys, out])

    return ordered.mapInArrow(run, schema)


def cost_estimate(diff: DataFrame, chunks_now: DataFrame, cache: DataFrame, model_id: str) -> DataFrame:
    """project_id, unchanged_chunks, cached_chunks, to_embed_chunks, requests, percent_of_day.

    chunks_now: project_id, path, text_hash of every chunk as it would be indexed; cache: model_id, text_hash.
    """
    known = cache.filter(F.col("model_id") == model_id).select("text_hash").distinct().withColumn("hit", F.lit(True))
    rows = chunks_now.join(diff, KEY).join(known, "text_hash", "left")
    same = F.col("state") == "unchanged"
    out = rows.groupBy("project_id").agg(F.count_if(same).alias("unchanged_chunks"), F.count_if(~same & F.col("hit").isNotNull()).alias("cached_chunks"), F.count_if(~same & F.col("hit").isNull()).alias("to_embed_chunks"))
    requests = F.ceil(F.col("to_embed_chunks") / REQUEST_SIZE).cast("long")
    return out.withColumn("requests", requests).withColumn("percent_of_day", F.round(100 * F.col("requests") / REQUESTS_A_DAY).cast("long"))


def set_embeddings(chunks: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """chunks with the given vectors put in; a vector of another length fails the job. vectors: chunk_id, vector."""
    checked = vectors.select("chunk_id", F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.lit("a vector has the wrong length")).cast("array<float>")).alias("__v"))
    joined = chunks.join(checked, "chunk_id", "left")
    return joined.withColumn("embedding", F.coalesce("__v", "embedding")).drop("__v")


def pending_embeddings(chunks: DataFrame) -> DataFrame:
    return chunks.filter("embedding IS NULL")


def cached_vectors(texts: DataFrame, cache: DataFrame, model_id: str, dim: int) -> DataFrame:
    """texts (text_hash, ...) plus vector: the cache's, if it has the right length; else null."""
    good = cache.filter((F.col("model_id") == model_id) & (F.size("embedding") == dim)).groupBy("text_hash").agg(F.first("embedding").alias("vector"))
    return texts.join(good, "text_hash", "left")


def purged_cache(cache: DataFrame, model_id: str, dim: int) -> DataFrame:
    """The cache without this model's vectors of another length, which are never used again. Rewritten by its owner, at times of their choice."""
    return cache.filter(~(F.col("model_id").eqNullSafe(model_id) & ~F.size("embedding").eqNullSafe(dim)))


def batches_of(lengths: list[int], cost: int = BATCH_COST) -> list[list[int]]:
    """Row numbers in batches of similar length: count * longest^2 is at most cost, but for a row that is alone above it."""
    out: list[list[int]] = []
    for row in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if out and (len(out[-1]) + 1) * lengths[row] ** 2 <= cost:
            out[-1].append(row)
        else:
            out.append([row])
    return out


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Deterministic vectors of unit length from hashed words: the default where no model is plugged in."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[row, h % dim] += 1 if h & 1 << 20 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


def embed_pending(chunks: DataFrame, cache: DataFrame, model_id: str, dim: int, factory: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_embedder) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, new cache rows). Each distinct text that the cache misses is embedded once; the model is made once per task.

    chunks are read three times: store them first if they are costly to make.
    """
    text = T.model_input(T.embedding_text(F.col("path"), F.col("symbol"), F.col("start_line"), F.col("end_line"), F.col("content")))
    todo = pending_embeddings(chunks).withColumn("__text", text).withColumn("text_hash", T.sha256(F.col("__text")))
    known = stored(cached_vectors(todo.select("chunk_id", "text_hash"), cache, model_id, dim))
    lacking = known.filter("vector IS NULL").select("text_hash").distinct()
    missing = todo.join(lacking, "text_hash", "left_semi").groupBy("text_hash").agg(F.first("__text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = factory()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            vectors = np.zeros((len(texts), dim), np.float32)
            for rows in batches_of([len(t) for t in texts]):
                made = np.asarray(embed([texts[i] for i in rows]), np.float32)
                if made.shape != (len(rows), dim):
                    raise ValueError(f"the model gave vectors of shape {made.shape}, not {(len(rows), dim)}")
                vectors[rows] = made
            yield pa.RecordBatch.from_arrays([batch.column("text_hash"), pa.array(list(vectors), pa.list_(pa.float32()))], ["text_hash", "vector"])

    # Written before it is used twice, so that the model sees each text once.
    fresh = stored(missing.mapInArrow(run, "text_hash string, vector array<float>"))
    made = known.filter("vector IS NULL").select("chunk_id", "text_hash").join(fresh, "text_hash").select("chunk_id", "vector")
    found = known.filter("vector IS NOT NULL").select("chunk_id", "vector").unionByName(made)
    return set_embeddings(chunks, found, dim), fresh.select(F.lit(model_id).alias("model_id"), "text_hash", F.col("vector").alias("embedding"))


def embed_queries(queries: DataFrame, dim: int, factory: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_embedder) -> DataFrame:
    """queries plus vector. queries: text."""
    rows = queries.withColumn("__input", T.model_input(F.coalesce("text", F.lit("")), True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = factory()
        for batch in batches:
            vectors = np.asarray(embed(batch.column("__input").to_pylist()), np.float32).reshape(batch.num_rows, dim)
            yield batch.drop_columns(["__input"]).append_column("vector", pa.array(list(vectors), pa.list_(pa.float32())))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, vector array<float>")


def latest_job(jobs: DataFrame, keys: str = "project_id", order: Column | None = None) -> DataFrame:
    """The newest row of each project: partial maxima, no sort of the whole."""
    columns = [c for c in jobs.columns if c != keys]
    newest = jobs.groupBy(keys).agg(F.max_by(F.struct(*columns), order if order is not None else F.struct("created_at", "job_id")).alias("__job"))
    return newest.select(keys, *[F.col(f"__job.{c}").alias(c) for c in columns])


def projects_with_latest_job(projects: DataFrame, jobs: DataFrame) -> DataFrame:
    """projects plus the columns of their newest job, null without any. Those that a project has too are named job_..."""
    newest = latest_job(jobs)
    names = {c: f"job_{c}" for c in newest.columns if c != "project_id" and c in projects.columns}
    return projects.join(newest.withColumnsRenamed(names), "project_id", "left")


def newest_jobs(jobs: DataFrame, limit: int) -> DataFrame:
    """jobs plus place: the `limit` newest of each project, ties to the greater job_id."""
    order = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("job_id"))
    return jobs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def embed_requests_by_day(jobs: DataFrame) -> DataFrame:
    """day, requests: the embedding requests of all jobs by the day of their start."""
    return jobs.groupBy(F.to_date("created_at").alias("day")).agg(F.sum("embed_requests").alias("requests"))


def embed_requests_today(jobs: DataFrame, as_of: Column) -> DataFrame:
    """requests: those of all jobs since the midnight before as_of; 0 without any."""
    today = jobs.filter((F.col("created_at") >= F.date_trunc("day", as_of)) & (F.col("created_at") <= as_of))
    return today.agg(F.coalesce(F.sum("embed_requests"), F.lit(0)).cast("long").alias("requests"))


def changed_file_chunks(chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """Chunks of the changed files, in order of path and place if written or shown. changed: project_id, path."""
    return chunks.join(changed.select(*KEY), KEY, "left_semi").orderBy(*KEY, "ord")
