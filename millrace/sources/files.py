"""Sources: file trees, zip archives, question files. Listings and contents are rows of Spark jobs."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import PRUNED
from ..operators.storage import stored

#: What an archive may hold.
MOST_ENTRIES, ENTRY_BYTES, ARCHIVE_BYTES = 20_000, 200 << 20, 1 << 30
FILE = "project_id string, path string, size long, content binary"
LISTED = "project_id string, root string, path string, size long"
#: Directories that a task lists on average, files of a batch of a listing, bytes that a task reads, what opening a file weighs, and parts of sums.
LISTED_DIRECTORIES, ENTRIES_A_BATCH, TASK_BYTES, OPEN_BYTES, SUM_PARTS = 1_000, 10_000, 128 << 20, 64 << 10, 1_024


def read_tree(roots: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """project_id, path (POSIX, relative), size, content: all files below each root, dot files and empty ones too. roots: project_id, root (a URI of any store pyarrow reaches).

    Directories whose names are pruned aren't entered. Content is null above max_bytes. A root that is missing or null gives
    nothing; a root that is given twice for a project is read once. Listing and reading are dealt over tasks, as list_tree and by_bytes say.
    """

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([("project_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                data = None
                if max_bytes is None or row["size"] <= max_bytes:
                    store, top = fs.FileSystem.from_uri(row["root"])
                    with store.open_input_file(f"{top.rstrip('/')}/{row['path']}") as f:
                        data = f.read()
                yield pa.RecordBatch.from_pylist([{**row, "content": data}], schema)

    listed = list_tree(roots)
    read = F.col("size") if max_bytes is None else F.when(F.col("size") <= max_bytes, F.col("size")).otherwise(0)
    return by_bytes(listed, read).mapInArrow(contents, FILE)


def list_tree(roots: DataFrame) -> DataFrame:
    """project_id, root, path, size of all files below each root. Arguments as in read_tree.

    Level by level: the directories found on a level are a stored table, dealt over all tasks, and list the next level, so a
    project of any size spreads as soon as it branches. A directory's own entries are one listing, given in batches.
    """
    frontier = roots.filter("root IS NOT NULL").select("project_id", "root").distinct().withColumn("path", F.lit(""))
    levels: list[DataFrame] = []
    cores, todo = roots.sparkSession.sparkContext.defaultParallelism, 1
    while todo or not levels:
        tasks = max(cores, -(-todo // LISTED_DIRECTORIES))
        found = stored(frontier.repartition(tasks, "project_id", "root", "path").mapInArrow(_entries, f"{LISTED}, directory boolean"))
        levels.append(found.filter("NOT directory").drop("directory"))
        frontier = found.filter("directory").drop("directory", "size")
        todo = frontier.count()
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files and the directories to be entered of each directory."""
    from pyarrow import fs

    for batch in batches:
        for project, root, below in zip(*(batch.column(c).to_pylist() for c in ("project_id", "root", "path")), strict=True):
            store, top = fs.FileSystem.from_uri(root)
            folder = f"{top.rstrip('/')}/{below}" if below else top
            held = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            kept = [f for f in held if f.type == fs.FileType.File or (f.type == fs.FileType.Directory and f.base_name not in PRUNED)]
            for at in range(0, len(kept), ENTRIES_A_BATCH):
                part = kept[at : at + ENTRIES_A_BATCH]
                columns = {
                    "project_id": [project] * len(part), "root": [root] * len(part), "path": [f.path[len(top.rstrip("/")) + 1 :] for f in part],
                    "size": [f.size for f in part], "directory": [f.type == fs.FileType.Directory for f in part],
                }
                yield pa.RecordBatch.from_pydict(columns, pa.schema([("project_id", pa.string()), ("root", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("directory", pa.bool_())]))


def by_bytes(listed: DataFrame, size: Column, task_bytes: int = 0) -> DataFrame:
    """The files, dealt over partitions of about task_bytes to read each, and no file split. size: bytes to be read of a row.

    A file weighs its bytes and OPEN_BYTES. Files lie on a line in hashed parts; sums before each part (one row a part) and
    inside it give every file its place, and a partition is a stretch of the line.
    """
    weighed = listed.withColumn("__w", size.cast("long") + OPEN_BYTES).withColumn("__p", F.pmod(F.xxhash64(*listed.columns), F.lit(SUM_PARTS)))
    sums = weighed.groupBy("__p").agg(F.sum("__w").alias("w")).orderBy("__p").collect()  # SUM_PARTS rows
    total = sum(r.w for r in sums)
    share = max(1, task_bytes or min(TASK_BYTES, -(-total // listed.sparkSession.sparkContext.defaultParallelism)))
    before, at = [], 0
    for r in sums:
        before.append((r["__p"], at))
        at += r.w
    offsets = F.broadcast(listed.sparkSession.createDataFrame(before, "__p long, __b long"))
    inside = F.sum("__w").over(Window.partitionBy("__p").orderBy("path", "project_id", "root").rowsBetween(Window.unboundedPreceding, -1))
    placed = weighed.join(offsets, "__p").withColumn("__t", F.floor((F.col("__b") + F.coalesce(inside, F.lit(0))) / share).cast("int"))
    return placed.repartitionById(max(1, -(-total // share)), "__t").drop("__w", "__p", "__b", "__t")


def refused(info: zipfile.ZipInfo) -> str | None:
    """Why an entry may not be in an archive."""
    name = info.filename.replace("\\", "/")
    if name.startswith("/") or (len(name) > 1 and name[1] == ":" and name[0].isalpha()):
        return "absolute path"
    if ".." in name.split("/"):
        return "path leaves the archive"
    if (info.external_attr >> 16) & 0o170000 == 0o120000:
        return "symbolic link"
    if info.file_size > ENTRY_BYTES:
        return "entry too large"
    return None


def checked_entries(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """The files of an archive, after all of them have been unpacked once to count their real bytes and check their sums; ValueError if any is refused."""
    infos = [i for i in z.infolist() if not i.is_dir()]
    if len(infos) > MOST_ENTRIES:
        raise ValueError("too many entries")
    total = 0
    for i in infos:
        error = refused(i)
        if error:
            raise ValueError(error)
        held = 0
        with z.open(i) as f:
            while piece := f.read(1 << 20):
                held += len(piece)
                total += len(piece)
                if held > ENTRY_BYTES:
                    raise ValueError("entry too large")
                if total > ARCHIVE_BYTES:
                    raise ValueError("archive too large")
    return infos


def read_archives(archives: DataFrame) -> DataFrame:
    """project_id, path, size, content, error: the files of zip archives; one row with an error for an archive that is refused as a whole. archives: project_id, content (as binaryFile reads them).

    No file of a refused archive comes out: all entries are checked before the first is given. Encrypted, damaged and
    unknown entries are refused likewise; a null archive is an empty one, hence no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("project_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
        row_of = lambda *values: pa.RecordBatch.from_pylist([dict(zip(schema.names, values, strict=True))], schema)
        for batch in batches:
            for row in range(batch.num_rows):
                project, data = batch.column("project_id")[row].as_py(), batch.column("content")[row].as_py() or b""
                try:
                    z = zipfile.ZipFile(io.BytesIO(data))
                    infos = checked_entries(z)
                except (zipfile.BadZipFile, ValueError, RuntimeError, NotImplementedError, EOFError, OSError, zlib.error) as e:
                    yield row_of(project, None, None, None, str(e))
                    continue
                with z:
                    for i in infos:
                        body = z.read(i)
                        yield row_of(project, i.filename.replace("\\", "/"), len(body), body, None)

    return archives.select("project_id", "content").mapInArrow(run, f"{FILE}, error string")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """query_id, q, expected, unanswerable of a JSON array of questions."""
    rows = spark.read.schema("q string, expectedFiles array<string>, expectUnanswerable boolean").option("multiLine", True).json(path)
    return rows.select(F.xxhash64("q").alias("query_id"), "q", F.coalesce("expectedFiles", F.array().cast("array<string>")).alias("expected"), F.coalesce("expectUnanswerable", F.lit(False)).alias("unanswerable"))
