"""A versioned index: files and chunks in buckets of (project, path), a manifest for each snapshot, batches applied once.

Layout of an index folder:

    data/<version>/files/bucket=<b>, data/<version>/chunks/bucket=<b>    Parquet, never changed
    manifests/<number>.json                                               version of each bucket, last batch of each stream

A snapshot is what the manifest with the highest number names. A batch (new texts, null for files that are gone) reads
the buckets of its files, leaves out files whose content hash is the same, chunks the others, writes the touched buckets anew
under a new version, and then puts the next manifest in place with one rename. Texts are shuffled once, to their buckets, and chunked
there; what a bucket keeps is written by the tasks that read it; search texts are made of the contents when they are read. A writer that dies before that leaves the old
snapshot whole, and its data are in no manifest. One changed file rewrites one bucket; a project without files has no rows.

Streams: a manifest also holds the last batch of each stream, so a batch that is replayed after the swap changes nothing;
one replayed before it is done again. One writer at a time: a manifest number that another writer has taken is an error.

Defined results: of several rows of one file in a batch the one with the greatest `seq` counts, then the greatest text, and a text
before none; rows without project or path are left out; an empty batch, and one that changes nothing, makes no
snapshot of its own unless a stream's batch number has to be kept. Other columns are not looked at.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import paths as P
from ..functions import text as T
from .indexing import KEY, build_chunks
from .storage import stored

BUCKETS = 64
FILES = "project_id string, path string, lang string, content_hash string, line_count int"
CHUNKS = "chunk_id string, project_id string, path string, ord int, start_line int, end_line int, symbol string, content string, content_hash string, search_text string, embedding array<float>"
#: As written: without what is made of other columns.
_TABLES = {"files": FILES, "chunks": CHUNKS.replace("search_text string, ", "")}
#: Keys of changed files are broadcast up to so many (some 100 bytes each).
BROADCAST_KEYS = 400_000


def bucket(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64("project_id", "path"), F.lit(buckets)).cast("int")


def _store(spark: SparkSession, folder: str):
    """(Hadoop file system of the folder, what makes a path)."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def manifest(spark: SparkSession, folder: str) -> dict:
    """number (0: none yet), buckets (bucket -> version), streams (name -> last batch) of the newest snapshot."""
    fs, path = _store(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path(f"{folder}/manifests"))] if fs.exists(path(f"{folder}/manifests")) else []
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."]
    if not numbers:
        return {"number": 0, "count": BUCKETS, "buckets": {}, "streams": {}}
    whole = spark.sparkContext.wholeTextFiles(f"{folder}/manifests/{max(numbers)}.json").values().first()
    return json.loads(whole)


def _put(spark: SparkSession, folder: str, new: dict) -> None:
    """The next manifest, under its name only when it is complete."""
    fs, path = _store(spark, folder)
    final, part = path(f"{folder}/manifests/{new['number']}.json"), path(f"{folder}/manifests/.{uuid.uuid4().hex}.json")
    out = fs.create(part)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(part, final):
        raise ValueError(f"another writer has made snapshot {new['number']} of {folder}")


def read_snapshot(spark: SparkSession, folder: str, table: str, buckets: list[int] | None = None, at: dict | None = None) -> DataFrame:
    """The rows of `files` or `chunks` in the newest snapshot, or in the one whose manifest is given; of some buckets alone, if named."""
    held = (at or manifest(spark, folder))["buckets"]
    places = [f"{folder}/data/{version}/{table}/bucket={b}" for b, version in held.items() if buckets is None or int(b) in buckets]
    fs, path = _store(spark, folder)
    there = [p for p in places if fs.exists(path(p))]  # a bucket that has become empty has no folder
    rows = spark.read.schema(_TABLES[table]).parquet(*there) if there else spark.createDataFrame([], _TABLES[table])
    if table == "chunks":
        return rows.select(*[T.search_text(F.col("content")).alias(c) if c == "search_text" else F.col(c) for c in _names(CHUNKS)])
    return rows


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _last_of_each(batch: DataFrame) -> DataFrame:
    """project_id, path, text: of several rows of a file the last. Texts move only for files that come more than once."""
    named = batch.filter("project_id IS NOT NULL AND path IS NOT NULL")
    rows = stored(named.select(*KEY, "text", *(["seq"] if "seq" in batch.columns else [])))
    again = stored(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*KEY))
    count = again.count()
    if not count:
        return rows.select(*KEY, "text")
    some = F.broadcast(again) if count <= BROADCAST_KEYS else again
    rank = F.struct(F.col("seq") if "seq" in rows.columns else F.lit(0), F.col("text").isNotNull(), F.col("text"))
    last = rows.join(some, KEY, "left_semi").groupBy(*KEY).agg(F.max_by("text", rank).alias("text"))
    return rows.join(some, KEY, "left_anti").select(*KEY, "text").unionByName(last)


def apply_batch(spark: SparkSession, folder: str, batch: DataFrame, stream: str | None = None, batch_id: int | None = None, lang_col: str | None = None, buckets: int = BUCKETS) -> dict:
    """The manifest after the batch. batch: project_id, path, text (null: the file is gone), and seq if a file may come twice.

    stream, batch_id: a batch of a stream at or below the last one that was applied is left alone.
    """
    now = manifest(spark, folder)
    if stream is not None and now["streams"].get(stream, -1) >= batch_id:
        return now
    count = now["count"] if now["number"] else buckets
    asked = _last_of_each(batch).withColumn("content_hash", T.file_content_hash(F.col("text"))).withColumn("bucket", bucket(count))
    # Hashes alone meet those of the snapshot; texts follow for the files that differ.
    hashes = stored(asked.drop("text"))
    touched = [r.bucket for r in hashes.select("bucket").distinct().collect()]  # `count` at most
    files = read_snapshot(spark, folder, "files", touched, now)
    before = files.select(*KEY, F.col("content_hash").alias("was"))
    keys = stored(hashes.join(before, KEY, "left").filter(~F.col("content_hash").eqNullSafe(F.col("was"))).drop("was"))
    dirty = [r.bucket for r in keys.select("bucket").distinct().collect()]
    streams = now["streams"] | ({stream: batch_id} if stream is not None else {})
    if not dirty and streams == now["streams"]:
        return now
    version = uuid.uuid4().hex
    if dirty:
        few = keys.count()
        own = keys.select(*KEY)
        own = F.broadcast(own) if few <= BROADCAST_KEYS else own
        new = asked.filter("text IS NOT NULL")
        # A batch that changes all it has, as a first one does, needs no join.
        new = new if few == hashes.count() else new.join(own, KEY, "left_semi")
        # A bucket's texts meet in one task: an index has as many buckets as keep one below some hundred megabytes.
        fresh = stored(new.withColumn("lang", P.lang_from_path(F.col("path"))).repartition("bucket"))
        lines = F.size(T.to_lines(F.col("text"))).alias("line_count")
        chunks = build_chunks(fresh.select(*KEY, "text", "lang"), lang_col)
        for table, rows in (("files", fresh.select(*KEY, "lang", "content_hash", lines)), ("chunks", chunks)):
            kept = read_snapshot(spark, folder, table, dirty, now).join(own, KEY, "left_anti")
            # Tasks hold whole buckets, or what one bucket keeps: none is shuffled, and each writes few files.
            whole = kept.select(rows.columns).unionByName(rows).select(*_names(_TABLES[table])).withColumn("bucket", bucket(count))
            whole.sortWithinPartitions("bucket", *KEY).write.partitionBy("bucket").parquet(f"{folder}/data/{version}/{table}")
    after = {"number": now["number"] + 1, "count": count, "buckets": now["buckets"] | {str(b): version for b in dirty}, "streams": streams}
    _put(spark, folder, after)
    return after


def continuous_index(files: DataFrame, folder: str, checkpoint: str, name: str = "files", lang_col: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """A stream of files (project_id, path, text, and maybe seq) applied batch by batch. A batch that is replayed changes nothing."""

    def step(batch: DataFrame, number: int) -> None:
        apply_batch(batch.sparkSession, folder, batch, name, number, lang_col)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def expire(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Removes manifests but the newest `keep`, and the versions that none of these names; returns those versions. For times without readers of old snapshots or a writer."""
    fs, path = _store(spark, folder)
    numbers = sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(path(f"{folder}/manifests")) if s.getPath().getName()[0] != ".")
    held = set()
    for n in numbers[-keep:]:
        held |= set(json.loads(spark.sparkContext.wholeTextFiles(f"{folder}/manifests/{n}.json").values().first())["buckets"].values())
    gone = [s.getPath().getName() for s in fs.listStatus(path(f"{folder}/data")) if s.getPath().getName() not in held] if fs.exists(path(f"{folder}/data")) else []
    for n in numbers[:-keep]:
        fs.delete(path(f"{folder}/manifests/{n}.json"), False)
    for version in gone:
        fs.delete(path(f"{folder}/data/{version}"), True)
    return gone
