"""What the operators of this package share: the cluster's shared folder, written tables, text blocks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words in every contract of this package.
SPACES = b" \t\n\r\x0b\x0c"
#: The same words as a pattern that Spark's and DuckDB's regular expressions both take.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder of this application inside spark.checkpoint.dir, which all machines of a cluster share.

    Where the setting is missing, a temporary folder is made on one machine (local master: tests); on a cluster that is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("millrace.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("millrace.shared.dir", root)
    return f"{root.rstrip('/')}/millrace-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder name inside the application's shared folder."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> None:
    """Removes all that this application has written to its shared folder. For the end of a job, when its results are stored elsewhere."""
    fs, root = store(shared_root(spark))
    if fs.get_file_info(root).type.name == "Directory":
        fs.delete_dir(root)


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = folder or shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowest_hashes(rows: DataFrame, n: int, keys: list[str], seed: int = 0, count: int | None = None) -> DataFrame:
    """The n rows with the lowest hashes of their keys, or all if there are fewer: the same ones at any size and in any partitioning.

    Of rows with equal keys one is taken. Rows far above the bound that n of `count` need go in a first filter, so a task
    never holds or sends more than its part of about 2n rows; should the filter leave too few, all rows are ordered.
    """
    total = rows.count() if count is None else count
    hashed = rows.withColumn("__h", F.xxhash64(F.lit(seed), *keys).bitwiseAND((1 << 63) - 1))
    few = hashed
    if total > 4 * n:
        few = hashed.filter(F.col("__h") < int((2 * n + 40) / total * (1 << 63))).dropDuplicates(["__h", *keys])
        if few.count() < n:
            few = hashed
    return few.dropDuplicates(["__h", *keys]).orderBy("__h", *keys).limit(n).drop("__h")


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about `size` bytes together; a longer text is a part alone. No row is cut or lost."""
    lengths = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(lengths.buffers()[1], np.int64, len(lengths) + 1, lengths.offset * 8) if len(lengths) else np.zeros(1, np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, min(end, batch.num_rows) - at)
        at = end
    give_back()


def give_back() -> None:
    """Memory that a worker has freed goes back to the machine: workers live on through the stages of a job."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def store(uri: str):
    """(file system, path) of a folder in the shared folder: any store that pyarrow reaches (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class SharedFile:
    """A file that appears under its name only when it is complete, so a retried or doubled task leaves one whole file."""

    def __init__(self, folder: str, name: str):
        self.fs, root = store(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.part = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.out, self.size = self.fs.open_output_stream(self.part), 0

    def write(self, data: bytes) -> int:
        """Appends; says where the data begin."""
        self.out.write(data)
        self.size += len(data)
        return self.size - len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)
