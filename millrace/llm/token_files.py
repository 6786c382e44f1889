"""Token-id files: every document compressed by itself with one shared zstandard dictionary.

A set of files is written in ascending order of ids, shard after shard. Each shard is a data file of zstandard frames,
one per document, and an index file: a header line (JSON: format, SHA-256 of the dictionary, type of the ids, documents,
tokens), then an array of (id, flags, offset, length, tokens). A document is read with one index lookup and one read of
its own frame; the dictionary is what lets frames of few tokens be short. A reader refuses a dictionary whose hash isn't
the header's.

The dictionary is trained on the serialized ids of a bounded sample of documents (DICTIONARY_ROWS, by the hash of id and
text). Documents are range-partitioned by id and the beginning of the text before they are encoded, so ids never move,
shards follow each other, and the rows of one id (or without id) may be many.

Defined results: null and empty texts are the closing token alone; null ids come first and stay null; rows with one id
stay together, ordered by their texts; empty tables give a set without shards. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunk_memo import REMEMBERED, ChunkMemo
from .shared import SharedFile, lowest_hashes, shared_folder, slices, store, written

DICTIONARY_ROWS, DICTIONARY_BYTES, SAMPLE_BYTES = 1_000, 64 << 10, 32 << 10
#: A shard is closed after the document with which its frames reach this size.
SHARD_BYTES = 64 << 20
FORMAT = "millrace-tokens-1"
INDEX = np.dtype([("id", "<i8"), ("null_id", "u1"), ("offset", "<u8"), ("length", "<u4"), ("tokens", "<u4")])
#: Chunks that are encoded as one text.
_TOGETHER = 500


class LibraryTokenizer:
    """The tokenizers library on whole texts; chunks that recur are encoded by it once per worker."""

    def __init__(self, path: str, width: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.width = Tokenizer.from_file(path), width
        vocabulary = self.library.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # the byte-level alphabet has a letter for each byte
        self.memo = ChunkMemo(self._chunks, np.dtype(width).itemsize, 2 * REMEMBERED)  # ids are short, so more chunks fit

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk. Many are encoded as one text, as they follow each other in texts; the bytes that ids stand for tell where each ends."""
        out: list[bytes] = []
        groups = [chunks[i : i + _TOGETHER] for i in range(0, len(chunks), _TOGETHER)]
        joined = [g if all(c[0] == " " and len(c) > 1 for c in g) else None for g in groups]
        encoded = iter(self.library.encode_batch_fast(["".join(g) for g in joined if g], add_special_tokens=False))
        for own, together in zip(groups, joined, strict=True):
            ids = np.array(next(encoded).ids, self.width) if together else np.zeros(0, self.width)
            last = np.cumsum(self.bytes_of[ids])
            ends = np.cumsum([len(c.encode()) for c in own])
            cuts = np.searchsorted(last, ends) + 1
            if together and len(last) == cuts[-1] and (last[cuts - 1] == ends).all():
                data, width, start = ids.tobytes(), ids.itemsize, 0
                for end in cuts.tolist():
                    out.append(data[start * width : end * width])
                    start = end
            else:  # heads of texts, single tails, or a vocabulary that isn't byte-level
                out += [np.array(e.ids, self.width).tobytes() for e in self.library.encode_batch_fast(own, add_special_tokens=False)]
        return out

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        return self.memo.encode(texts)


@lru_cache(maxsize=2)
def tokenizer(path: str, width: str) -> LibraryTokenizer:
    return LibraryTokenizer(path, width)


def id_width(vocabulary: int) -> str:
    """Ids are kept in 16 bits where the vocabulary allows."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, tokenizer_path: str, width: str, end_id: int) -> bytes:
    """From the DICTIONARY_ROWS documents with the lowest hashes of id and text (all, if there are fewer), at most SAMPLE_BYTES of ids of each.

    With too little to train on, the samples themselves are the dictionary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], width).tobytes()
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                own = tokenizer(tokenizer_path, width).encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array([(x + end)[:SAMPLE_BYTES] for x in own], pa.binary())], ["ids"])

    # Documents are chosen by a hash of theirs; then the texts of those few are fetched.
    keyed = docs.select(F.xxhash64("id", "text").alias("key"), "text")
    chosen = written(lowest_hashes(keyed.select("key"), DICTIONARY_ROWS, ["key"]))
    texts = keyed.join(F.broadcast(chosen), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    samples = sorted(bytes(r.ids) for r in texts.select("text").mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _loaded(data: bytes) -> zstandard.ZstdCompressionDict:
    trained = data[:4] == b"\x37\xa4\x30\xec"  # the magic number of trained dictionaries
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> str:
    """Writes the files and a table of shards (`shards`); says the folder. Ids must be whole numbers."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    width = id_width(max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1))
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dictionary = train_dictionary(narrow, tokenizer_path, width, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    kept = SharedFile(folder, "dictionary.zdict")
    kept.write(dictionary)
    kept.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level, dict_data=_loaded(dictionary) if dictionary else None, write_content_size=True)
        end, partition, number = np.array([end_id], width), TaskContext.get().partitionId(), 0
        data, index = None, []

        def closed() -> pa.RecordBatch:
            name = f"tokens-{partition:06d}-{number:04d}"
            rows = np.array(index, INDEX)
            data.close()
            side = SharedFile(folder, f"{name}.idx")
            side.write((json.dumps({"format": FORMAT, "dictionary": digest, "ids": width, "documents": len(rows), "tokens": int(rows["tokens"].sum())}) + "\n").encode())
            side.write(rows.tobytes())
            side.close()
            return pa.RecordBatch.from_pylist([{"part": partition, "number": number, "name": name, "documents": len(rows), "tokens": int(rows["tokens"].sum()), "bytes": data.size}])

        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                encoded = tokenizer(tokenizer_path, width).encode(part.column("text"))
                for key, ids in zip(part.column("id").to_pylist(), encoded, strict=True):
                    data = data or SharedFile(folder, f"tokens-{partition:06d}-{number:04d}.bin")
                    whole = ids + end.tobytes()
                    frame = compressor.compress(whole)
                    index.append((key or 0, key is None, data.write(frame), len(frame), len(whole) // end.itemsize))
                    if data.size >= SHARD_BYTES:
                        yield closed()
                        data, index, number = None, [], number + 1
        if data:
            yield closed()

    # Ranges are cut by id and how the text begins, which is in keeping with the order by id and text.
    order = [F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ordered = narrow.repartitionByRange(order[0], F.substring("text", 1, 64).asc_nulls_first()).sortWithinPartitions(*order)
    ordered.mapInArrow(run, "part long, number long, name string, documents long, tokens long, bytes long").write.parquet(f"{folder}/shards")
    return folder


def read_index(fs, root: str, name: str) -> tuple[dict, np.ndarray]:
    with fs.open_input_file(f"{root}/{name}.idx") as f:
        head, _, rows = f.read().partition(b"\n")
    header = json.loads(head)
    if header["format"] != FORMAT:
        raise ValueError(f"{name}: not a token index")
    return header, np.frombuffer(rows, INDEX)


def _dictionary(fs, root: str, digest: str) -> bytes:
    with fs.open_input_file(f"{root}/dictionary.zdict") as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError("the dictionary isn't the one these files were written with")
    return data


def read_document(folder: str, name: str, position: int) -> np.ndarray:
    """Ids of one document of one shard: the index row says where its frame is, and only that is read."""
    fs, root = store(folder)
    header, rows = read_index(fs, root, name)
    data = _dictionary(fs, root, header["dictionary"])
    with fs.open_input_file(f"{root}/{name}.bin") as f:
        f.seek(int(rows["offset"][position]))
        frame = f.read(int(rows["length"][position]))
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=_loaded(data) if data else None).decompress(frame), header["ids"])


def read_tokens(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids (binary, little-endian unsigned 32 bits) of every document of the files, one task or more per few shards.

    start: ids before the document's in the whole set. The window runs over one row per shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                header, rows = read_index(fs, root, name)
                data = _dictionary(fs, root, header["dictionary"])
                reader = zstandard.ZstdDecompressor(dict_data=_loaded(data) if data else None)
                starts = start + np.concatenate([[0], np.cumsum(rows["tokens"], dtype=np.int64)])[:-1]
                with fs.open_input_file(f"{root}/{name}.bin") as f:
                    at = 0
                    while at < len(rows):
                        until = max(at + 1, int(np.searchsorted(np.cumsum(rows["tokens"][at:], dtype=np.int64), 1 << 20)) + at)
                        own = rows[at:until]
                        block, base = f.read(int(own["length"].sum(dtype=np.int64))), int(own["offset"][0])
                        ids = [np.frombuffer(reader.decompress(block[int(o) - base : int(o) - base + int(n)]), header["ids"]).astype("<u4").tobytes() for o, n in zip(own["offset"], own["length"], strict=True)]
                        columns = [
                            pa.array(own["id"], pa.int64(), mask=own["null_id"].astype(bool)),
                            pa.array(starts[at:until], pa.int64()),
                            pa.array([len(x) // 4 for x in ids], pa.int64()),
                            pa.array(ids, pa.binary()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids"])
                        at = until

    shards = spark.read.schema("part long, number long, name string, documents long, tokens long, bytes long").parquet(f"{folder}/shards")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(shards.select("name", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start")))
    spread = placed.repartition(max(1, placed.count()))
    return spread.mapInArrow(run, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)
