"""WARC archives: writing with segments and revisits, reading with segment reassembly.

A record's block is an HTTP response in chunked transfer framing. Blocks beyond SEGMENT_BYTES are cut: the first part is
the response record (segment 1), the others are continuation records that name it as their origin; the last one states
the length of the whole. A page whose payload another page with a smaller id has, byte for byte and from LEAST_SHARED
bytes on, is written as a revisit of that page's record.

Reading parses the files' records where they are read. Only parts of cut records are shuffled: they are grouped by
origin identifier, ordered by segment number, checked for gaps and for the stated length, joined, and taken out of the
chunked framing. A revisit gets its payload's length and digest from the record that it refers to.

Defined results: a null payload is empty; rows with the smallest id of a group of equal payloads are all responses, also
if repeated; null ids are kept and never first of a group that has another id; empty tables give archives without
pages. A record that can't be reassembled has a null payload and says why in `error`. Other columns are not looked at.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SharedFile, shared_folder, slices, store, texts_of, written

SEGMENT_BYTES, CHUNK_BYTES, LEAST_SHARED = 32 << 10, 8 << 10, 100
FILE_BYTES = 256 << 20
#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
#: Revisits are few in most crawls: up to so many rows (about 150 bytes each) they are broadcast; beyond, Spark joins them by shuffling.
BROADCAST_ROWS = 50_000
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORD = "record_id string, type string, page_id string, uri string, refers_to string, origin string, segment int, total long, part binary, payload binary, error string"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload inside chunked framing; ValueError if the framing is broken. Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunked framing: no chunk size")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunked framing: chunk of another length")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """What an HTTP response block carries."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP headers")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record_id(page_id: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest}')}>"


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [VERSION, *[f"{k}: {v}".encode() for k, v in headers if v is not None], b"Content-Length: %d" % len(block)]
    return gzip.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def page_records(page_id: str | None, uri: str | None, payload: bytes, digest: str, first: str | None) -> Iterator[bytes]:
    """The records of one page. first: id of the page whose payload this one repeats."""
    own = record_id(page_id or "null", digest)
    uri = None if uri is None else uri.replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if first is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Refers-To", record_id(first, digest)), ("WARC-Profile", REVISIT_PROFILE), *common], head)
        return
    block = head + chunked(payload)
    parts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    if len(parts) == 1:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common], block)
        return
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Segment-Number", 1), *common], parts[0])
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"{page_id}:{n}", digest)), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total), ("WARC-Date", DATE), ("WARC-Target-URI", uri)], part)


def revisits(pages: DataFrame) -> DataFrame:
    """id, digest, first: the pages that repeat another's payload. pages: id, payload. Hashes and ids only."""
    hashed = written(pages.filter(F.octet_length("payload") >= LEAST_SHARED).select("id", F.sha2("payload", 256).alias("digest")))
    firsts = hashed.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = written(hashed.join(written(firsts), "digest").filter("NOT id <=> first").select("id", "digest", "first").distinct())
    return F.broadcast(found) if found.count() <= BROADCAST_ROWS else found


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Writes archives, one or more for each task, and a table of them (`files`); says the folder."""
    folder = folder or shared_folder(pages.sparkSession)
    narrow = pages.select(F.col(id_col).cast("string").alias("page"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    known = revisits(narrow.select("id", "payload")).select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("first").cast("string").alias("first"))
    placed = narrow.withColumn("digest", F.sha2("payload", 256))
    marked = placed.join(known, placed["id"].eqNullSafe(F.col("r_id")) & (placed["digest"] == F.col("r_digest")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number, out = TaskContext.get().partitionId(), 0, None

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"name": f"pages-{partition:06d}-{number:04d}.warc.gz", "bytes": out.size}])

        for batch in batches:
            for part in slices(batch, "payload"):
                for page, url, payload, digest, first in zip(part.column("page").to_pylist(), part.column("url").to_pylist(), texts_of(part, "payload"), part.column("digest").to_pylist(), part.column("first").to_pylist(), strict=True):
                    if out is None:
                        out = SharedFile(folder, f"pages-{partition:06d}-{number:04d}.warc.gz")
                        out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(f"file:{partition}:{number}", "")), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    for data in page_records(page, url, payload, digest, first):
                        out.write(data)
                if out and out.size >= FILE_BYTES:
                    yield closed()
                    out, number = None, number + 1
        if out:
            yield closed()

    marked.select("page", "url", "payload", "digest", "first").mapInArrow(run, "name string, bytes long").write.parquet(f"{folder}/files")
    return folder


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an unpacked archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:60]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.partition(b":")
            headers[key.decode().lower()] = value.decode().strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("the archive ends inside a record")
        yield headers, block


def read_records(spark: SparkSession, folder: str, segments: bool) -> DataFrame:
    """Columns of RECORD: parts of cut records (segments), or all other records of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        schema = pa.schema([(k, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for k, t in (x.split() for x in RECORD.split(", "))])
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.open(raw) as stream:
                    for h, block in parse(stream):
                        cut = "warc-segment-number" in h
                        if cut != segments or h["warc-type"] not in ("response", "revisit", "continuation"):
                            continue
                        row = {"record_id": h["warc-record-id"], "type": h["warc-type"], "page_id": h.get("warc-page-id"), "uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to")}
                        if cut:
                            total = h.get("warc-segment-total-length")
                            row |= {"origin": h.get("warc-segment-origin-id", h["warc-record-id"]), "segment": int(h["warc-segment-number"]), "total": total and int(total), "part": block}
                        elif h["warc-type"] == "response":
                            try:
                                row["payload"] = payload_of(block)
                            except ValueError as e:
                                row["error"] = str(e)
                        rows.append(row)
                        size += len(block)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.schema("name string, bytes long").parquet(f"{folder}/files").select("name")
    return files.repartition(max(1, files.count())).mapInArrow(run, RECORD)


def reassembled(parts: DataFrame) -> DataFrame:
    """record_id, type, page_id, uri, payload, error for each cut record. A group is one record: its size is that of one page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, errors = [], []
            for own, total in zip(batch.column("parts").to_pylist(), batch.column("total").to_pylist(), strict=True):
                block, error, payload = b"".join(p["part"] for p in own), None, None
                if [p["segment"] for p in own] != list(range(1, len(own) + 1)) or total is None:
                    error = "segments are missing"
                elif len(block) != total:
                    error = f"{len(block)} bytes, {total} stated"
                else:
                    try:
                        payload = payload_of(block)
                    except ValueError as e:
                        error = str(e)
                payloads.append(payload)
                errors.append(error)
            columns = [batch.column(c) for c in ("origin", "heads", "total")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(payloads, pa.binary()), pa.array(errors, pa.string())], ["origin", "heads", "total", "payload", "error"])

    # A repeated page has each of its segments more than once, all alike; it stays repeated.
    head = F.when(F.col("segment") == 1, F.struct("page_id", "uri"))
    once = parts.groupBy("origin", "segment").agg(F.first("part").alias("part"), F.max("total").alias("total"), F.max(head).alias("head"), F.count(head).alias("n"))
    grouped = once.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("segment", "part"))).alias("parts"), F.max("total").alias("total"), F.max(F.struct("n", "head")).alias("heads"))
    kind = "struct<n:long,head:struct<page_id:string,uri:string>>"
    joined = grouped.select("origin", "parts", "total", F.col("heads").cast(kind).alias("heads")).mapInArrow(run, f"origin string, heads {kind}, total long, payload binary, error string")
    rows = joined.select("*", F.explode(F.array_repeat(F.lit(1), F.greatest(F.lit(1), F.col("heads.n")).cast("int"))))
    return rows.select(F.col("origin").alias("record_id"), F.lit("response").alias("type"), "heads.head.page_id", "heads.head.uri", F.lit(None).cast("string").alias("refers_to"), "payload", "error")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, type (response or revisit), page_id, uri, refers_to (a record's identifier), payload, error: whole records."""
    whole = read_records(spark, folder, segments=False).select("record_id", "type", "page_id", "uri", "refers_to", "payload", "error")
    return whole.unionByName(reassembled(read_records(spark, folder, segments=True)))


def page_digests(spark: SparkSession, folder: str) -> DataFrame:
    """page_id (text), payload_bytes, payload_digest, record_type, refers_to (page_id) of all pages in the archives."""
    rows = written(read_pages(spark, folder).select("record_id", "type", "page_id", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).alias("payload_digest")))
    own = rows.filter("type = 'response'").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("string").alias("refers_to"))
    targets = rows.filter("type = 'response'").groupBy("record_id").agg(F.first("page_id").alias("of"), F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    again = rows.filter("type = 'revisit'").select("page_id", "refers_to").join(targets, F.col("refers_to") == F.col("record_id"), "left")
    return own.unionByName(again.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("of").alias("refers_to")))
