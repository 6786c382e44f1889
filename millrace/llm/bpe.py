"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue keeps a bucket of linked-list positions per merge rank and three levels of bitmaps over the ranks: a set bit
says that the 64 ranks, or words, below it hold something, so find-first-set on each level leads to the lowest rank.
A merge changes its neighbours' ranks; their old entries stay in their buckets and are skipped when they come up. A
piece of n bytes takes about n pushes and pops however long it is.

Defined results: null and empty texts have no tokens; repeated rows are encoded alike; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_memo import ChunkMemo, forget_half
from .shared import slices

#: Pieces without a space before them, remembered by a worker beside the chunks, at about 150 bytes each; past it, the older half is forgotten.
PIECES = 300_000


class RankQueue:
    """Positions by rank: lowest rank first, then lowest position."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, int]:
        """(rank, position), or (-1, -1) if nothing is left."""
        top = self.top
        if not top:
            return -1, -1
        a = (top & -top).bit_length() - 1
        b = (a << 6) + ((word := self.mid[a]) & -word).bit_length() - 1
        rank = (b << 6) + ((word := self.low[b]) & -word).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[b] &= self.low[b] - 1
            if not self.low[b]:
                self.mid[a] &= self.mid[a] - 1
                if not self.mid[a]:
                    self.top &= top - 1
        return rank, position


class BytePairs:
    """Encoder and decoder for one file of ranks (token in base64, rank) and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        # Of each token: its rank and where a queue has the rank's bits.
        self.places = {t: (r, r >> 6, 1 << (r & 63), r >> 12, 1 << ((r >> 6) & 63), 1 << (r >> 12)) for t, r in ranks.items()}
        self.queue = RankQueue(max(ranks.values()))
        self.pieces: dict[str, bytes] = {}
        self.bytes_of = {b"%d" % rank: token for token, rank in ranks.items()}
        self.memo: ChunkMemo | None = None
        self.memo = ChunkMemo(self._chunks, 1)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n, queue = len(piece), self.queue
        low, mid, top, buckets, place_of = queue.low, queue.mid, 0, queue.buckets, self.places.get
        after, before, rank_at = list(range(1, n + 2)), list(range(-1, n)), [-1] * (n + 1)
        fresh = [(i, i + 2) for i in range(n - 1)]  # pairs whose ranks are to be queued: from, to
        while True:
            # What push() and pop() do, here without a call for each entry. An empty queue has no bits set.
            for i, end in fresh:
                place = place_of(piece[i:end])
                if place is None:
                    continue
                rank, word, bit, upper, upper_bit, top_bit = place
                rank_at[i] = rank
                bucket = buckets.get(rank)
                if bucket:
                    heappush(bucket, i)
                else:
                    buckets[rank] = [i]
                    low[word] |= bit
                    mid[upper] |= upper_bit
                    top |= top_bit
            if not top:
                break
            a = (top & -top).bit_length() - 1
            bits = mid[a]
            b = (a << 6) + (bits & -bits).bit_length() - 1
            bits = low[b]
            rank = (b << 6) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[b] = bits = bits & (bits - 1)
                if not bits:
                    mid[a] = bits = mid[a] & (mid[a] - 1)
                    if not bits:
                        top &= top - 1
            if rank_at[i] != rank:
                fresh = ()
                continue  # stale: the pair at i has changed since
            gone = after[i]
            end = after[gone]
            after[i] = end
            before[end] = i
            left = before[i]
            rank_at[gone] = rank_at[i] = -1
            if left < 0:
                fresh = ((i, after[end]),) if end < n else ()
            else:
                rank_at[left] = -1
                fresh = ((i, after[end]), (left, end)) if end < n else ((left, end),)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Decimal ids of each chunk, a space after each id."""
        pieces, known_chunk, out = self.pieces, self.memo.get if self.memo else {}.get, []
        for chunk in chunks:
            ids = []
            for piece in self.split(chunk):
                # A piece with a space before it is a chunk of its own elsewhere, and remembered as such.
                known = known_chunk(piece[1:]) if piece[0] == " " else pieces.get(piece)
                if known is None:
                    known = b"".join([b"%d " % x for x in self.merge(piece.encode())])
                    if piece[0] != " " and len(piece) <= 64:
                        if len(pieces) >= PIECES:
                            forget_half(pieces)
                        pieces[piece] = known
                ids.append(known)
            out.append(b"".join(ids))
        return out

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Decimal ids of each text, joined by one space."""
        return [x[:-1] for x in self.memo.encode(texts)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split()))


@lru_cache(maxsize=2)
def byte_pairs(ranks_path: str, pattern: str) -> BytePairs:
    """Read once per worker; the file lies on every machine, as its library does."""
    with open(ranks_path, "rb") as f:
        return BytePairs({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int): the token ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [list(map(int, x.split())) for x in pairs.encode(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id, decoded (binary): the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(ranks_path, pattern)
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].as_py() or []
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, 1), pa.array([pairs.decode(b" ".join([b"%d" % x for x in ids]))], pa.binary())], ["id", "decoded"])

    narrow = encoded.select(F.col(id_col).alias("id"), "ids")
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encodes every whole text, decodes its ids, and keeps digests of both.

    For checks of whole corpora: ids and decoded bytes never leave the task that made them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = pairs.encode(part.column("text"))
                columns = [
                    part.column("id"),
                    pa.array([x.count(b" ") + 1 if x else 0 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(pairs.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
