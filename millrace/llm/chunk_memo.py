"""Encoding by chunks that start at single spaces, each distinct chunk encoded once per worker.

The published pre-tokenization pattern always starts a new match at a space between two characters that aren't white
space: no alternative continues over it, and " ?X+" takes the space with what follows. A text cut there may be encoded
chunk by chunk. A text with other white space beside a space is encoded as one.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks remembered by a worker for good, at about 150 bytes each: the first ones, hence the frequent ones. A third as many later ones are remembered for a while.
REMEMBERED = 300_000
#: Longer chunks are encoded each time, so that memory stays bounded by the number of chunks.
LONGEST = 64
#: Chunks that are put together at a time.
TOGETHER = 1 << 15
#: A letter and one of these at a chunk's end are always matches of their own, so the chunk is put together from its two parts.
TAILS = ",.;:!?"


def forget_half(known: dict) -> None:
    """Drops what was learned first."""
    for key in list(islice(known, len(known) // 2)):
        del known[key]


class ChunkMemo:
    """encode_chunks: chunks -> encoded bytes of each. The bytes of a text are those of its chunks, one after the other; width: size of their units."""

    def __init__(self, encode_chunks: Callable[[list[str]], list[bytes]], width: int, remembered: int = REMEMBERED):
        self.encode_chunks, self.width, self.remembered = encode_chunks, width, remembered
        self.known: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.tails = dict(zip(TAILS, encode_chunks(list(TAILS)), strict=True))

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The encoded bytes of each text; null counts as empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "").cast(pa.large_string())
        if not len(texts):
            return []
        cut = pc.split_pattern(texts, " ")
        starts = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        codes, chunks = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # A text's first chunk has no space before it.
        heads = [chunks[c] for c in codes[starts[:-1]].tolist()]
        inner = np.ones(len(codes), bool)
        inner[starts[:-1]] = False
        found = list(map(self.known.get, chunks))
        missing = [i for i, f in enumerate(found) if f is None]
        if missing:
            used = np.zeros(len(chunks), bool)
            used[codes[inner]] = True
            missing = [i for i, u in zip(missing, used[missing].tolist(), strict=True) if u]
            stems = [c[:-1] if c[-1:] in self.tails and c[-2:-1].isalpha() else c for c in map(chunks.__getitem__, missing)]
            self._learn(set(stems))
            for i, stem in zip(missing, stems, strict=True):
                known, tail = self.get(stem), chunks[i][len(stem) :]
                found[i] = known + self.tails[tail] if known is not None and tail else known
        odd = np.zeros(len(chunks), bool)
        odd[[i for i in missing if found[i] is None]] = True
        whole = np.bitwise_or.reduceat(odd[codes] & inner, starts[:-1])
        whole |= np.array([h[-1:].isspace() for h in heads], bool) & (np.diff(starts) > 1)
        at = np.flatnonzero(whole).tolist()
        for i, text in zip(at, texts.take(pa.array(at, pa.int64())).to_pylist(), strict=True):
            heads[i] = text
        first = iter(self.encode_chunks([h for h in heads if h]))
        codes[starts[:-1]] = np.arange(len(heads)) + len(chunks)
        return self._joined([f or b"" for f in found] + [next(first) if h else b"" for h in heads], codes, starts, whole, len(chunks))

    def _joined(self, values: list[bytes], codes: np.ndarray, starts: np.ndarray, whole: np.ndarray, n: int) -> list[bytes]:
        """Puts texts together from the values' units, TOGETHER chunks at a time, so that little is held beside them however long the texts are."""
        unit = np.dtype(f"u{self.width}")
        size = np.array([len(v) for v in values], np.int64) // self.width
        begin = np.cumsum(size) - size
        length = size[codes]
        length[np.repeat(whole, np.diff(starts)) & (codes < n)] = 0  # all of such a text is in its head
        units, parts = np.frombuffer(b"".join(values), unit), []
        for at in range(0, len(codes), TOGETHER):
            own = length[at : at + TOGETHER]
            ends = np.cumsum(own)
            pick = np.repeat(begin[codes[at : at + TOGETHER]] - (ends - own), own)
            pick += np.arange(len(pick))
            parts.append(units[pick].tobytes())
        data, bounds = b"".join(parts), np.concatenate([[0], np.cumsum(length)[starts[1:] - 1]]) * self.width
        return [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks.difference(self.known).difference(self.recent) if c and len(c) <= LONGEST and not c[0].isspace() and not c[-1].isspace()]
        store = self.known
        if len(self.known) + len(new) > self.remembered:
            store = self.recent
            if len(self.recent) + len(new) > self.remembered // 3:
                self.recent.clear()
                new = [c for c in chunks.difference(self.known) if c and len(c) <= LONGEST and not c[0].isspace() and not c[-1].isspace()]
        store.update(zip(new, self.encode_chunks([" " + c for c in new]), strict=True))

    def get(self, chunk: str) -> bytes | None:
        return self.known.get(chunk) or self.recent.get(chunk)
