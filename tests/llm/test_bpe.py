import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from millrace.llm.bpe import RankQueue, byte_pairs, decode_documents, encode_documents, round_trip

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "  two  spaces ", " lead", "tail ", "a\n\nb", "line \n next", "tab\tx", "it's we'll", "\x1c sep\x1dx", "\x85nel   x", "no break space", "½ ² Ⅷ ٣ 12", "naïve Ünïcode 漢字かな", "é combining", "🙂 👩‍👩‍👧", "<|endoftext|> x", "!!! ??? $$$", "a" * 3000, " " * 500, "ab" * 2000 + "!" * 900, "x\r\ny", "﻿bom"]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library(library):
    rng = random.Random(1)
    letters = "abcdeéñ  \n\t.,'s19#漢 "
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(600)]
    pairs = byte_pairs(RANKS, public_tokenizers.PATTERN)
    for text, ids in zip(texts, pairs.encode(texts), strict=True):
        assert list(map(int, ids.split())) == library.encode_ordinary(text), repr(text)
        assert pairs.decode(ids) == text.encode()


def test_queue_gives_ranks_in_order():
    rng, queue = random.Random(2), RankQueue(50_000)
    entries = [(rng.randint(0, 50_000), rng.randint(0, 99)) for _ in range(3000)]
    for e in entries:
        queue.push(*e)
    assert [queue.pop() for _ in entries] == sorted(entries)
    assert queue.pop() == (-1, -1) and not queue.top and not any(queue.low)


def test_round_trip_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "x"), (77, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n_tokens", "2 AS id")
    got = sorted(map(tuple, round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    encoded = encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    back = decode_documents(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in rows)
    assert round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
