"""What tasks of the searches hold at a time."""

import numpy as np
import pyarrow as pa

from millrace.operators import retrieval as R


def test_words_are_taken_apart_in_bounded_parts():
    texts = ["ab " * (i % 7) * 60_000 + f"w{i}" for i in range(40)] + ["", "x"]
    batch = pa.RecordBatch.from_pydict({"chunk_id": [str(i) for i in range(len(texts))], "words": texts}).slice(3)
    parts = list(R.word_parts(batch, 200))
    assert [i for _, ids in parts for i in ids.to_pylist()] == [str(i) for i in range(3, len(texts))]
    assert [w for lists, _ in parts for w in lists.to_pylist()] == [t.split(" ") for t in texts[3:]]
    assert len(parts) > 3 and max(sum(len(" ".join(w)) for w in lists.to_pylist()) for lists, _ in parts) <= R.BLOCK_BYTES


def test_rows_that_cannot_match_are_left_out_before_their_trigrams_are():
    asked = [sorted(set(R.word_trigrams("finduserbyname"))), sorted(set(R.word_trigrams("parseheader")))]
    words = pa.array([["plain", "prose"], ["call", "finduserbyname", "here"], [], ["pärse", "header"], ["parsehaeder"]])
    probes = R.Probes(asked, 0.6)
    lexemes, row = R._flat(words)
    coded = lexemes.dictionary_encode()
    flat, length, _ = probes.numbered(coded.dictionary.to_pylist())
    live = probes.possible(row, coded.indices.to_numpy().astype(np.int64), flat, length, len(words))
    assert live.tolist()[:3] == [False, True, False]
    plain = [[max(0.0, R.word_similarity(p, [g for w in own for g in R.word_trigrams(w)])) for p in asked] for own in words.to_pylist()]
    got = probes.scores(words)[0]
    assert all(abs(g - w) < 1e-6 for a, b in zip(got.tolist(), plain) for g, w in zip(a, b) if w >= 0.6)
