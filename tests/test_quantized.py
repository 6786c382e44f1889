"""Inverted lists of quantized vectors beside brute force."""

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import quantized as Z
from millrace.plans import registry

VECTORS = "id long, vec array<double>, label int"


def plain(rows, asked, k):
    out = {}
    ok = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    for q, v, _ in asked:
        if (q, v) not in [(i, w.tolist()) for i, w in ok]:
            continue
        best = out.setdefault(q, {})
        for i, w in ok:
            if i != q:
                best[i] = max(best.get(i, -2.0), round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6))
    return {(q, n): pair for q, best in out.items() for n, pair in enumerate(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k], 1)}


def test_all_lists_and_candidates_give_what_brute_force_gives(spark, monkeypatch):
    monkeypatch.setattr(Z, "MEET_ROWS", 7)
    monkeypatch.setattr(Z, "MEET_QUERIES", 3)
    draw = np.random.default_rng(1)
    rows = [(int(i), draw.normal(size=5).tolist(), 1) for i in range(60)]
    rows += [(100 + i, rows[3][1], 1) for i in range(30)]  # copies of a vector
    rows += [(7, draw.normal(size=5).tolist(), 1), (8, rows[8][1], 1)]  # an id of two vectors, and a repeated row
    rows += [(200, None, 1), (201, [0.0] * 5, 1), (202, [1.0, None, 1.0, 1.0, 1.0], 1), (203, [float("nan")] * 5, 1), (None, rows[0][1], 1), (204, [float("inf")] + [1.0] * 4, 1)]
    asked = [r for r in rows if r[0] is not None and r[0] % 2 == 1]
    table = spark.createDataFrame(rows, VECTORS)
    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in Z.quantized_search(table, spark.createDataFrame(asked, VECTORS), "id", "vec", 5, 4, 100, 1_000).collect()}
    want = plain(rows, asked, 4)
    assert got.keys() == want.keys() and {p: v[0] for p, v in got.items()} == {p: v[0] for p, v in want.items()}
    assert all(abs(got[p][1] - want[p][1]) < 2e-6 for p in want)


def test_empty_tables_and_lone_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    one = spark.createDataFrame([(1, [1.0, 2.0], 0)], VECTORS)
    assert Z.quantized_search(none, none, "id", "vec", 2).count() == 0
    assert Z.quantized_search(one, one, "id", "vec", 2).count() == 0
    assert Z.quantized_search(one, spark.createDataFrame([(2, [1.0, 2.0], 0)], VECTORS), "id", "vec", 2).collect()[0][:3] == (2, 1, 1.0)


def test_copies_keep_their_smallest_ids(spark):
    rows = spark.range(5_000).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    found = Z.distinct_vectors(rows.unionByName(rows), 4).collect()
    assert [(r.ids, r.v) for r in found] == [([0, 1, 2, 3], [1.0, 2.0])]


def test_codes_are_near_their_rows():
    x = np.random.default_rng(3).normal(size=(3_000, 9)).astype(np.float32)
    made = Z.fitted(x, 20)
    own, codes = made.encode(x)
    assert codes.shape == (3_000, 5) and codes.dtype == np.uint8
    for n in set(own.tolist()):
        assert ((x[own == n] - made.decode(n, codes[own == n])) ** 2).sum() < 0.05 * (x[own == n] ** 2).sum() + 1e-6


def test_registered_search_finds_most_and_scores_a_fixed_number(spark):
    row = registry.queries()["quantized_recall"](spark, "/root/testdata/sf0.01").first()
    assert row.queries == 25 and row.recall >= 0.9 and row.most_scored == Z.RERANK
