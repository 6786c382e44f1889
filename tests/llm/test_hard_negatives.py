import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hard_negatives as H


def brute(rows, anchors, positives=5, k=10, low=30, high=90, scale=256):
    """Each window by itself, over all rows, in whole numbers without bound."""
    kept = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = [int(np.floor(scale * float(np.float32(x)))) for x in v]
        if all(abs(x) <= (2**55 / max(len(v), 1)) ** 0.5 for x in whole):
            kept.append((i, label, whole))
    out = []
    for a in {r[0] for r in kept if anchors(r[0])}:
        _, label, q = min((r for r in kept if r[0] == a), key=lambda r: (r[2], r[1]))
        scored = [(-sum(x * y for x, y in zip(q, v)), i, own == label) for i, own, v in kept if i != a and len(v) == len(q)]
        for down, p, _ in sorted(s for s in scored if s[2])[:positives]:
            near = sorted(s for s in scored if not s[2] and low * -down <= 100 * -s[0] <= high * -down)[:k]
            out += [(a, p, n + 1, i, -down, -d) for n, (d, i, _) in enumerate(near)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 AS id", "2 AS slot", "3 AS score", "4 AS v")
    got = H.mine(df, F.col("vec_id") % 10 == 0, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("seed,block", [(0, None), (1, 20)])
def test_windows_beside_brute_force(spark, monkeypatch, seed, block):
    if block:
        monkeypatch.setattr(H, "ANCHORS", block)
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(4, 6))
    rows = [(i, int(c), (middle[c] + rng.normal(0, 0.7, 6)).tolist()) for i, c in enumerate(rng.integers(0, 4, 400))]
    rows += [(1_000 + i, 2, rows[10][2]) for i in range(60)] + [(2_000 + i, int(i % 4), [0.5] * 6) for i in range(150)]
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 500


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 1.0]), (2, 2, [0.6, 0.3]), (3, 2, None), (4, None, [0.5, 0.5]), (None, 2, [0.6, 0.6]), (5, 2, [nan, 1.0]), (6, 2, [inf, 0.1]), (7, 2, [None, 0.1]), (8, 2, [3e30, 0.1]), (9, 2, [0.6, 0.3]), (9, 2, [0.6, 0.3])]
    rows += [(0, 3, [1.5, 0.5]), (11, 2, [0.1]), (20, 2, []), (21, 2, []), (22, 1, []), (30, 5, [1.0, 1.0]), (40, 6, [-1.0, 0.0]), (41, 6, [1.0, 0.0]), (12, 1, [90_000.0, 0.5]), (50, 7, [0.0, 0.0]), (51, 7, [0.0, 0.0]), (52, 8, [0.0, 0.0])]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows, positives=1, k=1) == brute(rows, lambda i: i % 10 == 0, 1, 1)
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(10, 1, [1.0])]) == []


def test_scores_are_exact_beyond_doubles():
    x, y = np.array([[2**27 + 1, 3]]), np.array([[2**27 - 1, 5]])
    assert H.products(x, y).tolist() == [[(2**27 + 1) * (2**27 - 1) + 15]]
