import numpy as np

from millrace.llm.kmeans_tree import TreeIndex, fit_tree
from millrace.llm.queries_op3 import op3_nearest


def brute(rows, queries, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in {i: q for i, q in good if i in queries}.items():
        out[i] = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in good if j != i)[:k]
    return out


def test_recall_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = brute(rows, {i for i, _ in rows if i % 100 == 0})
    got = op3_nearest(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect()
    assert len(got) == 10 * len(want)
    hits = 0
    for q, near in want.items():
        own = [(r.score, r.vec_id) for r in got if r.query_id == q]
        assert own == sorted(own) and [r.rank for r in got if r.query_id == q] == list(range(1, 11))
        hits += len({j for _, j in own} & {j for _, j in near})
    assert hits >= 0.9 * len(got)


def test_ties_and_unusable_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, 2.0]) for i in range(1, 40)] + [(0, [1.0, 2.0]), (100, [5.0, 5.0]), (200, None), (201, [0.0, 0.0]), (202, [inf, 1.0]), (203, [nan, 1.0]), (204, [None, 1.0]), (None, [1.0, 1.0]), (205, [1.0]), (300, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS leaf", "2 AS id", "3 AS score")
    got = TreeIndex(df).search(df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 2], {0, 100, 200, 300})
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(q, j, d) for q in sorted(want) for d, j in want[q]]


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.rank) for r in TreeIndex(df).search(df.filter("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert TreeIndex(df.limit(0)).search(df).count() == 0


def test_search_over_all_leaves_is_exact():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8))
    tree = fit_tree(x, 20)
    leaf = tree.assign(x)
    assert set(leaf) <= set(range(tree.leaves))
    order = tree.visits(x[0], tree.leaves, np.bincount(leaf, minlength=tree.leaves), 0)
    assert sorted(order) == list(range(tree.leaves))
    assert order[0] == leaf[0] or leaf[0] in order[:5]


def test_leaves_below_leaves(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 4
    x = (centres[rng.integers(0, 40, 12_000)] + rng.normal(size=(12_000, 8))).astype(np.float32)
    x[:700] = x[0]  # copies, which no tree can split
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = TreeIndex(df, split_rows=300, most_leaves=8)
    assert index.below and index.measured >= 0.9
    sizes = {r["leaf"]: r["count"] for r in index.rows.groupBy("leaf").count().collect()}
    assert sum(sizes.values()) == len(rows) and max(sizes) >= 1 << 15
    assert sorted(n for n in sizes.values() if n > 300)[-1] >= 700
    got = index.search(df.filter("vec_id % 100 = 0")).collect()
    want = brute(rows, {i for i, _ in rows if i % 100 == 0})
    assert len(got) == 10 * len(want)
    true = {(q, round(d, 9)) for q, near in want.items() for d, _ in near}
    assert sum((r.query_id, round(r.score, 9)) in true for r in got) >= 0.9 * len(got)
