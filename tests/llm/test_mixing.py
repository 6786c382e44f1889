import math
import random
from collections import Counter, defaultdict

from test_pipeline import copies

from millrace.llm.mixing import MOST, mix, mixing_plan, source_targets

SCHEMA = "doc_id long, text string, source string, rate double, `__doc` string, `a.b` int"


def docs(spark, sources, n=300, seed=4):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 40))), rng.choice(sources), 0.5, "x", i) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), [dict(zip(("doc_id", "text", "source"), r, strict=False)) for r in rows]


def test_targets_and_copies_beside_a_plain_version(spark):
    # one source, three, seven with weights repeating, and a hot one beside a null one
    for sources in (["a"], ["a", "b", "c"], list("gfedcba"), ["hot"] * 40 + ["b", None, "é", ""]):
        df, rows = docs(spark, sources)
        want = Counter(r["doc_id"] for r in copies(rows))
        plan = {r.doc_id: r for r in mixing_plan(df).collect()}
        assert {i: r.copies for i, r in plan.items()} == {r["doc_id"]: want[r["doc_id"]] for r in rows}
        assert {i: r["size"] for i, r in plan.items()} == {r["doc_id"]: len(r["text"].split()) for r in rows}
        assert all(r.copies <= MOST and r.target <= MOST * r.source_size + 1e-9 for r in plan.values())
        mixed = mix(df)
        assert mixed.columns == df.columns and mixed.dtypes == df.dtypes
        assert Counter(r.doc_id for r in mixed.collect()) == want


def test_taken_words_come_near_the_targets(spark):
    df, rows = docs(spark, ["a", "a", "a", "b", "c", None], 4_000)
    source = {r["doc_id"]: r["source"] for r in rows}
    taken, target = defaultdict(int), {}
    for r in mixing_plan(df).collect():
        taken[source[r.doc_id]] += r["size"] * r.copies
        target[source[r.doc_id]] = r.target
    for s, wanted in target.items():
        # a copy more or less: standard deviation of at most 20 words a document
        assert abs(taken[s] - wanted) < 5 * 20 * math.sqrt(sum(v == s for v in source.values()))


def test_odd_rows_and_empty_tables(spark):
    rows = [(None, None, None, None, None, None), (None, "", "a", None, None, None), (1, "x y", "a", 1.0, "q", 1), (1, "x y", "a", 1.0, "q", 1), (2, None, "empty", None, None, None), (3, "z " * 50_000, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = mixing_plan(df).collect()
    assert len(plan) == len(rows)
    assert [r["size"] for r in sorted(plan, key=lambda r: (r.doc_id or 0, r["size"]))] == [0, 0, 2, 2, 0, 50_000]
    assert len({r.copies for r in plan if r.doc_id == 1}) == 1
    assert [r.target for r in plan if r.doc_id == 2] == [0.0]
    assert [r.copies for r in plan if r.doc_id == 2] == [0]
    assert mix(df).dtypes == df.dtypes
    assert mixing_plan(df.limit(0)).count() == 0 and mix(df.limit(0)).count() == 0


def test_rows_without_id_and_with_a_shared_one_near_their_target(spark):
    for key in (None, 7):
        rng = random.Random(1)
        rows = [(key, f"text {i} " + "w " * rng.randint(0, 20), "a", 0.0, "", 0) for i in range(1_000)]
        plan = mixing_plan(spark.createDataFrame(rows, SCHEMA), share=0.5).collect()
        taken = sum(r["size"] * r.copies for r in plan)
        assert abs(taken - plan[0].target) < 5 * 13 * math.sqrt(1_000 / 4) and {r.copies for r in plan} == {0, 1}
        assert mix(spark.createDataFrame(rows, SCHEMA), share=0.5).count() == sum(r.copies for r in plan)


def test_partitioning_does_not_matter(spark):
    df, _ = docs(spark, ["a", "b", None])
    once = sorted((r.doc_id, r.copies) for r in mixing_plan(df.repartition(7)).collect())
    assert once == sorted((r.doc_id, r.copies) for r in mixing_plan(df.coalesce(1)).collect())
    sized = df.selectExpr("source", "cast(1 as long) AS size")
    assert source_targets(sized).count() == 3
