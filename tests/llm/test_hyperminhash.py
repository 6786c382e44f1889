import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import hyperminhash
from millrace.llm.components import components
from millrace.llm.hyperminhash import band_keys, chance, estimates, links_in, near_duplicates, registers
from millrace.llm.queries_op9 import op9_near_dedup


def brute(rows, shingle=4, percent=80):
    """(id, size, component, kept) of each row by all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append(frozenset(tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else frozenset())
    having, parent = defaultdict(list), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in enumerate(sets):
        for s in own:
            having[s].append(i)
    for i, own in enumerate(sets):
        shared = defaultdict(int)
        for s in own:
            for j in having[s]:
                shared[j] += 1
        for j, n in shared.items():
            if j < i and 100 * n >= percent * (len(own) + len(sets[j]) - n):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    ids = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[find(i)].append(key)
    out = []
    for i, (key, _) in enumerate(rows):
        name = (min(ids[find(i)]) if ids[find(i)] else None) if sets[i] else key
        out.append((key, len(sets[i]), name, key == name))
    return sorted(out, key=str)


def near_copies(n, seed, words=120, most=14):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = base[:]
        for _ in range(rng.randint(0, most)):
            own[rng.randrange(words)] = f"v{rng.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


def test_query_against_brute_force_on_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = sorted(map(tuple, op9_near_dedup(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == brute(rows)


def test_groups_beyond_a_block_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "BUCKET_BLOCK", 20)
    monkeypatch.setattr(hyperminhash, "GROUP_BLOCK", 24)
    monkeypatch.setattr(hyperminhash, "HUBS", 4)
    texts = near_copies(150, 1) + near_copies(60, 2, 30, 3) + ["same text here you see"] * 40
    texts += [None, "", " \n", "one", "ONE", "one two", "One\ttwo", "one two three", "É a b c", "é a b c", "a b c d e", "a b c d e f"]
    rows = list(enumerate(texts)) + [(3, "one"), (3, "another text of the same id"), (None, texts[0]), (None, "only without id at all"), (None, None), (900, "only without id at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "2 AS id", "3 AS set", "4 AS kept")
    assert sorted(map(tuple, near_duplicates(df).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 5, 60, 400, 5000])
def test_estimates(n):
    """Registers agree with the probability of the similarity, for small sets too."""
    rng, errors, shared_band = np.random.default_rng(n), [], 0
    for _ in range(60):
        both = rng.integers(0, 1 << 63, n * 4, dtype=np.uint64)
        only = [rng.integers(0, 1 << 63, max(0, round(n / 2)), dtype=np.uint64) for _ in range(2)]
        a, b = (np.unique(np.concatenate([both, o])) for o in only)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        regs = np.stack([registers(a), registers(b)])
        errors.append(estimates(regs[0], regs[1:], chance(np.array([len(a), len(b)]))[0, 1:])[0] - true)
        keys = band_keys(regs)
        shared_band += bool((keys[0] == keys[1]).any())
    assert abs(np.mean(errors)) < 0.025 and max(map(abs, errors)) < 0.19 and shared_band == 60
    a, b = (registers(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(2))
    assert abs(estimates(a, b[None], chance(np.array([n, n]))[0, 1:])[0]) < 0.04


def test_links_in_blocks_are_exact():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) < 0.93], rng.integers(0, 1 << 60, 5, dtype=np.uint64)])) for _ in range(40)]
    want = {(x, y) for x in range(40) for y in range(x + 1, 40) if 100 * len(np.intersect1d(sets[x], sets[y])) >= 80 * len(np.union1d(sets[x], sets[y]))}
    found = set(links_in(sets, np.arange(40), 80))
    assert found <= want and len(found) > 20


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (300, 200), (7, 7)] + [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(51)} == {got[0]} and got[100] == got[200] == got[300] and len({got[i] for i in range(1000, 1200)}) == 1
    assert len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_rows_without_id_and_long_sets(spark, monkeypatch):
    """Groups of rows without id, of one id and of long texts, with blocks so small that all ways of comparing are taken."""
    monkeypatch.setattr(hyperminhash, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(hyperminhash, "GROUP_BLOCK", 24)
    monkeypatch.setattr(hyperminhash, "BLOCK_SHINGLES", 2_000)
    base = [f"w{i}" for i in range(120)]
    near = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(0, 120, 2)]
    long = " ".join(f"l{i}" for i in range(6_000))
    rows = [(None, t) for t in near for _ in range(160)] + [(7, near[0]), (3, near[5]), (3, "an other text of this id"), (9, long), (8, long + " more"), (2, long + " yet more words")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(got) == len(rows)
    sizes = Counter((r.doc_id, r.component_id, r.kept) for r in got)
    # Texts of this table are all within reach of each other: one component, named 3.
    assert sizes == Counter({(None, 3, False): 9600, (7, 3, False): 1, (3, 3, True): 2, (9, 2, False): 1, (8, 2, False): 1, (2, 2, True): 1})
