import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import conversation_repair as C


def brute(rows):
    """One conversation, each state's cheapest and first repair, row by row; insertions without bound on their place, two in a row at most."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(states):
        out = dict(states)
        for _ in range(2):
            for s, (cost, audit, lines) in list(out.items()):
                for i in follows[s]:
                    if i != "s":
                        new = (cost + 5, audit + "I", [*lines, names[i] + ":"])
                        out[i] = min(out.get(i, new), new)
        return out

    states, seen, count = {"": (0, "", [])}, set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        bare = text.strip(" \t\n\r\x0b\x0c")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        if fault:
            count[fault] += 1
        new = {}
        for s, (cost, audit, lines) in inserted(states).items():
            offers = [(s, 2, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                offers += [(i, more, "K", [f"{role}:{text}"]) for i in follows[s] if role[:1] == i]
                offers += [(i, more + 1, "R", [f"{names[i]}:{text}"]) for i in follows[s] if i != "s"]
            for t, paid, label, line in offers:
                offer = (cost + paid, audit + label, lines + line)
                new[t] = min(new.get(t, offer), offer)
        states = new
    cost, audit, lines = min(v for s, v in inserted(states).items() if s in ("", "a"))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, n, longest, texts=("Yes.", "No?", "and so", " ", "", "More!", "a.", "b.", "c.", "d.")):
    rng = np.random.default_rng(seed)
    out = []
    for conv in range(n):
        for turn in range(int(rng.integers(0, longest))):
            role = str(rng.choice(["user", "assistant", "system", "tool", "", "user", "assistant"]))
            own = None if rng.random() < 0.05 else int(turn + rng.integers(0, 2))
            out += [(conv, own, role, str(rng.choice(texts)) + str(rng.integers(0, 4)) + "."[: int(rng.integers(0, 2))])] * (2 if rng.random() < 0.05 else 1)
    return out


def repaired(spark, rows, **how):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS id", "2 AS part", "3 AS gaps")
    got = C.repair(df, **how)
    assert got.columns == ["conv_id", *C.NAMES]
    return {r.conv_id: tuple(r)[1:] for r in got.collect()}


@pytest.mark.parametrize("how", [{}, {"block_rows": 5}, {"block_bytes": 30}])
def test_beside_a_plain_version(spark, monkeypatch, how):
    rows = conversations(3, 60, 14) + [(100, i, str(r), t) for i, (r, t) in enumerate(itertools.product(["user", "assistant", "system"] * 3, ["x.", "y", "z?"]))]
    rows += [(101, i % 150, "user" if i % 3 else "assistant", f"{i % 170}.") for i in range(400)]
    got = repaired(spark, rows, **how)
    for conv in {r[0] for r in rows}:
        assert got[conv] == brute([r[1:] for r in rows if r[0] == conv]), conv


def test_auctions_give_shortest_paths():
    rng = np.random.default_rng(4)
    for length in (1, 7, 64, 65, 300):
        codes = rng.integers(0, 12, (9, length))
        layers, exits = C.COST[codes], np.repeat(C.EXIT[None], 9, 0)
        want = np.full((9, length + 1, 4), C.NEVER)
        want[:, -1] = exits
        for i in range(length - 1, -1, -1):
            want[:, i] = np.minimum((layers[:, i] + want[:, i + 1, None]).min(2), C.NEVER)
        got = C.solve(layers, exits)
        assert (got[:, 0] == want[:, 0]).all() and (got >= want).all()
        # Along the traced repair, what remains is exact, and its arcs sum to the whole.
        labels, states = C.trace(codes, got, np.zeros(9, np.int64))
        for p in range(9):
            along = want[p, np.arange(length + 1), states[p]]
            assert (got[p, np.arange(length + 1), states[p]] == along).all()
            assert (layers[p, np.arange(length), states[p, :-1], states[p, 1:]] == along[:-1] - along[1:]).all()


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hello."), (1, None, None, "x."), (2, 0, "system", "Be good."), (3, 0, "user", "long. " * 200_000), (3, 1, "assistant", "ok."), (4, 5, "user", "a."), (4, 5, "user", "a."), (4, 9, "assistant", "b."), (5, 0, "ünknown", "a.")]
    rows += [(6, 7, "user", "same.")] * 3_000
    got = repaired(spark, rows)
    for conv in {r[0] for r in rows}:
        assert got[conv] == brute([(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv])
    assert got[6][6] == "D" * 3_000 and got[4][0] == 3
    assert repaired(spark, []) == {}
    dropped = C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), present=F.lit(False)).collect()
    assert {tuple(r)[1:] for r in dropped} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(dropped) == 7
