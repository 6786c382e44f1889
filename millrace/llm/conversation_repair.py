"""Conversation repair: the cheapest edits that make roles alternate, by an auction for shortest paths.

A conversation's rows, in order, are layers of a lattice over what its repaired roles end in: START, S (one system row),
U, A. A row is kept (0), gets the other role of user and assistant (1), or is deleted (2; blank and duplicate rows must be);
before each edit, and at the end, an empty row may be inserted (5); truncated rows that stay add 5. Two insertions in a row
are never cheapest: without the pair the roles alternate as before, and a lone system row is cheaper to delete.

The auction: every node has a price, at most the cost of any arc out of it plus the price behind that arc. A path grows from an
origin: if the price of its last node is below the best of its arcs, the price rises to it and the path contracts by that
node; else the path extends along the best arc. When it reaches the end, the prices along it are the exact costs that remain;
an arc is tight if its cost is the difference of prices, and the cheapest repairs are the paths of tight arcs to the end.
The one whose edits' initials come first in ASCII is traced: no label (I and an edit, or an edit) begins another, so
the least label at every node is right. Prices begin at the sum of the cheapest arcs ahead. Auctions of many conversations run side
by side in numpy; conversations of more than LAYERS rows are cut into runs, each run becomes one layer (an
auction for every pair of states), the lattice of runs is solved in the same way, and its prices end the runs.

Conversations of more than BLOCK_ROWS rows or BLOCK_BYTES bytes are dealt over tasks: rows are ranged by conversation and
turn, each task cuts its rows into blocks, a block is reduced to one layer of sixteen costs, and one narrow row a block meets its
conversation to be priced and chained. Texts stay in blocks; only the last step, a hash over the whole repaired
conversation, has to see its blocks in order, and streams them by. Duplicates are known from first turns by digest.

Defined results: null role, text, turn or id count as one space where their string is asked for; a null id is a conversation
like others. Turns are ordered nulls first; rows of one turn by role, then text; equal rows are as many rows. A role
whose first character isn't s, u or a, or that is empty, can't be kept. Conversations without rows have zeros, no edits and the
hash of the empty string. Empty tables give empty results. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

START, S, U, A = range(4)
#: Costs of the edits.
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Layers of one auction; rows and bytes of a conversation that one task holds; rows of conversations that are solved together.
LAYERS, BLOCK_ROWS, BLOCK_BYTES, TOGETHER = 16, 512, 4 << 20, 2_048
#: Tables of one row a long conversation or block are broadcast up to so many rows (some 50 bytes each).
BROADCAST_ROWS = 200_000
NEVER = 1 << 29
#: What may follow each state: the initial of a role and the state it leads to.
NEXT = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
ROLES = {U: "user", A: "assistant"}
LABELS = ["", "D", "ID", "IK", "IR", "K", "R"]
#: A row's code: 3 times its initial's place plus 0 (whole), 1 (truncated) or 2 (must go); PASS is a layer that changes nothing.
INITIALS, PASS = "sua?", 12


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(costs, numbers of labels) by code, state before and state after: the cheapest label, the first of equals."""
    cost, label = np.full((13, 4, 4), NEVER, np.int64), np.zeros((13, 4, 4), np.int64)

    def offer(code: int, s: int, t: int, c: int, name: str) -> None:
        if (c, LABELS.index(name)) < (cost[code, s, t], label[code, s, t]):
            cost[code, s, t], label[code, s, t] = c, LABELS.index(name)

    for s in range(4):
        cost[PASS, s, s] = 0
        for code in range(12):
            extra = TRUNCATED if code % 3 == 1 else 0
            at = {"": (s, 0)} | {"I": (t, INSERT) for i, t in NEXT[s].items() if i != "s"}
            for before, (state, paid) in at.items():
                offer(code, s, state, paid + DELETE, before + "D")
                if code % 3 < 2:
                    for initial, t in NEXT[state].items():
                        if initial == INITIALS[code // 3]:
                            offer(code, s, t, paid + extra, before + "K")
                        if initial != "s":
                            offer(code, s, t, paid + extra + RELABEL, before + "R")
    return cost, label


COST, LABEL = _tables()
#: What the end costs in each state: after a user's row, an answer is inserted.
EXIT = np.array([0, NEVER, INSERT, 0])


def auction(layers: np.ndarray, exits: np.ndarray, origins: tuple[int, ...] = (START, S, U, A)) -> np.ndarray:
    """Prices, problems x (layers + 1) x states: what remains to the end, on all cheapest paths from the origins; NEVER elsewhere. layers: problems x layers x before x after; exits: problems x states."""
    n, length = layers.shape[:2]
    ahead = np.concatenate([layers.reshape(n, length, 16).min(2), exits.min(1)[:, None]], 1)
    price = np.repeat(np.minimum(np.cumsum(ahead[:, ::-1], 1)[:, ::-1], NEVER)[:, :, None], 4, 2)
    path = np.zeros((n, length + 1), np.int64)
    for origin in origins:
        path[:, 0] = origin
        at, live = np.zeros(n, np.int64), np.arange(n)
        while len(live):
            i = at[live]
            s = path[live, i]
            ended = i == length
            inner = np.minimum(i, length - 1)
            arcs = layers[live, inner, s] + price[live, inner + 1]
            arc = arcs.argmin(1)
            best = np.minimum(np.where(ended, exits[live, s], arcs[np.arange(len(live)), arc]), NEVER)
            rises = price[live, i, s] < best
            price[live[rises], i[rises], s[rises]] = best[rises]
            extends = ~rises & ~ended
            path[live[extends], i[extends] + 1] = arc[extends]
            at[live] = i + extends - (rises & (i > 0))
            live = live[~(~rises & ended) & ~((i == 0) & (best >= NEVER))]
    return exposed(layers, price, exits)


def exposed(layers: np.ndarray, price: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """The prices of nodes from which tight arcs lead to the end: their exact costs. The others, on no cheapest path, get NEVER."""
    price = price.copy()
    price[:, -1] = np.where((price[:, -1] == exits) & (exits < NEVER), exits, NEVER)
    for i in range(layers.shape[1] - 1, -1, -1):
        tight = (price[:, i, :, None] == layers[:, i] + price[:, i + 1, None, :]) & (layers[:, i] < NEVER)
        price[:, i] = np.where(tight.any(2), price[:, i], NEVER)
    return price


def transfers(layers: np.ndarray) -> np.ndarray:
    """problems x before x after: the least cost through all layers."""
    out = np.full((len(layers), 4, 4), NEVER, np.int64)
    for end in range(4):
        exits = np.full((len(layers), 4), NEVER, np.int64)
        exits[:, end] = 0
        out[:, :, end] = solve(layers, exits)[:, 0]
    return out


def solve(layers: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """Prices as in auction, for any number of layers."""
    n, length = layers.shape[:2]
    if not length:
        return exits[:, None]
    if length <= LAYERS:
        return auction(layers, exits)
    runs = -(-length // LAYERS)
    padded = np.concatenate([layers, np.broadcast_to(COST[PASS], (n, runs * LAYERS - length, 4, 4))], 1).reshape(n * runs, LAYERS, 4, 4)
    ends = solve(transfers(padded).reshape(n, runs, 4, 4), exits)
    inner = auction(padded, ends[:, 1:].reshape(n * runs, 4))
    prices = inner[:, :-1].reshape(n, runs * LAYERS, 4)
    return np.concatenate([prices[:, :length], ends[:, -1:]], 1)


def trace(codes: np.ndarray, prices: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of labels, states before each row and at the end) of the first of the cheapest repairs. codes: problems x rows."""
    n, length = codes.shape
    arcs = COST[codes]
    tight = (prices[:, :-1, :, None] == arcs + prices[:, 1:, None, :]) & (arcs < NEVER) & (prices[:, :-1, :, None] < NEVER)
    labels, states, every = np.zeros((n, length), np.int64), np.zeros((n, length + 1), np.int64), np.arange(n)
    states[:, 0] = entry
    for i in range(length):
        own = LABEL[codes[:, i], states[:, i]]
        states[:, i + 1] = np.where(tight[every, i, states[:, i]], own, len(LABELS)).argmin(1)
        labels[:, i] = own[every, states[:, i + 1]]
    return labels, states


def code_of(role: str, text: str, duplicate: bool) -> tuple[int, str | None]:
    """(code, fault: blank, duplicate, truncated or None) of a row."""
    bare = text.rstrip(" \t\n\r\x0b\x0c")
    fault = "blank" if not bare else "duplicate" if duplicate else None if bare[-1] in ".!?" else "truncated"
    place = "sua".find(role[0]) if role else -1
    return 3 * (place if place >= 0 else 3) + {None: 0, "truncated": 1}.get(fault, 2), fault


def legal_pair(before: str, after: str) -> bool:
    return before[:1] + after[:1] in ("su", "ua", "au")


def edited(labels: list[str], states: list[int], roles: list[str], texts: list[str], at_end: bool) -> tuple[str, list[str]]:
    """(audit, repaired lines)."""
    lines = []
    for label, state, after, role, text in zip(labels, states, states[1:], roles, texts, strict=False):
        if label[0] == "I":
            lines.append(ROLES[A if state == U else U] + ":")
        if label[-1] != "D":
            lines.append(f"{role if label[-1] == 'K' else ROLES[after]}:{text}")
    if at_end and states[-1] == U:
        return "".join(labels) + "I", [*lines, ROLES[A] + ":"]
    return "".join(labels), lines


def _solved(batch: list[tuple]) -> list[tuple]:
    """The result rows of some whole conversations: (id, turns, roles, texts) each."""
    out, codes = [], []
    for _, turns, roles, texts in batch:
        seen: set = set()
        count, own = {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}, []
        for role, text in zip(roles, texts, strict=True):
            code, fault = code_of(role, text, (role, text) in seen)
            seen.add((role, text))
            count[fault] += 1
            own.append(code)
        codes.append(own)
        known = [t for t in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append([gaps, count["blank"], count["duplicate"], count["truncated"], sum(not legal_pair(a, b) for a, b in zip(roles, roles[1:]))])
    order = sorted(range(len(batch)), key=lambda i: len(codes[i]))
    for first in range(0, len(order), 64):
        some = order[first : first + 64]
        width = max(len(codes[i]) for i in some)
        table = np.array([codes[i] + [PASS] * (width - len(codes[i])) for i in some], np.int64).reshape(len(some), width)
        exits = np.repeat(EXIT[None], len(some), 0)
        prices = solve(COST[table], exits)
        labels, states = trace(table, prices, np.full(len(some), START))
        for place, i in enumerate(some):
            n = len(codes[i])
            audit, lines = edited([LABELS[x] for x in labels[place, :n]], states[place, : n + 1].tolist(), batch[i][2], batch[i][3], True)
            out[i] += [int(prices[place, 0, START]), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()]
    return [(b[0], *o) for b, o in zip(batch, out, strict=True)]


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_KINDS = ", ".join(f"{n} {'string' if n in NAMES[6:] else 'long'}" for n in NAMES)


def _columns(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conversation. present: which rows count; the others only say that their conversation exists."""
    here = present if present is not None else F.lit(True)
    space = lambda c: F.when(here, F.coalesce(F.col(c), F.lit(" ")))
    own = rows.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), here.alias("here"))
    sizes = own.filter("here").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long_ones = written(sizes.filter((F.col("n") > block_rows) | (F.col("bytes") > block_bytes)).select(F.col("id").alias("of")))
    if long_ones.isEmpty():
        return _short(own, id_col)
    small = _beside(long_ones)
    short = own.join(small, own["id"].eqNullSafe(small["of"]), "left_anti")
    long_rows = own.filter("here").join(small, own["id"].eqNullSafe(small["of"]), "left_semi").drop("here")
    return _short(short, id_col).unionByName(_long(long_rows, id_col, block_rows, block_bytes))


def _beside(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast once its rows are counted."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _short(rows: DataFrame, id_col: str) -> DataFrame:
    """Whole conversations stream by, sorted; TOGETHER rows of them are solved at a time."""
    kind = rows.schema["id"].dataType.simpleString()
    ordered = rows.repartition("id").sortWithinPartitions("id", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [id_col, *NAMES], None
        held, count, size = [], 0, 0
        for batch in batches:
            kinds = kinds or [batch.schema.field("id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for key, turn, role, text, here in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not held or held[-1][0] != key:
                    if count >= TOGETHER or size >= BLOCK_BYTES:
                        yield _columns(_solved(held), names, kinds)
                        held, count, size = [], 0, 0
                    held.append((key, [], [], []))
                if here:
                    for own, value in zip(held[-1][1:], (turn, role, text), strict=True):
                        own.append(value)
                    count, size = count + 1, size + len(text)
        if held:
            yield _columns(_solved(held), names, kinds)

    return ordered.mapInArrow(run, f"`{id_col}` {kind}, {_KINDS}")


def _long(rows: DataFrame, id_col: str, block_rows: int, block_bytes: int) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    blocks = written(_blocks(rows, kind, block_rows, block_bytes))
    turns = rows.groupBy("id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    counts = blocks.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    chained = written(_chain(blocks, kind))
    ends = written(_ends(blocks.select("part", "block", "id", "codes").join(_beside(chained.select("part", "block", "exits", "is_last")), ["part", "block"]), kind))
    entries = _beside(written(_entries(ends, kind).join(chained.select("part", "block", "exits", "is_last"), ["part", "block"])))
    pieces = written(_pieces(blocks.join(entries, ["part", "block"]), kind))
    audits = pieces.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "block", "audit"))).alias("all"))  # as long as the result
    audits = audits.select("id", F.array_join(F.transform("all", lambda p: p["audit"]), "").alias("audit"))
    per_id = chained.groupBy("id").agg(F.max("cost").alias("cost"), F.max("illegal").alias("illegal"))
    out = _hashes(pieces, kind)
    for more in (audits, per_id, turns, counts):
        more = more.withColumnRenamed("id", "__id")
        out = out.join(more, out["id"].eqNullSafe(more["__id"])).drop("__id")
    return out.select(F.col("id").alias(id_col), *[F.coalesce(c, F.lit(0)).alias(c) if c == "gaps" else F.col(c) for c in NAMES])


def _blocks(rows: DataFrame, kind: str, block_rows: int, block_bytes: int) -> DataFrame:
    """One row a block: its rows' roles, texts and codes, counts of faults, illegal pairs inside, roles at its ends, least costs through it."""
    digest = F.sha2(F.concat("role", F.lit("\x00"), "text"), 256)
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    marked = rows.withColumn("digest", digest)
    # Texts that come again at a later turn.
    again = marked.groupBy(F.col("id").alias("of"), F.col("digest").alias("what")).agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").drop("last")
    again = _beside(written(again))
    met = marked.join(again, marked["id"].eqNullSafe(again["of"]) & (marked["digest"] == again["what"]), "left")
    flagged = met.select("id", "turn", "role", "text", F.coalesce(place > F.col("first"), F.lit(False)).alias("again"))
    ordered = flagged.repartitionByRange(F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    names = ["id", "part", "block", "roles", "texts", "codes", "blank", "duplicate", "truncated", "illegal", "costs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, kinds = TaskContext.get().partitionId(), 0, None
        held: list[tuple] = []
        size, before = 0, None

        def closed() -> pa.RecordBatch:
            codes = np.array([h[2] for h in held], np.int64)
            faults = [h[3] for h in held]
            roles = [h[0] for h in held]
            through = transfers(COST[codes[None]])[0].ravel().tolist()
            row = (before[0], part, number, roles, [h[1] for h in held], codes.astype(np.uint8).tobytes(), *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(not legal_pair(a, b) for a, b in zip(roles, roles[1:])), through)
            return _columns([row], names, kinds)

        for batch in batches:
            kinds = kinds or [batch.schema.field("id").type, pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary(), *[pa.int64()] * 4, pa.list_(pa.int64())]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, turn, role, text, later = row
                if held and (before[0] != key or len(held) >= block_rows or size + len(text) > block_bytes):
                    yield closed()
                    held, size, number = [], 0, number + 1
                held.append((role, text, *code_of(role, text, later or row[:4] == before)))
                size, before = size + len(text), row[:4]
        if held:
            yield closed()

    return ordered.mapInArrow(run, f"id {kind}, part int, block long, roles array<string>, texts array<string>, codes binary, blank long, duplicate long, truncated long, illegal long, costs array<long>")


def _chain(blocks: DataFrame, kind: str) -> DataFrame:
    """part, block, id, exits (costs from each state behind the block to the end), is_last, cost, illegal (of the whole conversation)."""
    narrow = blocks.select("id", "part", "block", "costs", "illegal", F.element_at("roles", 1).alias("first"), F.element_at("roles", -1).alias("last"))

    def chain(own: pa.Table) -> pa.Table:
        own = own.sort_by([("part", "ascending"), ("block", "ascending")])
        layers = np.array(own.column("costs").to_pylist(), np.int64).reshape(1, -1, 4, 4)
        prices = solve(layers, EXIT[None])[0]
        first, last = own.column("first").to_pylist(), own.column("last").to_pylist()
        illegal = sum(own.column("illegal").to_pylist()) + sum(not legal_pair(a, b) for a, b in zip(last, first[1:]))
        n = own.num_rows
        return pa.table({"part": own.column("part"), "block": own.column("block"), "id": own.column("id"), "exits": pa.array(prices[1:].tolist(), pa.list_(pa.int64())), "is_last": pa.array(np.arange(n) == n - 1), "cost": pa.array([int(prices[0, START])] * n, pa.int64()), "illegal": pa.array([illegal] * n, pa.int64())})

    return narrow.groupBy("id").applyInArrow(chain, f"part int, block long, id {kind}, exits array<long>, is_last boolean, cost long, illegal long")


def _traced(codes: bytes, exits: list[int], entry: int) -> tuple[list[str], list[int]]:
    own, ends = np.frombuffer(codes, np.uint8).astype(np.int64)[None], np.array(exits, np.int64)[None]
    labels, states = trace(own, solve(COST[own], ends), np.array([entry]))
    return [LABELS[x] for x in labels[0]], states[0].tolist()


def _ends(blocks: DataFrame, kind: str) -> DataFrame:
    """part, block, id, ends: the state behind the block for each state before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[_traced(c, e, s)[1][-1] for s in range(4)] for c, e in zip(batch.column("codes").to_pylist(), batch.column("exits").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("part", "block", "id")] + [pa.array(found, pa.list_(pa.int32()))], ["part", "block", "id", "ends"])

    return blocks.mapInArrow(run, f"part int, block long, id {kind}, ends array<int>")


def _entries(ends: DataFrame, kind: str) -> DataFrame:
    """part, block, entry: the state in which the repair enters each block."""

    def walk(own: pa.Table) -> pa.Table:
        own = own.sort_by([("part", "ascending"), ("block", "ascending")])
        entry, state = [], START
        for e in own.column("ends").to_pylist():
            entry.append(state)
            state = e[state]
        return pa.table({"part": own.column("part"), "block": own.column("block"), "entry": pa.array(entry, pa.int32())})

    return ends.groupBy("id").applyInArrow(walk, "part int, block long, entry int")


def _pieces(blocks: DataFrame, kind: str) -> DataFrame:
    """id, part, block, audit, lines (null: none) of each block."""
    narrow = blocks.select("id", "part", "block", "roles", "texts", "codes", "exits", "entry", "is_last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                audit, lines = edited(*_traced(row["codes"], row["exits"], row["entry"]), row["roles"], row["texts"], row["is_last"])
                joined = "\n".join(lines).encode() if lines else None
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, 1) for c in ("id", "part", "block")), pa.array([audit]), pa.array([joined], pa.binary())], ["id", "part", "block", "audit", "lines"])

    return narrow.mapInArrow(run, f"id {kind}, part int, block long, audit string, lines binary")


def _hashes(pieces: DataFrame, kind: str) -> DataFrame:
    """id, repaired_sha256: blocks stream by in order."""
    ordered = pieces.select("id", "part", "block", "lines").repartition("id").sortWithinPartitions("id", "part", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, begun, kind_ = None, None, False, pa.int64()
        for batch in batches:
            kind_, done = batch.schema.field("id").type, []
            for own, lines in zip(batch.column("id").to_pylist(), batch.column("lines"), strict=True):
                if digest is None or own != key:
                    done += [] if digest is None else [(key, digest.hexdigest())]
                    key, digest, begun = own, hashlib.sha256(), False
                if lines.is_valid:
                    digest.update((b"\n" if begun else b"") + lines.as_py())
                    begun = True
            yield _columns(done, ["id", "repaired_sha256"], [kind_, pa.string()])
        if digest is not None:
            yield _columns([(key, digest.hexdigest())], ["id", "repaired_sha256"], [kind_, pa.string()])

    return ordered.mapInArrow(run, f"id {kind}, repaired_sha256 string")
