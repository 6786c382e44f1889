"""Retrieval for many queries at once: vector, full-text, fuzzy and reference arms, rank fusion, hybrid and multi-project search.

Chunks and queries meet within a project, in the task that reads the chunks: a block of queries (BROADCAST_QUERIES at most)
is broadcast, each task scores its chunks against it and keeps the k best of each query. Only those leave it, at most
k rows for each query and task: texts, vectors and postings never move, and scores of all pairs are never listed. More
queries than a block has make further passes, each over the chunks of its own projects. Metadata are joined after the top rows are known. Every
ranking ends in the chunk's id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from .storage import stored

#: Pools, weights and constants of the arms and of their fusion.
VECTOR_K, TEXT_K, FUZZY_K, REFERENCE_CAP = 20, 20, 25, 100
POOLS, WEIGHTS, RANK_CONSTANT = {"vector": 50, "fts": 50, "trigram": 25}, {"vector": 1.0, "fts": 1.0, "trigram": 0.5}, 60
ARM_ORDER = {"vector": 0, "fts": 1, "trigram": 2}
TERM_WEIGHT, TERM_CAP, WORD_SIMILARITY = 0.1, 256, 0.6
#: Queries of one pass over the chunks, held by every task; a table of query words is broadcast up to so many rows.
BROADCAST_QUERIES = 10_000
#: How often blocks of queries are cut again where they come out larger, as repeated ids may make them.
MOST_LEVELS = 4
#: Scores (chunks times queries) that a task computes at a time.
BLOCK_SCORES = 1 << 21
#: Bytes of chunks' words that a task takes apart at a time; arrays made of them are about ten times as large.
BLOCK_BYTES = 4 << 20
#: Approximate search: rows a bucket holds on average, sides of a bucket at least, rows that are asked to calibrate, share of
#: their neighbours to be found, rows and queries of a bucket in one task, and buckets whose sizes are broadcast (20 bytes each).
BUCKET_ROWS, LEAST_BITS, CALIBRATION_ROWS, ANN_RECALL = 256, 4, 200, 0.95
MEET_ROWS, MEET_QUERIES, BROADCAST_BUCKETS = 4_096, 512, 1_000_000


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best rows of each query with their rank: score down, chunk_id up."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def searchable_projects(projects: DataFrame, active_model: str, needs_vectors: bool = True) -> DataFrame:
    """project_id, searchable, reason: not ready, or indexed with another model."""
    reason = F.when(F.col("status") != "ready", "not_ready")
    if needs_vectors:
        reason = reason.when(~F.col("embedding_model").eqNullSafe(active_model), "other_model")
    return projects.select("project_id", reason.isNull().alias("searchable"), reason.alias("reason"))


class Best:
    """The k best rows of each query so far: score down, id up."""

    def __init__(self, queries: int, k: int, id_type: pa.DataType):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.held = pa.table({"q": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "id": pa.array([], id_type)})
        self.most = max(200_000, 2 * k * queries)

    def add(self, scores: np.ndarray, eligible: np.ndarray, numbers: np.ndarray, ids: pa.Array) -> None:
        """scores, eligible: chunks x queries; numbers: those of the queries. Scores that aren't finite take no place."""
        eligible = eligible & np.isfinite(scores)
        if len(scores) > self.k:
            masked = np.where(eligible, scores, -np.inf)
            eligible = eligible & (scores >= np.partition(masked, len(masked) - self.k, axis=0)[len(masked) - self.k])
        row, column = np.nonzero(eligible & (scores >= self.floor[numbers]))
        new = pa.table({"q": pa.array(numbers[column], pa.int64()), "score": pa.array(scores[row, column], pa.float64()), "id": ids.take(pa.array(row))})
        self.held = pa.concat_tables([self.held, new])
        if self.held.num_rows > self.most:
            self.cut()

    def cut(self) -> pa.Table:
        held = self.held.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")]).combine_chunks()
        q = held.column("q").to_numpy()
        first = np.searchsorted(q, q)
        self.held = held.filter(pa.array(np.arange(len(q)) - first < self.k))
        q, score = self.held.column("q").to_numpy(), self.held.column("score").to_numpy()
        last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == self.k - 1)
        self.floor[q[last]] = score[last]
        return self.held


def query_blocks(queries: DataFrame, n: int, level: int = 0) -> DataFrame:
    """queries plus __block: blocks of about half of BROADCAST_QUERIES, with few projects in more than one.

    A project with few queries lies in one block; one with more than a quarter of a block's bound is cut first. So a chunk is
    read by as many passes as its own project's queries need, not by those of all others. Blocks that come out above the bound are cut once more.
    """
    counts = queries.groupBy("project_id").agg(F.count(F.lit(1)).alias("__c"))
    cut = F.ceil(F.col("__c") / max(1, BROADCAST_QUERIES // 2))
    unit = F.when(F.col("__c") > BROADCAST_QUERIES // 4, F.pmod(F.xxhash64(F.lit(level), "query_id"), cut)).otherwise(0)
    sized = queries.join(counts.withColumnRenamed("project_id", "__p"), F.col("project_id").eqNullSafe(F.col("__p"))).withColumn("__u", unit)
    blocks = 2 * -(-n // BROADCAST_QUERIES)
    return sized.withColumn("__block", F.pmod(F.xxhash64(F.lit(level), "project_id", "__u"), F.lit(blocks))).drop("__p", "__c", "__u")


def _few(rows: DataFrame) -> DataFrame:
    """Broadcast, if there are no more than BROADCAST_QUERIES of them."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_QUERIES else rows


def best_of_tasks(chunks: DataFrame, queries: DataFrame, k: int, prepare: Callable, score: Callable, level: int = 0) -> DataFrame:
    """query_id, chunk_id, score: the k best chunks of each query in each task. chunks: project_id, chunk_id, more; queries: query_id, project_id, asked.

    prepare(list of `asked`) makes what a project's queries are scored with; score(that, rows of one project) gives
    parts of (scores, eligible, numbers of the queries, ids), chunks x queries each. level: how often the queries have been cut.
    """
    n = queries.count()
    if n > BROADCAST_QUERIES and level < MOST_LEVELS:
        blocks = stored(query_blocks(queries, n, level))
        out = None
        for row in blocks.select("__block").distinct().orderBy("__block").collect():  # about 2 * n / BROADCAST_QUERIES rows
            asked = blocks.filter(F.col("__block") == row["__block"]).drop("__block")
            own = chunks.join(_few(asked.select("project_id").distinct()), "project_id", "left_semi")
            part = best_of_tasks(own, asked, k, prepare, score, level + 1)
            out = part if out is None else out.unionByName(part)
        return out
    asked = queries.filter("asked IS NOT NULL").select("query_id", "project_id", "asked").toArrow()  # BROADCAST_QUERIES or so
    shared = chunks.sparkSession.sparkContext.broadcast(asked.sort_by([("project_id", "ascending"), ("query_id", "ascending")]))
    id_type = to_arrow_type(chunks.schema["chunk_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        projects, wanted = table.column("project_id").combine_chunks(), table.column("asked")
        places: dict = {}
        for number, project in enumerate(projects.to_pylist()):
            places.setdefault(project, []).append(number)
        made: dict = {}
        best = Best(table.num_rows, k, id_type)
        for batch in batches:
            coded = batch.column("project_id").dictionary_encode()
            for code, project in enumerate(coded.dictionary.to_pylist()):
                if project not in places:
                    continue
                if project not in made:
                    made[project] = (np.array(places[project]), prepare(wanted.take(pa.array(places[project])).to_pylist()))
                numbers, ready = made[project]
                rows = batch.filter(pc.fill_null(pc.equal(coded.indices, code), False))
                for scores, eligible, ids in score(ready, rows):
                    best.add(scores, eligible, numbers, ids)
        found = best.cut()
        ids = table.column("query_id").combine_chunks().take(found.column("q").combine_chunks())
        yield from pa.table({"query_id": ids, "chunk_id": found.column("id"), "score": found.column("score")}).combine_chunks().to_batches()

    kinds = [f"{c} {t.schema[c].dataType.simpleString()}" for t, c in ((queries, "query_id"), (chunks, "chunk_id"))]
    return chunks.mapInArrow(run, f"{', '.join(kinds)}, score double")


def _row_blocks(rows: int, queries: int) -> Iterator[tuple[int, int]]:
    step = max(1, BLOCK_SCORES // max(queries, 1))
    for at in range(0, rows, step):
        yield at, min(rows, at + step)


def word_parts(rows: pa.RecordBatch, queries: int) -> Iterator[tuple[pa.ListArray, pa.Array]]:
    """(words, ids) of runs of rows: no more than BLOCK_SCORES scores and BLOCK_BYTES of words each, or one row. rows: chunk_id, words (as word_texts gives them)."""
    texts = rows.column("words")
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    step, a = max(1, BLOCK_SCORES // max(queries, 1)), 0
    while a < len(texts):
        full = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK_BYTES, "right"))
        b = min(len(texts), a + step, max(a + 1, full))
        part = texts.slice(a, b - a)
        # An empty text has one empty word, which nobody asks for.
        yield pc.split_pattern(part, " "), rows.column("chunk_id").slice(a, b - a)
        a = b


def vector_search(chunks: DataFrame, queries: DataFrame, k: int = VECTOR_K) -> DataFrame:
    """query_id, chunk_id, score (cosine, six digits), rank. chunks: project_id, chunk_id, embedding; queries: query_id, project_id, vector.

    Vectors of another length than the query's aren't compared with it; those that are null or hold null or non-finite parts
    take no part, on either side.
    """

    def prepare(asked: list) -> list[tuple[np.ndarray, np.ndarray]]:
        lengths = np.array([len(v) for v in asked])
        return [(lengths == d, np.array([v for v in asked if len(v) == d], np.float64)) for d in np.unique(lengths).tolist()]

    def score(ready: list, rows: pa.RecordBatch) -> Iterator[tuple]:
        lengths = pc.list_value_length(rows.column("embedding")).to_numpy()
        for which, q in ready:
            same = rows.filter(pa.array(lengths == q.shape[1]))
            flat = same.column("embedding").flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(same.num_rows, q.shape[1])
            for a, b in _row_blocks(same.num_rows, len(which)):
                norms = np.linalg.norm(x[a:b], axis=1)[:, None] * np.linalg.norm(q, axis=1)[None]
                found = (x[a:b] @ q.T) / np.maximum(norms, 1e-300)
                scores = np.zeros((b - a, len(which)))
                scores[:, which] = np.copysign(np.floor(np.abs(found) * 1e6 + 0.5) / 1e6, found)
                yield scores, np.broadcast_to(which, scores.shape), same.column("chunk_id").slice(a, b - a)

    asked = queries.select("query_id", "project_id", F.col("vector").cast("array<double>").alias("asked")).filter(finite("asked"))
    rows = chunks.filter(finite("embedding")).select("project_id", "chunk_id", "embedding")
    return top_k(best_of_tasks(rows, asked, k, prepare, score).withColumn("score", F.round("score", 6)), k)


def finite(vector: str) -> Column:
    """Whether a vector is there and all its parts are numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(vector).isNotNull() & good


class WordIndex:
    """Queries by the words they ask for."""

    def __init__(self, asked: list[list[str]], more: list[str] = ()):
        """asked: the distinct words of each query; more: words that get a number too."""
        code: dict[str, int] = {}
        pairs = np.array([(code.setdefault(w, len(code)), q) for q, own in enumerate(asked) for w in own], np.int64).reshape(-1, 2)
        for w in more:
            code.setdefault(w, len(code))
        self.code, self.queries = code, len(asked)
        self.words = pa.array(list(code), pa.string())
        order = np.argsort(pairs[:, 0], kind="stable")
        self.of = pairs[order, 1]
        self.count = np.bincount(pairs[:, 0], minlength=len(code))
        self.first = np.cumsum(self.count) - self.count

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Number of each word; -1 for those that nobody asks for."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def sums(self, row: np.ndarray, word: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
        """rows x queries: sum of n over the row's words that the query asks for. Each (row, word) once."""
        length = self.count[word]
        pick = np.repeat(self.first[word] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        return np.bincount(np.repeat(row, length) * self.queries + self.of[pick], np.repeat(n, length), rows * self.queries).reshape(rows, self.queries)


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all items, row of each item)."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), lengths)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, project_id, asked: white-space terms, each once, as arrays of lexemes; `or` says nothing; a term of several lexemes is a phrase."""
    terms = F.array_distinct(F.filter(F.transform(F.split("text", r"\s+"), T.lexemes), lambda t: (F.size(t) > 0) & (t != F.array(F.lit("or")))))
    return queries.select("query_id", "project_id", terms.alias("asked"))


def chunk_words(chunks: DataFrame) -> DataFrame:
    """project_id, chunk_id, words: the lexemes of content and search text, in order. May be stored with an index and given to the searches for the chunks."""
    return chunks.select("project_id", "chunk_id", (F.col("words") if "words" in chunks.columns else T.lexemes(F.col("search_text"))).alias("words"))


def word_texts(chunks: DataFrame) -> DataFrame:
    """As chunk_words, but words are one text with a space between each two."""
    words = F.array_join("words", " ") if "words" in chunks.columns else T.lexeme_text(F.col("search_text"))
    return chunks.select("project_id", "chunk_id", words.alias("words"))


def fulltext_search(chunks: DataFrame, queries: DataFrame, k: int = TEXT_K, index: str | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: 0.1 for each occurrence (TERM_CAP a term at most) of the query's terms; a phrase occurs where its lexemes follow each other.

    index: the folder of postings of these chunks (operators/postings.py), read instead of them.
    """
    if index is not None:
        from .postings import indexed_search

        return indexed_search(chunks.sparkSession, index, queries, k)

    def prepare(asked: list) -> tuple[WordIndex, list[tuple[int, list[int]]]]:
        phrases = [(q, t) for q, own in enumerate(asked) for t in own if len(t) > 1]
        index = WordIndex([[t[0] for t in own if len(t) == 1] for own in asked], [w for _, t in phrases for w in t])
        return index, [(q, [index.code[w] for w in t]) for q, t in phrases]

    def score(ready: tuple, rows: pa.RecordBatch) -> Iterator[tuple]:
        index, phrases = ready
        for lists, ids in word_parts(rows, index.queries):
            words, row = _flat(lists)
            word = index.numbers(words)
            known = word >= 0
            pair, n = np.unique(row[known] * max(len(index.words), 1) + word[known], return_counts=True)
            total = index.sums(pair // max(len(index.words), 1), pair % max(len(index.words), 1), np.minimum(n, TERM_CAP), len(ids))
            order = np.argsort(word, kind="stable") if phrases else word
            ordered = word[order] if phrases else word
            for q, term in phrases:
                at = order[np.searchsorted(ordered, term[0]) : np.searchsorted(ordered, term[0], "right")]
                at = at[at + len(term) <= len(word)]
                for step in range(1, len(term)):
                    at = at[(word[at + step] == term[step]) & (row[at + step] == row[at])]
                where, n = np.unique(row[at], return_counts=True)
                total[where, q] += np.minimum(n, TERM_CAP)
            yield total, total > 0, ids

    found = best_of_tasks(word_texts(chunks), query_terms(queries), k, prepare, score)
    return top_k(found.withColumn("score", F.round(TERM_WEIGHT * F.col("score").cast("long"), 6)), k)


def find_references(chunks: DataFrame, symbols: DataFrame, cap: int = REFERENCE_CAP) -> DataFrame:
    """query_id, chunk_id, path, start_line, end_line, rank: chunks that have all lexemes of the symbol, by path and line. symbols: query_id, project_id, symbol.

    Only words that some symbol has leave the tasks that read the chunks, if the symbols' words are few enough to be broadcast.
    """
    wanted = symbols.select("query_id", "project_id", F.array_distinct(T.lexemes(F.col("symbol"))).alias("all")).select("*", F.explode("all").alias("lexeme"))
    wanted = F.broadcast(wanted) if wanted.count() <= 10 * BROADCAST_QUERIES else wanted
    words = chunk_words(chunks).select("project_id", "chunk_id", F.explode(F.array_distinct("words")).alias("lexeme"))
    found = words.join(wanted, ["project_id", "lexeme"]).groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("m"), F.first(F.size("all")).alias("n")).filter("m = n")
    placed = found.join(chunks.select("chunk_id", "path", "start_line", "end_line"), "chunk_id")
    order = Window.partitionBy("query_id").orderBy("path", "start_line", "chunk_id")
    return placed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap).select("query_id", "chunk_id", "path", "start_line", "end_line", "rank")


def trigrams(text: Column) -> Column:
    """The trigrams of the lower-cased words of letters and digits, each word after two spaces and before one, in order."""
    padded = F.transform(T.lexemes(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substr(w, i, F.lit(3)))))


def word_trigrams(word: str) -> list[str]:
    padded = f"  {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def trigram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the trigrams of all words, each as a number of its three code points; how many each word has)."""
    points = np.frombuffer("".join([f"  {w} " for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    count = np.array([len(w) + 1 for w in words], np.int64)
    begin = np.cumsum(count + 2) - (count + 2)
    at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return points[at] << 42 | points[at + 1] << 21 | points[at + 2], count


def word_similarity(probe: list, text: list, least: float = WORD_SIMILARITY) -> float:
    """Best share of the probe's trigrams in a run of the text's: common / (probe + run - common), over runs that begin and end on one of the probe's. Exact from `least` on: longer runs can't reach it."""
    wanted, best = set(probe), 0.0
    at = [i for i, t in enumerate(text) if t in wanted]
    longest = len(wanted) / least
    for n, i in enumerate(at):
        seen: set[str] = set()
        common, last = 0, i
        for j in at[n:]:
            common += text[j] not in seen
            seen.update(text[last : j + 1])
            if len(seen) > longest:
                break
            last = j
            best = max(best, common / (len(wanted) + len(seen) - common))
    return best


class Probes:
    """Fuzzy queries of one project: their trigrams' numbers, the fewest that must be met, and the reach of a run.

    A run that matters has at most `most` different trigrams. Where no `reach` positions in a row repeat so much that they have
    no more, such a run is at most `reach` long, and so lies in one of the overlapping blocks of twice that length.
    """

    def __init__(self, asked: list[list[str]], least: float):
        self.index, self.least = WordIndex(asked), least
        self.needed = np.array([int(np.ceil(least * len(p) - 1e-9)) for p in asked])
        self.probes = [[self.index.code[g] for g in p] for p in asked]
        self.most = int(max(map(len, asked), default=1) / least + 1e-9)
        self.reach = 4 * self.most
        codes = np.array([ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]) for g in self.index.code], np.int64)
        self.number = np.argsort(codes)
        self.codes = codes[self.number]

    def numbered(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """(numbers of the words' trigrams, those of the probes by their own; how many each word has; a bound of the numbers)."""
        codes, length = trigram_codes(words)
        distinct, flat = np.unique(codes, return_inverse=True)
        numbers = len(self.codes) + np.arange(len(distinct))
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, distinct), len(self.codes) - 1)
            numbers = np.where(self.codes[at] == distinct, self.number[at], numbers)
        return numbers[flat], length, len(self.codes) + len(distinct)

    def possible(self, row: np.ndarray, word: np.ndarray, flat: np.ndarray, length: np.ndarray, rows: int) -> np.ndarray:
        """Which rows hold, anywhere, as many of some probe's trigrams as a run has to."""
        asked = len(self.index.words)
        known = flat < asked
        has = np.bincount(np.repeat(np.arange(len(length)), length)[known], minlength=len(length))
        own, first = flat[known], np.cumsum(has) - has
        some = has[word] > 0
        met = np.unique(row[some] * max(len(length), 1) + word[some])
        row, word = met // max(len(length), 1), met % max(len(length), 1)
        each = has[word]
        grams = own[np.repeat(first[word] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        pair = np.unique(np.repeat(row, each) * max(asked, 1) + grams)
        shared = self.index.sums(pair // max(asked, 1), pair % max(asked, 1), np.ones(len(pair)), rows)
        return (shared >= self.needed[None]).any(axis=1)

    def scores(self, words: pa.Array) -> tuple[np.ndarray, int]:
        """(chunks x queries, runs of trigrams that were scored one by one). words: the chunks' lexemes."""
        lexemes, row = _flat(words)
        coded, asked, n = lexemes.dictionary_encode(), len(self.index.words), len(words)
        flat, length, numbers = self.numbered(coded.dictionary.to_pylist())
        word, first = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(length) - length
        # Rows that can't reach the score are as if they were empty.
        live = self.possible(row, word, flat, length, n)[row]
        row, word = row[live], word[live]
        each = length[word]
        grams = flat[np.repeat(first[word] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        of = np.repeat(row, each)
        size = np.bincount(of, minlength=n)
        begin = np.cumsum(size) - size
        at = np.arange(len(grams)) - begin[of]
        out, scored = np.zeros((n, self.index.queries)), 0
        # Blocks of 2 * reach positions, one every `reach`; a repetitive chunk is one block.
        whole = self._repetitive(grams, of, at, size, begin, numbers)
        count = np.where(whole, 1, np.maximum(1, -(-size // self.reach)))
        blocks = np.cumsum(count) - count
        known = np.flatnonzero(grams < asked)
        place = np.where(whole[of[known]], 0, at[known] // self.reach)
        block = blocks[of[known]] + place
        # Each position lies in its block and in the one before.
        before = place > 0
        pair = np.unique(np.concatenate([block * asked + grams[known], (block[before] - 1) * asked + grams[known][before]]))
        owner = np.repeat(np.arange(n), count)
        step = max(1, BLOCK_SCORES // max(self.index.queries, 1))
        for low in range(0, len(owner), step):
            a, b = np.searchsorted(pair, [low * asked, (low + step) * asked])
            some = pair[a:b]
            shared = self.index.sums(some // asked - low, some % asked, np.ones(len(some)), min(step, len(owner) - low))
            for i, q in np.argwhere(shared >= self.needed[None]).tolist():
                c = owner[low + i]
                start = begin[c] + (0 if whole[c] else (low + i - blocks[c]) * self.reach)
                end = begin[c] + size[c] if whole[c] else min(start + 2 * self.reach, begin[c] + size[c])
                found = word_similarity(self.probes[q], grams[start:end].tolist(), self.least)
                out[c, q] = max(out[c, q], np.floor(found * 1e6 + 0.5) / 1e6)
                scored += 1
        return out, scored

    def _repetitive(self, grams: np.ndarray, of: np.ndarray, at: np.ndarray, size: np.ndarray, begin: np.ndarray, numbers: int) -> np.ndarray:
        """Chunks in which `reach` + 1 positions in a row have no more than `most` trigrams that didn't occur within `reach` before."""
        order = np.argsort(of * numbers + grams, kind="stable")
        same = (of[order][1:] == of[order][:-1]) & (grams[order][1:] == grams[order][:-1])
        near = np.zeros(len(grams), bool)
        near[order[1:]] = same & (at[order][1:] - at[order][:-1] <= self.reach)
        fresh = np.concatenate([[0], np.cumsum(~near)])
        starts = np.flatnonzero(at + self.reach < size[of]) if len(grams) else np.zeros(0, np.int64)
        few = fresh[starts + self.reach + 1] - fresh[starts] <= self.most
        out = np.zeros(len(size), bool)
        out[of[starts[few]]] = True
        return out


def trigram_search(chunks: DataFrame, queries: DataFrame, k: int = FUZZY_K, least: float = WORD_SIMILARITY) -> DataFrame:
    """query_id, chunk_id, score, rank for queries that name identifiers.

    Chunks are cut into overlapping blocks of trigrams where they are read; a block with fewer than ceil(least * trigrams) of a
    probe's can't reach the score, and only the others are scored run by run.
    """

    def prepare(asked: list) -> Probes:
        return Probes(asked, least)

    def score(probes: Probes, rows: pa.RecordBatch) -> Iterator[tuple]:
        for lists, ids in word_parts(rows, max(probes.index.queries, 1 << 12)):
            scores, _ = probes.scores(lists)
            yield scores, scores >= least, ids

    probe = F.array_distinct(trigrams(F.array_join(T.identifier_tokens(F.col("text")), " ")))
    asked = queries.select("query_id", "project_id", probe.alias("asked")).filter(F.size("asked") > 0)
    return top_k(best_of_tasks(word_texts(chunks), asked, k, prepare, score).withColumn("score", F.round("score", 6)), k)


def fuse(ranked: DataFrame, keys: tuple[str, ...] = ("query_id",), item: str = "chunk_id", constant: int = RANK_CONSTANT) -> DataFrame:
    """keys, item, score, rank: sum over arms of weight / (constant + rank), added in order of arms; ties by first arm, then rank. ranked: arm_no, weight, rank."""
    parts = F.array_sort(F.collect_list(F.struct("arm_no", (F.col("weight") / (constant + F.col("rank"))).alias("part"), "rank")))
    summed = ranked.groupBy(*keys, item).agg(parts.alias("parts"))
    scored = summed.withColumn("score", F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["part"])).withColumn("first", F.struct(F.col("parts")[0]["arm_no"].alias("a"), F.col("parts")[0]["rank"].alias("r")))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "first.a", "first.r", item)
    return scored.withColumn("rank", F.row_number().over(order)).select(*keys, item, F.round("score", 6).alias("score"), "rank")


def canonical(arms: DataFrame) -> DataFrame:
    """arms plus canonical_id: per query and path, the chunk that is met first, arm by arm. arms: query_id, arm_no, rank, chunk_id, path."""
    first = arms.groupBy("query_id", "path").agg(F.min_by("chunk_id", F.struct("arm_no", "rank")).alias("canonical_id"))
    return arms.join(first, ["query_id", "path"])


def dedupe_by_file(arms: DataFrame) -> DataFrame:
    """query_id, arm_no, weight, chunk_id (the canonical one), rank: a file's best place in each arm, places numbered anew."""
    best = canonical(arms).groupBy("query_id", "arm_no", "weight", F.col("canonical_id").alias("chunk_id")).agg(F.min("rank").alias("old"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "arm_no").orderBy("old"))).drop("old")


def union_arms(chunks: DataFrame, arms: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, found in arms.items():
        rows = found.select("query_id", "chunk_id", "rank").withColumn("arm_no", F.lit(ARM_ORDER[name])).withColumn("weight", F.lit(WEIGHTS[name]))
        out = rows if out is None else out.unionByName(rows)
    return out.join(chunks.select("chunk_id", "path"), "chunk_id")


def hybrid_search(chunks: DataFrame, queries: DataFrame, limit: int = 10, with_vectors: bool = True, with_fuzzy: bool = True, embedded: DataFrame | None = None) -> DataFrame:
    """query_id, rank, score, chunk_id, path, start_line, end_line: arms, one place per file, fused; metadata joined last. queries: query_id, project_id, text, vector.

    embedded: the chunks with their vectors, read by the vector arm alone; none: `chunks` has them.
    """
    arms = search_arms(chunks, queries, with_vectors, with_fuzzy, embedded)
    return fuse_arms(chunks, arms, limit)


def search_arms(chunks: DataFrame, queries: DataFrame, with_vectors: bool = True, with_fuzzy: bool = True, embedded: DataFrame | None = None) -> dict[str, DataFrame]:
    """Each arm's pool of rows; arguments as in hybrid_search."""
    arms = {"fts": fulltext_search(chunks, queries, POOLS["fts"])}
    if with_vectors:
        arms["vector"] = vector_search(chunks if embedded is None else embedded, queries, POOLS["vector"])
    if with_fuzzy:
        arms["trigram"] = trigram_search(chunks, queries, POOLS["trigram"])
    return arms


def fuse_arms(chunks: DataFrame, arms: dict[str, DataFrame], limit: int = 10) -> DataFrame:
    best = fuse(dedupe_by_file(union_arms(chunks, arms))).filter(F.col("rank") <= limit)
    return best.join(chunks.select("chunk_id", "path", "start_line", "end_line"), "chunk_id").select("query_id", "rank", "score", "chunk_id", "path", "start_line", "end_line")


def multi_project_search(chunks: DataFrame, queries: DataFrame, scopes: DataFrame, limit: int = 10, per_project: int = 10, **how) -> DataFrame:
    """query_id, rank, score, chunk_id, project_id: hybrid lists of each project in a query's scope, fused once more. scopes: query_id, project_id; projects without chunks give nothing."""
    asked = queries.drop("project_id").join(scopes, "query_id").withColumn("__q", F.col("query_id")).withColumn("query_id", F.concat_ws("\x00", F.col("query_id").cast("string"), "project_id"))
    lists = hybrid_search(chunks, asked, per_project, **how).join(asked.select("query_id", F.col("__q").alias("q"), "project_id"), "query_id")
    # Projects are arms of the second fusion, in order of their names.
    ranked = lists.select(F.col("q").alias("query_id"), "chunk_id", "rank", F.lit(1.0).alias("weight"), F.col("project_id").alias("arm_no"))
    best = fuse(ranked).filter(F.col("rank") <= limit)
    return best.join(chunks.select("chunk_id", "project_id"), "chunk_id").select("query_id", "rank", "score", "chunk_id", "project_id")


def flips(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(masks, sides of each): no side, each side alone, and each pair of sides."""
    own = [0] + [1 << i for i in range(bits)] + [1 << i | 1 << j for i in range(bits) for j in range(i)]
    masks = np.array(own, np.int64)
    return masks, (masks[:, None] >> np.arange(bits) & 1).astype(np.float64)


def bucket_keys(x: np.ndarray, planes: np.ndarray, probes: int = 1) -> np.ndarray:
    """rows x tables x probes: the bucket of each row in each table, then those across the nearest planes (two at most).

    planes: tables x bits x dim. The farther a bucket, by the sum of squared distances to the planes crossed, the later.
    """
    tables, bits = planes.shape[:2]
    side = np.einsum("tbd,nd->ntb", planes, x)
    own = (side > 0) @ (1 << np.arange(bits)) + (np.arange(tables, dtype=np.int64) << bits)
    if probes == 1:
        return own[:, :, None]
    masks, crossed = flips(bits)
    order = np.argsort(side**2 @ crossed.T, axis=2, kind="stable")[:, :, :probes]
    return own[:, :, None] ^ masks[order]


def hyperplane_keys(vectors: DataFrame, planes: np.ndarray, probes: int = 1) -> DataFrame:
    """id, v, keys: the buckets of bucket_keys. vectors: id, v, all of the planes' length."""
    shared = vectors.sparkSession.sparkContext.broadcast(planes)
    tables, bits, dim = planes.shape
    step = max(1, BLOCK_SCORES // (tables * len(flips(bits)[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
                keys = bucket_keys(flat.reshape(part.num_rows, dim), shared.value, probes).reshape(part.num_rows, -1)
                lists = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * keys.shape[1], keys.ravel())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), lists], ["id", "v", "keys"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"id {kind}, v array<double>, keys array<bigint>")


def _of_length(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    return rows.filter(F.col("id").isNotNull() & (F.size("v") == dim) & finite("v"))


def calibrated_buckets(rows: DataFrame, count: int, dim: int, k: int, tables: int, recall: float) -> tuple[int, int]:
    """(bits, probes): the most bits, up to about BUCKET_ROWS rows a bucket, with which some number of probes finds `recall`
    of the true neighbours of CALIBRATION_ROWS rows, those with the lowest hashes; and the fewest such probes."""
    some = rows.orderBy(F.xxhash64("id", "v"), "id").limit(CALIBRATION_ROWS)
    asked = stored(some.select(F.col("id").alias("query_id"), F.lit("all").alias("project_id"), F.col("v").alias("vector")))
    near = vector_search(rows.select(F.lit("all").alias("project_id"), F.col("id").alias("chunk_id"), F.col("v").alias("embedding")), asked, k + 1)
    near = near.filter(F.col("chunk_id") != F.col("query_id")).select("query_id", "chunk_id")
    pairs = near.join(asked, "query_id").join(rows.select(F.col("id").alias("chunk_id"), "v"), "chunk_id").select("vector", "v").collect()  # k a calibration row
    bits = max(LEAST_BITS, int(np.ceil(np.log2(max(count, 1) / BUCKET_ROWS))))
    if not pairs:
        return bits, 1
    q, x = (np.array([r[c] for r in pairs], np.float64) for c in ("vector", "v"))
    while True:
        planes = hyperplanes(dim, tables, bits)
        every = len(flips(bits)[0])
        turns = np.full(len(q), np.inf)
        for at in range(0, len(q), 256):
            met = bucket_keys(q[at : at + 256], planes, every) == bucket_keys(x[at : at + 256], planes)
            turns[at : at + 256] = np.where(met.any(2), met.argmax(2) + 1.0, np.inf).min(1)
        wanted = np.sort(turns)[max(0, int(np.ceil(recall * len(turns))) - 1)]
        if np.isfinite(wanted) or bits == 1:
            return bits, int(min(wanted, every))
        bits -= 1


def hyperplanes(dim: int, tables: int, bits: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(tables, bits, dim))


def ann_search(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, dim: int, k: int = 10, tables: int = 16, bits: int | None = None, probes: int | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: exact cosine (six digits) of the rows whose bucket a query looks into. Both tables: id_col, vector_col.

    bits and probes: calibrated to ANN_RECALL unless given; bits grow with the table, so that buckets don't. Rows and
    queries meet by bucket, cut into blocks, so that a bucket of any size is dealt over many tasks; a block gives each
    query's k best, and only those are brought together; a query's own buckets are looked into first, and the others give
    only what is no worse than the k-th row found there. Rows of another length, without id or with null or non-finite parts take no part;
    a zero vector is at 0 from all. No row is its own neighbour.
    """
    rows, asked = _of_length(vectors, id_col, vector_col, dim), _of_length(queries, id_col, vector_col, dim)
    if bits is None or probes is None:
        bits, probes = calibrated_buckets(rows, rows.count(), dim, k, tables, ANN_RECALL)
    planes = hyperplanes(dim, tables, bits)
    left = stored(hyperplane_keys(rows, planes)).select("id", "v", F.explode("keys").alias("bucket"))
    right = stored(hyperplane_keys(asked, planes, probes)).select("id", "v", F.posexplode("keys").alias("at", "bucket")).withColumn("at", F.col("at") % probes)
    none = F.lit(float("-inf"))
    first = stored(_best_of_buckets(left, right.filter("at = 0").withColumn("least", none), k, dim))
    if probes > 1:
        # What a query finds in its own buckets bounds what the others give.
        floors = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        later = right.filter("at > 0").join(floors, "id", "left").withColumn("least", F.coalesce("least", none))
        first = first.drop("rank").unionByName(_best_of_buckets(left, stored(later), k, dim).drop("rank"))
    once = first.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return top_k(once, k)


def _best_of_buckets(left: DataFrame, right: DataFrame, k: int, dim: int) -> DataFrame:
    """query_id, chunk_id, score, rank: each query's k best, at `least` or above, in its buckets. left: id, v, bucket; right: id, v, bucket, least."""
    # One row per bucket that both sides have: at most tables * 2^bits, a small share of the rows.
    sizes = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).join(right.groupBy("bucket").agg(F.count(F.lit(1)).alias("asked")), "bucket")
    cuts = stored(sizes.select("bucket", F.ceil(F.col("rows") / MEET_ROWS).cast("int").alias("rbs"), F.ceil(F.col("asked") / MEET_QUERIES).cast("int").alias("qbs")))
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_BUCKETS else cuts
    part = lambda n: F.pmod(F.xxhash64("id", "v"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = left.join(cuts, "bucket").select("id", "v", "bucket", part("rbs").alias("rb"), every("qbs").alias("qb"))
    wanted = right.join(cuts, "bucket").select("id", "v", "least", "bucket", every("rbs").alias("rb"), part("qbs").alias("qb"))
    id_type = to_arrow_type(left.schema["id"].dataType)

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        x, q = (t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for t in (rows, asked))
        ids, q_ids = (t.column("id").combine_chunks() for t in (rows, asked))
        best = Best(len(q), k, id_type)
        if len(x) and len(q):
            best.floor = asked.column("least").to_numpy().copy()
            norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None]
            found = (x @ q.T) / np.maximum(norms, 1e-300)
            own = ids.to_numpy(zero_copy_only=False)[:, None] == q_ids.to_numpy(zero_copy_only=False)[None]
            best.add(np.copysign(np.floor(np.abs(found) * 1e6 + 0.5) / 1e6, found), ~own, np.arange(len(q)), ids)
        out = best.cut()
        return pa.table({"query_id": q_ids.take(out.column("q").combine_chunks()), "chunk_id": out.column("id"), "score": out.column("score")})

    kinds = f"query_id {right.schema['id'].dataType.simpleString()}, chunk_id {left.schema['id'].dataType.simpleString()}, score double"
    met = held.groupBy("bucket", "rb", "qb").cogroup(wanted.groupBy("bucket", "rb", "qb")).applyInArrow(meet, kinds)
    once = met.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return top_k(once.withColumn("score", F.round("score", 6)), k)
