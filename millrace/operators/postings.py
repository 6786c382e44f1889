"""A stored inverted index: postings in blocks, files by word, and top-k search that skips blocks that can't matter.

Chunks of a project are numbered within the task that reads them: the longest first, so that high counts lie together, in segments of
SEGMENT chunks, each in order of their ids. A block is one word's postings of one segment: places in the segment, counts,
positions, and the greatest count. Words fall into folders by their hash, and a segment's blocks of one folder are a page: one
row, in which the words are one text and numbers lie one after another, as narrow as they may be. So few rows are shuffled and
written; a query reads the folders of its words and takes only its words' blocks out of their pages. A folder's pages are dealt
over several files. One directory row a segment, in a folder of its own, names its chunks.

A search scores the segments of each build task's longest chunks first. Their k-th scores are floors: a segment is read on
only if, for some query, the sum of its words' greatest counts reaches the floor. Headers alone decide that; places, counts
and positions of skipped segments are neither shuffled nor decoded. Results equal those of the scan, row by row.

The index is a table beside the chunks, written once to a new folder. Chunks without id, project or text have no
postings; an empty table gives an empty index; other columns than those named are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import BROADCAST_QUERIES, REFERENCE_CAP, TERM_CAP, TERM_WEIGHT, TEXT_K, Best, WordIndex, query_terms, top_k
from .storage import stored

#: Chunks of a segment (places are bytes), folders of words, files that one folder's pages are dealt over.
SEGMENT, FOLDERS, SPREAD = 256, 32, 8
#: Bytes of a file's row groups, about: readers hold one at most.
GROUP_BYTES = 32 << 20
#: For each of a page's words, in their order: the greatest count, how many chunks hold it, and how many positions it has there.
_HEADS = ("most", "chunks_of", "positions_of")
_NUMBERS = ("places", "counts", "positions")
_PAGE = f"project_id string, segment long, folder int, words string, {', '.join(f'{c} binary' for c in _HEADS + _NUMBERS)}, chunks array<struct<chunk_id: string, path: string, start_line: int, end_line: int>>"
_BLOCK = "project_id string, segment long, lexeme string, most int, places binary, counts binary, positions binary"


def build_postings(chunks: DataFrame, folder: str) -> None:
    """Writes the index of `chunks` (chunk_id, project_id, path, start_line, end_line, search_text) to a new folder."""
    # Texts that are null go where words are read: as a filter of the table, that would make every search text twice.
    named = chunks.filter("chunk_id IS NOT NULL AND project_id IS NOT NULL")
    words = named.select("chunk_id", F.col("project_id").cast("string").alias("project_id"), "path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), T.lexeme_text(F.col("search_text")).alias("words"))
    ordered = words.sortWithinPartitions("project_id", F.desc(F.octet_length("words")), "chunk_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for part in _segments(batches):
            yield _pages(part, (task << 32) + number)
            number += 1

    pages = ordered.mapInArrow(run, _PAGE)
    dealt = pages.repartition("folder", F.pmod(F.xxhash64("segment"), F.lit(SPREAD))).sortWithinPartitions("folder", "project_id", "segment")
    dealt.write.option("parquet.block.size", GROUP_BYTES).partitionBy("folder").parquet(folder)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of SEGMENT rows of one project, and what is left of each project."""
    held: pa.Table | None = None
    for batch in batches:
        batch = batch.filter(batch.column("words").is_valid())
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        while held.num_rows:
            same = pc.index(pc.equal(held.column("project_id"), held.column("project_id")[0]), False).as_py()
            size = held.num_rows if same < 0 else same
            if same < 0 and size < SEGMENT:
                break
            yield held.slice(0, min(size, SEGMENT))
            held = held.slice(min(size, SEGMENT))
    if held is not None and held.num_rows:
        yield held


def _pages(part: pa.Table, segment: int) -> pa.RecordBatch:
    """The pages of a segment's words by folder, and its directory row."""
    part = part.sort_by("chunk_id").combine_chunks()
    project, n = part.column("project_id")[0].as_py(), part.num_rows
    texts = pa.concat_arrays(part.column("words").chunks)
    lists = pc.split_pattern(pc.if_else(pc.equal(texts, ""), pa.scalar(None, texts.type), texts), " ")
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    lexemes = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    # Words are numbered by their folders.
    folder = np.fromiter(map(zlib.crc32, lexemes), np.int64, len(lexemes)) % FOLDERS
    ranked = np.argsort(folder, kind="stable")
    number = np.empty(len(lexemes), np.int64)
    number[ranked] = np.arange(len(lexemes))
    place = np.repeat(np.arange(n), lengths)
    position = np.arange(len(place)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # By word, then place, then position: a word's number with the token's.
    order = np.sort((number[coded.indices.to_numpy(zero_copy_only=False)] << 32) | np.arange(len(place)))
    word, order = order >> 32, order & 0xFFFFFFFF
    place, position = place[order], position[order]
    # Where each of a word's chunks begins, and where its postings do.
    opens = np.concatenate([[True], (word[1:] != word[:-1]) | (place[1:] != place[:-1])]) if len(word) else np.zeros(0, bool)
    pair = np.flatnonzero(opens)
    counts = np.diff(np.append(pair, len(word)))
    first = np.searchsorted(word[pair], np.arange(len(lexemes) + 1))
    tokens = np.append(pair, len(word))[first]
    most = np.maximum.reduceat(counts, first[:-1]) if len(lexemes) else counts
    rows = []
    ends = np.searchsorted(folder[ranked], np.arange(FOLDERS + 1))
    for f in range(FOLDERS):
        a, b = ends[f], ends[f + 1]
        if a < b:
            chosen, at, token = slice(a, b), slice(first[a], first[b]), slice(tokens[a], tokens[b])
            text = b" ".join([lexemes[i] for i in ranked[chosen]])
            heads = (_narrow(most[chosen]), _narrow(np.diff(first[a : b + 1])), _narrow(np.diff(tokens[a : b + 1])))
            rows.append((f, text, *heads, _narrow(place[pair[at]]), _narrow(counts[at]), _narrow(position[token])))
    rows.append((-1, *[None] * (1 + len(_HEADS) + len(_NUMBERS))))
    columns = list(zip(*rows, strict=True))
    named = part.select(["chunk_id", "path", "start_line", "end_line"]).to_pylist()
    directory = pa.list_(pa.struct([("chunk_id", pa.string()), ("path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]))
    arrays = [
        pa.array([project] * len(rows), pa.string()),
        pa.array([segment] * len(rows), pa.int64()),
        pa.array(columns[0], pa.int32()),
        pa.array(columns[1], pa.binary()).cast(pa.string()),
        *[pa.array(c, pa.binary()) for c in columns[2:]],
        pa.array([None] * (len(rows) - 1) + [named], directory),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["project_id", "segment", "folder", "words", *_HEADS, *_NUMBERS, "chunks"])


def _narrow(values: np.ndarray) -> bytes:
    """Numbers of one width each, the least that holds them all; their number tells it again."""
    return values.astype(np.min_scalar_type(int(values.max()))).tobytes()


def _wide(values: bytes | pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(values, f"u{len(values) // n}").astype(np.int64)


@dataclass
class Asked:
    """The queries of one project: single words in an index, phrases as numbers of words, and their places among all queries."""

    numbers: np.ndarray
    terms: list[list[list[str]]]
    index: WordIndex = field(init=False)
    phrases: list[tuple[int, list[int]]] = field(init=False)

    def __post_init__(self):
        phrases = [(q, t) for q, own in enumerate(self.terms) for t in own if len(t) > 1]
        self.index = WordIndex([[t[0] for t in own if len(t) == 1] for own in self.terms], [w for _, t in phrases for w in t])
        self.phrases = [(q, [self.index.code[w] for w in t]) for q, t in phrases]

    def bounds(self, word: np.ndarray, most: np.ndarray) -> np.ndarray:
        """What a chunk of the segment may score at most for each query. word: numbers of the segment's asked words."""
        out = self.index.sums(np.zeros(len(word), np.int64), word, np.minimum(most, TERM_CAP), 1)[0]
        if self.phrases:
            of = np.zeros(len(self.index.words), np.int64)
            of[word] = most
            for q, term in self.phrases:
                out[q] += min(TERM_CAP, *of[term])
        return out

    def scores(self, blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], chunks: int) -> np.ndarray:
        """chunks x queries: occurrences of the queries' terms. blocks: word -> places, counts, positions."""
        row = np.concatenate([b[0] for b in blocks.values()])
        word = np.repeat(np.fromiter(blocks, np.int64, len(blocks)), [len(b[0]) for b in blocks.values()])
        total = self.index.sums(row, word, np.minimum(np.concatenate([b[1] for b in blocks.values()]), TERM_CAP), chunks)
        for q, term in self.phrases:
            if all(w in blocks for w in term):
                at = _keys(blocks[term[0]])
                for step, w in enumerate(term[1:], 1):
                    at = at[np.isin(at + step, _keys(blocks[w]))]
                where, n = np.unique(at >> 32, return_counts=True)
                total[where, q] += np.minimum(n, TERM_CAP)
        return total


def _keys(block: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    return (np.repeat(block[0], block[1]) << 32) + block[2]


def _unpacked(places: bytes, counts: bytes, positions: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    count = _wide(counts, len(places))
    return np.frombuffer(places, np.uint8).astype(np.int64), count, _wide(positions, int(count.sum()))


def _pages_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_PAGE).parquet(folder)


def _wanted(asked: DataFrame) -> tuple[list[int], pa.Table | DataFrame]:
    """The folders of the words that `asked` (project_id, lexeme; written) asks for, and the words, in memory if they are few."""
    words = asked.select("project_id", "lexeme").distinct()
    folders = sorted(r[0] for r in words.select((F.crc32(F.col("lexeme").cast("binary")) % FOLDERS).cast("int")).distinct().collect())  # FOLDERS at most
    return folders, words.toArrow() if words.count() <= 100 * BROADCAST_QUERIES else words


def asked_blocks(pages: DataFrame, wanted: tuple[list[int], pa.Table | DataFrame], numbers: tuple[str, ...] = _NUMBERS) -> DataFrame:
    """The blocks of the wanted words. Other folders, and numbers that aren't named, aren't read."""
    folders, words = wanted
    own = pages.filter(F.col("folder").isin(folders))
    return _blocks(own, numbers, words) if isinstance(words, pa.Table) else _blocks(own, numbers).join(words, ["project_id", "lexeme"], "left_semi")


def _directory(pages: DataFrame) -> DataFrame:
    return pages.filter("folder = -1").select("project_id", "segment", "chunks")


def _blocks(pages: DataFrame, numbers: tuple[str, ...], words: pa.Table | None = None) -> DataFrame:
    """The blocks of pages, one row each: all, or those of `words` (project, lexeme). most, and those of the numbers that are named."""
    heads = [c for c, needed in zip(_HEADS, (True, bool(numbers), "positions" in numbers), strict=True) if needed]
    shared = pages.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, set[str]] = {}
        if shared.value is not None:
            for project, lexeme in zip(*(c.to_pylist() for c in shared.value.columns), strict=True):
                own.setdefault(project, set()).add(lexeme)
            any_project = shared.value.column("lexeme").combine_chunks().unique()
        for batch in batches:
            found: dict[str, list] = {c: [] for c in ("project_id", "segment", "lexeme", "most", *numbers)}
            lists = pc.split_pattern(batch.column("words"), " ")
            flat, begin = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            hits = np.arange(len(flat)) if shared.value is None else np.flatnonzero(pc.is_in(flat, value_set=any_project).to_numpy(zero_copy_only=False))
            lexemes, bounds = flat.take(pa.array(hits)).to_pylist(), np.searchsorted(hits, begin)
            for i in np.flatnonzero(np.diff(bounds)).tolist():
                project, segment = batch.column("project_id")[i].as_py(), batch.column("segment")[i].as_py()
                asked = own.get(project, ()) if shared.value is not None else None
                chosen = {int(hits[j] - begin[i]): lexemes[j] for j in range(bounds[i], bounds[i + 1]) if asked is None or lexemes[j] in asked}
                if not chosen:
                    continue
                at = {c: _wide(batch.column(c)[i].as_buffer(), int(begin[i + 1] - begin[i])) for c in heads}
                found["project_id"] += [project] * len(chosen)
                found["segment"] += [segment] * len(chosen)
                found["lexeme"] += chosen.values()
                found["most"] += at["most"][list(chosen)].tolist()
                for c in numbers:
                    values = memoryview(batch.column(c)[i].as_buffer())
                    end = np.cumsum(at["positions_of" if c == "positions" else "chunks_of"])
                    cut = (np.concatenate([[0], end]) * (len(values) // int(end[-1]))).tolist()
                    found[c] += [bytes(values[cut[j] : cut[j + 1]]) for j in chosen]
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[c]) for c, v in found.items()], list(found))

    kinds = {"project_id": pa.string(), "segment": pa.int64(), "lexeme": pa.string(), "most": pa.int32()} | dict.fromkeys(_NUMBERS, pa.binary())
    schema = ", ".join(c for c in _BLOCK.split(", ") if c.split()[0] not in _NUMBERS or c.split()[0] in numbers)
    return pages.select("project_id", "segment", "words", *heads, *numbers).mapInArrow(run, schema)


def _by_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[dict]]]:
    """(project, segment, rows) of rows in that order."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = row["project_id"], row["segment"]
            if own != key and rows:
                yield *key, rows
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield *key, rows


def _together(blocks: DataFrame, directory: DataFrame | None = None) -> DataFrame:
    blocks = blocks if directory is None else blocks.unionByName(directory, allowMissingColumns=True)
    return blocks.repartition("project_id", "segment").sortWithinPartitions("project_id", "segment")


def indexed_search(spark: SparkSession, folder: str, queries: DataFrame, k: int = TEXT_K) -> DataFrame:
    """query_id, chunk_id, score, rank: as fulltext_search over the indexed chunks. queries: query_id, project_id, text.

    BROADCAST_QUERIES queries are asked at a time.
    """
    terms = stored(query_terms(queries.filter("text IS NOT NULL").withColumn("project_id", F.col("project_id").cast("string"))).filter(F.size("asked") > 0))
    blocks = max(1, -(-terms.count() // BROADCAST_QUERIES))
    out = None
    for block in range(blocks):
        own = terms.filter(F.pmod(F.xxhash64("query_id", "project_id"), F.lit(blocks)) == block)
        found = _search(spark, folder, own, k)
        out = found if out is None else out.unionByName(found)
    return out


def _search(spark: SparkSession, folder: str, terms: DataFrame, k: int) -> DataFrame:
    table = terms.toArrow().sort_by([("project_id", "ascending"), ("query_id", "ascending")])  # BROADCAST_QUERIES or so
    wanted = _wanted(terms.select("project_id", F.explode(F.flatten("asked")).alias("lexeme")))
    pages = _pages_of(spark, folder)
    longest = F.col("segment").bitwiseAND(0xFFFFFFFF) == 0
    first = stored(_scored(_together(asked_blocks(pages.filter(longest), wanted), _directory(pages).filter(longest)), terms, table, None, k))
    # The k-th score of a query so far, in occurrences; what can't reach it isn't looked at.
    floors = first.groupBy("query_id", "project_id").agg(F.sort_array(F.collect_list("score"), False).alias("s"))  # k a task
    floors = floors.select("query_id", "project_id", F.get("s", F.lit(k - 1)).alias("floor")).filter("floor IS NOT NULL").toArrow()
    least = np.zeros(table.num_rows)
    place = {key: i for i, key in enumerate(zip(table.column("query_id").to_pylist(), table.column("project_id").to_pylist(), strict=True))}
    for q, p, floor in zip(*(floors.column(c).to_pylist() for c in ("query_id", "project_id", "floor")), strict=True):
        least[place[q, p]] = floor
    others = pages.filter(~longest)
    live = stored(_live(_together(asked_blocks(others, wanted, ())), table, least))
    few = live.count() <= 100 * BROADCAST_QUERIES
    alive = lambda rows: rows.join(F.broadcast(live) if few else live, ["project_id", "segment"], "left_semi")
    # Pages are dropped before they are taken apart, but never shuffled.
    blocks = asked_blocks(alive(others), wanted) if few else alive(asked_blocks(others, wanted))
    rest = _scored(_together(blocks, alive(_directory(others))), terms, table, least, k)
    found = first.unionByName(rest).drop("project_id")
    return top_k(found.withColumn("score", F.round(TERM_WEIGHT * F.col("score").cast("long"), 6)), k)


def _projects(table: pa.Table) -> dict[str, Asked]:
    places: dict[str, list[int]] = {}
    for number, project in enumerate(table.column("project_id").to_pylist()):
        places.setdefault(project, []).append(number)
    asked = table.column("asked").to_pylist()
    return {p: Asked(np.array(own), [asked[i] for i in own]) for p, own in places.items()}


def _live(headers: DataFrame, table: pa.Table, least: np.ndarray) -> DataFrame:
    """project_id, segment: those in which some query's bound reaches its floor. headers: project_id, segment, lexeme, most."""
    shared = headers.sparkSession.sparkContext.broadcast((table, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, floors = _projects(shared.value[0]), shared.value[1]
        found = []
        for project, segment, rows in _by_segment(batches):
            asked = own.get(project)
            if asked is not None:
                bound = asked.bounds(np.array([asked.index.code[r["lexeme"]] for r in rows]), np.array([r["most"] for r in rows]))
                if ((bound >= floors[asked.numbers]) & (bound > 0)).any():
                    found.append((project, segment))
        columns = list(zip(*found, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], ["project_id", "segment"])

    return headers.mapInArrow(run, "project_id string, segment long")


def _scored(blocks: DataFrame, terms: DataFrame, table: pa.Table, least: np.ndarray | None, k: int) -> DataFrame:
    """query_id, project_id, chunk_id, score (occurrences): each task's k best of each query, at its floor or above."""
    shared = blocks.sparkSession.sparkContext.broadcast((table, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, least = shared.value
        own, best = _projects(table), Best(table.num_rows, k, pa.string())
        if least is not None:
            best.floor = least.astype(np.float64)
        for project, _, rows in _by_segment(batches):
            asked = own.get(project)
            ids = next((r["chunks"] for r in rows if r["lexeme"] is None), None)
            words = {asked.index.code[r["lexeme"]]: _unpacked(r["places"], r["counts"], r["positions"]) for r in rows if r["lexeme"] is not None} if asked is not None else {}
            if ids and words:
                scores = asked.scores(words, len(ids))
                best.add(scores.astype(np.float64), scores > 0, asked.numbers, pa.array([c["chunk_id"] for c in ids], pa.string()))
        found = best.cut()
        at = found.column("q").combine_chunks()
        yield from pa.table({"query_id": table.column("query_id").combine_chunks().take(at), "project_id": table.column("project_id").combine_chunks().take(at), "chunk_id": found.column("id"), "score": found.column("score")}).combine_chunks().to_batches()

    kind = terms.schema["query_id"].dataType.simpleString()
    return blocks.mapInArrow(run, f"query_id {kind}, project_id string, chunk_id string, score double")


def indexed_references(spark: SparkSession, folder: str, symbols: DataFrame, cap: int = REFERENCE_CAP) -> DataFrame:
    """query_id, chunk_id, path, start_line, end_line, rank: as find_references over the indexed chunks. symbols: query_id, project_id, symbol."""
    wanted = stored(symbols.select("query_id", F.col("project_id").cast("string").alias("project_id"), F.array_distinct(T.lexemes(F.col("symbol"))).alias("all")).filter(F.size("all") > 0))
    lexemes = wanted.select("query_id", "project_id", F.size("all").alias("n"), F.explode("all").alias("lexeme"))
    pages = _pages_of(spark, folder)
    blocks = asked_blocks(pages, _wanted(lexemes), ("places",))
    asked = F.broadcast(lexemes) if lexemes.count() <= 10 * BROADCAST_QUERIES else lexemes
    met = blocks.join(asked, ["project_id", "lexeme"])
    # Segments that lack one of a symbol's words go before any place is looked at.
    whole = met.groupBy("query_id", "project_id", "segment", "n").agg(F.collect_list("places").alias("all")).filter(F.size("all") == F.col("n"))
    # Places are bytes: each is the digits of one in hexadecimal.
    digits = lambda b: F.transform(F.sequence(F.lit(1), 2 * F.octet_length(b) - 1, F.lit(2)), lambda i: F.substr(F.hex(b), i, F.lit(2)))
    common = F.aggregate(F.transform("all", digits), F.lit(None).cast("array<string>"), lambda a, p: F.when(a.isNull(), p).otherwise(F.array_intersect(a, p)))
    placed = whole.select("query_id", "project_id", "segment", F.explode(common).alias("digits"))
    placed = placed.select("query_id", "project_id", "segment", F.conv("digits", 16, 10).cast("int").alias("place"))
    directory = _directory(pages).select("project_id", "segment", F.posexplode("chunks").alias("place", "c"))
    rows = placed.join(directory, ["project_id", "segment", "place"]).select("query_id", "c.*")
    order = Window.partitionBy("query_id").orderBy("path", "start_line", "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def read_bytes(spark: SparkSession, folder: str, queries: DataFrame) -> DataFrame:
    """query_id, blocks, bytes, all_bytes: the blocks that hold a query's words and their bytes, beside those of the whole index."""
    terms = query_terms(queries.withColumn("project_id", F.col("project_id").cast("string")))
    lexemes = stored(terms.select("query_id", "project_id", F.explode(F.array_distinct(F.flatten("asked"))).alias("lexeme")))
    pages = _pages_of(spark, folder)
    size = sum((F.octet_length(c) for c in _NUMBERS), F.lit(0))
    whole = pages.agg(F.sum(size).alias("all_bytes"))
    own = asked_blocks(pages, _wanted(lexemes)).groupBy("project_id", "lexeme").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("blocks"))
    return own.join(lexemes, ["project_id", "lexeme"]).groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum("bytes").alias("bytes")).join(F.broadcast(whole))
