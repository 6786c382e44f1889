"""Queries on retrieval, conversations and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers as N
from ..functions import paths as P
from ..operators import analytics as A
from ..operators import conversations as C
from ..operators import evaluation as E
from ..operators import indexing as I
from ..operators import retrieval as R
from ..operators.postings import build_postings, indexed_references
from ..operators.quantized import exact_top, quantized_candidates, quantized_search as by_codes
from ..operators.storage import shared_root, stored
from .derive import FILES, LEXEMES, MESSAGES, SEARCH_TEXT, files, messages, table, whole_chunks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def passages(spark: SparkSession, sf_dir: str, project: str = "all") -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(project).alias("project_id"), "text")


_TEXT_HITS = f"""{FILES},
words AS (SELECT path AS chunk_id, unnest({LEXEMES.format(f"({SEARCH_TEXT.format('text')})")}) AS lexeme FROM files),
postings AS (SELECT chunk_id, lexeme, count(*) AS n FROM words GROUP BY ALL),
terms AS (SELECT DISTINCT item_id AS query_id, unnest({LEXEMES.format("text")}) AS lexeme FROM benchmark),
fts AS (SELECT query_id, chunk_id, round(CAST(0.1 AS DOUBLE) * sum(least(n, 256)), 6) AS score FROM postings JOIN terms USING (lexeme) WHERE lexeme <> 'or' GROUP BY ALL)"""


@query(f"WITH {_TEXT_HITS} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fts QUALIFY rank <= 20")
def fulltext_search(spark, sf_dir):
    return R.fulltext_search(whole_chunks(spark, sf_dir, "all"), passages(spark, sf_dir))


@query()
def flagship_passage_search(spark, sf_dir):
    """Documents cut into chunks of lines; the ten best chunks for each of the benchmark's passages by full-text search."""
    f = files(spark, sf_dir).withColumn("project_id", F.lit("all"))
    chunks = stored(I.build_chunks(f).select("chunk_id", "project_id", "path", "search_text"))
    found = R.fulltext_search(chunks, passages(spark, sf_dir), 10).join(chunks.select("chunk_id", "path"), "chunk_id")
    return found.select("query_id", "rank", "score", "path")


@query(SQL["fulltext_search"])
def fulltext_search_indexed(spark, sf_dir):
    """As fulltext_search, through postings that are built first."""
    chunks = whole_chunks(spark, sf_dir, "all")
    return R.fulltext_search(chunks, passages(spark, sf_dir), index=_index(chunks))


def _index(chunks):
    """A new folder with the postings of the chunks."""
    folder = f"{shared_root(chunks.sparkSession)}/postings-{uuid.uuid4().hex}"
    build_postings(chunks, folder)
    return folder


@query("""WITH q AS (SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, e.vec_id AS chunk_id, round(list_inner_product(q.v, e.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 6) AS score FROM q JOIN embeddings e USING (label))
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 20""")
def vector_search_20(spark, sf_dir):
    """Nearest rows of the same label, for every row whose id is divisible by 20."""
    return _nearest(spark, sf_dir, 20)


def _nearest(spark, sf_dir, step):
    rows = table(spark, sf_dir, "embeddings")
    chunks = rows.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("project_id"), "embedding")
    asked = rows.filter(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("project_id"), F.col("embedding").alias("vector"))
    return R.vector_search(chunks, asked)


@query()
def ann_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return R.ann_search(rows, rows.filter("vec_id % 20 = 0"), "vec_id", "embedding", 64)


@query()
def quantized_search(spark, sf_dir):
    """Ten nearest rows by cosine for every row whose id is divisible by 20, through inverted lists of codes."""
    rows = table(spark, sf_dir, "embeddings")
    return by_codes(rows, rows.filter("vec_id % 20 = 0"), "vec_id", "embedding", 64)


@query()
def quantized_recall(spark, sf_dir):
    """What quantized_search finds of the true ten, all rows scored, and how many vectors a query has scored exactly at most."""
    rows = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    candidates, classes, asked = quantized_candidates(rows, rows.filter("vec_id % 20 = 0"), "vec_id", "v", 64)
    found = exact_top(candidates, classes, asked, 64, 10)
    chunks = classes.select(F.lit("all").alias("project_id"), F.explode("ids").alias("chunk_id"), F.col("v").alias("embedding"))
    near = R.vector_search(chunks, asked.select(F.col("id").alias("query_id"), F.lit("all").alias("project_id"), F.col("v").alias("vector")), 11)
    true = R.top_k(near.filter("chunk_id <> query_id").drop("rank"), 10)
    met = true.join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    recall = met.agg(F.countDistinct("query_id").alias("queries"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))
    scored = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most_scored"))
    return recall.crossJoin(scored)  # one row each


@query()
def trigram_search(spark, sf_dir):
    """Questions that name an identifier with a letter missing; chunks that hold it."""
    from ..functions.text import search_text

    def name(n):
        return F.translate(F.substring(F.md5(n.cast("string")), 1, 10), "0123456789", "ghijklmnop")

    chunks = whole_chunks(spark, sf_dir, "all")
    content = F.concat("content", F.lit(" find"), F.initcap(name(F.regexp_extract("path", r"(\d+)\.txt", 1).cast("long") % 500)))
    chunks = chunks.withColumn("content", content).withColumn("search_text", search_text(F.col("content")))
    asked = table(spark, sf_dir, "benchmark").withColumn("n", name(F.col("item_id")))
    text = F.concat(F.lit("where is find"), F.initcap(F.concat(F.substring("n", 1, 5), F.substring("n", 7, 9))), F.lit(" called"))
    return R.trigram_search(chunks, asked.select(F.col("item_id").alias("query_id"), F.lit("all").alias("project_id"), text.alias("text")))


def _identified(spark, sf_dir):
    from ..functions.text import search_text

    chunks = whole_chunks(spark, sf_dir, "all")
    n = F.regexp_extract("path", r"(\d+)\.txt", 1).cast("long") % 100
    content = F.concat("content", F.lit(" validateUser"), n.cast("string"))
    return chunks.withColumn("content", content).withColumn("search_text", search_text(F.col("content")))


@query(f"""WITH {FILES}, c AS (SELECT path, path AS chunk_id, doc_id % 100 AS n FROM files)
SELECT item_id AS query_id, chunk_id, path, 1 AS start_line, row_number() OVER (PARTITION BY item_id ORDER BY path) AS rank FROM c JOIN benchmark b ON b.item_id % 100 = n QUALIFY rank <= 100""")
def find_references(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("all").alias("project_id"), F.concat(F.lit("validateUser"), (F.col("item_id") % 100).cast("string")).alias("symbol"))
    return R.find_references(_identified(spark, sf_dir), asked).drop("end_line")


@query(SQL["find_references"])
def find_references_indexed(spark, sf_dir):
    """As find_references, through postings that are built first."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("all").alias("project_id"), F.concat(F.lit("validateUser"), (F.col("item_id") % 100).cast("string")).alias("symbol"))
    return indexed_references(spark, _index(_identified(spark, sf_dir)), asked).drop("end_line")


def _pieces(spark, sf_dir, project=None):
    """All files in chunks that a model's input holds whole; stored, as every arm reads them."""
    f = files(spark, sf_dir)
    return stored(I.fitting_chunks(I.build_chunks(f.withColumn("project_id", F.lit(project)) if project else f)))


def _embedded(spark, chunks):
    """The chunks with vectors, with a cache that holds none."""
    cache = spark.createDataFrame([], "model_id string, text_hash string, embedding array<float>")
    return I.embed_pending(chunks.withColumn("embedding", F.lit(None).cast("array<float>")), cache, "hash-64", 64)[0]


@query()
def hybrid_search_all_arms(spark, sf_dir):
    """The full-text, vector and trigram arms over all files, fused."""
    chunks = _pieces(spark, sf_dir, "all")
    return R.hybrid_search(chunks, stored(I.embed_queries(passages(spark, sf_dir), 64)), embedded=_embedded(spark, chunks)).drop("end_line")


@query()
def multi_project_search(spark, sf_dir):
    """All three arms; every source is in every question's scope."""
    chunks = _pieces(spark, sf_dir)
    asked = stored(I.embed_queries(passages(spark, sf_dir), 64))
    scopes = asked.select("query_id").crossJoin(chunks.select("project_id").distinct())
    return R.multi_project_search(chunks, asked, scopes, embedded=_embedded(spark, chunks))


WINDOW = 8
_HOLDERS = rf"""windows AS (SELECT 'd' AS kind, lang || '/' || doc_id || '.txt' AS id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), regexp_extract_all(text, '[^\x20\x09-\x0D]+') FROM benchmark),
runs AS (SELECT kind, id, unnest(list_transform(range(1, greatest(1, len(w) - {WINDOW - 2})), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS run FROM windows),
holders AS (SELECT DISTINCT CAST(b.id AS BIGINT) AS query_id, d.id AS path FROM runs d JOIN runs b USING (run) WHERE d.kind = 'd' AND b.kind = 'b')"""


def _holders(spark, sf_dir):
    """query_id, path: the files that hold eight words running of a benchmark passage; what a search for it should find."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    starts = F.when(F.size("w") >= WINDOW, F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)))
    run = F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(WINDOW)), " "))).alias("run")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("w")).select("query_id", run)
    asked = F.broadcast(asked) if asked.count() <= MOST_RUNS else asked
    held = files(spark, sf_dir).select("path", words.alias("w")).select("path", run)
    return held.join(asked, "run").select("query_id", "path").distinct()


#: Passages' word runs are broadcast up to so many (some 60 bytes each); beyond, Spark shuffles them.
MOST_RUNS = 1_000_000


@query(f"""WITH {_TEXT_HITS}, {_HOLDERS},
ranked AS (SELECT query_id, chunk_id AS path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fts QUALIFY rank <= 50),
hits AS (SELECT query_id, count(*) FILTER (rank <= 5) AS in5, count(*) FILTER (rank <= 10) AS in10, min(rank) AS first FROM ranked JOIN holders USING (query_id, path) GROUP BY 1),
counts AS (SELECT query_id, count(*) AS wanted FROM holders GROUP BY 1)
SELECT 'fts' AS mode, count(*) AS questions, round(avg(coalesce(in5, 0) / wanted), 6) AS recall_5, round(avg(coalesce(in10, 0) / wanted), 6) AS recall_10, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr
FROM counts LEFT JOIN hits USING (query_id)""")
def fulltext_quality(spark, sf_dir):
    """Recall and reciprocal rank of full-text search for the passages that some file holds."""
    chunks, holders = whole_chunks(spark, sf_dir, "all"), stored(_holders(spark, sf_dir))
    found = R.fulltext_search(chunks, passages(spark, sf_dir), R.POOLS["fts"])
    return _quality({"fts": found.withColumnRenamed("chunk_id", "path")}, holders)


@query()
def retrieval_quality(spark, sf_dir):
    """Recall and reciprocal rank of each of the three arms over chunks, and of their fusion; a file's place is its best chunk's."""
    chunks, holders = _pieces(spark, sf_dir, "all"), stored(_holders(spark, sf_dir))
    asked = stored(I.embed_queries(passages(spark, sf_dir), 64))
    arms = {name: stored(found) for name, found in R.search_arms(chunks, asked, embedded=_embedded(spark, chunks)).items()}
    paths = chunks.select("chunk_id", "path")
    ranked = {name: found.join(paths, "chunk_id").drop("chunk_id") for name, found in arms.items()}
    return _quality(ranked | {"hybrid": R.fuse_arms(chunks, arms)}, holders)


def _quality(lists, holders):
    """lists: for each mode query_id, path, rank of its rows."""
    retrieved = None
    for mode, found in lists.items():
        first = found.groupBy("query_id", "path").agg(F.min("rank").alias("at"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
        rows = first.select("query_id", F.lit(mode).alias("mode"), place.alias("rank"), "path")
        retrieved = rows if retrieved is None else retrieved.unionByName(rows)
    return E.retrieval_scorecard(E.evaluate_rows(retrieved, holders, holders.select("query_id").distinct()))


# Three arms out of the events: their places by value, id and time, per user.
_ARMS = """arms AS (
 SELECT user_id AS query_id, 0 AS arm_no, CAST(1.0 AS DOUBLE) AS weight, event_type AS path, event_id AS chunk_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events
 UNION ALL SELECT user_id, 1, CAST(1.0 AS DOUBLE), event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) FROM events
 UNION ALL SELECT user_id, 2, CAST(0.5 AS DOUBLE), event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) FROM events),
canon AS (SELECT query_id, path, arg_min(chunk_id, arm_no * 1000000 + rank) AS canonical_id FROM arms GROUP BY ALL),
best AS (SELECT a.query_id, arm_no, weight, canonical_id AS chunk_id, min(rank) AS old FROM arms a JOIN canon c ON a.query_id = c.query_id AND a.path = c.path GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id, arm_no ORDER BY old) AS rank FROM best)"""


def _arms(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("path"), F.col("event_id").alias("chunk_id"), "value")
    out = None
    for no, weight, order in ((0, 1.0, (F.desc("value"), F.asc("chunk_id"))), (1, 1.0, (F.desc("chunk_id"),)), (2, 0.5, (F.asc("chunk_id"),))):
        arm = e.select("query_id", F.lit(no).alias("arm_no"), F.lit(weight).alias("weight"), "path", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("rank"))
        out = arm if out is None else out.unionByName(arm)
    return out


@query(f"WITH {_ARMS} SELECT query_id, arm_no, chunk_id, rank FROM numbered")
def dedupe_by_file(spark, sf_dir):
    return R.dedupe_by_file(_arms(spark, sf_dir)).drop("weight")


@query(f"""WITH {_ARMS}, f AS (SELECT query_id, chunk_id, sum(weight / (60 + rank) ORDER BY arm_no) AS raw, arg_min(rank, arm_no) AS r, min(arm_no) AS a FROM numbered GROUP BY ALL)
SELECT query_id, chunk_id, round(raw, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, a, r, chunk_id) AS rank FROM f""")
def rank_fusion(spark, sf_dir):
    return R.fuse(R.dedupe_by_file(_arms(spark, sf_dir)))


@query("SELECT c_custkey AS project_id, c_mktsegment <> 'BUILDING' AND c_nationkey = 3 AS searchable, CASE WHEN c_mktsegment = 'BUILDING' THEN 'not_ready' WHEN c_nationkey <> 3 THEN 'other_model' END AS reason FROM customer")
def searchable_projects(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.when(F.col("c_mktsegment") == "BUILDING", "indexing").otherwise("ready").alias("status"), F.col("c_nationkey").cast("string").alias("embedding_model"))
    return R.searchable_projects(c, "3")


_EXCHANGES = f"""{MESSAGES}, turned AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY pos, message_id) - 1 AS turn FROM messages),
ex AS (SELECT a.conversation_id, a.message_id AS user_id, b.message_id AS assistant_id, a.content AS question, b.content AS answer, row_number() OVER (PARTITION BY a.conversation_id ORDER BY a.turn) AS n
  FROM turned a JOIN turned b ON a.conversation_id = b.conversation_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0 AND a.role = 'user' AND b.role = 'assistant')"""


@query(f"WITH {_EXCHANGES} SELECT * FROM ex")
def exchanges(spark, sf_dir):
    return C.exchanges(messages(spark, sf_dir))


@query(f"WITH {_EXCHANGES} SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY n DESC) <= 3")
def recent_window(spark, sf_dir):
    return C.recent_window(C.exchanges(messages(spark, sf_dir)))


@query(f"""WITH {_EXCHANGES}, older AS (SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY n DESC) > 1),
marks AS (SELECT conversation_id, assistant_id FROM ex WHERE n = 1 AND conversation_id % 2 = 0),
m AS (SELECT conversation_id, min(n) AS through FROM older SEMI JOIN marks USING (conversation_id, assistant_id) GROUP BY 1)
SELECT older.* FROM older LEFT JOIN m USING (conversation_id) WHERE through IS NULL OR n > through""")
def evicted_exchanges(spark, sf_dir):
    pairs = C.exchanges(messages(spark, sf_dir))
    return C.evicted_exchanges(pairs, pairs.filter("n = 1 AND conversation_id % 2 = 0").select("conversation_id", "assistant_id"), 1)


@query(f"""WITH {_EXCHANGES}, c AS (SELECT conversation_id, count(*) AS m FROM ex GROUP BY 1)
SELECT conversation_id, CASE WHEN conversation_id % 2 = 0 THEN m - 1 - least(1, greatest(m - 1, 0)) > 0 ELSE m > 2 END AS due FROM c""")
def summary_due(spark, sf_dir):
    pairs = C.exchanges(messages(spark, sf_dir))
    return C.summary_due(pairs, pairs.filter("n = 1 AND conversation_id % 2 = 0").select("conversation_id", "assistant_id"), 1, 2)


@query(f"WITH {MESSAGES} SELECT conversation_id, message_id FROM messages WHERE conversation_id % 3 <> 0 OR pos > 1")
def messages_after(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("created_at", F.col("pos"))
    marks = m.filter("conversation_id % 3 = 0 AND pos = 1").select("conversation_id", "message_id")
    return C.messages_after(m, marks).select("conversation_id", "message_id")


# Evidence of an answer: three pieces, of which the markers [1], [2] and [3] are; [0] and those in fences aren't.
@query(f"""WITH {MESSAGES}, a AS (SELECT message_id, pos % 4 AS x, pos % 3 + 1 AS y FROM messages), l AS (SELECT message_id, list_filter(CASE WHEN x = y AND y = 2 THEN [2] WHEN x = y THEN [y, 2] WHEN x = 2 OR y = 2 THEN [x, y] ELSE [x, y, 2] END, lambda n: n BETWEEN 1 AND 3) AS l FROM a)
SELECT message_id AS answer_id, CAST(unnest(l) AS INTEGER) AS marker, CAST(unnest(range(len(l))) AS INTEGER) AS place FROM l""")
def resolve_citations(spark, sf_dir):
    return C.resolve_citations(_answers(spark, sf_dir), _evidence(spark, sf_dir)).select("answer_id", F.col("marker").cast("int"), "place")


def _answers(spark, sf_dir):
    return messages(spark, sf_dir).select(F.col("message_id").alias("answer_id"), F.col("content").alias("text"))


def _evidence(spark, sf_dir):
    e = messages(spark, sf_dir).select(F.col("message_id").alias("trajectory_id"), F.explode(F.array(*map(F.lit, (7, 8, 9)))).alias("pos")).withColumn("step", F.lit(0))
    return C.evidence_markers(e).select(F.col("trajectory_id").alias("answer_id"), "marker", F.concat(F.lit("f"), F.col("pos").cast("string")).alias("path"), F.lit(1).alias("start_line"), F.lit(5).alias("end_line"))


@query(f"WITH {MESSAGES} SELECT message_id AS answer_id, CAST(m AS INTEGER) AS marker, 'f' || (6 + m) AS path, m = pos % 4 OR m = pos % 3 + 1 OR m = 2 AS used FROM messages, unnest([1, 2, 3]) u(m)")
def answer_citations(spark, sf_dir):
    return C.answer_citations(_answers(spark, sf_dir), _evidence(spark, sf_dir)).select("answer_id", "marker", "path", "used")


@query()
def render_markers(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", N.render_markers(F.col("content"), F.create_map(F.lit(1), F.lit("http://a/1"))).alias("md"))


@query(f"WITH {MESSAGES} SELECT message_id, CASE WHEN length(content) > 100 THEN regexp_replace(substr(content, 1, 100), '\\[[0-9]*$', '') || '…' ELSE content END AS answer FROM messages")
def truncate_answer(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", N.truncate_answer(F.col("content"), 100).alias("answer"))


@query(f"WITH {MESSAGES} SELECT message_id, CASE WHEN regexp_matches(lower(content), 'what.*\\bbreaks?\\b|\\btrace\\b|\\beverywhere\\b|all the places|why does|how does.*\\bflow\\b|\\bunused\\b|dead code|\\bimpact\\b') THEN 'thorough' ELSE 'fast' END AS mode FROM messages")
def classify_mode(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", P.classify_mode(F.col("content")).alias("mode"))


@query("""SELECT conv_id AS conversation_id, 'conversation-' || conv_id || '.md' AS file_name, '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg('## ' || upper(substr(role, 1, 1)) || substr(role, 2) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS document FROM conversations GROUP BY conv_id""")
def export_conversations(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("pos"), F.col("turn").cast("string").alias("message_id"), "role", F.col("text").alias("content"))
    c = m.select("conversation_id").distinct().withColumn("title", F.format_string("Conversation %d", "conversation_id"))
    return C.export_conversations(c, m)


_BY_VALUE = "row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)"


@query(f"""WITH r AS (SELECT user_id AS query_id, event_type AS path, {_BY_VALUE} AS rank FROM events),
l AS (SELECT query_id, list(path ORDER BY rank) AS items FROM r GROUP BY 1),
q AS (SELECT DISTINCT user_id AS query_id, CASE WHEN user_id % 5 = 0 THEN [] WHEN user_id % 2 = 0 THEN ['purchase'] ELSE ['purchase', 'click', 'none'] END AS expected FROM events),
e AS (SELECT *, CASE WHEN len(expected) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(items[1:5]), expected)) / len(expected) END AS r5, CASE WHEN len(expected) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(items[1:10]), expected)) / len(expected) END AS r10,
 coalesce(1.0 / list_min(list_filter(list_transform(items, lambda x, i: CASE WHEN list_contains(expected, x) THEN i END), lambda x: x IS NOT NULL)), 0) AS rr FROM l JOIN q USING (query_id))
SELECT 'value' AS mode, count(*) AS questions, round(avg(r5), 6) AS recall_5, round(avg(r10), 6) AS recall_10, round(avg(rr), 6) AS mrr FROM e""")
def retrieval_scorecard(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    got = e.select(F.col("user_id").alias("query_id"), F.lit("value").alias("mode"), F.row_number().over(order).alias("rank"), F.col("event_type").alias("path"))
    want = F.when(F.col("query_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("query_id") % 2 == 0, F.array(F.lit("purchase"))).otherwise(F.array(F.lit("purchase"), F.lit("click"), F.lit("none")))
    return E.retrieval_scorecard(E.evaluate_retrieval(got, got.select("query_id").distinct().withColumn("expected", want)))


@query("SELECT event_type AS label, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_summary(spark, sf_dir):
    return E.latency_summary(table(spark, sf_dir, "events").filter("value IS NOT NULL").select(F.col("event_type").alias("label"), F.col("value").alias("ms")))


@query("SELECT count(*) AS parsed, CAST(0 AS BIGINT) AS failed, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM labels")
def verdict_rates(spark, sf_dir):
    return E.verdict_rates(table(spark, sf_dir, "labels").select(F.struct("quality", "toxic").alias("verdict")), ("quality", "toxic"))


@query("""WITH v AS (SELECT doc_id, quality = 1 AS g, toxic = 1 AS c, doc_id % 6 AS shape FROM labels)
SELECT count(*) FILTER (shape NOT IN (3, 5)) AS parsed, count(*) FILTER (shape IN (3, 5)) AS failed, round(avg(CASE WHEN shape NOT IN (3, 5) THEN g::INT END), 6) AS grounded, round(avg(CASE WHEN shape NOT IN (3, 5) THEN c::INT END), 6) AS "allClaimsCited" FROM v""")
def parse_verdicts(spark, sf_dir):
    """Verdicts plain, in code fences, with a missing field and with a flag as text."""
    g, c, shape = F.col("quality") == 1, F.col("toxic") == 1, F.col("doc_id") % 6
    text = F.format_string('{"grounded": %s, "allClaimsCited": %s, "handledUnknownCorrectly": true, "reasoning": "r"}', g.cast("string"), c.cast("string"))
    raw = F.when(shape == 1, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(shape == 3, F.regexp_replace(text, '"reasoning": "r"', '"x": 1')).when(shape == 5, F.regexp_replace(text, "Correctly\": true", 'Correctly": "true"')).otherwise(text)
    rows = table(spark, sf_dir, "labels").select(N.parse_verdict(raw).alias("verdict"))
    return E.verdict_rates(rows, ("grounded", "allClaimsCited"))


@query(f"""WITH a AS (SELECT user_id AS query_id, list(event_id ORDER BY value DESC, event_id) AS a FROM events GROUP BY 1), b AS (SELECT user_id AS query_id, list(event_id ORDER BY value DESC, event_id DESC) FILTER (event_id % 9 <> 0) AS b FROM events GROUP BY 1)
SELECT count(*) AS questions, round(avg(len(list_intersect(a[1:5], coalesce(b[1:5], []))) / least(5, len(a))), 6) AS recall_5, round(avg(len(list_intersect(a[1:10], coalesce(b[1:10], []))) / least(10, len(a))), 6) AS recall_10, count(*) FILTER (a[1] IS NOT DISTINCT FROM b[1]) AS same_first FROM a LEFT JOIN b USING (query_id)""")
def topk_agreement(spark, sf_dir):
    e = table(spark, sf_dir, "events")

    def snapshot(rows, *order):
        rank = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
        lists = rows.select(F.col("user_id").alias("query_id"), rank.alias("rank"), F.col("event_id").cast("string").alias("key"))
        return lists.filter(F.col("rank") <= E.SNAPSHOT_RANKS).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("keys"))

    return E.topk_agreement(snapshot(e, F.desc("value"), F.asc("event_id")), snapshot(e.filter("event_id % 9 <> 0"), F.desc("value"), F.desc("event_id")))


@query("SELECT CASE WHEN o_custkey % 2 = 0 THEN 'groq' ELSE 'gemini' END AS provider, CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority END AS model, date_trunc('day', o_orderdate)::DATE AS day, count(*) AS answers, CAST(sum(o_orderkey) AS BIGINT) AS input_tokens, CAST(sum(o_custkey) AS BIGINT) AS output_tokens FROM orders GROUP BY ALL")
def usage_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    model = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("groq:"), "o_orderpriority")).otherwise("gemini")
    rows = o.select(model.alias("model_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderkey").alias("input_tokens"), F.col("o_custkey").alias("output_tokens"))
    return A.usage_rollup(rows).withColumn("day", F.to_date("day"))


@query("SELECT o_custkey AS conversation_id, list_sort(list(DISTINCT o_orderpriority)) AS project_ids, count(DISTINCT o_orderpriority) >= 2 AS multi FROM orders GROUP BY 1")
def conversation_projects(spark, sf_dir):
    return C.conversation_projects(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("conversation_id"), F.col("o_orderpriority").alias("project_id")))


@query("SELECT o.o_orderkey AS message_id, count(l.l_linenumber) AS n, coalesce(string_agg(CAST(l.l_linenumber AS VARCHAR), ',' ORDER BY l.l_linenumber), '') AS markers FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1")
def messages_with_citations(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    got = C.messages_with_citations(o.select(F.col("o_orderkey").alias("message_id")), l.select(F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").alias("marker"), F.col("l_partkey").alias("chunk_id")))
    return got.select("message_id", F.size("citations").cast("long").alias("n"), F.array_join(F.transform("citations", lambda c: c["marker"].cast("string")), ",").alias("markers"))


@query(f"WITH {FILES}, l AS (SELECT project_id, path, string_split(text, chr(10)) AS lines FROM files) SELECT project_id, path, array_to_string(lines[2:4], chr(10)) AS content FROM l")
def citation_lines(spark, sf_dir):
    f = files(spark, sf_dir).select("project_id", "path", F.split("text", "\n", -1).alias("lines"))
    cited = f.select("project_id", "path", F.lit(2).alias("start_line"), F.lit(4).alias("end_line"))
    return C.citation_lines(cited, f).select("project_id", "path", "content")


@query("""SELECT event_id, CASE WHEN s = 429 OR m LIKE '%RESOURCE_EXHAUSTED%' THEN 'rate_limited' WHEN s = 503 THEN 'unavailable' WHEN s = 413 THEN 'too_large' WHEN s IN (401, 403) THEN 'auth' WHEN m = 'got 429 too many requests' THEN 'rate_limited' END AS kind
FROM (SELECT event_id, ([429, 503, 413, 401, 403, 500, 200])[1 + event_id % 7] AS s, (['x', 'got 429 too many requests', 'line 429', 'RESOURCE_EXHAUSTED'])[1 + event_id % 4] AS m FROM events)""")
def provider_errors(spark, sf_dir):
    status = F.get(F.array(*map(F.lit, (429, 503, 413, 401, 403, 500, 200))), (F.col("event_id") % 7).cast("int"))
    text = F.get(F.array(*map(F.lit, ("x", "got 429 too many requests", "line 429", "RESOURCE_EXHAUSTED"))), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", N.classify_provider_error(status, text).alias("kind"))


@query(f"WITH {FILES}, c AS (SELECT path, doc_id % 100 AS n FROM files), r AS (SELECT item_id AS query_id, path, row_number() OVER (PARTITION BY item_id ORDER BY path) AS rank FROM c JOIN benchmark b ON b.item_id % 100 = n QUALIFY rank <= 100) SELECT query_id, path, path || ': 1-1' AS line FROM r")
def references_by_file(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("all").alias("project_id"), F.concat(F.lit("validateUser"), (F.col("item_id") % 100).cast("string")).alias("symbol"))
    return A.references_by_file(R.find_references(_identified(spark, sf_dir), asked))


@query("SELECT item_id, '[' || item_id || '] p:1-2' || chr(10) || text || chr(10) || chr(10) || 'Question?' AS prompt FROM benchmark")
def assemble_prompts(spark, sf_dir):
    """Evidence blocks and a question; the missing summary leaves no gap."""
    e = F.array(F.struct(F.col("item_id").alias("marker"), F.lit("p").alias("path"), F.lit(1).alias("start"), F.lit(2).alias("end"), F.col("text").alias("content")))
    return table(spark, sf_dir, "benchmark").select("item_id", N.assemble_prompt(F.lit(None).cast("string"), N.evidence_block(e), F.lit("Question?")).alias("prompt"))


_TURNS = "string_agg('Q: ' || question || chr(10) || 'A: ' || answer, chr(10) || chr(10) ORDER BY n)"


def _turns(exchanges):
    """conversation_id, turns: its exchanges in order (few: a window, or those that leave it)."""
    turns = F.array_sort(F.collect_list(F.struct("n", "question", "answer")))
    return exchanges.groupBy("conversation_id").agg(turns.alias("turns"))


@query(f"""WITH {_EXCHANGES}, w AS (SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY n DESC) <= 3)
SELECT conversation_id, 'RECENT TURNS:' || chr(10) || {_TURNS} || chr(10) || chr(10) || 'FOLLOW-UP QUESTION:' || chr(10) || 'And then?' || chr(10) || chr(10) || 'STANDALONE QUESTION:' AS prompt FROM w GROUP BY 1""")
def condensation_prompts(spark, sf_dir):
    turns = _turns(C.recent_window(C.exchanges(messages(spark, sf_dir))))
    return turns.select("conversation_id", N.condensation_prompt(F.col("turns"), F.lit("And then?")).alias("prompt"))


@query(f"""WITH {_EXCHANGES}, w AS (SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY n DESC) <= 3),
t AS (SELECT conversation_id, {_TURNS} AS turns FROM w GROUP BY 1)
SELECT conversation_id, CASE WHEN conversation_id % 2 = 0 THEN 'EXISTING SUMMARY:' || chr(10) || 'so far' || chr(10) || chr(10) || 'NEW TURNS TO FOLD IN:' || chr(10) || turns || chr(10) || chr(10) || 'UPDATED SUMMARY:'
  ELSE 'TURNS TO SUMMARIZE:' || chr(10) || turns || chr(10) || chr(10) || 'SUMMARY:' END AS prompt FROM t""")
def summary_prompts(spark, sf_dir):
    turns = _turns(C.recent_window(C.exchanges(messages(spark, sf_dir))))
    at_hand = F.when(F.col("conversation_id") % 2 == 0, "so far")
    return turns.select("conversation_id", N.summary_prompt(at_hand, F.col("turns")).alias("prompt"))


@query("""SELECT item_id, 'EVIDENCE:' || chr(10) || '[1] p:1-2' || chr(10) || text || chr(10) || chr(10) || 'QUESTION:' || chr(10) || 'What is ' || item_id || '?' || chr(10) || chr(10) || 'ANSWER:' || chr(10) || 'This [1].' || chr(10) || chr(10) ||
  CASE WHEN item_id % 3 = 0 THEN 'Note: this question is not actually answerable from the evidence above.' ELSE 'Note: this question IS answerable from the evidence above.' END AS prompt FROM benchmark""")
def judge_prompts(spark, sf_dir):
    e = F.array(F.struct(F.lit(1).alias("marker"), F.lit("p").alias("path"), F.lit(1).alias("start"), F.lit(2).alias("end"), F.col("text").alias("content")))
    asked = F.concat(F.lit("What is "), F.col("item_id").cast("string"), F.lit("?"))
    return table(spark, sf_dir, "benchmark").select("item_id", N.judge_prompt(e, asked, F.lit("This [1]."), F.col("item_id") % 3 == 0).alias("prompt"))


@query(f"""WITH {FILES}, f AS (SELECT project_id, path, text, row_number() OVER (PARTITION BY project_id ORDER BY path) AS rank FROM files QUALIFY rank <= 30)
SELECT project_id, CAST((rank - 1) // 5 AS BIGINT) AS batch, 'FILES:' || chr(10) || string_agg('[' || rank || '] ' || path || ':1-9' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Describe what this group is responsible for.' AS prompt
FROM f GROUP BY ALL""")
def tour_prompts(spark, sf_dir):
    """The first thirty files of each source, five to a prompt."""
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("path"))
    ranked = files(spark, sf_dir).select("project_id", "path", F.lit(1).alias("start"), F.lit(9).alias("end"), F.col("text").alias("content"), rank.alias("rank"))
    return A.tour_prompts(ranked.filter(F.col("rank") <= 30))


@query()
def change_evidence(spark, sf_dir):
    """Chunks of changed files and callers of their symbols, a change for each source."""
    chunks = _identified(spark, sf_dir).withColumn("project_id", F.lit("all"))
    number = F.regexp_extract("path", r"(\d+)\.txt", 1).cast("long")
    chunks = chunks.withColumn("symbol", F.concat(F.lit("validateUser"), (number % 100).cast("string")))
    changed = files(spark, sf_dir).filter("doc_id % 10 = 0").select(F.col("project_id").alias("change_id"), F.lit("all").alias("project_id"), "path", F.col("doc_id").cast("int").alias("pos"), (F.col("doc_id") % 30 == 0).alias("binary"))
    asked = A.changed_symbols(changed, chunks).withColumn("query_id", F.concat_ws(":", "change_id", F.col("file_no").cast("string")))
    found = R.find_references(chunks, asked).join(asked.select("query_id", "change_id", "file_no"), "query_id")
    return A.change_evidence(changed, chunks, found)
