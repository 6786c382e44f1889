"""Conversations and citations: exchanges, windows, evidence markers, citation rows, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import parse_citations

SUMMARY_AFTER, WINDOW = 6, 3


def exchanges(messages: DataFrame) -> DataFrame:
    """conversation_id, n (from 1), user_id, assistant_id, question, answer: messages strictly two at a time; a pair stays if it is user, then assistant. messages: conversation_id, message_id, pos, role, content."""
    turn = F.row_number().over(Window.partitionBy("conversation_id").orderBy("pos", "message_id")) - 1
    pairs = messages.withColumn("turn", turn).groupBy("conversation_id", F.floor(F.col("turn") / 2).alias("pair")).agg(
        F.min_by(F.struct("role", "message_id", "content"), "turn").alias("a"), F.max_by(F.struct("role", "message_id", "content"), "turn").alias("b"), F.count(F.lit(1)).alias("m")
    )
    good = pairs.filter("m = 2 AND a.role = 'user' AND b.role = 'assistant'")
    n = F.row_number().over(Window.partitionBy("conversation_id").orderBy("pair"))
    return good.select("conversation_id", n.alias("n"), F.col("a.message_id").alias("user_id"), F.col("b.message_id").alias("assistant_id"), F.col("a.content").alias("question"), F.col("b.content").alias("answer"))


def recent_window(pairs: DataFrame, size: int = WINDOW) -> DataFrame:
    """The last `size` exchanges of each conversation; none for a size of zero or less."""
    back = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("n")))
    return pairs.withColumn("back", back).filter(F.col("back") <= size).drop("back")


def evicted_exchanges(pairs: DataFrame, watermarks: DataFrame, size: int = WINDOW) -> DataFrame:
    """Exchanges older than the window and after the summary's last one; all the older ones if that isn't among them. watermarks: conversation_id, assistant_id."""
    back = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("n")))
    older = pairs.withColumn("back", back).filter(F.col("back") > size).drop("back")
    mark = older.join(watermarks, ["conversation_id", "assistant_id"]).groupBy("conversation_id").agg(F.min("n").alias("through"))
    return older.join(mark, "conversation_id", "left").filter(F.col("through").isNull() | (F.col("n") > F.col("through"))).drop("through")


def summary_due(pairs: DataFrame, watermarks: DataFrame, size: int = WINDOW, after: int = SUMMARY_AFTER) -> DataFrame:
    """conversation_id, due: more than `after` exchanges without a summary yet, or some evicted since the last one."""
    count = pairs.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("m"))
    gone = evicted_exchanges(pairs, watermarks, size).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("evicted"))
    has = watermarks.select("conversation_id").distinct().withColumn("has", F.lit(True))
    due = F.when(F.col("has"), F.coalesce("evicted", F.lit(0)) > 0).otherwise(F.col("m") > after)
    return count.join(gone, "conversation_id", "left").join(has, "conversation_id", "left").select("conversation_id", due.alias("due"))


def messages_after(messages: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Messages created after the watermark's; all of a conversation whose watermark is missing. messages: conversation_id, message_id, created_at; watermarks: conversation_id, message_id."""
    mark = messages.join(watermarks, ["conversation_id", "message_id"]).groupBy("conversation_id").agg(F.max("created_at").alias("since"))
    return messages.join(mark, "conversation_id", "left").filter(F.col("since").isNull() | (F.col("created_at") > F.col("since"))).drop("since")


def evidence_markers(evidence: DataFrame) -> DataFrame:
    """evidence plus marker: 1, 2, ... over each trajectory. evidence: trajectory_id, step, pos."""
    return evidence.withColumn("marker", F.row_number().over(Window.partitionBy("trajectory_id").orderBy("step", "pos")))


def conversation_projects(links: DataFrame) -> DataFrame:
    """conversation_id, project_ids (sorted), multi (two or more)."""
    out = links.groupBy("conversation_id").agg(F.array_sort(F.collect_set("project_id")).alias("project_ids"))
    return out.withColumn("multi", F.size("project_ids") >= 2)


def messages_with_citations(messages: DataFrame, citations: DataFrame) -> DataFrame:
    """messages plus citations, ordered by marker; empty without any. citations: message_id, marker, ..."""
    columns = ["marker", *[c for c in citations.columns if c not in ("message_id", "marker")]]
    own = citations.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("citations"))
    joined = messages.join(own, "message_id", "left")
    return joined.withColumn("citations", F.coalesce("citations", F.array().cast(own.schema["citations"].dataType)))


def resolve_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answer_id, marker, path, start_line, end_line, place (order in the answer). answers: answer_id, text; evidence: answer_id, marker, path, start_line, end_line."""
    count = evidence.groupBy("answer_id").agg(F.count(F.lit(1)).alias("m"))
    marks = answers.join(count, "answer_id").select("answer_id", F.posexplode(parse_citations(F.col("text"), F.col("m"))).alias("place", "marker"))
    return marks.join(evidence, ["answer_id", "marker"]).select("answer_id", "marker", "path", "start_line", "end_line", "place")


def answer_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row for each piece of evidence, cited or not: evidence plus used. answers: answer_id, text."""
    count = evidence.groupBy("answer_id").agg(F.count(F.lit(1)).alias("__m"))
    cited = answers.join(count, "answer_id").select("answer_id", F.explode(parse_citations(F.col("text"), F.col("__m"))).alias("marker")).withColumn("used", F.lit(True))
    return evidence.join(cited, ["answer_id", "marker"], "left").withColumn("used", F.coalesce("used", F.lit(False)))


def citation_lines(citations: DataFrame, files: DataFrame) -> DataFrame:
    """citations plus content: the cited lines of indexed files. files: project_id, path, lines."""
    joined = citations.join(files.select("project_id", "path", "lines"), ["project_id", "path"])
    first = F.greatest(F.lit(1), F.col("start_line"))
    return joined.withColumn("content", F.array_join(F.slice("lines", first, F.greatest(F.lit(0), F.col("end_line") - first + 1)), "\n")).drop("lines")


def file_view(ranges: DataFrame, files: DataFrame, context: int = 20) -> DataFrame:
    """ranges plus context_start, context_end, view: lines of indexed files with so many lines of context, clamped to the file. Ranges in files that aren't indexed give nothing.

    ranges: project_id, path, start_line, end_line; files: project_id, path, lines.
    """
    joined = ranges.join(files.select("project_id", "path", "lines"), ["project_id", "path"])
    first = F.greatest(F.lit(1), F.col("start_line") - context)
    last = F.least(F.size("lines"), F.col("end_line") + context)
    placed = joined.withColumn("context_start", first.cast("int")).withColumn("context_end", last.cast("int"))
    shown = F.slice("lines", F.col("context_start"), F.greatest(F.lit(0), F.col("context_end") - F.col("context_start") + 1))
    return placed.withColumn("view", shown).drop("lines")


def slug(title: Column, fallback: Column) -> Column:
    name = F.regexp_replace(F.left(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), r"^-|-$", ""), F.lit(60)), r"-$", "")
    return F.coalesce(F.nullif(name, F.lit("")), fallback.cast("string"))


def export_conversations(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """conversation_id, file_name, document: one markdown text per conversation. conversations: conversation_id, title; messages: conversation_id, pos, message_id, role, content."""
    turns = messages.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("pos", "message_id", "role", "content"))).alias("turns"))
    body = F.array_join(F.transform("turns", lambda m: F.concat(F.lit("## "), F.initcap(m["role"]), F.lit("\n\n"), F.coalesce(m["content"], F.lit("")))), "\n\n")
    joined = conversations.join(turns, "conversation_id", "left")
    document = F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("title", F.col("conversation_id").cast("string"))), body)
    return joined.select("conversation_id", F.concat(slug(F.col("title"), F.col("conversation_id")), F.lit(".md")).alias("file_name"), document.alias("document"))
