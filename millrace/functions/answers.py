"""Column functions on answers: citation markers, links, sections, verdicts, prompts, provider errors. Nulls stay null."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The marker shapes, section titles and limits that answers keep to.
FENCE = r"(?s)```.*?```"
MARKER = r"\[(\d+(?:\s*,\s*\d+)*)\]|【(\d+)(?:†[^】]*)?】"
SECTION_TITLES = ("What this project is", "How it is organized", "How a request flows through it", "Where to start reading")
ANSWER_CHARS, TOOL_CHARS, BATCH_FILES, CUT = 600, 4000, 5, "\n... [truncated]"
JUDGE_NOTES = ("Note: this question is not actually answerable from the evidence above.", "Note: this question IS answerable from the evidence above.")
CHANGE_CONTEXT = "current code of the changed files, and callers of the symbols they define"
CHANGE_REQUEST = "Summarize the change, then flag anything that looks risky given what surrounds it."
TOUR_REQUEST = "Describe what this group is responsible for."
VERDICT = "grounded boolean, allClaimsCited boolean, handledUnknownCorrectly boolean, reasoning string"


def parse_citations(answer: Column, evidence: Column) -> Column:
    """Marker numbers from 1 to the number of pieces of evidence, outside code fences, each once, in order."""
    prose = F.regexp_replace(answer, FENCE, "")
    marks = F.regexp_extract_all(prose, F.lit(MARKER), F.lit(0))
    numbers = F.flatten(F.transform(marks, lambda m: F.regexp_extract_all(F.regexp_replace(m, "†.*", ""), F.lit(r"(\d+)"), F.lit(1))))
    return F.array_distinct(F.filter(F.transform(F.transform(numbers, lambda n: F.ltrim(n, F.lit("0"))), lambda n: F.when(F.char_length(n) <= 9, F.try_to_number(n, F.lit("999999999")).cast("int"))), lambda n: (n >= 1) & (n <= evidence)))


@F.pandas_udf(StringType())
def render_markers(answers: pd.Series, links: pd.Series) -> pd.Series:
    """Markers in prose as [n](url), or [n] where the map of links has none; lists space-joined; fences untouched."""
    import re

    marker, fence = re.compile(MARKER), re.compile(f"({FENCE[4:]})", re.S)

    def link(m: re.Match, urls: dict) -> str:
        numbers = [int(n) for n in (m[1].split(",") if m[1] else [m[2]])]
        return " ".join(f"[{n}]({urls[n]})" if urls.get(n) else f"[{n}]" for n in numbers)

    def render(text: str | None, urls: dict | None) -> str | None:
        if text is None:
            return None
        known = dict(urls or {})
        return "".join(p if p.startswith("```") else marker.sub(lambda m: link(m, known), p) for p in fence.split(text))

    return pd.Series([render(t, u) for t, u in zip(answers, links, strict=True)], dtype=object)


def citation_link(kind: Column, ref: Column, revision: Column, path: Column, start: Column, end: Column) -> Column:
    """Link to the lines at the revision, for git sources; else null."""
    base = F.regexp_replace(F.regexp_replace(ref, r"\.git/?$", ""), "/$", "")
    url = F.concat(base, F.lit("/blob/"), revision, F.lit("/"), path, F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))
    return F.when(kind.isin("git_url", "git_private") & revision.isNotNull() & (revision != ""), url)


def sources_line(citations: Column) -> Column:
    """Used citations by marker: `[n] path:a-b`, joined by a middle dot. citations: array of struct(marker, path, start, end, used)."""
    used = F.array_sort(F.transform(F.filter(citations, lambda c: c["used"]), lambda c: F.struct(c["marker"].alias("marker"), c["path"].alias("path"), c["start"].alias("start"), c["end"].alias("end"))))
    return F.array_join(F.transform(used, lambda c: F.format_string("[%d] %s:%d-%d", c["marker"], c["path"], c["start"], c["end"])), " · ")


def truncate_answer(text: Column, longest: int = ANSWER_CHARS) -> Column:
    return F.when(F.char_length(text) > longest, F.concat(F.regexp_replace(F.left(text, F.lit(longest)), r"\[\d*\z", ""), F.lit("…"))).otherwise(text)


def split_provider_id(model_id: Column) -> Column:
    """struct(provider, model): before and after the first colon; model null without one."""
    return F.struct(F.regexp_extract(model_id, r"^([^:]*)", 1).alias("provider"), F.nullif(F.regexp_extract(model_id, r"^[^:]*:(.*)$", 1), F.lit("")).alias("model"))


def parse_verdict(raw: Column) -> Column:
    """The judge's struct, out of one JSON code fence if there is one; null unless it has its three booleans and its text."""
    body = F.coalesce(F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit("")), raw)
    kinds = F.from_json(body, "map<string,string>")
    typed = F.from_json(body, VERDICT)
    quoted = F.concat(*[F.coalesce(F.regexp_extract(body, rf'"{k}"\s*:\s*(true|false)\b', 1), F.lit("")) for k in ("grounded", "allClaimsCited", "handledUnknownCorrectly")])
    whole = typed["grounded"].isNotNull() & typed["allClaimsCited"].isNotNull() & typed["handledUnknownCorrectly"].isNotNull() & typed["reasoning"].isNotNull()
    return F.when(kinds.isNotNull() & whole & (F.char_length(quoted) >= 12) & body.rlike(r'"reasoning"\s*:\s*"'), typed)


def parse_sections(text: Column) -> Column:
    """array of struct(title, body): the known `## ` sections that have a body, in order."""
    parts = F.split(F.concat(F.lit("\n"), text), r"\n##[ \t]+")
    pairs = F.transform(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), lambda p: F.struct(F.rtrim(F.regexp_extract(p, r"\A([^\n]*)", 1)).alias("title"), F.regexp_replace(F.regexp_replace(p, r"\A[^\n]*", ""), r"\A\s+|\s+\z", "").alias("body")))
    return F.filter(pairs, lambda s: s["title"].isin(*SECTION_TITLES) & (s["body"] != ""))


def evidence_block(evidence: Column) -> Column:
    """`[n] path:a-b` and the content for each piece, a blank line between. evidence: array of struct(marker, path, start, end, content)."""
    return F.array_join(F.transform(evidence, lambda e: F.format_string("[%d] %s:%d-%d\n%s", e["marker"], e["path"], e["start"], e["end"], e["content"])), "\n\n")


def assemble_prompt(*parts: Column) -> Column:
    """The parts that aren't null or empty, a blank line between."""
    return F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts])


def turns_block(exchanges: Column) -> Column:
    """`Q: ` and `A: ` lines of each exchange, a blank line between. exchanges: array of struct(question, answer), in order."""
    return F.array_join(F.transform(exchanges, lambda e: F.concat(F.lit("Q: "), e["question"], F.lit("\nA: "), e["answer"])), "\n\n")


def _titled(title: str, body: Column) -> Column:
    """`TITLE:` and the body below it; null for an empty or missing body."""
    return F.when(body != "", F.concat(F.lit(f"{title}:\n"), body))


def answer_prompt(overview: Column, summary: Column, exchanges: Column, evidence: Column, question: Column) -> Column:
    """What an answer is written from; parts that are missing leave no gap, evidence and question always stand."""
    context = F.concat(F.lit("CONTEXT:\n"), F.coalesce(evidence_block(evidence), F.lit("")))
    earlier = [_titled("PROJECT OVERVIEW", overview), _titled("EARLIER IN THIS CONVERSATION", summary), _titled("RECENT TURNS", turns_block(exchanges))]
    return assemble_prompt(*earlier, context, F.concat(F.lit("QUESTION:\n"), question))


def condensation_prompt(exchanges: Column, question: Column) -> Column:
    """Asks for a follow-up question as one that stands alone."""
    turns = F.concat(F.lit("RECENT TURNS:\n"), F.coalesce(turns_block(exchanges), F.lit("")))
    return assemble_prompt(turns, F.concat(F.lit("FOLLOW-UP QUESTION:\n"), question), F.lit("STANDALONE QUESTION:"))


def summary_prompt(summary: Column, exchanges: Column) -> Column:
    """Asks for a summary of the exchanges, or, with one at hand, for it with these folded in."""
    turns, at_hand = turns_block(exchanges), F.coalesce(summary, F.lit("")) != ""
    folded = assemble_prompt(_titled("EXISTING SUMMARY", summary), F.concat(F.lit("NEW TURNS TO FOLD IN:\n"), turns), F.lit("UPDATED SUMMARY:"))
    return F.when(at_hand, folded).otherwise(assemble_prompt(F.concat(F.lit("TURNS TO SUMMARIZE:\n"), turns), F.lit("SUMMARY:")))


def judge_prompt(evidence: Column, question: Column, answer: Column, unanswerable: Column) -> Column:
    """What a verdict on an answer is given from."""
    note = F.when(unanswerable, JUDGE_NOTES[0]).otherwise(JUDGE_NOTES[1])
    parts = [F.concat(F.lit(f"{title}:\n"), body) for title, body in (("EVIDENCE", evidence_block(evidence)), ("QUESTION", question), ("ANSWER", answer))]
    return assemble_prompt(*parts, note)


def change_prompt(commit: Column, message: Column, diffs: Column, evidence: Column) -> Column:
    """What a review of a commit is written from. diffs: array of struct(path, insertions, deletions, patch)."""
    shown = F.transform(diffs, lambda d: F.format_string("--- %s (+%d/-%d) ---\n%s", d["path"], d["insertions"], d["deletions"], d["patch"]))
    changed = F.concat(F.lit("DIFF:\n"), F.array_join(shown, "\n\n"))
    around = F.concat(F.lit(f"CONTEXT ({CHANGE_CONTEXT}):\n"), evidence_block(evidence))
    return assemble_prompt(F.concat(F.lit("COMMIT "), commit, F.lit(": "), message), changed, around, F.lit(CHANGE_REQUEST))


def tour_prompt(evidence: Column) -> Column:
    """Asks what one group of files is responsible for."""
    return F.concat(F.lit("FILES:\n"), evidence_block(evidence), F.lit(f"\n\n{TOUR_REQUEST}"))


def tour_summary_prompt(summaries: Column) -> Column:
    """Asks for the tour from its groups' summaries, in order. summaries: array of string."""
    groups = F.transform(summaries, lambda s, i: F.concat(F.lit("Group "), (i + 1).cast("string"), F.lit(":\n"), s))
    return F.concat(F.lit("GROUP SUMMARIES:\n"), F.array_join(groups, "\n\n"))


def tool_block(evidence: Column, longest: int = TOOL_CHARS) -> Column:
    """What a tool shows: as evidence_block with fenced contents, all of it cut at `longest` characters with a mark."""
    piece = "[%d] %s:%d-%d\n```\n%s\n```"
    shown = F.array_join(F.transform(evidence, lambda e: F.format_string(piece, e["marker"], e["path"], e["start"], e["end"], e["content"])), "\n\n")
    return F.when(F.char_length(shown) > longest, F.concat(F.left(shown, F.lit(longest)), F.lit(CUT))).otherwise(shown)


def classify_provider_error(status: Column, message: Column) -> Column:
    """Kind of a provider's failure; null if it isn't one. Numbers in messages count only beside a word that says the same."""
    text = F.coalesce(message, F.lit(""))
    return (
        F.when((status == 429) | text.rlike(r"\bRESOURCE_EXHAUSTED\b"), "rate_limited")
        .when((status == 503) | text.rlike(r"\bUNAVAILABLE\b"), "unavailable")
        .when((status == 413) | text.rlike(r"(?i)\b(context length|too large|maximum context)\b"), "too_large")
        .when(status.isin(401, 403), "auth")
        .when(text.rlike(r"\b429\b") & text.rlike(r"(?i)quota|rate.?limit|too many requests"), "rate_limited")
        .when(text.rlike(r"\b503\b") & text.rlike(r"(?i)unavailable|overloaded|service"), "unavailable")
    )
