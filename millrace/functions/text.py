"""Column functions on texts: lines, hashes, identifiers, lexemes, embedding inputs, redaction. Nulls stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What results of the indexed corpus depend on.
HASH_VERSION = 2
IDENTIFIER_PART = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"
IDENTIFIER_TOKEN = r"(?<![A-Za-z0-9_])[a-z]+[A-Z][A-Za-z0-9_]*|(?<![A-Za-z0-9_])[A-Z_]{3,}(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])[A-Za-z0-9_]+\.[A-Za-z0-9_]+\("
TOKEN_SHAPES = (r"gh[pousr]_[A-Za-z0-9]{36}", r"github_pat_[A-Za-z0-9_]{22,}")
MODEL_CHARS, TITLE_CHARS, PARAGRAPH_CHARS = 4500, 80, 500


def normal_text(raw: Column) -> Column:
    """Without a leading byte-order mark; CRLF as LF; CR as LF only in texts without any LF."""
    text = F.regexp_replace(F.regexp_replace(raw, "^﻿", ""), "\r\n", "\n")
    return F.when(F.contains(text, F.lit("\n")), text).otherwise(F.translate(text, "\r", "\n"))


def to_lines(raw: Column) -> Column:
    """Lines of the normalised text; an empty text has none, and a final line end adds none."""
    text = normal_text(raw)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def file_content_hash(text: Column, version: int = HASH_VERSION) -> Column:
    return F.sha2(F.concat(F.lit(f"{version}\n"), text), 256)


def split_identifiers(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(IDENTIFIER_PART), F.lit(0)), " ")


def search_text(content: Column) -> Column:
    return F.concat(content, F.lit("\n"), split_identifiers(content))


def identifier_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIER_TOKEN), F.lit(0)))


def lexemes(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def lexeme_text(text: Column) -> Column:
    """The lexemes with a space between each two: cheaper to make and to hand over than an array of them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def embedding_text(path: Column, symbol: Column, start: Column, end: Column, content: Column) -> Column:
    named = F.when(symbol.isNotNull(), F.concat(F.lit(" ("), symbol, F.lit(")"))).otherwise("")
    return F.concat(F.lit("// "), path, named, F.lit(" lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\n"), content)


def model_input(text: Column, query: bool = False) -> Column:
    return F.left(F.concat(F.lit("search_query: " if query else "search_document: "), text), F.lit(MODEL_CHARS))


def redact(text: Column, extra: tuple[str, ...] = ()) -> Column:
    for shape in TOKEN_SHAPES + extra:
        text = F.regexp_replace(text, shape, "[REDACTED]")
    return text


def stored_title(text: Column) -> Column:
    return F.left(F.translate(text, "\x00", ""), F.lit(TITLE_CHARS))


def first_paragraph(markdown: Column) -> Column:
    """The first paragraph that isn't a heading, after a leading heading line; white space collapsed; null if there is none."""
    body = F.regexp_replace(markdown, r"\A#+\s[^\n]*(?:\n|\z)", "")
    parts = F.filter(F.transform(F.split(body, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"\A\s+|\s+\z", "")), lambda p: (p != "") & ~p.rlike(r"\A#+\s"))
    flat = F.regexp_replace(F.get(parts, F.lit(0)), r"\s+", " ")
    return F.when(F.char_length(flat) > PARAGRAPH_CHARS, F.concat(F.left(flat, F.lit(PARAGRAPH_CHARS)), F.lit("…"))).otherwise(flat)


def minified(text: Column, longest: int = 2000) -> Column:
    return F.exists(F.split(text, "\n", -1), lambda line: F.char_length(line) > longest)


def read_range(lines: Column, start: Column, end: Column, default_lines: int = 300) -> Column:
    """Lines start to end (1-based, inclusive), clamped to the file; null end: a window of default_lines; end before start: empty; start past the end: null."""
    first = F.greatest(F.lit(1), F.floor(start).cast("int"))
    last = F.least(F.size(lines), F.coalesce(F.floor(end).cast("int"), first + default_lines - 1))
    return F.when(first <= F.size(lines), F.array_join(F.slice(lines, first, F.greatest(F.lit(0), last - first + 1)), "\n"))


def estimate_tokens(chars: Column, max_tokens: int) -> Column:
    return (F.ceil(chars / 4) + max_tokens).cast("long")


def fits_budget(chars: Column, max_tokens: int, budget: int, slack: float = 1.1) -> Column:
    return estimate_tokens(chars, max_tokens) <= slack * budget
