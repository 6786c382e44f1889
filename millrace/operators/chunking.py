"""Chunks of files: windows of lines that end at natural boundaries, and structural chunks of functions and classes.

A chunk's content is always lines[start_line - 1 : end_line] joined by line ends. Files are chunked each by itself in
Arrow batches, without a shuffle.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scripts

#: Fixed values of the windows, and what ends one.
TARGET, OVERLAP, LEAST, SEARCH = 60, 15, 30, 20
#: Characters of chunks that a task holds before it gives them on.
BATCH_CHARS = 4 << 20
_DECLARATION = re.compile(r"[ \t\v\f\r\xa0﻿]*(?:export |function |class |def |const \w+ = )", re.A)
_CLOSING = re.compile(r"}[ \t\v\f\r\xa0﻿]*$")
_BLANK = re.compile(r"[ \t\v\f\r\xa0﻿ -     　]*$")
CHUNK = "ord int, start_line int, end_line int, symbol string, content string"


class Part(NamedTuple):
    """Lines start (from 0) up to end, exclusive. whole: not to be merged with neighbours; method: however short."""

    start: int
    end: int
    symbol: str | None = None
    whole: bool = False
    method: bool = False


def boundaries(lines: list[str]) -> list[int | None]:
    """For each line, where a window may end because of it: before a declaration, after a closing brace or a blank line."""
    return [i if _DECLARATION.match(line) else i + 1 if _CLOSING.match(line) or _BLANK.match(line) else None for i, line in enumerate(lines)]


def line_windows(lines: list[str], first: int = 0, last: int | None = None, symbol: str | None = None) -> list[Part]:
    """Windows of about TARGET lines that overlap by OVERLAP, each ending at the boundary nearest to its full length."""
    last, out, start = len(lines) if last is None else last, [], first
    marks = boundaries(lines[first:last])
    while start < last:
        full = start + TARGET
        end = last
        if full < last:
            seen = range(max(start + LEAST, full - SEARCH), min(last, full + SEARCH))
            ends = [marks[i - first] + first for i in seen if marks[i - first] is not None and marks[i - first] + first > start]
            end = min(ends, key=lambda e: abs(e - full), default=full)  # the first of equally near ones
        out.append(Part(start, end, symbol))
        if end >= last:
            break
        start = max(start + 1, end - OVERLAP)
    return out


def _python_regions(lines: list[str]) -> list[Part] | None:
    try:
        tree = ast.parse("\n".join(lines))
    except (SyntaxError, ValueError, RecursionError):
        return None
    out = []
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and not node.decorator_list:
            own = Part(node.lineno - 1, node.end_lineno, node.name, True)
            methods = [Part(m.lineno - 1, m.end_lineno, f"{node.name}.{m.name}", True) for m in node.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef) and not m.decorator_list] if isinstance(node, ast.ClassDef) else []
            out += methods if methods and own.end - own.start > TARGET else [own]
    return out


def _script_regions(lines: list[str]) -> list[Part] | None:
    """Functions and classes of the top level; of a class above TARGET lines its methods, and what lies between them under its name."""
    found = scripts.regions(lines)
    if found is None:
        return None
    out = []
    for r in found:
        if r.last + 1 - r.first <= TARGET or not r.methods:
            out.append(Part(r.first, r.last + 1, r.symbol, True))
            continue
        at = r.first
        for m in r.methods:
            if m.first < at:
                return None  # two members on one line
            out += [Part(at, m.first, r.symbol, True)] if m.first > at else []
            out.append(Part(m.first, m.last + 1, m.symbol, True, True))
            at = m.last + 1
        out += [Part(at, r.last + 1, r.symbol, True)] if at <= r.last else []
    return out


def merge_tiny(parts: list[Part]) -> list[Part]:
    """Neighbours of which one is below LEAST lines become one, up to TARGET lines, unless one is to stay whole."""
    out: list[Part] = []
    for p in parts:
        if out and out[-1].end == p.start and not out[-1].whole and not p.whole and min(p.end - p.start, out[-1].end - out[-1].start) < LEAST and p.end - out[-1].start <= TARGET:
            names = [s for s in (out[-1].symbol, p.symbol) if s]
            out[-1] = Part(out[-1].start, p.end, ", ".join(names) or None)
        else:
            out.append(p)
    return out


def structural(lines: list[str], lang: str | None) -> list[Part]:
    """Functions, classes and methods (of classes above TARGET lines) with their names, windows between them; windows alone where the language isn't known or doesn't parse."""
    regions = _python_regions(lines) if lang == "py" else _script_regions(lines) if lang in ("ts", "tsx", "js", "jsx") else None
    if not regions:
        return line_windows(lines)
    out, at = [], 0
    for r in sorted(regions):
        if r.start > at:
            out += line_windows(lines, at, r.start)
        size = r.end - r.start
        out += [p._replace(whole=True) for p in line_windows(lines, r.start, r.end, r.symbol)] if size > TARGET else [r._replace(whole=size >= LEAST or r.method)]
        at = r.end
    if at < len(lines):
        out += line_windows(lines, at)
    return merge_tiny(out)


def chunk_files(files: DataFrame, keys: list[str], lines_col: str = "lines", lang_col: str | None = None) -> DataFrame:
    """keys, ord, start_line, end_line, symbol, content. lang_col: structural chunks by that language; none: windows of lines."""
    narrow = files.select(*keys, F.col(lines_col).alias("__lines"), (F.col(lang_col) if lang_col else F.lit(None).cast("string")).alias("__lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, out = [], 0, {"ord": [], "start_line": [], "end_line": [], "symbol": [], "content": []}
            for row in range(batch.num_rows):
                lines = batch.column("__lines")[row].as_py() or []
                parts = structural(lines, batch.column("__lang")[row].as_py()) if lang_col else line_windows(lines)
                for n, p in enumerate(parts):
                    rows.append(row)
                    for k, v in zip(out, (n, p.start + 1, p.end, p.symbol, "\n".join(lines[p.start : p.end])), strict=True):
                        out[k].append(v)
                    held += len(out["content"][-1])
                    if held >= BATCH_CHARS:
                        yield given(batch, rows, out)
                        rows, held, out = [], 0, {k: [] for k in out}
            yield given(batch, rows, out)

    def given(batch: pa.RecordBatch, rows: list[int], out: dict[str, list]) -> pa.RecordBatch:
        types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
        kept = batch.select(keys).take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]], [*keys, *out])

    kinds = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys)
    return narrow.mapInArrow(run, f"{kinds}, {CHUNK}")
