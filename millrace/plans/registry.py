"""The queries of the library's own operators and their SQL."""

from __future__ import annotations

from . import corpus, indexes, questions, shapes, streams

_MODULES = (corpus, questions, shapes, indexes, streams)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
