"""The queries and SQL of this package, for __spark_entry__."""

from . import queries_op1, queries_op2, queries_op3, queries_op4, queries_op5, queries_op6, queries_op7, queries_op8, queries_op9, queries_op10, queries_op11, queries_op12, queries_op13

_MODULES = (queries_op1, queries_op2, queries_op3, queries_op4, queries_op5, queries_op6, queries_op7, queries_op8, queries_op9, queries_op10, queries_op11, queries_op12, queries_op13)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in vars(m).items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(m, "SQL", {}).items()}
