"""The op queries that have SQL beside it, on the smallest tables."""

import duckdb
import pytest

from millrace.llm import registry
from test_queries import TABLES, plain


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_and_sql(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in r.fetchall())
