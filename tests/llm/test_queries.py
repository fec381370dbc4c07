"""Registered queries against their SQL, on the small tables."""

import duckdb
import pytest

from hornlog.llm import queries

TABLES = "documents pages benchmark labels".split()


@pytest.mark.parametrize("name", queries.ORACLE)
def test_query_equals_sql(spark, small, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = db.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, small).select(*names)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))
