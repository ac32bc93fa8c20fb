"""Queries with SQL give what DuckDB gives."""

import pytest

from cellwright.llm import queries
from tests.test_oracle import connect


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf, name):
    cur = connect(sf).execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    expected = sorted((tuple(r[k] for k in sorted(range(len(names)), key=names.__getitem__)) for r in cur.fetchall()), key=str)
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str) == expected
