"""Every query with SQL gives what DuckDB gives on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = sorted(entry.core.SQL)


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    return float(x) if isinstance(x, float) else x


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, name):
    con = connect(sf)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    expected = sorted((tuple(plain(r[k]) for k in order) for r in cur.fetchall()), key=str)
    df = entry.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    assert len(got) == len(expected)
    assert got == expected


def test_queries_without_sql(spark, sf):
    rows = entry.entry(spark).collect()
    assert rows and all(abs(r.pp0 + r.pp1 + r.pp2 - 1) < 1e-5 for r in rows)
    pi = [r.pi_amb for r in entry.queries()["pi_amb_fit"](spark, sf).collect()]
    assert abs(sum(pi) - 1) < 1e-9 and min(pi) >= 0
    assert all(0 <= r.alpha_rna <= 1 for r in entry.queries()["alpha_newton_mmle"](spark, sf).collect())
