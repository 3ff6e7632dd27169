"""Every query with SQL against DuckDB; the others for rows."""

import os

import duckdb
import pytest

from gaplens.plans.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


def rows_of_sql(sql):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DIR)
    got = df.collect()
    if name not in ORACLE_SQL:
        assert got
        return
    names, want = rows_of_sql(ORACLE_SQL[name])
    order = sorted(names)
    assert sorted(df.columns) == order
    plain = lambda x: round(x, 9) + 0.0 if isinstance(x, float) else x
    flat = lambda rows, pick: sorted(repr([plain(pick(r, c)) for c in order]) for r in rows)
    assert flat(got, lambda r, c: r[c]) == flat(want, lambda r, c: r[names.index(c)])
