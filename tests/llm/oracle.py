"""Compare a query with its DuckDB SQL over the same tables."""

import os

import duckdb


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        name = f.removesuffix(".parquet")
        at = f"{sf_dir}/{f}/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}'")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def assert_same(df, sql, sf_dir):
    names, want = rows_of_sql(sql, sf_dir)
    order = sorted(names)
    assert sorted(df.columns) == order
    got = sorted(map(repr, (tuple(r[c] for c in order) for r in df.collect())))
    want = sorted(map(repr, (tuple(r[names.index(c)] for c in order) for r in want)))
    assert got == want
