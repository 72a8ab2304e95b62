"""Runs oracle SQL in DuckDB over tables given as DataFrames and compares rows."""
import duckdb


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas() if hasattr(df, "toPandas") else df)
    cur = con.sql(sql)
    return cur.columns, cur.fetchall()


def same(df, sql, **tables):
    columns, rows = sql_rows(sql, **tables)
    assert sorted(columns) == sorted(df.columns)
    got = [tuple(r[c] for c in sorted(columns)) for r in df.collect()]
    want = [tuple(r[columns.index(c)] for c in sorted(columns)) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got
