"""Compares a query with its SQL in DuckDB, as multisets of rows."""

import glob
import os

import duckdb


def rows(frame_rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    return sorted(repr([plain(r[i]) for i in order]) for r in frame_rows)


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same(df, sql, sf_dir):
    cur = connect(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(cur.fetchall(), names)
