"""Rows of a query and of its SQL, made comparable."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns: list[str], data) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    flat = lambda v: None if v is None or v != v else round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted(repr([flat(r[i]) for i in order]) for r in data)


def same(df, sql: str, sf_dir: str) -> None:
    want = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
