"""Compares a query with its DuckDB SQL."""

import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(None if v is None or v is pd.NA or v != v else (round(v, 4) + 0.0 if isinstance(v, float) else v) for v in r) for r in df[cols].astype(object).itertuples(index=False)]
    return sorted(rows, key=repr)


def same(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    got, want = spark_df.toPandas(), con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
