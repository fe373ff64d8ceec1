"""Runs a query and its SQL and compares rows."""

import duckdb
import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (bool, int, float)):
        return f"{float(v):.9g}"
    return str(v)


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return [rel.columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


def spark_rows(df):
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    return [df.columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in df.collect())
