"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


_KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def compare(spark, con, query, sql: str, folder: str = SF) -> str | None:
    """None if both agree in names, types and values, else what differs."""
    df = query(spark, folder)
    got = _rows(df.columns, df.collect())
    rel = con.sql(sql)
    exp = _rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    spark_types = {c: _KIND.get(t, t) for c, t in df.dtypes}
    sql_types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    if spark_types != sql_types:
        return f"types {[(c, spark_types[c], sql_types[c]) for c in spark_types if spark_types[c] != sql_types[c]]}"
    if len(got) != len(exp):
        return f"rows {len(got)} != {len(exp)}"
    if not exp:
        return "no rows on either side"
    bad = [(g, e) for g, e in zip(got, exp) if g != e]
    return f"{len(bad)} of {len(exp)} rows differ, first: {bad[0]}" if bad else None
