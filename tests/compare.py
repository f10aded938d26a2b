"""Run a query on Spark and its oracle on DuckDB and compare schema, rows and values."""
from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, int):
        return value
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


_INTS = {"TINYINT", "SMALLINT", "INTEGER", "BIGINT"}


def compare(name, fn, sql, spark, sf_dir, con):
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    spark_types = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                   "boolean": "BOOLEAN"}
    odd = [(c, t, types[c]) for c, t in df.dtypes if spark_types.get(t) != types[c]]
    a, b = _rows(df.columns, got), _rows(names, want)
    note = f" types {odd}" if odd else ""
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}{note}"
    if a != b:
        cols = sorted(names)
        diff = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y))
        bad = sum(x != y for x, y in zip(a, b))
        return f"{bad} values differ{note}: {cols}\n   spark {str(a[diff])[:600]}\n   duck  {str(b[diff])[:600]}"
    return f"OK {len(a)}{note}"
