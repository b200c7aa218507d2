"""Run a registered query and its SQL check on one data folder and compare the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(names, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = (tuple((type(v).__name__, v) for v in (_plain(r[i]) for i in order)) for r in rows)
    return [names[i] for i in order], Counter(plain)


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql: str):
    cursor = con.execute(sql)
    return _rows([d[0] for d in cursor.description], cursor.fetchall())


SAME_TYPES = {
    "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
    "array<bigint>": "BIGINT[]", "array<double>": "DOUBLE[]", "date": "DATE",
}


def type_difference(df, con, sql: str) -> str | None:
    have = {name: SAME_TYPES.get(kind, kind) for name, kind in df.dtypes}
    want = {name: str(kind) for name, kind, *_ in con.execute(sql).description}
    wrong = {n: (have[n], want.get(n)) for n in have if want.get(n) != have[n]}
    return f"types (ours, SQL) {wrong}" if wrong else None


def difference(df, con, sql: str) -> str | None:
    """None when names, types and rows agree, else a short account."""
    wrong = type_difference(df, con, sql)
    if wrong:
        return wrong
    names, rows = spark_rows(df)
    want_names, want = duck_rows(con, sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if rows == want:
        return None
    only, missing = rows - want, want - rows
    sample = [(a, b) for a, b in zip(sorted(only, key=str)[:3], sorted(missing, key=str)[:3])]
    return f"rows {rows.total()} vs {want.total()}, {only.total()} differ; {names} e.g. {sample}"
