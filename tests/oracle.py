"""Compare a query with its SQL in DuckDB: names, kinds of types, and the multiset of rows."""

from __future__ import annotations

import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        raise TypeError("decimal result: cast it")
    if isinstance(value, float) and math.isnan(value):
        raise ValueError("NaN in a result")
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        [tuple(_plain(row[i]) for i in order) for row in rows],
        key=lambda row: tuple((v is not None, str(type(v)), v) for v in row),
    )


def differences(df, con, sql: str) -> list[str]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = _rows(names, found.fetchall())
    ours = _rows(df.columns, [tuple(row) for row in df.collect()])
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    if len(ours) != len(theirs):
        return [f"{len(ours)} rows != {len(theirs)}"]
    out = []
    for a, b in zip(ours, theirs, strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            out.append(f"{a} != {b}")
    if not ours:
        out.append("no rows")
    return out
