"""Value-by-value comparison of a Spark result with the result of a SQL statement."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        if Path(f"{folder}/{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}") + 0.0
    return value


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    kinds = {d[0]: str(d[1]) for d in found.description}
    order = sorted(df.columns)
    if order != sorted(names):
        return [f"columns differ: only spark {set(order) - set(names)}, only sql {set(names) - set(order)}"]
    problems = [
        f"type of {f.name}: spark {f.dataType.simpleString()}, sql {kinds[f.name]}"
        for f in df.schema
        if _TYPES.get(f.dataType.simpleString()) != kinds[f.name]
    ]
    expected = Counter(tuple(_cell(row[names.index(c)]) for c in order) for row in found.fetchall())
    actual = Counter(tuple(_cell(row[c]) for c in order) for row in df.collect())
    if expected != actual:
        missing, extra = expected - actual, actual - expected
        problems.append(
            f"rows: spark {actual.total()}, sql {expected.total()}, unmatched {extra.total()} and {missing.total()}"
        )
        problems += [f"  spark {dict(zip(order, r))}" for r in list(extra)[:2]]
        problems += [f"  sql   {dict(zip(order, r))}" for r in list(missing)[:2]]
    elif not expected:
        problems.append("note: no rows")
    return problems
