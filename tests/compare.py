"""Compare a Spark result with the rows of its SQL counterpart in DuckDB."""

from __future__ import annotations

import glob
import math
import os
from typing import Any

import duckdb
from pyspark.sql import DataFrame

DUCK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE",
    "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
    "date": "DATE", "array<double>": "DOUBLE[]",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _sortable(row: tuple) -> tuple:
    return tuple((value is not None, str(type(value)), value if value is not None else 0) for value in row)


def _plain(value: Any) -> Any:
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return value + 0.0
    return value


def differences(result: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty if names, types and rows agree exactly, whatever the order of rows and columns."""
    names = sorted(result.columns)
    rows = sorted((tuple(_plain(r[n]) for n in names) for r in result.collect()), key=_sortable)
    expected_types = {
        name: kind for name, kind, *_ in connection.execute(f"DESCRIBE {sql}").fetchall()
    }
    found = []
    if sorted(expected_types) != names:
        return [f"columns {names} != {sorted(expected_types)}"]
    for field in result.schema.fields:
        kind = DUCK_TYPES.get(field.dataType.simpleString(), field.dataType.simpleString())
        if kind != expected_types[field.name]:
            found.append(f"type of {field.name}: {kind} != {expected_types[field.name]}")
    cursor = connection.execute(sql)
    order = [d[0] for d in cursor.description]
    expected = sorted(
        (tuple(_plain(row[order.index(n)]) for n in names) for row in cursor.fetchall()), key=_sortable
    )
    if len(rows) != len(expected):
        found.append(f"{len(rows)} rows != {len(expected)}")
    for mine, theirs in zip(rows, expected):
        if mine != theirs:
            found.append(f"{names}: {mine} != {theirs}")
            if len(found) > 3:
                break
    return found
