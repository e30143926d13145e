"""Registry of queries, table loading and SQL fragments shared by the catalogue."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablewright.functions.columns import FLOATING, INTEGRAL, column

DIGITS = 6

# Ranges of this size make ordered operators cross range borders at test sizes already.
SMALL_RANGE = 4096


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


class Tables:
    """The parquet tables of one directory, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self._folder}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        return self.read(name)

    @property
    def events_n(self) -> DataFrame:
        """`events` with missing values put in at known places."""
        return self.events.selectExpr("*", *[f"{sql} AS {name}" for name, sql in INJECTED.items()])


# Missing values put into `events`, the same in Spark SQL and in the comparison SQL.
INJECTED = {
    "value_n": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END",
    "value_run": (
        "CASE WHEN event_id % 7 IN (0, 1) OR event_id BETWEEN 3000 AND 6100 OR event_id > 9990 "
        "THEN NULL ELSE value END"
    ),
    "type_n": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END",
}
EVENTS_N = "(SELECT *, " + ", ".join(f"{sql} AS {name}" for name, sql in INJECTED.items()) + " FROM events)"

EVENTS_COLUMNS = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
    "value": "double", "props": "string",
}
EVENTS_N_COLUMNS = EVENTS_COLUMNS | {"value_n": "double", "value_run": "double", "type_n": "string"}
LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
WIDTHS = {"bigint": 8, "double": 8, "timestamp_ntz": 8, "int": 4, "string": 4}


def canonical(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Whole numbers as bigint and fractions rounded, for comparing values across engines."""
    out = []
    for field in df.schema.fields:
        value = column(field.name)
        if isinstance(field.dataType, INTEGRAL):
            value = value.cast("bigint")
        elif isinstance(field.dataType, FLOATING + (T.DecimalType,)):
            value = F.round(value.cast("double"), digits) + F.lit(0.0)
        out.append(value.alias(field.name))
    return df.select(*out)


def query(key: str, sql: str | None = None, raw: bool = False):
    """Register `f(tables) -> DataFrame`; results are made canonical unless `raw`."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            result = build(Tables(spark, folder))
            return result if raw else canonical(result)

        REGISTRY[key] = Entry(run, sql)
        return build

    return register


def union(columns, statement: Callable[..., str]) -> str:
    """UNION ALL of one statement per column; `columns` is a list of names or a dict name -> type."""
    if isinstance(columns, dict):
        return " UNION ALL ".join(statement(name, kind) for name, kind in columns.items())
    return " UNION ALL ".join(statement(name) for name in columns)


def numbers(columns: dict[str, str]) -> list[str]:
    return [name for name, kind in columns.items() if kind in ("bigint", "int", "double")]


def pct(part: str, whole: str, digits: int) -> str:
    return f"coalesce(round(100.0 * ({part}) / nullif(({whole}), 0), {digits}), 0.0)::DOUBLE"


def byte_text(size: str) -> str:
    """1024-based size with one decimal."""
    return (
        f"CASE WHEN {size} < 1024 THEN printf('%.1f B', {size}::DOUBLE) "
        f"WHEN {size} < 1048576 THEN printf('%.1f KB', {size} / 1024.0) "
        f"WHEN {size} < 1073741824 THEN printf('%.1f MB', {size} / 1048576.0) "
        f"ELSE printf('%.1f GB', {size} / 1073741824.0) END"
    )


def column_bytes(name: str, kind: str) -> str:
    fixed = f"{WIDTHS[kind]} * count(*)"
    return f"({fixed} + coalesce(sum(strlen({name})), 0))::BIGINT" if kind == "string" else f"({fixed})::BIGINT"


def fences_sql(source: str, name: str, multiplier: float = 1.5) -> str:
    """One row: q1, q3, lo, hi of a column."""
    return (
        f"(SELECT q1, q3, q1 - {multiplier} * (q3 - q1) AS lo, q3 + {multiplier} * (q3 - q1) AS hi FROM "
        f"(SELECT quantile_cont({name}::DOUBLE, 0.25) AS q1, quantile_cont({name}::DOUBLE, 0.75) AS q3 FROM {source}))"
    )
