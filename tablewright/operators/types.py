"""Narrower and better-fitting column types, chosen from one aggregate pass over all values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, functions as F, types as T

from tablewright.functions import parsing
from tablewright.functions.columns import INTEGRAL, field_of, percentage_sql, present_sql, quoted
from tablewright.operators.cardinality import distinct_counts
from tablewright.operators.facts import FieldFacts, Facts
from tablewright.operators.ordering import with_position
from tablewright.operators.profile import memory_total
from tablewright.operators.tables import local_table

# Integer types from the narrowest, with their ranges.
INTEGER_RANGES = (
    (T.ByteType(), -(2**7), 2**7 - 1),
    (T.ShortType(), -(2**15), 2**15 - 1),
    (T.IntegerType(), -(2**31), 2**31 - 1),
    (T.LongType(), -(2**63), 2**63 - 1),
)

# Text columns at or under these are worth a dictionary.
DICTIONARY_RATIO = 0.05
DICTIONARY_VALUES = 50

# Facts that decide a column's type.
CHOICE_FACTS = (
    "missing", "whole_min", "whole_max", "float_misfits", "numbers", "integers", "date_like",
    *[f"layout_{i}" for i in range(len(parsing.DATE_LAYOUTS))],
)


@dataclass(frozen=True)
class TypeChoice:
    field: T.StructField
    to: T.DataType
    layout: int | None = None
    unparsed: int = 0

    @property
    def changed(self) -> bool:
        return self.to != self.field.dataType

    def sql(self) -> str:
        name = quoted(self.field.name)
        if not self.changed:
            return name
        if self.layout is not None:
            return parsing.timestamp_from_text(name, self.layout)
        cast = "try_cast" if isinstance(self.field.dataType, T.StringType) else "CAST"
        return f"{cast}({present_sql(self.field)} AS {self.to.simpleString()})"


def choose_types(df: DataFrame, facts: Facts | None = None) -> list[TypeChoice]:
    """A type for each column; text becomes dates or numbers only by the share of fitting values."""

    def row(c: FieldFacts) -> dict[str, str]:
        return {"ordinal": str(c.ordinal), "rows": "rows"} | {k: f"CAST({c(k)} AS BIGINT)" for k in CHOICE_FACTS}

    table = (facts or Facts.of(df, only=CHOICE_FACTS)).table(row)
    found = {r["ordinal"]: r for r in table.collect()}
    return [_choose(field, found[i]) for i, field in enumerate(df.schema.fields)]


def _choose(field: T.StructField, seen: Row) -> TypeChoice:
    filled = seen["rows"] - seen["missing"]
    if filled == 0:
        return TypeChoice(field, field.dataType)
    if isinstance(field.dataType, INTEGRAL):
        for data_type, low, high in INTEGER_RANGES:
            if low <= seen["whole_min"] and seen["whole_max"] <= high:
                return TypeChoice(field, data_type)
    if isinstance(field.dataType, T.DoubleType):
        return TypeChoice(field, T.DoubleType() if seen["float_misfits"] else T.FloatType())
    if isinstance(field.dataType, T.StringType):
        if seen["date_like"] > parsing.DATETIME_SHARE * filled:
            parsed = [seen[f"layout_{i}"] for i in range(len(parsing.DATE_LAYOUTS))]
            layout = max(range(len(parsed)), key=lambda i: parsed[i])
            if parsed[layout]:
                return TypeChoice(field, T.TimestampNTZType(), layout, filled - parsed[layout])
        if seen["numbers"] == filled:
            whole = seen["integers"] == filled
            return TypeChoice(field, T.LongType() if whole else T.DoubleType())
    return TypeChoice(field, field.dataType)


def optimize_dtypes(df: DataFrame, choices: list[TypeChoice] | None = None) -> DataFrame:
    choices = choose_types(df) if choices is None else choices
    return df.selectExpr(*[f"{c.sql()} AS {quoted(c.field.name)}" for c in choices])


def type_changes(df: DataFrame, choices: list[TypeChoice] | None = None) -> DataFrame:
    """(column, from_type, to_type, values_lost) for the columns whose type would change."""
    choices = choose_types(df) if choices is None else choices
    rows = [
        (c.field.name, c.field.dataType.simpleString(), c.to.simpleString(), c.unparsed)
        for c in choices if c.changed
    ]
    schema = "column string, from_type string, to_type string, values_lost bigint"
    return local_table(df.sparkSession, rows, schema)


def type_change_bytes(df: DataFrame, choices: list[TypeChoice] | None = None) -> DataFrame:
    """Estimated bytes of the table before and after the change of types."""
    after = memory_total(optimize_dtypes(df, choices)).agg(F.max("est_bytes").alias("b")).scalar()
    both = memory_total(df).select(F.col("est_bytes").alias("bytes_before"), after.alias("bytes_after"))
    return both.selectExpr(
        "bytes_before", "bytes_after", "bytes_before - bytes_after AS bytes_saved",
        f"{percentage_sql('(bytes_before - bytes_after)', 'bytes_before', 2)} AS saved_pct",
    )


def dictionary_advice(df: DataFrame) -> DataFrame:
    """Which text columns repeat enough for a dictionary (under 5% distinct, or under 50 values)."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    counts = distinct_counts(df, text)
    low = f"unique_values < rows * {DICTIONARY_RATIO}D OR unique_values < {DICTIONARY_VALUES}"
    return counts.selectExpr("column", "unique_values", f"{low} AS dictionary_encode")


def dictionary(df: DataFrame, name: str) -> DataFrame:
    """(code, value) with codes from 0 in value order; meant for columns that the advice names."""
    values = df.selectExpr(f"{present_sql(field_of(df, name))} AS value").filter("value IS NOT NULL").distinct()
    return with_position(values, ["value"], "code").select("code", "value")
