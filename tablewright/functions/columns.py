"""Type classes, missing-value predicates and column selection."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
NUMERIC = INTEGRAL + FLOATING + (T.DecimalType,)
DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.StructType, T.MapType)


def type_class(data_type: T.DataType) -> str:
    """`numeric`, `boolean`, `text`, `datetime` or `other`; booleans are never numeric."""
    if isinstance(data_type, NUMERIC):
        return "numeric"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(data_type, DATETIME):
        return "datetime"
    return "other"


def quoted(name: str) -> str:
    """`name` as one SQL identifier, so dots and blanks in column names stay literal."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def by_position(df: DataFrame) -> DataFrame:
    """The table with columns named f0, f1, ... so that internal names cannot meet the user's."""
    return df.toDF(*[f"f{i}" for i in range(len(df.columns))])


def positions(df: DataFrame, names: Iterable[str]) -> list[str]:
    """What `by_position` calls the named columns."""
    return [f"f{df.columns.index(name)}" for name in names]


def free_name(name: str, taken: Iterable[str]) -> str:
    """`name`, with underscores behind it until no column has it, in whatever case."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def field_of(df: DataFrame, name: str) -> T.StructField:
    for field in df.schema.fields:
        if field.name == name:
            return field
    raise KeyError(f"no column is called {name!r}")


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    known = set(df.columns)
    unknown = [name for name in names if name not in known]
    if unknown:
        raise KeyError(f"no columns are called {unknown}; there are {sorted(known)}")


def require_numeric(df: DataFrame, name: str) -> T.StructField:
    field = field_of(df, name)
    if type_class(field.dataType) != "numeric":
        raise ValueError(f"{name!r} holds {field.dataType.simpleString()}, but numbers are asked for")
    return field


def columns_of_class(df: DataFrame, *classes: str) -> list[str]:
    return [f.name for f in df.schema.fields if type_class(f.dataType) in classes]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_class(df, "numeric")


# SQL text is the cheap way to name many expressions at once: one call parses a whole select list.


def text_literal(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def number_literal(value: float | None) -> str:
    """A double literal; None is a null double."""
    if value is None:
        return "CAST(NULL AS DOUBLE)"
    if math.isnan(value) or math.isinf(value):
        return f"CAST('{value}' AS DOUBLE)"
    return f"({float(value)!r}D)"


def present_sql(field: T.StructField) -> str:
    """The column with NaN turned into null, so that null is the only missing value."""
    name = quoted(field.name)
    if isinstance(field.dataType, FLOATING):
        return f"nanvl({name}, CAST(NULL AS {field.dataType.simpleString()}))"
    return name


def double_sql(field: T.StructField) -> str:
    """Numeric column as double: NaN is null and -0.0 is 0.0."""
    return f"(CAST({present_sql(field)} AS DOUBLE) + 0D)"


def missing_sql(field: T.StructField) -> str:
    name = quoted(field.name)
    if isinstance(field.dataType, FLOATING):
        return f"({name} IS NULL OR isnan({name}))"
    return f"({name} IS NULL)"


def percentage_sql(part: str, whole: str, digits: int) -> str:
    """100 * part / whole, rounded; 0.0 for an empty whole."""
    return f"coalesce(round({_share(part, whole)}, {digits}), 0D)"


def share_sql(part: str, whole: str) -> str:
    """100 * part / whole without rounding; 0.0 for an empty whole."""
    return f"coalesce({_share(part, whole)}, 0D)"


def _share(part: str, whole: str) -> str:
    return f"try_divide(CAST({part} AS DOUBLE), CAST({whole} AS DOUBLE)) * 100D"


def present(field: T.StructField) -> Column:
    return F.expr(present_sql(field))


def as_double(field: T.StructField) -> Column:
    return F.expr(double_sql(field))


def missing(field: T.StructField) -> Column:
    return F.expr(missing_sql(field))


def nan_to_null(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    wanted = set(df.columns if names is None else names)
    floats = [f for f in df.schema.fields if f.name in wanted and isinstance(f.dataType, FLOATING)]
    if not floats:
        return df
    return df.withColumns({f.name: present(f) for f in floats})
