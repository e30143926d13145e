"""Missing-value treatment of one column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.columns import (
    as_double, column, field_of, missing, missing_sql, present, require_numeric, text_literal, type_class,
)
from tablewright.operators import ordering
from tablewright.operators.quantiles import exact_quantiles

# Method names.
NUMERIC_METHODS = (
    "mean", "median", "mode", "forward_fill", "backward_fill", "interpolate", "constant", "drop",
)
CATEGORICAL_METHODS = ("mode", "constant", "forward_fill", "backward_fill", "new_category", "drop")

# Fill texts.
DEFAULT_CONSTANT = "Unknown"
NEW_CATEGORY = "Missing"


def most_frequent(df: DataFrame, name: str) -> Column:
    """Most frequent value, smallest on ties, null without any value; found now, as one row.

    The row stays a Spark table, so the value keeps its exact type.
    """
    values = df.select(present(field_of(df, name)).alias("value")).filter("value IS NOT NULL")
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc("value")).limit(1).select("value")
    return df.sparkSession.createDataFrame(top.toArrow(), top.schema).scalar()


def _replace(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select(*[value.alias(name) if c == name else column(c) for c in df.columns])


def _exact_literal(field: T.StructField, value: Any) -> Column:
    """A constant in the column's type; ValueError if the type cannot hold it exactly."""
    kind = type_class(field.dataType)
    if kind == "text":
        return F.lit(str(value)).cast(field.dataType)
    if kind == "datetime":
        return F.lit(str(value)).cast(field.dataType)
    if kind == "boolean" and isinstance(value, bool):
        return F.lit(value).cast(field.dataType)
    if kind == "numeric" and isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        if _fits(field.dataType, value):
            return F.lit(value).cast(field.dataType)
    raise ValueError(f"{field.name!r} holds {field.dataType.simpleString()}, which has no place for {value!r}; change the type first")


def _fits(kind: T.DataType, value: int | float | Decimal) -> bool:
    """Whether the type holds the number exactly; fractions may be rounded to the type's precision if it is binary."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return True
    exact = Decimal(str(value))
    if not exact.is_finite():
        return False
    if isinstance(kind, T.DecimalType):
        return exact == round(exact, kind.scale) and abs(exact) < Decimal(10) ** (kind.precision - kind.scale)
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}[type(kind)]
    return exact == int(exact) and -(1 << (bits - 1)) <= exact < 1 << (bits - 1)


def _drop(df: DataFrame, field: T.StructField) -> DataFrame:
    return df.filter(~missing(field))


def fill_mean(df: DataFrame, name: str) -> DataFrame:
    value = as_double(require_numeric(df, name))
    mean = df.agg(F.avg(value)).first()[0]
    return _replace(df, name, F.coalesce(value, F.lit(mean).cast("double")))


def fill_median(df: DataFrame, name: str) -> DataFrame:
    value = as_double(require_numeric(df, name))
    median = exact_quantiles(df, {name: [0.5]}).value(name, 0.5)
    return _replace(df, name, F.coalesce(value, F.lit(median).cast("double")))


def fill_mode(df: DataFrame, name: str) -> DataFrame:
    return _replace(df, name, F.coalesce(present(field_of(df, name)), most_frequent(df, name)))


def fill_constant(df: DataFrame, name: str, value: Any) -> DataFrame:
    field = field_of(df, name)
    return _replace(df, name, F.coalesce(present(field), _exact_literal(field, value)))


def drop_missing(df: DataFrame, name: str) -> DataFrame:
    return _drop(df, field_of(df, name))


def _ordered(
    fill: Callable[..., DataFrame], df: DataFrame, name: str, order_by: Sequence[str] | None, **options: Any
) -> DataFrame:
    if not order_by:
        raise ValueError("fills that follow the row order need order_by")
    return fill(df, name, order_by, **options)


def handle_missing_numeric(
    df: DataFrame,
    name: str,
    method: str,
    custom_value: float | None = None,
    order_by: Sequence[str] | None = None,
    **options: Any,
) -> DataFrame:
    """Treat missing numbers; mean, median and interpolate give a double column, others keep the type."""
    field = field_of(df, name)
    if type_class(field.dataType) != "numeric":
        raise ValueError(f"{name!r} holds no numbers; treat it as a category")
    if method not in NUMERIC_METHODS:
        raise ValueError(f"{method!r} does not treat numbers; choose from {', '.join(NUMERIC_METHODS)}")
    if method == "mean":
        return fill_mean(df, name)
    if method == "median":
        return fill_median(df, name)
    if method == "constant":
        if custom_value is None:
            raise ValueError("a constant fill needs its constant in custom_value")
        return fill_constant(df, name, custom_value)
    if method == "interpolate":
        return _ordered(ordering.interpolate, df, name, order_by, **options)
    return _handle_shared(df, field, method, order_by, **options)


def handle_missing_categorical(
    df: DataFrame,
    name: str,
    method: str,
    custom_value: Any = None,
    order_by: Sequence[str] | None = None,
    **options: Any,
) -> DataFrame:
    """Treat missing values of a column of any type, keeping the type."""
    field = field_of(df, name)
    if method not in CATEGORICAL_METHODS:
        raise ValueError(f"{method!r} does not treat categories; choose from {', '.join(CATEGORICAL_METHODS)}")
    if method == "constant":
        return fill_constant(df, name, DEFAULT_CONSTANT if custom_value is None else custom_value)
    if method == "new_category":
        return fill_constant(df, name, NEW_CATEGORY)
    return _handle_shared(df, field, method, order_by, **options)


def _handle_shared(
    df: DataFrame, field: T.StructField, method: str, order_by: Sequence[str] | None, **options: Any
) -> DataFrame:
    if method == "mode":
        return fill_mode(df, field.name)
    if method == "drop":
        return _drop(df, field)
    fill = ordering.forward_fill if method == "forward_fill" else ordering.backward_fill
    return _ordered(fill, df, field.name, order_by, **options)


def missing_change(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """Missing values and rows before and after a treatment."""
    def counts(df: DataFrame, side: str) -> DataFrame:
        return df.selectExpr(
            f"count_if({missing_sql(field_of(df, name))}) AS missing_{side}", f"count(1) AS rows_{side}"
        )

    old = counts(before, "before").selectExpr("struct(*) AS old").scalar()
    return counts(after, "after").withColumn("old", old).selectExpr(
        f"{text_literal(name)} AS column", "old.missing_before", "missing_after",
        "old.missing_before - missing_after AS missing_fixed", "old.rows_before", "rows_after",
    )
