"""Counts behind charts: histograms, bars, densities and the missing-value matrix."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.columns import as_double, column, double_sql, missing, require_numeric
from tablewright.operators.ordering import POSITION, ROWS_PER_RANGE, with_position
from tablewright.operators.profile import value_counts

# Bounds of the number of histogram bins, bars shown, rows of a missing-value matrix.
MIN_BINS, MAX_BINS = 10, 50
BARS = 20
MATRIX_BINS = 1000


def bin_count(df: DataFrame, name: str) -> int:
    """Distinct values, but at least 10 and at most 50; no more than 51 of them are looked at."""
    value = double_sql(require_numeric(df, name))
    few = df.selectExpr(f"{value} AS value").filter("value IS NOT NULL").distinct().limit(MAX_BINS + 1).count()
    return min(MAX_BINS, max(MIN_BINS, few))


def histogram(df: DataFrame, name: str, bins: int | None = None) -> DataFrame:
    """Equal-width bins over the finite [min, max] that hold values; the maximum belongs to the last bin.

    Infinite values have bins of their own, number -1 and `bins`, with themselves as edges.
    """
    value = as_double(require_numeric(df, name))
    bins = bin_count(df, name) if bins is None else bins
    finite = F.when(F.abs(value) < F.lit(float("inf")), value)
    low, high = df.agg(F.min(finite).alias("low"), F.max(finite).alias("high")).first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    # The range itself may be more than a double holds; then both ends are scaled first.
    width = (high / bins - low / bins) if high > low else 1.0
    if math.isinf(high - low):
        position = F.floor(finite / F.lit(width) - F.lit(low / width))
    else:
        width = (high - low) / bins if high > low else 1.0
        position = F.floor((finite - F.lit(low)) / F.lit(width))
    position = (
        F.when(value == F.lit(float("inf")), F.lit(bins)).when(value == F.lit(float("-inf")), F.lit(-1))
        .when(finite.isNotNull(), F.least(position, F.lit(bins - 1)).cast("int"))
    )
    counts = (
        df.select(position.cast("int").alias("bin")).filter("bin is not null")
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    )
    edge: Column = F.lit(low) + F.col("bin") * F.lit(width)
    outside = F.when(F.col("bin") == bins, F.lit(float("inf"))).when(F.col("bin") == -1, F.lit(float("-inf")))
    return counts.select(
        "bin", F.coalesce(outside, edge).alias("bin_low"), F.coalesce(outside, edge + F.lit(width)).alias("bin_high"), "n"
    )


def category_bars(df: DataFrame, name: str, k: int = BARS) -> DataFrame:
    return value_counts(df, name, k)


def density(df: DataFrame, name: str, bins: int | None = None) -> DataFrame:
    """Histogram counts of the finite values scaled to a density with total area 1."""
    counts = histogram(df, name, bins).filter("abs(bin_low) < double('infinity')")
    total = counts.agg(F.sum("n").alias("n")).scalar()
    width = F.col("bin_high") - F.col("bin_low")
    return counts.select("bin", "bin_low", "bin_high", (F.col("n") / (total * width)).alias("density"))


def missing_matrix(
    df: DataFrame, order_by: Sequence[str], bins: int = MATRIX_BINS, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Missing values per column in consecutive stretches of rows, as (bin, column, n_missing, n_rows)."""
    flags = df.select(
        *[column(c).alias(f"_o{i}") for i, c in enumerate(order_by)],
        *[missing(f).cast("int").alias(f"_m{i}") for i, f in enumerate(df.schema.fields)],
    )
    placed = with_position(flags, [f"_o{i}" for i in range(len(order_by))], POSITION, rows_per_range)
    total = df.agg(F.count(F.lit(1)).alias("rows")).scalar()
    per_bin = placed.groupBy(F.floor(F.col(POSITION) * F.lit(bins) / total).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(f"_m{i}").alias(f"_m{i}") for i in range(len(df.columns))],
    )
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("column"), F.col(f"_m{i}").alias("n_missing"))
            for i, name in enumerate(df.columns)
        ]
    )
    return per_bin.select("bin", "n_rows", F.inline(cells)).select("bin", "column", "n_missing", "n_rows")
