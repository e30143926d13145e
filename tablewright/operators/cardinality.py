"""Distinct values per column and the two published bandings of those counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, types as T

from tablewright.functions.columns import present_sql, share_sql, text_literal
from tablewright.operators.facts import inline_rows, small_sorted
from tablewright.operators.tables import empty_table

# Distinct counts per aggregate. Catalyst expands each input row once per counted column, with
# partial aggregation before the shuffle, so a hot value travels once per task.
COLUMNS_PER_PASS = 40

# Bytes up to which a text is counted as it is; a digest has 64.
WHOLE_TEXT = 32


def _has_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _has_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(_has_map(f.dataType) for f in data_type.fields)
    return isinstance(data_type, T.MapType)


def distinct_counts(
    df: DataFrame, names: Sequence[str] | None = None, approximate: bool = False, rsd: float = 0.02
) -> DataFrame:
    """Distinct non-missing values per column and their ratio to the rows, most distinct first.

    Maps cannot be grouped, so columns that hold them have no distinct count.
    """
    wanted = None if names is None else set(names)
    fields = [
        (i, f) for i, f in enumerate(df.schema.fields)
        if (wanted is None or f.name in wanted) and not _has_map(f.dataType)
    ]

    def count(field: T.StructField) -> str:
        value = present_sql(field)
        if approximate:
            return f"approx_count_distinct({value}, {rsd}D)"
        if isinstance(field.dataType, T.StringType):
            # Long texts travel as digests, which are longer than any text that travels itself.
            value = f"IF(octet_length({value}) <= {WHOLE_TEXT}, {value}, sha2({value}, 256))"
        return f"count(DISTINCT {value})"

    parts = []
    for start in range(0, len(fields), COLUMNS_PER_PASS):
        chunk = fields[start : start + COLUMNS_PER_PASS]
        row = df.selectExpr("count(1) AS rows", *[f"{count(f)} AS u{i}" for i, f in chunk])
        rows = [
            {"ordinal": str(i), "column": text_literal(f.name), "unique_values": f"u{i}"} for i, f in chunk
        ]
        parts.append(row.selectExpr("rows", inline_rows(rows)))
    if not parts:
        return empty_table(
            df.sparkSession, "column string, unique_values bigint, unique_ratio double, rows bigint"
        )
    table = small_sorted(reduce(DataFrame.unionAll, parts), "unique_values DESC", "ordinal")
    ratio = "coalesce(round(try_divide(unique_values, rows), 4), 0D) AS unique_ratio"
    return table.selectExpr("column", "unique_values", ratio, "rows")


def cardinality(df: DataFrame, approximate: bool = False) -> DataFrame:
    return distinct_counts(df, approximate=approximate).select("column", "unique_values", "unique_ratio")


def chart_bands(counts: DataFrame) -> DataFrame:
    """Low below 10, medium below 50, high otherwise."""
    band = "CASE WHEN unique_values < 10 THEN 'low' WHEN unique_values < 50 THEN 'medium' ELSE 'high' END"
    return counts.selectExpr("column", "unique_values", f"{band} AS band")


def table_bands(counts: DataFrame) -> DataFrame:
    """Low up to 10, medium up to 50, high above, with the unrounded share of rows."""
    category = (
        "CASE WHEN unique_values <= 10 THEN 'Low (≤10)' WHEN unique_values <= 50 THEN 'Medium (11-50)' "
        "ELSE 'High (>50)' END"
    )
    return counts.selectExpr(
        "column", "unique_values", f"{share_sql('unique_values', 'rows')} AS cardinality_pct",
        f"{category} AS category",
    )
