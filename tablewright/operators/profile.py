"""Table and column profile: every table here is a projection of one aggregate pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.functions.columns import (
    field_of, number_literal, percentage_sql, present_sql, text_literal, type_class,
)
from tablewright.functions.display import bytes_sql, iso_sql
from tablewright.functions.parsing import DATETIME_SHARE
from tablewright.operators.cardinality import distinct_counts
from tablewright.operators.duplicates import duplicate_counts
from tablewright.operators.facts import FieldFacts, Facts, inline_rows, named_struct, small_sorted
from tablewright.operators.ordering import first_values
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.tables import empty_table, local_table

# Readable names of types.
READABLE_TYPES = {
    T.ByteType: "Integer", T.ShortType: "Integer", T.IntegerType: "Integer", T.LongType: "Integer",
    T.FloatType: "Float", T.DoubleType: "Float", T.DecimalType: "Decimal",
    T.StringType: "Text/Object", T.BooleanType: "Boolean",
    T.DateType: "DateTime", T.TimestampType: "DateTime", T.TimestampNTZType: "DateTime",
}

# Savings from narrower types, as shares of the column's bytes.
BYTE_RANGE_SAVING = 0.875
SHORT_RANGE_SAVING = 0.75
REPEATED_TEXT_SAVING = 0.5
REPEATED_TEXT_RATIO = 0.05


def _facts(df: DataFrame, facts: Facts | None, *only: str) -> Facts:
    return facts if facts is not None else Facts.of(df, only=only)


def basic_stats(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Rows, columns, estimated megabytes and column names."""
    sizes = _facts(df, facts, "octets").table(lambda c: {"rows": "rows", "bytes": c.bytes})
    names = ", ".join(text_literal(n) for n in df.columns)
    return sizes.selectExpr(
        "max(rows) AS n_rows", f"CAST({len(df.columns)} AS BIGINT) AS n_cols",
        "round(sum(bytes) / 1048576D, 3) AS memory_mb", f"array({names}) AS column_names",
    )


def missing_by_column(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    table = _facts(df, facts, "missing").table(
        lambda c: {
            "column": c.name,
            "dtype": c.dtype,
            "null_count": c("missing"),
            "null_pct": percentage_sql(c("missing"), "rows", 2),
            "non_null_count": c.filled,
        }
    )
    return small_sorted(table, "null_count DESC", "null_pct DESC", "column")


def missing_totals(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Missing cells and rows with any missing value, over the whole table."""
    facts = _facts(df, facts, "missing", "rows_with_missing")
    per_pass = [
        row.selectExpr(
            f"{'rows' if i == 0 else '0L'} AS rows",
            f"{' + '.join(e('missing') for e in entries)} AS missing_cells",
            f"{'rows_with_missing' if i == 0 else '0L'} AS rows_with_missing",
        )
        for i, (entries, row) in enumerate(facts.passes)
    ]
    if len(per_pass) == 1:
        summed = per_pass[0]
    else:
        summed = reduce(DataFrame.unionAll, per_pass).selectExpr(
            "sum(rows) AS rows", "sum(missing_cells) AS missing_cells",
            "sum(rows_with_missing) AS rows_with_missing",
        )
    cells = f"CAST({len(facts.fields)} AS BIGINT) * rows"
    return summed.selectExpr(
        f"{cells} AS total_cells", "missing_cells AS total_missing",
        f"{percentage_sql('missing_cells', f'({cells})', 4)} AS missing_pct",
        "rows_with_missing AS rows_with_any_null",
        f"{percentage_sql('rows_with_missing', 'rows', 4)} AS rows_with_any_null_pct",
    )


def rows_with_missing(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    return missing_totals(df, facts).select("rows_with_any_null", "rows_with_any_null_pct")


def columns_with_missing(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    return missing_by_column(df, facts).filter("null_count > 0").select("column", "null_count", "null_pct")


def data_types(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Stored and inferred type of each column; text is tested value by value over the whole column."""

    def row(c: FieldFacts) -> dict[str, str]:
        inferred, all_dates = c.dtype, str(c.kind == "datetime").lower()
        if c.kind == "text":
            all_dates = f"{c('dates')} = {c.filled}"
            inferred = (
                f"CASE WHEN {c('numbers')} = {c.filled} THEN 'numeric_possible' "
                f"WHEN {all_dates} THEN 'datetime_possible' ELSE 'object' END"
            )
        return {
            "column": c.name,
            "dtype": c.dtype,
            "inferred": inferred,
            "is_datetime": all_dates,
            "is_numeric": str(c.kind == "numeric").lower(),
        }

    return _facts(df, facts, "missing", "numbers", "dates").table(row)


def datetime_columns_by_value(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    return data_types(df, facts).select("column", "is_datetime")


def skewness_kurtosis(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Bias-adjusted skewness and excess kurtosis of each numeric column."""
    table = _facts(df, facts, "skewness", "kurtosis").table(
        lambda c: {
            "column": c.name,
            "skewness": f"round({c('skewness')}, 6)",
            "kurtosis": f"round({c('kurtosis')}, 6)",
        },
        where=lambda c: c.kind == "numeric",
    )
    return table or empty_table(df.sparkSession, "column string, skewness double, kurtosis double")


def standard_deviations(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    table = _facts(df, facts, "std_samp").table(
        lambda c: {"column": c.name, "std": c("std_samp")}, where=lambda c: c.kind == "numeric"
    )
    if table is None:
        return empty_table(df.sparkSession, "column string, std double")
    return small_sorted(table, "std DESC", "column")


def column_ranges(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Type, nulls, range, mean and population deviation of each column; datetime ranges as ISO text."""

    def row(c: FieldFacts) -> dict[str, str]:
        is_datetime = c.kind == "datetime"
        return {
            "ordinal": str(c.ordinal),
            "column": c.name,
            "dtype": c.dtype,
            "nulls": c("missing"),
            "null_pct": percentage_sql(c("missing"), "rows", 4),
            "min": f"CAST({c('min')} AS DOUBLE)",
            "max": f"CAST({c('max')} AS DOUBLE)",
            "min_iso": iso_sql(c("first")) if is_datetime else "CAST(NULL AS STRING)",
            "max_iso": iso_sql(c("last")) if is_datetime else "CAST(NULL AS STRING)",
            "mean": f"CAST({c('mean')} AS DOUBLE)",
            "std": f"CAST({c('std_pop')} AS DOUBLE)",
        }

    return _facts(df, facts, "missing", "min", "max", "first", "last", "mean", "std_pop").table(row)


def column_statistics(
    df: DataFrame, facts: Facts | None = None, distinct: DataFrame | None = None, examples: DataFrame | None = None
) -> DataFrame:
    """`column_ranges` with distinct counts and, if given, example values."""
    distinct = distinct if distinct is not None else distinct_counts(df)
    # One row per column on either side.
    table = column_ranges(df, facts).join(
        F.broadcast(distinct.selectExpr("column", "unique_values AS unique")), "column", "left"
    )
    kept = ["column", "dtype", "nulls", "null_pct", "unique", "min", "max", "min_iso", "max_iso", "mean", "std"]
    if examples is not None:
        table = table.join(F.broadcast(examples), "column", "left")
        kept.append("coalesce(example_values, '') AS example_values")
    return small_sorted(table, "ordinal").selectExpr(*kept)


def memory_by_column(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Estimated bytes of each column in Spark's uncompressed row format, with its share."""
    facts = _facts(df, facts, "octets")
    totals = {e.ordinal: " + ".join(o.bytes for o in es) for es, _ in facts.passes for e in es}
    table = facts.table(
        lambda c: {
            "column": c.name, "dtype": c.dtype, "est_bytes": c.bytes, "total_bytes": totals[c.ordinal],
        }
    )
    if len(facts.passes) > 1:
        table = table.withColumn("total_bytes", table.selectExpr("sum(est_bytes) AS total").scalar())
    table = table.selectExpr(
        "column", "dtype", "est_bytes", f"{bytes_sql('est_bytes')} AS formatted",
        f"{percentage_sql('est_bytes', 'total_bytes', 2)} AS pct",
    )
    return small_sorted(table, "est_bytes DESC", "column")


def memory_by_type(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Estimated bytes and number of the columns of each type."""
    facts = _facts(df, facts, "octets")
    per_column = facts.table(lambda c: {"dtype": c.dtype, "bytes": c.bytes})
    # One group per type name, and a table of types that fits one row each.
    kinds = per_column.groupBy("dtype").agg(
        F.sum("bytes").alias("est_bytes"), F.count(F.lit(1)).alias("columns_count")
    )
    listed = kinds.selectExpr("collect_list(struct(*)) AS kinds", "sum(est_bytes) AS total")
    return listed.selectExpr("total", "inline(kinds)").selectExpr(
        "dtype", "est_bytes", f"{bytes_sql('est_bytes')} AS formatted",
        f"{percentage_sql('est_bytes', 'total', 2)} AS pct", "columns_count",
    )


def memory_total(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    sizes = _facts(df, facts, "octets").table(lambda c: {"est_bytes": c.bytes})
    total = sizes.selectExpr("coalesce(sum(est_bytes), 0) AS est_bytes")
    return total.selectExpr("est_bytes", f"{bytes_sql('est_bytes')} AS formatted")


def memory_saving(df: DataFrame, facts: Facts | None = None, distinct: DataFrame | None = None) -> DataFrame:
    """Bytes that narrower integers and dictionary-encoded text would save, per column."""
    facts = _facts(df, facts, "octets", "whole_min", "whole_max")
    text = [f.name for f in facts.fields if type_class(f.dataType) == "text"]

    def row(c: FieldFacts) -> dict[str, str]:
        share = "0D"
        if isinstance(c.field.dataType, T.LongType):
            low, high = c("whole_min"), c("whole_max")
            share = (
                f"CASE WHEN {low} >= -128 AND {high} <= 127 THEN {BYTE_RANGE_SAVING}D "
                f"WHEN {low} >= -32768 AND {high} <= 32767 THEN {SHORT_RANGE_SAVING}D ELSE 0D END"
            )
        return {
            "ordinal": str(c.ordinal),
            "column": c.name,
            "rows": "rows",
            "is_text": str(c.kind == "text").lower(),
            "est_bytes": c.bytes,
            "share": share,
        }

    table = facts.table(row)
    share = "share"
    if text:
        distinct = distinct if distinct is not None else distinct_counts(df, text)
        # One row per column on either side.
        table = table.join(F.broadcast(distinct.select("column", "unique_values")), "column", "left")
        share = (
            f"IF(is_text AND unique_values < rows * {REPEATED_TEXT_RATIO}D, {REPEATED_TEXT_SAVING}D, share)"
        )
    table = table.selectExpr("ordinal", "column", "est_bytes", f"round(est_bytes * {share}, 1) AS saving_bytes")
    return small_sorted(table, "ordinal").drop("ordinal")


def memory_saving_total(df: DataFrame, facts: Facts | None = None, distinct: DataFrame | None = None) -> DataFrame:
    total = memory_saving(df, facts, distinct).selectExpr(
        "sum(est_bytes) AS est_bytes", "floor(sum(saving_bytes)) AS saving_bytes"
    )
    return total.selectExpr(
        "est_bytes", "saving_bytes", f"{percentage_sql('saving_bytes', 'est_bytes', 2)} AS saving_pct"
    )


def column_classes(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Which columns count as numeric, categorical and datetime, text judged by all its values."""

    def row(c: FieldFacts) -> dict[str, str]:
        numeric = str(c.kind == "numeric").lower()
        dates = str(c.kind == "datetime").lower()
        categorical = str(c.kind == "boolean").lower()
        if c.kind == "text":
            numeric = f"({c.filled} > 0 AND {c('numbers')} = {c.filled})"
            dates = (
                f"({c.filled} > 0 AND ({c('dates')} = {c.filled} "
                f"OR {c('date_like_dashed')} > {c.filled} * {DATETIME_SHARE}D))"
            )
            categorical = f"NOT {numeric} AND NOT {dates}"
        return {"column": c.name, "numeric": numeric, "categorical": categorical, "datetime": dates}

    return _facts(df, facts, "missing", "numbers", "dates", "date_like_dashed").table(row)


def column_overview(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    return _facts(df, facts, "missing", "octets").table(
        lambda c: {
            "column": c.name,
            "dtype": c.dtype,
            "non_null_count": c.filled,
            "memory": bytes_sql(c.bytes),
        }
    )


def type_distribution(df: DataFrame) -> DataFrame:
    """Columns per stored type with a readable label; reads the schema only."""
    counts: dict[str, tuple[str, int]] = {}
    for field in df.schema.fields:
        name = field.dataType.simpleString()
        label = READABLE_TYPES.get(type(field.dataType), name)
        counts[name] = (label, counts.get(name, (label, 0))[1] + 1)
    rows = [(name, label, n) for name, (label, n) in counts.items()]
    return local_table(df.sparkSession, rows, "dtype string, label string, columns_count bigint")


def example_values(df: DataFrame, order_by: list[str], k: int = 3) -> DataFrame:
    """First `k` non-missing values of each column in row order, joined by ', '.

    Each column is a separate bounded top-k (every task keeps `k` rows), so nothing is sorted.
    """
    entries = first_values(df, [f.name for f in df.schema.fields], order_by, k)
    in_order = "transform(sort_array(collect_list(entry)), entry -> entry.text)"
    return entries.groupBy("column").agg(F.expr(f"array_join({in_order}, ', ') AS example_values"))


def describe_columns(df: DataFrame, names: list[str], probabilities: list[float] | None = None) -> DataFrame:
    """count, mean, std, min, quantiles, max of numeric columns, one row per column and statistic."""
    probabilities = probabilities or [0.25, 0.5, 0.75]
    found = exact_quantiles(df, {name: probabilities for name in names})

    def row(c: FieldFacts) -> dict[str, str]:
        entries = [
            ("count", c.filled), ("mean", c("mean")), ("std", c("std_samp")), ("min", c("min")),
            *[(f"{p * 100:g}%", number_literal(found.value(c.field.name, p))) for p in probabilities],
            ("max", c("max")),
        ]
        structs = [
            named_struct({"statistic": text_literal(stat), "value": f"CAST({sql} AS DOUBLE)"})
            for stat, sql in entries
        ]
        return {"column": c.name, "entries": f"array({', '.join(structs)})"}

    table = Facts.of(df, names, ("missing", "mean", "std_samp", "min", "max")).table(row)
    return table.selectExpr("column", "inline(entries)")


def value_counts(df: DataFrame, name: str, k: int | None = None) -> DataFrame:
    """Most frequent non-missing values, ties by value."""
    values = df.selectExpr(f"{present_sql(field_of(df, name))} AS value").filter("value IS NOT NULL")
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.orderBy(F.desc("n"), F.asc("value"))
    return ordered.limit(k) if k is not None else ordered


def quick_metrics(df: DataFrame, facts: Facts | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """Rows, columns, bytes, missing share and surplus duplicates as (metric, value)."""
    facts = (facts or Facts.of(df, only=("missing", "octets", "rows_with_missing"))).collected()
    duplicates = duplicates if duplicates is not None else duplicate_counts(df)
    sizes = facts.table(lambda c: {"rows": "rows", "bytes": c.bytes}).selectExpr(
        "CAST(max(rows) AS DOUBLE) AS rows", "CAST(sum(bytes) AS DOUBLE) AS bytes"
    )
    values = {"rows": "rows", "columns": f"{len(df.columns)}D", "est_bytes": "bytes"}
    listed = inline_rows([{"metric": text_literal(name), "value": sql} for name, sql in values.items()])
    return (
        sizes.selectExpr(listed)
        .unionAll(missing_totals(df, facts).selectExpr("'missing_pct'", "missing_pct"))
        .unionAll(duplicates.selectExpr("'duplicates'", "CAST(n_surplus_rows AS DOUBLE)"))
    )
