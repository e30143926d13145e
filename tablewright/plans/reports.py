"""Whole-table reports: the analysis as a set of tables, and before/after comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, functions as F

from tablewright.functions.columns import (
    double_sql, field_of, missing_sql, percentage_sql, present_sql, quoted, text_literal, type_class,
)
from tablewright.operators import cardinality, charts, correlation, duplicates, outliers, profile
from tablewright.operators.facts import Facts, inline_rows
from tablewright.operators.tables import computed
from tablewright.plans import score

# Rows shown in the dashboard and the comparison, unless the caller says otherwise (None for all).
DASHBOARD_COLUMNS, DASHBOARD_OUTLIERS = 10, 5
COMPARED_VALUES = 10


def analysis_report(df: DataFrame, order_by: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """All profile tables. Counters, moments and fences are computed once and shared by the tables."""
    facts = Facts.of(df).collected()
    bounds = outliers.fences(df)
    distinct = computed(cardinality.distinct_counts(df))
    repeated = computed(duplicates.duplicate_counts(df))
    examples = profile.example_values(df, list(order_by)) if order_by else None
    return {
        "basic_stats": profile.basic_stats(df, facts),
        "missing_by_column": profile.missing_by_column(df, facts),
        "missing_totals": profile.missing_totals(df, facts),
        "data_types": profile.data_types(df, facts),
        "cardinality": distinct.select("column", "unique_values", "unique_ratio"),
        "outliers_iqr": outliers.detect_outliers_iqr(df, order_by, bounds),
        "outliers_zscore": outliers.detect_outliers_zscore(df, order_by=order_by, facts=facts),
        "skewness_kurtosis": profile.skewness_kurtosis(df, facts),
        "duplicates": repeated,
        "correlation_matrix": correlation.correlation_matrix(df),
        "column_statistics": profile.column_statistics(df, facts, distinct, examples),
        "usability": score.usability_score(df, facts, repeated, bounds),
        "standard_deviation": profile.standard_deviations(df, facts),
    }


def report_overview(report: dict[str, DataFrame]) -> DataFrame:
    """(section, rows) of an analysis report."""
    parts = [
        table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "n")
        for section, table in report.items()
    ]
    return reduce(DataFrame.unionAll, parts)


def report_values(report: dict[str, DataFrame]) -> DataFrame:
    """(section, item, measure, value): all numbers of an analysis report as one long table; items are the texts that name a row."""
    parts = []
    for section, table in report.items():
        texts = [f.name for f in table.schema.fields if type_class(f.dataType) == "text" and f.name in ("column", "col_a", "col_b")]
        numbers = [f.name for f in table.schema.fields if type_class(f.dataType) == "numeric"]
        if not numbers:
            continue
        item = f"concat_ws('~', {', '.join(map(quoted, texts))})" if texts else "''"
        cells = ", ".join(f"struct({text_literal(n)} AS measure, CAST({quoted(n)} AS DOUBLE) AS value)" for n in numbers)
        parts.append(table.selectExpr(f"{text_literal(section)} AS section", f"{item} AS item", f"inline(array({cells}))"))
    return reduce(DataFrame.unionAll, parts)


def cleaning_metrics(original: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(metric, before, after, change): rows, columns, bytes, missing cells, surplus duplicates.

    Duplicates are compared only if both tables have the same set of columns.
    """
    def measures(df: DataFrame, side: str) -> DataFrame:
        facts = Facts.of(df, only=("missing", "octets"))
        sums = facts.table(lambda c: {"rows": "rows", "missing": c("missing"), "bytes": c.bytes}).selectExpr(
            "max(rows) AS rows", "sum(missing) AS missing", "sum(bytes) AS bytes"
        )
        values = {
            "rows": "rows", "columns": f"{len(df.columns)}L", "est_bytes": "bytes", "missing_cells": "missing",
        }
        return sums.selectExpr(inline_rows([{"metric": f"'{m}'", side: sql} for m, sql in values.items()]))

    before, after = measures(original, "before"), measures(cleaned, "after")
    if set(original.columns) == set(cleaned.columns):
        before = before.unionAll(duplicates.duplicate_counts(original).selectExpr("'duplicates'", "n_surplus_rows"))
        after = after.unionAll(duplicates.duplicate_counts(cleaned).selectExpr("'duplicates'", "n_surplus_rows"))
    # Five rows on either side.
    return before.join(F.broadcast(after), "metric").selectExpr(
        "metric", "before", "after", "after - before AS change"
    )


def _size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} PB"


def cleaning_report_text(metrics: DataFrame, steps: Sequence[dict[str, Any]]) -> str:
    """The metrics (five rows) and the steps as Markdown."""
    found = {row["metric"]: row for row in metrics.collect()}
    lines = ["# Cleaning report", "", "| metric | before | after | change |", "|---|---:|---:|---:|"]
    for metric in ("rows", "columns", "est_bytes", "missing_cells", "duplicates"):
        if metric in found:
            row = found[metric]
            show = _size if metric == "est_bytes" else (lambda n: f"{n:,}")
            change = ("-" if row["change"] < 0 else "") + show(abs(row["change"]))
            lines.append(f"| {metric} | {show(row['before'])} | {show(row['after'])} | {change} |")
    lines += ["", "## Steps", ""]
    for i, step in enumerate(steps, start=1):
        target = f" on `{step['column']}`" if step.get("column") else ""
        parameters = f" {step['parameters']}" if step.get("parameters") else ""
        lines.append(f"{i}. {step['operation']}{target}{parameters}")
    if not steps:
        lines.append("The table was left as it is.")
    return "\n".join(lines) + "\n"


def compare_column(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """(metric, before, after, delta) of one column: values, missing, and mean or distinct values."""
    is_number = type_class(field_of(before, name).dataType) == "numeric"

    def measures(df: DataFrame, side: str) -> DataFrame:
        field = field_of(df, name)
        detail = f"round(avg({double_sql(field)}), 2)" if is_number else f"count(DISTINCT {present_sql(field)})"
        row = df.selectExpr(
            f"CAST(count({present_sql(field)}) AS DOUBLE) AS n",
            f"CAST(count_if({missing_sql(field)}) AS DOUBLE) AS missing", f"CAST({detail} AS DOUBLE) AS detail",
        )
        values = {"count": "n", "missing": "missing", "mean" if is_number else "unique": "detail"}
        return row.selectExpr(inline_rows([{"metric": f"'{m}'", side: sql} for m, sql in values.items()]))

    # Three rows on either side.
    joined = measures(before, "before").join(F.broadcast(measures(after, "after")), "metric")
    return joined.selectExpr("metric", "before", "after", "round(after - before, 2) AS delta")


def compare_distribution(before: DataFrame, after: DataFrame, name: str, k: int | None = COMPARED_VALUES) -> DataFrame:
    """Histogram (numbers) or the `k` most frequent values (others; None for all) of a column on both sides."""
    is_number = type_class(field_of(before, name).dataType) == "numeric"

    def counts(df: DataFrame, side: str) -> DataFrame:
        if is_number:
            table = charts.histogram(df, name).select(F.col("bin").cast("string").alias("value"), "n")
        else:
            table = profile.value_counts(df, name, k).select(F.col("value").cast("string"), "n")
        return table.select(F.lit(side).alias("side"), "value", "n")

    return counts(before, "before").unionAll(counts(after, "after"))


def dashboard(df: DataFrame, missing_listed: int | None = DASHBOARD_COLUMNS, outliers_listed: int | None = DASHBOARD_OUTLIERS) -> DataFrame:
    """(panel, item, value): size, missing share, types, outliers and score for an overview page.

    The `missing_listed` columns with most missing values are listed. Outliers list the columns that have any, or
    the first `outliers_listed` columns if none has. None lists all.
    """
    facts = Facts.of(df, only=("missing", "rows_with_missing")).collected()
    bounds = outliers.fences(df)
    repeated = duplicates.duplicate_counts(df)
    by_column = facts.table(
        lambda c: {"place": str(c.ordinal), "item": c.name, "n": c("missing"),
                   "value": percentage_sql(c("missing"), "rows", 2)}
    )
    counts = outliers.detect_outliers_iqr(df, bounds=bounds)
    names = ", ".join(text_literal(n) for n in df.columns)
    placed = counts.selectExpr("column", "outliers_iqr", f"array_position(array({names}), column) AS place")
    most = placed.selectExpr("max(outliers_iqr) AS most").scalar()
    clean = placed.filter(most == 0).orderBy("place")
    listed = placed.filter("outliers_iqr > 0").unionAll(clean if outliers_listed is None else clean.limit(outliers_listed))
    gaps = by_column.orderBy(F.desc("n"), "place")
    gaps = gaps if missing_listed is None else gaps.limit(missing_listed)
    panels = [
        facts.totals(panel="'size'", item="'rows'", value="CAST(rows AS DOUBLE)"),
        facts.totals(panel="'size'", item="'columns'", value=f"{len(df.columns)}D"),
        profile.missing_totals(df, facts).selectExpr("'missing'", "'total'", "missing_pct"),
        gaps.selectExpr("'missing'", "item", "value"),
        profile.type_distribution(df).selectExpr("'types'", "dtype", "CAST(columns_count AS DOUBLE)"),
        listed.selectExpr("'outliers'", "column", "CAST(outliers_iqr AS DOUBLE)"),
        score.usability_score(df, facts, repeated, bounds).selectExpr("'score'", "'score'", "CAST(score AS DOUBLE)"),
    ]
    return reduce(DataFrame.unionAll, panels)
