"""Profiles that are stored and merged: a new part of a table is added without reading the old parts.

A state has one row per column with counters, ends, moments and a distinct-count sketch, all of which merge. States
of parts are written wherever the caller likes; merged, they give the profile of the whole, with exact counters and
moments and an estimated number of distinct values (about 1 % off at 2**LOG_ENTRIES sketch entries).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tablewright.functions.columns import double_sql, missing_sql, percentage_sql, present_sql, text_literal, type_class

LOG_ENTRIES = 14
STATE = "ordinal int, column string, dtype string, rows bigint, missing bigint, low double, high double, mean double, squares double, sketch binary"


def profile_state(df: DataFrame) -> DataFrame:
    """State of a table or a part of one, from one aggregate; columns with maps have no sketch."""
    aggregates, rows = ["count(1) AS rows"], []
    for i, field in enumerate(df.schema.fields):
        number = type_class(field.dataType) == "numeric"
        value = double_sql(field) if number else "CAST(NULL AS DOUBLE)"
        hashed = "CAST(NULL AS BIGINT)" if "map<" in field.dataType.simpleString() else f"IF({missing_sql(field)}, NULL, xxhash64({present_sql(field)}))"
        aggregates += [
            f"count_if({missing_sql(field)}) AS missing{i}", f"min({value}) AS low{i}", f"max({value}) AS high{i}", f"avg({value}) AS mean{i}",
            f"var_pop({value}) * count({value}) AS squares{i}", f"hll_sketch_agg({hashed}, {LOG_ENTRIES}) AS sketch{i}",
        ]
        rows.append(
            f"struct({i} AS ordinal, {text_literal(field.name)} AS column, {text_literal(field.dataType.simpleString())} AS dtype, rows, "
            f"missing{i} AS missing, low{i} AS low, high{i} AS high, mean{i} AS mean, squares{i} AS squares, sketch{i} AS sketch)"
        )
    return df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(rows)}))")


def merged_states(*states: DataFrame) -> DataFrame:
    """One state of several parts with the same columns; a state may itself hold the rows of many parts."""
    every = reduce(DataFrame.unionByName, states)
    parts = "collect_list(IF(mean IS NULL, NULL, struct(CAST(rows - missing AS DOUBLE) AS n, mean, squares)))"
    found = every.groupBy("ordinal", "column", "dtype").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.expr(f"{parts} AS parts"), F.expr("hll_union_agg(sketch, true) AS sketch"),
    )
    count = "aggregate(parts, 0D, (s, p) -> s + p.n)"
    found = found.withColumn("mean", F.expr(f"IF(size(parts) = 0, NULL, aggregate(parts, 0D, (s, p) -> s + p.n / {count} * p.mean))"))
    squares = "IF(size(parts) = 0, NULL, aggregate(parts, 0D, (s, p) -> s + p.squares + p.n * (p.mean - mean) * (p.mean - mean))) AS squares"
    return found.selectExpr("ordinal", "column", "dtype", "rows", "missing", "low", "high", "mean", squares, "sketch")


def profile_of(state: DataFrame) -> DataFrame:
    """(column, dtype, rows, missing, missing_pct, min, max, mean, std, distinct_estimate) of a state, in column order."""
    filled = "(rows - missing)"
    return state.orderBy("ordinal").selectExpr(
        "column", "dtype", "rows", "missing", f"{percentage_sql('missing', 'rows', 4)} AS missing_pct", "low AS min", "high AS max", "mean",
        f"sqrt(try_divide(squares, CAST({filled} AS DOUBLE))) AS std", "hll_sketch_estimate(sketch) AS distinct_estimate",
    )
