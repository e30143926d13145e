"""Pairwise Pearson correlation of numeric columns, each pair over its complete rows.

One scan of the centred columns gives the sums of all pairs: a task multiplies blocks of rows (values by values, values by
masks, squares by masks) and hands on one row per pair, so 200 columns cost as many scans as two. Python meets
the rows in Arrow batches only; a row of the result is made by Spark from sums that are keyed by pair.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from tablewright.functions.columns import double_sql, field_of, number_literal, numeric_columns, text_literal
from tablewright.operators.tables import empty_table

# Tasks get this module by value: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: strength above which a pair is reported.
STRONG = 0.7

ROWS_AT_ONCE = 4096

# Of a pair (a, b): complete rows, sums, sums of squares and products over them, infinite values, least and largest value.
SUMS = ("n", "sum_a", "sum_b", "squares_a", "squares_b", "product", "infinite")
EDGES = ("low_a", "low_b", "high_a", "high_b")
PAIR_ROW = "a int, b int, " + ", ".join(f"{x} double" for x in (*SUMS, *EDGES))


def _scaled(name: str, largest: float | None) -> str:
    """The value over a power of two near the largest one; a column with infinite values stays as it is."""
    if not largest or math.isinf(largest):
        return name
    # In two steps: the power itself may be out of range.
    half = math.frexp(largest)[1] // 2
    rest = math.frexp(largest)[1] - half
    return f"{name} * {number_literal(2.0 ** -half)} * {number_literal(2.0 ** -rest)}"


class PairSums:
    """Sums of all pairs of columns over the rows in which both have a value."""

    def __init__(self, count: int):
        self.sums = np.zeros((len(SUMS), count, count))
        # Least and largest value of a column where the other one has a value; of no more interest once they differ.
        self.low, self.high = np.full((count, count), np.inf), np.full((count, count), -np.inf)

    def add(self, values: np.ndarray) -> None:
        there, endless = ~np.isnan(values), np.isinf(values)
        plain = np.where(there & ~endless, values, 0.0)
        mask = there.astype(float)
        by_mask, squares = plain.T @ mask, (plain * plain).T @ mask
        infinite = endless.astype(float).T @ mask
        self.sums += (mask.T @ mask, by_mask, by_mask.T, squares, squares.T, plain.T @ plain, infinite + infinite.T)
        for b in np.flatnonzero((self.low >= self.high).any(axis=0)):
            rows = values[there[:, b]]
            if len(rows):
                self.low[:, b] = np.fmin(self.low[:, b], np.fmin.reduce(rows, axis=0))
                self.high[:, b] = np.fmax(self.high[:, b], np.fmax.reduce(rows, axis=0))

    def rows(self) -> pa.RecordBatch:
        a, b = np.triu_indices(len(self.low))
        columns = [*(x[a, b] for x in self.sums), self.low[a, b], self.low[b, a], self.high[a, b], self.high[b, a]]
        return pa.record_batch([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *map(pa.array, columns)], names=["a", "b", *SUMS, *EDGES])


def pair_sums(numbers: DataFrame) -> DataFrame:
    """Sums of all pairs of columns of a table of doubles, from one scan."""
    count = len(numbers.columns)

    def summed(batches):
        held = PairSums(count)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                held.add(np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]))
        yield held.rows()

    # A row of zeros per pair, for tables without partitions.
    places = f"explode(sequence(0, {count - 1}))"
    pairs = numbers.sparkSession.range(1).selectExpr(f"{places} AS a").selectExpr("a", f"explode(sequence(a, {count - 1})) AS b")
    nothing = pairs.selectExpr("a", "b", *[f"0D AS {x}" for x in SUMS], *[f"double('{'' if 'low' in x else '-'}infinity') AS {x}" for x in EDGES])
    found = numbers.mapInArrow(summed, PAIR_ROW).unionAll(nothing)
    return found.groupBy("a", "b").agg(
        *[F.sum(x).alias(x) for x in SUMS], *[(F.min if "low" in x else F.max)(x).alias(x) for x in EDGES]
    )


def _pairs(df: DataFrame, names: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(col_a, col_b, r) for the given pairs of positions in `names`; r is null if a side is constant or
    holds infinite values in the rows of the pair.

    Three scans, whatever the number of columns: largest values, means and spreads (one row each), sums of pairs.
    """
    if not pairs:
        return empty_table(df.sparkSession, "col_a string, col_b string, r double")
    numbers = df.selectExpr(*[f"{double_sql(field_of(df, n))} AS v{i}" for i, n in enumerate(names)])
    # Scaled by the largest absolute value first, so that neither squares nor means leave the range of doubles.
    largest = numbers.selectExpr(*[f"max(abs(v{i})) AS v{i}" for i in range(len(names))]).first()
    scaled = numbers.selectExpr(*[f"{_scaled(f'v{i}', largest[i])} AS v{i}" for i in range(len(names))])
    seen = scaled.selectExpr(*[f"struct(avg(v{i}) AS mean, stddev_pop(v{i}) AS spread) AS v{i}" for i in range(len(names))]).first()

    def centred(i: int) -> str:
        mean, spread = seen[i]["mean"], seen[i]["spread"]
        if not spread or not math.isfinite(mean) or not math.isfinite(spread):
            return f"v{i}"
        return f"(v{i} - {number_literal(mean)}) / {number_literal(spread)} AS v{i}"

    sums = pair_sums(scaled.selectExpr(*[centred(i) for i in range(len(names))]))
    if len(pairs) < len(names) * (len(names) + 1) // 2:
        sums = sums.filter("a <> b")
    spread = "({1} / n - {0} / n * ({0} / n))"
    both = f"sqrt({spread.format('sum_a', 'squares_a')} * {spread.format('sum_b', 'squares_b')})"
    r = f"try_divide(product / n - sum_a / n * (sum_b / n), {both})"
    r = f"IF(a = b, 1D, nanvl(least(greatest({r}, -1D), 1D), CAST(NULL AS DOUBLE)))"
    listed = f"array({', '.join(map(text_literal, names))})"
    return sums.selectExpr(
        f"{listed}[a] AS col_a", f"{listed}[b] AS col_b",
        f"IF(n = 0 OR infinite > 0 OR low_a >= high_a OR low_b >= high_b, NULL, {r}) AS r",
    )


def pair_correlations(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(col_a, col_b, r) for each pair of different columns, in column order."""
    names = numeric_columns(df) if names is None else list(names)
    return _pairs(df, names, list(combinations(range(len(names)), 2)))


def correlation_matrix(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """The full matrix in long form, rounded to four decimals; the diagonal of a constant is null."""
    names = numeric_columns(df) if names is None else list(names)
    half = _pairs(df, names, list(combinations_with_replacement(range(len(names)), 2)))
    mirrored = "struct(col_b AS col_a, col_a AS col_b, round(r, 4) AS r)"
    cells = f"array(struct(col_a, col_b, round(r, 4) AS r), {mirrored})"
    return half.selectExpr(f"inline(IF(col_a = col_b, slice({cells}, 1, 1), {cells}))")


def correlation_wide(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row per column, one correlation per other column."""
    names = numeric_columns(df) if names is None else list(names)
    long = correlation_matrix(df, names)
    return long.groupBy(F.col("col_a").alias("column")).pivot("col_b", names).agg(F.first("r"))


def strong_pairs(df: DataFrame, threshold: float = STRONG, pairs: DataFrame | None = None) -> DataFrame:
    """Pairs whose unrounded correlation exceeds the threshold in size, strongest kind named."""
    pairs = pair_correlations(df) if pairs is None else pairs
    return pairs.filter(f"abs(r) > {threshold}D").selectExpr(
        "col_a", "col_b", "round(r, 3) AS r",
        "IF(r > 0, 'Strong Positive', 'Strong Negative') AS strength",
    )
