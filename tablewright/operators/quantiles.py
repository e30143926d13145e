"""Exact quantiles of many columns by radix selection: no sort, no sketch and no value map on one reducer.

Spark's `percentile` gathers every distinct value of a column in one task. Here a round counts the values of each
column by a digit that grows with the value, and only the digit that holds a wanted rank is looked at again, with the least
and largest value that were seen in it. Digits cut what is between these two into DIGITS equal parts. Where a
round of that leaves many values with different exponents (a long tail), the next digit is sign and exponent; values
with one exponent have at most 2**52 places, so five more rounds leave a single value. Most columns need one round.

Counts are keyed by (column, digit) and combined before the shuffle: a task sends at most MOST_DIGITS rows of five
numbers per column and interval, to all reducers. The driver receives what is left of these counts, a table of the same
bound, whatever the number of rows and tasks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tablewright.functions.columns import double_sql, number_literal, require_numeric

# Parts of an interval; a digit by exponent (of 2,100) and sign, or zero, has a few more.
DIGITS = 4096
LEAST_EXPONENT, MOST_EXPONENT = -1075, 1025
MOST_DIGITS = 2 * (MOST_EXPONENT - LEAST_EXPONENT + 1) + 1

# Columns that are counted in one pass.
COLUMNS_PER_PASS = 16

# An interval with at most this many values is finished by counting its values one by one.
INTERVAL_LIMIT = 20_000


@dataclass
class OrderStatistic:
    """The value of 0-based `rank` in a column, known to be one of the `inside` values from `low` to `high`."""

    name: str
    rank: int
    below: int
    inside: int
    low: float | None = None
    high: float | None = None
    rounds: int = 0
    value: float | None = None
    solved: bool = False

    @property
    def interval(self) -> tuple[str, float, float, bool]:
        """Column, least and largest value, and whether the next digit is sign and exponent."""
        split = self.rounds > 0 and math.frexp(self.low)[1] != math.frexp(self.high)[1] or self.low < 0 < self.high and self.rounds > 0
        return (self.name, self.low, self.high, split or not math.isfinite(self.high - self.low))

    def solve(self, value: float) -> None:
        self.value, self.solved = value, True


@dataclass
class Quantiles:
    counts: dict[str, int] = field(default_factory=dict)
    values: dict[tuple[str, float], float | None] = field(default_factory=dict)

    def value(self, name: str, probability: float) -> float | None:
        return self.values[(name, probability)]


def _ranks(n: int, probability: float) -> tuple[int, int, float]:
    position = (n - 1) * probability
    lower = math.floor(position)
    return lower, math.ceil(position), position


def _exponent_digit(value: str) -> str:
    """Grows with the value: sign and exponent. Neither the logarithm nor rounding turns two values round."""
    exponent = f"CAST(floor(least(log2(abs({value})), {MOST_EXPONENT}D)) AS INT) - {LEAST_EXPONENT - 1}"
    return f"CASE WHEN {value} > 0 THEN {exponent} WHEN {value} < 0 THEN -({exponent}) ELSE 0 END"


def _equal_digit(value: str, low: float, high: float) -> str:
    """Grows with the value, for values from low to high."""
    first, last = number_literal(low), number_literal(high)
    return f"least(floor(({value} - {first}) / ({last} - {first}) * {DIGITS}), {DIGITS - 1})"


def _within(value: str, low: float, high: float) -> str:
    return f"({value} >= {number_literal(low)} AND {value} <= {number_literal(high)})"


def exact_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], interval_limit: int = INTERVAL_LIMIT
) -> Quantiles:
    """Linearly interpolated quantiles of the non-missing values of each numeric column."""
    if not wanted:
        return Quantiles()
    if len(wanted) > COLUMNS_PER_PASS:
        names, result = list(wanted), Quantiles()
        for start in range(0, len(names), COLUMNS_PER_PASS):
            part = exact_quantiles(df, {n: wanted[n] for n in names[start : start + COLUMNS_PER_PASS]}, interval_limit)
            result.counts |= part.counts
            result.values |= part.values
        return result
    narrow = df.selectExpr(
        *[f"{double_sql(require_numeric(df, name))} AS v{i}" for i, name in enumerate(wanted)]
    )
    columns = {name: f"v{i}" for i, name in enumerate(wanted)}

    ends = narrow.selectExpr(*[f"struct(count({v}) AS n, min({v}) AS low, max({v}) AS high)" for v in columns.values()]).first()
    result = Quantiles()
    statistics: dict[tuple[str, int], OrderStatistic] = {}
    for end, name in zip(ends, wanted):
        result.counts[name] = end["n"]
        for probability in wanted[name] if end["n"] else ():
            for rank in _ranks(end["n"], probability)[:2]:
                statistics[(name, rank)] = s = OrderStatistic(name, rank, 0, end["n"], end["low"], end["high"])
                if s.low == s.high:
                    s.solve(s.low)

    while open_ := [s for s in statistics.values() if not s.solved]:
        cases = {}
        for interval in sorted({(s.interval, s.inside <= interval_limit) for s in open_}):
            (name, low, high, split), few = interval
            value = columns[name]
            digit = value if few else _exponent_digit(value) if split else _equal_digit(value, low, high)
            cases[interval] = (_within(value, low, high), value, digit)
        counted = dict(zip(cases, _counted(narrow, list(cases.values()))))
        for s in open_:
            _narrow(s, *counted[(s.interval, s.inside <= interval_limit)])

    for name in wanted:
        n = result.counts[name]
        for probability in wanted[name]:
            result.values[(name, probability)] = None
            if n:
                lower, upper, position = _ranks(n, probability)
                low, high = statistics[(name, lower)].value, statistics[(name, upper)].value
                result.values[(name, probability)] = (
                    low if low == high else (upper - position) * low + (position - lower) * high
                )
    return result


def _counted(narrow: DataFrame, cases: Sequence[tuple[str, str, str]]) -> list[tuple[np.ndarray, ...]]:
    """For each case (condition, value, digit): count, least and largest value of each digit, in the order of the digits."""
    columns = []
    for i, (test, value, digit) in enumerate(cases):
        columns += [f"IF({test}, CAST({digit} AS DOUBLE), NULL) AS d{i}", f"IF({test}, {value}, NULL) AS w{i}"]
    rows = narrow.filter(" OR ".join(test for test, _, _ in cases)).selectExpr(*columns)
    listed = ", ".join(f"(d{i}, w{i}) AS `{i}`" for i in range(len(cases)))
    melted = narrow.sparkSession.sql(f"SELECT * FROM {{rows}} UNPIVOT EXCLUDE NULLS ((digit, value) FOR number IN ({listed}))", rows=rows)
    found = melted.groupBy("number", "digit").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    ).toArrow()
    number, digit, n, low, high = (found[x].to_numpy() for x in ("number", "digit", "n", "low", "high"))
    number = number.astype(np.int64)
    out = []
    for i in range(len(cases)):
        mine = np.flatnonzero(number == i)
        mine = mine[np.argsort(digit[mine], kind="stable")]
        out.append((n[mine], low[mine], high[mine]))
    return out


def _narrow(s: OrderStatistic, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    """Go on with the digit that holds the rank."""
    upto = np.cumsum(n)
    at = int(np.searchsorted(upto, s.rank - s.below, side="right"))
    s.below += int(upto[at] - n[at])
    s.inside, s.low, s.high = int(n[at]), float(low[at]), float(high[at])
    s.rounds += 1
    if s.low == s.high:
        s.solve(s.low)
