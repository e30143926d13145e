"""One fused aggregate pass over a table, read back as small per-column tables.

`Facts.of(df)` declares every counter and moment a profile may need as one aggregate without
grouping keys. Each profile table is a projection of that single row, so Catalyst prunes the
aggregates (and the scanned columns) a table does not use; `collected()` runs the pass once and
keeps the row, for reports that derive many tables from it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.functions import parsing
from tablewright.functions.columns import (
    INTEGRAL, by_position, double_sql, missing_sql, quoted, text_literal, type_class,
)

# Aggregates per pass. More of them outgrow what the JVM compiles well; a further pass reads only the
# columns it needs, so a wide table is still read once in all.
AGGREGATES_PER_PASS = 64

# Tolerance within which a double may be stored as a float.
FLOAT_TOLERANCE = 1e-6

# Bytes of a value in Spark's row format, by type; text adds its own length to a 4-byte offset.
FIXED_WIDTH = {
    T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
    T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}
TEXT_OFFSET = 4


def _prepared(field: T.StructField, ordinal: int) -> list[str]:
    """Values that several facts of a column share, computed once per row (unused ones are pruned)."""
    value = quoted(field.name)
    kind = type_class(field.dataType)
    if kind == "numeric":
        return [f"{double_sql(field)} AS _value{ordinal}"]
    if kind == "text":
        return [
            f"{parsing.date_shape(value)} AS _shape{ordinal}",
            f"{parsing.timestamp_from_any_layout(value, f'_shape{ordinal}')} AS _time{ordinal}",
        ]
    return []


def _number_facts(field: T.StructField, ordinal: int) -> dict[str, str]:
    value = f"_value{ordinal}"
    n = f"CAST(count({value}) AS DOUBLE)"
    constant = f"min({value}) = max({value})"
    skewness = f"skewness({value}) * sqrt({n} * ({n} - 1)) / ({n} - 2)"
    kurtosis = f"({n} - 1) / (({n} - 2) * ({n} - 3)) * (({n} + 1) * kurtosis({value}) + 6D)"
    facts = {
        "min": f"min({value})",
        "max": f"max({value})",
        "mean": f"avg({value})",
        "std_pop": f"stddev_pop({value})",
        "std_samp": f"stddev_samp({value})",
        "skewness": f"CASE WHEN {n} < 3 THEN NULL WHEN {constant} THEN 0D ELSE {skewness} END",
        "kurtosis": f"CASE WHEN {n} < 4 THEN NULL WHEN {constant} THEN 0D ELSE {kurtosis} END",
    }
    if isinstance(field.dataType, INTEGRAL):
        facts["whole_min"] = f"CAST(min({quoted(field.name)}) AS BIGINT)"
        facts["whole_max"] = f"CAST(max({quoted(field.name)}) AS BIGINT)"
    else:
        narrow = f"CAST(CAST({value} AS FLOAT) AS DOUBLE)"
        tolerance = f"{FLOAT_TOLERANCE}D + {FLOAT_TOLERANCE}D * abs({value})"
        facts["float_misfits"] = (
            f"count_if({value} <> {narrow} AND abs({value} - {narrow}) > {tolerance})"
        )
    return facts


def _text_facts(field: T.StructField, ordinal: int) -> dict[str, str]:
    value, shape, time = quoted(field.name), f"_shape{ordinal}", f"_time{ordinal}"
    facts = {
        "octets": f"coalesce(sum(octet_length({value})), 0)",
        "numbers": f"count({parsing.number_from_text(value)})",
        "integers": f"count({parsing.integer_from_text(value)})",
        "booleans": f"count({parsing.boolean_from_text(value)})",
        "dates": f"count({time})",
        "date_like": f"count_if({parsing.has_layout(shape)})",
        "date_like_dashed": f"count_if({parsing.has_layout(shape, range(3))})",
    }
    for i in range(len(parsing.DATE_LAYOUTS)):
        facts[f"layout_{i}"] = f"count_if({parsing.has_layout(shape, range(i, i + 1))} AND {time} IS NOT NULL)"
    return facts


def _other_facts(field: T.StructField, ordinal: int) -> dict[str, str]:
    # Nested values have no fixed width; their JSON text stands in for it.
    value = quoted(field.name)
    sized = value if isinstance(field.dataType, T.BinaryType) else f"to_json(struct({value}))"
    return {"octets": f"coalesce(sum(octet_length({sized})), 0)"}


def _datetime_facts(field: T.StructField, ordinal: int) -> dict[str, str]:
    return {"first": f"min({quoted(field.name)})", "last": f"max({quoted(field.name)})"}


FACTS_BY_CLASS: dict[str, Callable[[T.StructField, int], dict[str, str]]] = {
    "numeric": _number_facts,
    "text": _text_facts,
    "datetime": _datetime_facts,
    "boolean": lambda field, ordinal: {},
    "other": _other_facts,
}


def _facts_of_field(field: T.StructField, ordinal: int, only: frozenset[str] | None) -> dict[str, str]:
    facts = {"missing": f"count_if({missing_sql(field)})"}
    facts |= FACTS_BY_CLASS[type_class(field.dataType)](field, ordinal)
    return {name: sql for name, sql in facts.items() if only is None or name in only}


@dataclass(frozen=True)
class FieldFacts:
    """Names one column's facts inside the aggregate row, as SQL."""

    field: T.StructField
    ordinal: int
    known: frozenset[str]

    def __call__(self, fact: str) -> str:
        return f"c{self.ordinal}_{fact}" if fact in self.known else "NULL"

    @property
    def name(self) -> str:
        return text_literal(self.field.name)

    @property
    def dtype(self) -> str:
        return text_literal(self.field.dataType.simpleString())

    @property
    def kind(self) -> str:
        return type_class(self.field.dataType)

    @property
    def filled(self) -> str:
        return f"(rows - {self('missing')})"

    @property
    def bytes(self) -> str:
        """Estimated uncompressed bytes of the column."""
        data_type = self.field.dataType
        if isinstance(data_type, T.DecimalType):
            return f"rows * {8 if data_type.precision <= 18 else 16}"
        if type(data_type) in FIXED_WIDTH:
            return f"rows * {FIXED_WIDTH[type(data_type)]}"
        return f"({self('octets')} + rows * {TEXT_OFFSET})"


def named_struct(values: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"{text_literal(n)}, {sql}" for n, sql in values.items()) + ")"


def inline_rows(rows: Sequence[dict[str, str]]) -> str:
    """SQL that unfolds one aggregate row into the given rows."""
    return f"inline(array({', '.join(named_struct(row) for row in rows)}))"


FieldWithFacts = tuple[int, T.StructField, dict[str, str]]


def _grouped(fields: Sequence[FieldWithFacts]) -> list[list[FieldWithFacts]]:
    """Consecutive fields, cut where their aggregates exceed what one pass should hold."""
    groups: list[list[FieldWithFacts]] = [[]]
    held = 0
    for item in fields:
        if groups[-1] and held + len(item[2]) > AGGREGATES_PER_PASS:
            groups.append([])
            held = 0
        groups[-1].append(item)
        held += len(item[2])
    return groups


@dataclass(frozen=True)
class Facts:
    fields: tuple[T.StructField, ...]
    passes: tuple[tuple[tuple[FieldFacts, ...], DataFrame], ...]

    @classmethod
    def of(
        cls, df: DataFrame, names: Sequence[str] | None = None, only: Sequence[str] | None = None
    ) -> "Facts":
        """Facts of the named columns (all if None); `only` limits the kinds of facts declared."""
        kinds = None if only is None else frozenset(only)
        wanted = None if names is None else set(names)
        fields = [(i, f) for i, f in enumerate(df.schema.fields) if wanted is None or f.name in wanted]
        plain = by_position(df)
        passes = []
        for group in _grouped([(o, f, _facts_of_field(plain.schema[o], o, kinds)) for o, f in fields]):
            entries, prepared, aggregates = [], ["*"], ["count(1) AS rows"]
            if not passes and fields and (kinds is None or "rows_with_missing" in kinds):
                any_missing = " OR ".join(missing_sql(plain.schema[o]) for o, _ in fields)
                aggregates.append(f"count_if({any_missing}) AS rows_with_missing")
            for ordinal, field, facts in group:
                prepared += _prepared(plain.schema[ordinal], ordinal)
                entries.append(FieldFacts(field, ordinal, frozenset(facts)))
                aggregates += [f"{sql} AS c{ordinal}_{fact}" for fact, sql in facts.items()]
            passes.append((tuple(entries), plain.selectExpr(*prepared).selectExpr(*aggregates)))
        return cls(tuple(f for _, f in fields), tuple(passes))

    def collected(self) -> "Facts":
        """The same facts computed now: one row per pass, whatever the size of the table."""
        kept = []
        for entries, row in self.passes:
            kept.append((entries, row.sparkSession.createDataFrame(row.toArrow(), row.schema)))
        return Facts(self.fields, tuple(kept))

    def table(
        self,
        row: Callable[[FieldFacts], dict[str, str]],
        where: Callable[[FieldFacts], bool] = lambda facts: True,
    ) -> DataFrame | None:
        """One output row per column; `row` names the output fields. None if no column applies."""
        parts = []
        for entries, one_row in self.passes:
            rows = [row(entry) for entry in entries if where(entry)]
            if rows:
                parts.append(one_row.selectExpr(inline_rows(rows)))
        return reduce(DataFrame.unionAll, parts) if parts else None

    def totals(self, **values: str) -> DataFrame:
        """One row over the whole table from the first pass (`rows`, `rows_with_missing`)."""
        return self.passes[0][1].selectExpr(*[f"{sql} AS {name}" for name, sql in values.items()])


def small_sorted(table: DataFrame, *order: str) -> DataFrame:
    """Sort a table of at most one row per column without a range exchange."""
    by = [F.expr(o.removesuffix(" DESC")).desc() if o.endswith(" DESC") else F.expr(o) for o in order]
    return table.coalesce(1).sortWithinPartitions(*by)
