"""Facts of Parquet tables from the footers of their files, so that no column chunk is read for them.

Row counts, missing values of all columns but fractions, and ends of whole numbers and dates stand in the footers; Spark
pushes such aggregates into its second Parquet source. Fractions are scanned, because a NaN is missing but counted as a
value there and left out of the ends; ends of text may be cut short, so none is taken from there either. Files
without these statistics, or of differing columns, make Spark refuse: then all columns are scanned.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, types as T

from tablewright.functions.columns import FLOATING, INTEGRAL, NESTED, by_position, quoted
from tablewright.operators.facts import FieldFacts, Facts

# Settings of a session that plans aggregates of Parquet files from their footers.
FOOTER_SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
PUSHED = "PushedAggregation: [COUNT("


def _footer_facts(field: T.StructField) -> dict[str, str]:
    """What footers tell of a column, as aggregates that Spark can push to them."""
    value, kind = quoted(field.name), field.dataType
    if isinstance(kind, FLOATING + NESTED):
        return {}
    facts = {"missing": f"count(1) - count({value})"}
    if isinstance(kind, INTEGRAL):
        low, high = f"min({value})", f"max({value})"
        facts |= {"min": f"CAST({low} AS DOUBLE)", "max": f"CAST({high} AS DOUBLE)"}
        facts |= {"whole_min": f"CAST({low} AS BIGINT)", "whole_max": f"CAST({high} AS BIGINT)"}
    if isinstance(kind, T.DateType):
        facts |= {"first": f"min({value})", "last": f"max({value})"}
    return facts


def _folder_columns(df: DataFrame) -> set[str]:
    """Columns that stand in folder names (`key=value`) instead of in the files."""
    first = df.select("_metadata.file_path").head(1)
    parts = first[0][0].split("/")[:-1] if first else []
    return {part.split("=", 1)[0] for part in parts if "=" in part}


def footer_row(spark: SparkSession, path: str | list[str], wanted: dict[int, dict[str, str]]) -> DataFrame:
    """One row with `rows` and the wanted facts (SQL by name, by ordinal), planned on the footers of the files."""
    session = spark.newSession()
    for name, value in FOOTER_SETTINGS.items():
        session.conf.set(name, value)
    table = by_position(session.read.parquet(*([path] if isinstance(path, str) else path)))
    listed = [f"{sql} AS c{o}_{fact}" for o, facts in wanted.items() for fact, sql in facts.items()]
    return table.selectExpr("count(1) AS rows", *listed)


def is_pushed(row: DataFrame) -> bool:
    """Whether Spark plans the row on footers; the whole row is, or nothing."""
    return PUSHED in row._jdf.queryExecution().executedPlan().toString()


def parquet_facts(
    spark: SparkSession, path: str | list[str], only: Sequence[str] = ("missing", "whole_min", "whole_max")
) -> Facts:
    """Facts of the kinds in `only` over all columns of Parquet files, as `Facts.of` gives them, computed now.

    A column is scanned only if one of its facts is not in the footers. `rows_with_missing` looks at whole rows and
    is refused.
    """
    if "rows_with_missing" in only:
        raise ValueError("rows with missing values cannot be told from footers; take Facts.of for them")
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    scanned = Facts.of(df, only=only)
    in_folders = _folder_columns(df)
    plain = by_position(df).schema.fields
    wanted = {}
    for entries, _ in scanned.passes:
        for entry in entries:
            told = {} if entry.field.name in in_folders else _footer_facts(plain[entry.ordinal])
            if entry.known <= told.keys():
                wanted[entry.ordinal] = {fact: told[fact] for fact in told if fact in entry.known}
    row = footer_row(spark, path, wanted)
    try:
        told = row.toArrow() if is_pushed(row) else None
    except (PySparkException, Py4JJavaError):
        told = None
    if told is None:
        return scanned.collected()
    return _joined(spark, df, scanned, told, row.schema, set(wanted))


def _joined(
    spark: SparkSession, df: DataFrame, scanned: Facts, told: pa.Table, schema: T.StructType, from_footers: set[int]
) -> Facts:
    """Facts as one local row: those that footers told, and those of the remaining columns from a scan."""
    fields, columns = list(schema.fields), {name: told.column(name) for name in told.column_names}
    rest = [f.name for o, f in enumerate(df.schema.fields) if o not in from_footers]
    entries: list[FieldFacts] = [e for es, _ in scanned.passes for e in es]
    if rest:
        kinds = {fact for e in entries for fact in e.known}
        for _, row in Facts.of(df, rest, tuple(kinds)).passes:
            values = row.toArrow()
            for field in row.schema.fields:
                if field.name not in columns:
                    fields.append(field)
                    columns[field.name] = values.column(field.name)
    table = spark.createDataFrame(pa.table(columns), T.StructType(fields))
    return Facts(scanned.fields, ((tuple(entries), table),))
