"""Values rendered for people: byte counts, ISO timestamps, null-safe strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.functions.columns import column, missing, type_class

# Texts shown as blanks.
NULL_WORDS = ("nan", "none", "null", "<na>")
NULL_LITERALS = ("nan", "NaN", "None", "null", "NULL", "<NA>", "NaT")

# Byte units, 1024 apart.
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def bytes_sql(size: str) -> str:
    """A byte count as text with one decimal and the largest fitting unit."""
    cases = []
    for power, unit in enumerate(BYTE_UNITS):
        shown = f"format_string('%.1f {unit}', bround(CAST({size} AS DOUBLE) / {1024**power}D, 1))"
        limit = f"WHEN {size} < {1024 ** (power + 1)}" if power < len(BYTE_UNITS) - 1 else "ELSE"
        cases.append(f"{limit} THEN {shown}" if limit != "ELSE" else f"ELSE {shown}")
    return f"CASE {' '.join(cases)} END"


def iso_sql(value: str) -> str:
    """A date or timestamp as ISO text; the fraction appears, with six digits, only if it is not zero."""
    stamp = f"CAST({value} AS TIMESTAMP_NTZ)"
    whole = f"""date_format({stamp}, "yyyy-MM-dd'T'HH:mm:ss")"""
    fraction = f"date_format({stamp}, 'SSSSSS')"
    return f"concat({whole}, IF({fraction} = '000000', '', concat('.', {fraction})))"


def display_strings(df: DataFrame) -> DataFrame:
    """Every column as text, with anything missing (or spelling out a null) as ''."""
    shown = []
    for field in df.schema.fields:
        text = column(field.name).cast("string")
        blank = missing(field)
        if type_class(field.dataType) == "text":
            blank = blank | F.lower(text).isin(*NULL_WORDS) | text.isin(*NULL_LITERALS)
        shown.append(F.when(blank, F.lit("")).otherwise(text).alias(field.name))
    return df.select(*shown)
