"""Checks of a table before it is profiled or cleaned."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from tablewright.functions.columns import type_class
from tablewright.operators.tables import local_table

# Limits on the table and on column names.
MIN_ROWS, MIN_COLUMNS, MAX_COLUMNS = 1, 1, 1000
MAX_NAME_LENGTH = 100
NAME_PATTERN = r"^[a-zA-Z0-9_\-\s]+$"


def validation_findings(df: DataFrame) -> DataFrame:
    """(check, required, ok, detail); the required checks decide `is_valid`."""
    names = df.columns
    repeated = sorted({n for n in names if names.count(n) > 1})
    blank = [str(i) for i, n in enumerate(names) if not n.strip()]
    odd_types = [f.name for f in df.schema.fields if type_class(f.dataType) == "other"]
    long = [n for n in names if len(n) > MAX_NAME_LENGTH]
    odd_names = [n for n in names if n.strip() and not re.match(NAME_PATTERN, n)]
    # Reads at most one row.
    some_rows = bool(names) and not df.isEmpty()
    rows = [
        ("min_rows", True, some_rows, "" if some_rows else "the table has no rows"),
        ("column_count", True, MIN_COLUMNS <= len(names) <= MAX_COLUMNS, str(len(names))),
        ("names_not_blank", True, not blank, ", ".join(blank)),
        ("names_unique", True, not repeated, ", ".join(repeated)),
        ("types_supported", True, not odd_types, ", ".join(odd_types)),
        ("name_length", False, not long, ", ".join(long)),
        ("name_characters", False, not odd_names, ", ".join(odd_names)),
    ]
    return local_table(df.sparkSession, rows, "check string, required boolean, ok boolean, detail string")


def is_valid(df: DataFrame) -> bool:
    return all(row["ok"] for row in validation_findings(df).collect() if row["required"])
