"""Column names as unique lower-case identifiers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablewright.operators.tables import local_table


def _identifier(name: str, position: int) -> str:
    words = re.sub(r"[\s\-.]+", "_", name.strip().lower())
    plain = re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "", words)).strip("_")
    if not plain:
        return f"unnamed_column_{position}"
    return f"col_{plain}" if plain[0].isdigit() else plain


def standard_names(names: Sequence[str]) -> list[str]:
    """Identifiers for `names`, in order; a repeat gets the next free suffix `_1`, `_2`, ..."""
    wanted = [_identifier(name, i) for i, name in enumerate(names)]
    taken: set[str] = set()
    reserved = set(wanted)
    out = []
    for name in wanted:
        unique, suffix = name, 0
        while unique in taken or (suffix and unique in reserved):
            suffix += 1
            unique = f"{name}_{suffix}"
        taken.add(unique)
        out.append(unique)
    return out


def standardize_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*standard_names(df.columns))


def renamed_columns(df: DataFrame) -> DataFrame:
    """(position, column, new_name) for every column; reads the schema only."""
    rows = [(i, old, new) for i, (old, new) in enumerate(zip(df.columns, standard_names(df.columns)))]
    return local_table(df.sparkSession, rows, "position int, column string, new_name string")
