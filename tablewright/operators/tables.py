"""Small driver-side results as local Spark tables, handed over as Arrow."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Arrow types of the SQL type names used for fixed-schema results.
ARROW_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table from driver-side rows; `schema` is like `name string, n bigint`."""
    fields = [part.split() for part in schema.split(",")]
    columns = {
        name: pa.array([row[i] for row in rows], ARROW_TYPES[kind]) for i, (name, kind) in enumerate(fields)
    }
    return spark.createDataFrame(pa.table(columns))


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def computed(table: DataFrame) -> DataFrame:
    """A small table (a row or so per column) computed now, for callers that read it more than once."""
    return table.sparkSession.createDataFrame(table.toArrow(), table.schema)
