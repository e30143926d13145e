"""Writing tables and the result of a cleaning run."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, functions as F

from tablewright.operators.ordering import POSITION, with_position

# Export defaults.
SEPARATOR, ENCODING, DATE_FORMAT = ",", "UTF-8", "yyyy-MM-dd"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
SPEC_VERSION = "1.0.0"


def write_delimited(
    df: DataFrame,
    path: str,
    include_index: bool = False,
    order_by: Sequence[str] | None = None,
    separator: str = SEPARATOR,
    encoding: str = ENCODING,
    date_format: str = DATE_FORMAT,
    timestamp_format: str = TIMESTAMP_FORMAT,
    mode: str = "errorifexists",
) -> None:
    """Delimited text with a header; `include_index` puts the row position (by `order_by`) first."""
    if include_index:
        if not order_by:
            raise ValueError("include_index needs order_by")
        df = with_position(df, order_by).select(POSITION, *[F.col(f"`{c}`") for c in df.columns])
    df.write.mode(mode).option("timestampNTZFormat", timestamp_format).csv(
        path, header=True, sep=separator, encoding=encoding, dateFormat=date_format,
        timestampFormat=timestamp_format, escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def spec_document(steps: Sequence[dict[str, Any]]) -> str:
    """Cleaning steps as a JSON document that can be replayed."""
    return json.dumps(
        {
            "metadata": {
                "created_at": datetime.now(timezone.utc).isoformat(),
                "version": SPEC_VERSION,
                "pipeline_length": len(steps),
            },
            "pipeline": list(steps),
        },
        indent=2,
    )


def write_run(
    path: str,
    original: DataFrame,
    cleaned: DataFrame,
    steps: Sequence[dict[str, Any]],
    profile: dict[str, DataFrame] | None = None,
    audit: DataFrame | None = None,
    data_format: str = "parquet",
) -> None:
    """One directory per run: cleaned data, profile tables, audit table, steps and a readable report."""
    from tablewright.plans.reports import analysis_report, cleaning_metrics, cleaning_report_text

    if data_format == "csv":
        write_delimited(cleaned, f"{path}/cleaned")
    else:
        cleaned.write.format(data_format).save(f"{path}/cleaned")
    spark = cleaned.sparkSession
    written = spark.read.format(data_format).load(f"{path}/cleaned") if data_format != "csv" else cleaned
    profile = analysis_report(written) if profile is None else profile
    for name, table in profile.items():
        table.coalesce(1).write.parquet(f"{path}/profile/{name}")
    if audit is not None:
        audit.coalesce(1).write.parquet(f"{path}/audit")
    report = cleaning_report_text(cleaning_metrics(original, written), steps)
    for name, text in (("pipeline", spec_document(steps)), ("report", report)):
        spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(f"{path}/{name}")
