"""Cleaning runs in a folder: each step committed, counted while it is written, resumed after a stop, closed by a manifest.

A run's folder holds, while it goes on, the result of each finished step and a note that says so; a step without its note
is done again. What a run writes is counted by the job that writes it, so its audit reads no table. The manifest is
written last: a folder without one is a run that stopped. Called again with the same table and steps it goes on behind
its last finished step; with another table or other steps it starts anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.operators.tables import local_table
from tablewright.plans.reports import analysis_report, cleaning_metrics, cleaning_report_text
from tablewright.plans.steps import Step, _apply_one, _order_after, check_steps
from tablewright.sources.sinks import spec_document, write_delimited
from tablewright.sources.storage import Counters, counted, exists, remove, write_counted

MANIFEST, NOTE, STEPS = "manifest", "_run", "_steps"


@dataclass(frozen=True)
class Run:
    path: str
    cleaned: DataFrame
    audit: DataFrame
    manifest: dict[str, Any]


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    remove(spark, path)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(path, lineSep="\x00")


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, lineSep="\x00").first()["value"]


def _identity(df: DataFrame, steps: Sequence[Step], order_by: Sequence[str] | None, data_format: str, given: Counters) -> str:
    known = [df.schema.json(), list(steps), list(order_by or []), data_format, asdict(given)]
    return hashlib.sha256(json.dumps(known, sort_keys=True).encode()).hexdigest()


def _audit(spark: SparkSession, steps: Sequence[Step], counters: Sequence[Counters]) -> DataFrame:
    rows = [
        (i, s["operation"], s.get("column"), json.dumps(s.get("parameters") or {}, sort_keys=True), a.rows, b.rows, a.missing, b.missing, "success")
        for i, (s, a, b) in enumerate(zip(steps, counters, counters[1:]), start=1)
    ]
    schema = (
        "step int, operation string, column string, parameters string, rows_before bigint, rows_after bigint, missing_before bigint, missing_after bigint, status string"
    )
    return local_table(spark, rows, schema)


def clean_to(
    path: str, df: DataFrame, steps: Sequence[Step], order_by: Sequence[str] | None = None, data_format: str = "parquet", profile: bool = True
) -> Run:
    """Clean a table into a run folder: cleaned data, audit, profile tables, report, steps and manifest.

    A finished run of the same table and steps is returned as it is; a finished run of others, or a folder that no run
    made, is refused.
    """
    check_steps(steps)
    spark, path = df.sparkSession, path.rstrip("/")
    given = counted(df)
    identity = _identity(df, steps, order_by, data_format, given)
    if exists(spark, f"{path}/{MANIFEST}"):
        manifest = json.loads(_read_text(spark, f"{path}/{MANIFEST}"))
        if manifest["identity"] != identity:
            raise ValueError(f"{path!r} holds a finished run of another table or of other steps")
        return _finished(spark, path, manifest)
    if exists(spark, f"{path}/{NOTE}"):
        if _read_text(spark, f"{path}/{NOTE}") != identity:
            remove(spark, path)
    elif exists(spark, path):
        raise ValueError(f"{path!r} is there and is no run; name another folder")
    if not exists(spark, f"{path}/{NOTE}"):
        _write_text(spark, f"{path}/{NOTE}", identity)

    table, counters = df, [given]
    for i, step in enumerate(steps):
        out, note = f"{path}/{STEPS}/{i}", f"{path}/{STEPS}/{i}-done"
        if not exists(spark, note):
            try:
                after = _apply_one(table, step, order_by)
                remove(spark, out)
                plain = after.toDF(*[f"c{k}" for k in range(len(after.columns))])
                seen = write_counted(plain, lambda written, out=out: written.write.parquet(out))
            except Exception as error:
                raise ValueError(f"step {i} ({step['operation']}) stopped: {error}; the steps before it are kept in {path!r}") from error
            _write_text(spark, note, json.dumps({"columns": after.columns, **asdict(seen)}))
        state = json.loads(_read_text(spark, note))
        after = spark.read.parquet(out).toDF(*state.pop("columns"))
        counters.append(Counters(**state))
        order_by = _order_after(table, after, order_by)
        table = after

    for name in ("cleaned", "audit", "profile", "report", "pipeline"):  # parts of a closing that stopped
        remove(spark, f"{path}/{name}")
    if data_format == "csv":
        final = write_counted(table, lambda written: write_delimited(written, f"{path}/cleaned"))
    else:
        final = write_counted(table, lambda written: written.write.format(data_format).save(f"{path}/cleaned"))
    _audit(spark, steps, counters).coalesce(1).write.parquet(f"{path}/audit")
    if profile:
        for name, part in analysis_report(table).items():
            part.coalesce(1).write.parquet(f"{path}/profile/{name}")
        _write_text(spark, f"{path}/report", cleaning_report_text(cleaning_metrics(df, table), steps))
    _write_text(spark, f"{path}/pipeline", spec_document(steps))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/cleaned").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
    ).first()
    manifest = {
        "identity": identity, "format": data_format, "columns": table.columns, "input": asdict(given),
        "cleaned": {**asdict(final), "files": files["files"], "bytes": files["bytes"]}, "steps": [asdict(c) for c in counters[1:]],
    }
    _write_text(spark, f"{path}/{MANIFEST}", json.dumps(manifest, sort_keys=True))
    remove(spark, f"{path}/{STEPS}")
    remove(spark, f"{path}/{NOTE}")
    return _finished(spark, path, manifest)


def _finished(spark: SparkSession, path: str, manifest: dict[str, Any]) -> Run:
    if manifest["format"] == "csv":
        cleaned = spark.read.csv(f"{path}/cleaned", header=True, escape='"', inferSchema=False)
    else:
        cleaned = spark.read.format(manifest["format"]).load(f"{path}/cleaned")
    return Run(path, cleaned, spark.read.parquet(f"{path}/audit"), manifest)


def verify_run(run: Run) -> bool:
    """Whether the cleaned table, read again, has the rows, missing cells and digest of the manifest (not for text formats)."""
    seen = asdict(counted(run.cleaned))
    return all(run.manifest["cleaned"][name] == value for name, value in seen.items())
