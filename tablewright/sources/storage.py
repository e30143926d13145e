"""Where intermediate tables are written: the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tablewright.functions.columns import missing_sql, quoted

CHECKPOINT_DIR = "spark.checkpoint.dir"


@cache
def _folder_of_this_process() -> str:
    return tempfile.mkdtemp(prefix="tablewright-")


def has_shared_folder(spark: SparkSession) -> bool:
    return bool(spark.conf.get(CHECKPOINT_DIR, None))


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; only a local master may do without it."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    return _folder_of_this_process()


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    system, target = _file_system(spark, path)
    system.delete(target, True)


@cache
def _folder_of_session(application: str, folder: str, spark: SparkSession) -> str:
    """A folder in the shared one that goes when the session's process ends."""
    path = f"{folder.rstrip('/')}/tablewright-{application}-{uuid.uuid4().hex}"
    system, target = _file_system(spark, path)
    system.mkdirs(target)
    system.deleteOnExit(target)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    """A path that nothing has been written to, in the session's part of the shared folder."""
    return f"{_folder_of_session(spark.sparkContext.applicationId, shared_folder(spark), spark)}/{label}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Counters:
    """What was seen of a table while it was written: rows, missing cells, and a digest that no order of the rows changes."""

    rows: int
    missing: int
    digest: str


def counter_columns(df: DataFrame) -> list[Column]:
    """Aggregates of `Counters`; columns with maps, which have no order, stay out of the digest."""
    cells = " + ".join(f"count_if({missing_sql(f)})" for f in df.schema.fields) or "0L"
    names = [quoted(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    digest = f"sum(CAST(xxhash64({', '.join(names)}) AS DECIMAL(38, 0)))" if names else "CAST(0 AS DECIMAL(38, 0))"
    return [F.expr("count(1) AS rows"), F.expr(f"{cells} AS missing"), F.expr(f"CAST(coalesce({digest}, 0) AS STRING) AS digest")]


def counted(df: DataFrame) -> Counters:
    """The counters of a table, by a scan of their own."""
    row = df.agg(*counter_columns(df)).first()
    return Counters(row["rows"], row["missing"], row["digest"])


def write_counted(df: DataFrame, write: Callable[[DataFrame], None]) -> Counters:
    """Write a table and count it in the same job."""
    seen = Observation()
    write(df.observe(seen, *counter_columns(df)))
    return Counters(**seen.get)


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """The table written once to the shared folder and read from there.

    Ends a long lineage: whatever reads the result, or reads it again after a lost executor, starts
    from files with pruning and pushdown, not from the steps that made them.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.toDF(*[f"c{i}" for i in range(len(df.columns))]).write.parquet(path)
    return spark.read.parquet(path).toDF(*df.columns)


def stored_counted(df: DataFrame, label: str = "stored") -> tuple[DataFrame, Counters]:
    """`stored`, and the table's counters from the job that writes it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    seen = write_counted(plain, lambda table: table.write.parquet(path))
    return spark.read.parquet(path).toDF(*df.columns), seen


def has_storage(spark: SparkSession) -> bool:
    """Whether `stored` has a place to write to."""
    return has_shared_folder(spark) or spark.sparkContext.master.startswith("local")


def stored_if_shared(df: DataFrame, label: str = "stored") -> DataFrame:
    """`stored`, or the table itself on a cluster without a shared folder: small tables that may be made again."""
    return stored(df, label) if has_storage(df.sparkSession) else df
