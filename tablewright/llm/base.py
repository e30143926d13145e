"""Registry of the training-data queries, table access and scratch tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.sources.storage import new_path


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(key: str, sql: str | None = None):
    """Register `f(spark, folder) -> DataFrame` under `key`, with the SQL that gives the same rows if there is one."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[key] = Entry(run, sql)
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names; rows without an id are left out."""
    return df.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text")).where("id IS NOT NULL")


def crc_fold(id_column, modulus: int):
    """crc32 of the id written as text, modulo `modulus`: the fold that a row belongs to."""
    return F.crc32(id_column.cast("string").cast("binary")) % modulus


def free_name(name: str, taken: list[str]) -> str:
    """`name`, with underscores behind it until no column of `taken` has it."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


class Scratch:
    """Tables written to the shared folder while an operator runs; all but the kept ones go when it is done."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths, self.kept = spark, label, [], set()

    def __enter__(self) -> Scratch:
        return self

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """`df`, written once and read back from files: its lineage ends here."""
        path = new_path(self.spark, f"{self.label}-{name}")
        self.paths.append(path)
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        out = self.write(df, name)
        self.kept.add(self.paths[-1])
        return out

    def __exit__(self, *_) -> None:
        for path in self.paths:
            if path not in self.kept:
                target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
