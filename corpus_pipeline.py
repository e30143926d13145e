"""From raw documents to training pieces: quality, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, folder of the tables) and returns what it keeps; its result is written as Parquet
and read again as the next stage's documents. Rows without an id pass all stages that decide by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm import decontaminate, line_chunks, minhash, quality, sentencepiece_sampling
from tablewright.llm.base import Scratch, free_name, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by the labels of the learning folds, takes for good ones."""
    model = quality.fit_on(docs, quality.training_labels(spark, sf_dir))
    return docs.where(quality.score_text_column(F.col("text"), model) >= 0.5)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the chunks of lines that stand earlier; n_chars follows the text."""
    out = line_chunks.dedup_lines(docs)
    chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id; rows that share it go by a hash of the text.

    Rows that share an id are documents of their own; of those with the same text too, the one with the least other values stays.
    """
    number = free_name("row_number", docs.columns)
    gone = minhash.repeated_rows(docs).withColumnRenamed("node", number)
    named = docs.where("doc_id IS NOT NULL").withColumn(number, minhash.row_number(F.col("doc_id"), F.col("text")))
    named = named.join(gone.hint("merge"), number, "left_anti").groupBy(number).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return named.select("row.*").unionByName(docs.where("doc_id IS NULL"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return docs.where(~decontaminate.contaminated_column(F.col("text"), table(spark, sf_dir, "benchmark")))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each document, and whether they decode to its text."""
    out = sentencepiece_sampling.sample_pieces(docs, sentencepiece_sampling.load_vocabulary(), check=True)
    return out.select(
        "doc_id", "lang", "source", "n_chars", F.size("piece_ids").cast("long").alias("n_pieces"), "lossless", "piece_ids",
    )


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("pieces", pieces_stage),
]

# Stages 1, 3, 4 and 5 (a fitted classifier, components, fingerprints, sampling) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        return scratch.keep(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
