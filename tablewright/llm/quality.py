"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives rates of symbols, capitals, exclamation and question marks, bars, repeated neighbour words,
digits, sentence marks and line breaks, and a mean word length, all damped for short texts and put under a
square root or logarithm, which makes them roughly normal within a class. Class means and covariances are
sums over all labelled rows, made by Spark; covariances shrink towards the pooled variances. A score is the
logistic of the difference of the two log-densities, from Cholesky factors that are made once.

Defined cases: a null text scores as an empty one; rows of an unknown label (null) do not teach; if either
class has no labelled row, every score is the smoothed share of label 1. Rows stay as they are, repeated or
not; extra columns are kept, and new columns get underscores behind their names if those are taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.llm.base import Scratch, crc_fold, free_name, query, quoted, table
from tablewright.llm.kernels import slices, texts_of, word_edges, word_hashes

DAMPING = 20.0  # words that every text has besides its own, without any mark
SHRINKAGE = 0.1  # share of the pooled variances in a class covariance
FLOOR = 1e-4  # least variance of a feature

SYMBOLS, MARKS, BARS, SENTENCE = b"#$%&*@^~+=<>{}[]\\_`/", b"!?", b"|", b".,;:"
CLASSES = (SYMBOLS, MARKS, BARS, SENTENCE, b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n")
FEATURES = len(CLASSES) + 2


def _class_of_byte() -> np.ndarray:
    out = np.full(256, len(CLASSES), np.uint8)
    for k, members in enumerate(CLASSES):
        out[list(members)] = k
    return out


CLASS_OF_BYTE = _class_of_byte()


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text."""
    data, offsets = texts_of(texts)
    out = np.zeros((len(offsets) - 1, FEATURES))
    for a, b in slices(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        rows = np.repeat(np.arange(b - a), np.diff(at))
        kinds = len(CLASSES) + 1
        counts = np.bincount(rows * kinds + CLASS_OF_BYTE[part], minlength=(b - a) * kinds).reshape(b - a, kinds)
        starts, ends, first = word_edges(part, at)
        hashes = word_hashes(part, starts, ends)
        text_of_word = np.repeat(np.arange(b - a), np.diff(first))
        again = (hashes[1:] == hashes[:-1]) & (text_of_word[1:] == text_of_word[:-1])
        stutter = np.bincount(text_of_word[1:][again], minlength=b - a)
        letters = np.bincount(text_of_word, weights=(ends - starts), minlength=b - a)
        words = np.diff(first) + DAMPING
        out[a:b, : len(CLASSES)] = np.sqrt(counts[:, :-1] / words[:, None])
        out[a:b, -2] = np.sqrt(stutter / words)
        out[a:b, -1] = np.log((letters + 5 * DAMPING) / words)
    return out


def statistics_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        values = statistics(texts)
        sizes = np.arange(len(values) + 1, dtype=np.int32) * FEATURES
        return pa.ListArray.from_arrays(pa.array(sizes), pa.array(values.ravel()))

    return measured(text)


@dataclass(frozen=True)
class Model:
    """Per class 0 and 1: mean, inverse Cholesky factor and log of prior times density at the mean; or one share."""

    means: np.ndarray | None
    factors: np.ndarray | None
    offsets: np.ndarray | None
    share: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(features), self.share)
        logs = [
            self.offsets[c] - 0.5 * np.square((features - self.means[c]) @ self.factors[c].T).sum(axis=1) for c in (0, 1)
        ]
        return 1.0 / (1.0 + np.exp(-np.clip(logs[1] - logs[0], -700, 700)))


def fit(features: DataFrame, column: str, label: str, shrinkage: float = SHRINKAGE) -> Model:
    """Model from rows of statistics with a label 0 or 1; one aggregate of fixed size per class reaches the driver."""
    pairs = [(i, j) for i in range(FEATURES) for j in range(i, FEATURES)]
    sums = [f"sum({column}[{i}])" for i in range(FEATURES)] + [f"sum({column}[{i}] * {column}[{j}])" for i, j in pairs]
    rows = features.where(f"{label} IN (0, 1)").groupBy(label).agg(
        F.count("*").alias("n"), F.expr(f"array({', '.join(sums)})").alias("sums")
    )
    by_class = {int(r[label]): (r["n"], np.array(r["sums"])) for r in rows.collect()}
    counts = [by_class.get(c, (0, None))[0] for c in (0, 1)]
    share = (counts[1] + 1) / (sum(counts) + 2)
    if not all(counts):
        return Model(None, None, None, share)
    means, spreads = [], []
    for c in (0, 1):
        n, s = by_class[c]
        mean, square = s[:FEATURES] / n, np.zeros((FEATURES, FEATURES))
        for (i, j), value in zip(pairs, s[FEATURES:]):
            square[i, j] = square[j, i] = value / n
        means.append(mean)
        spreads.append(square - np.outer(mean, mean))
    pooled = np.diag(sum(n * np.diag(s) for n, s in zip(counts, spreads)) / sum(counts) + FLOOR)
    factors, offsets = [], []
    for c in (0, 1):
        root = np.linalg.cholesky((1 - shrinkage) * spreads[c] + shrinkage * pooled + FLOOR * np.eye(FEATURES))
        factors.append(np.linalg.inv(root))
        offsets.append(np.log(counts[c] / sum(counts)) - np.log(np.diag(root)).sum())
    return Model(np.array(means), np.array(factors), np.array(offsets), share)


def score_column(features: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def scored(values: pa.Array) -> pa.Array:
        return pa.array(model.scores(values.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)))

    return scored(features)


def score_text_column(text: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(statistics(texts)))

    return scored(text)


def fit_on(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Model from the texts of `df` whose id has a label."""
    taught = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    # Measured before the join, so that a few numbers per text are shuffled and not the texts.
    measured = df.select(quoted(id_col).alias("id"), statistics_column(quoted(text_col)).alias("x"))
    return fit(measured.join(taught, "id"), "x", "label")


def score_quality(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`df` with score (0 to 1) and predicted (1 if the score is at least 0.5)."""
    score = free_name("score", df.columns)
    out = df.withColumn(score, score_text_column(quoted(text_col), model))
    return out.withColumn(free_name("predicted", df.columns), (F.col(score) >= 0.5).cast("int"))


def training_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the learning folds: rows whose crc32(doc_id) mod 3 is 1 are held out."""
    return table(spark, folder, "labels").where(crc_fold(F.col("doc_id"), 3) != 1)


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    with Scratch(spark, "quality") as scratch:
        measured = scratch.keep(documents.select("doc_id", statistics_column(F.col("text")).alias("x")))
        taught = training_labels(spark, folder).select("doc_id", F.col("quality").alias("label"))
        model = fit(measured.join(taught, "doc_id"), "x", "label")
    return measured.select(
        "doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), score_column(F.col("x"), model).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
