"""Whitening of vectors by shifted CholeskyQR: distributed Gram passes, triangular solves, SVD of the composed factor.

Entries become whole numbers x = floor(1024 c) + 100000, whose sums S over all n vectors are exact, so a centred
row (n x - S) / n has no rounding but that of its division. A pass sums the products of the centred rows' columns,
after the rows went through the triangular solves of all factors so far; the driver takes the Cholesky factor of that
small matrix and the next pass starts with one more solve. The first factor is shifted, which keeps it from breaking
down whatever the condition of the rows; two more passes leave orthonormal columns. Then centred rows = Q R with R
the product of the factors, and the singular vectors of R are the components: the covariance itself, whose
condition is that of R squared, is never decomposed. What is left of Q's Gram matrix beyond the identity goes
into R, so columns without variance, and columns that depend on others, need no rule of their own.

Only sums over the rows, a matrix of dimensions by dimensions, reach the driver. Each pass reads `df` again: write
it first if it is costly to make.

Defined cases: a vector that is null, or holds a null, an infinite or undefined entry or one of 2**52 and more, is not
in the fit list and gets nulls; so do vectors of another number of entries than most have (the larger number of
two that are equally frequent) and empty ones. Components without variance are left out: of one vector, or of equal
ones, there are none. Repeated rows count each; a null id is an id like others; extra columns are kept, new
columns get underscores behind names that are taken. A deviation that does not fit in a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm.base import Scratch, free_name, query, quoted, table

GRID, OFFSET = 1024, 100_000
COMPONENTS = 8
ROWS_AT_ONCE = 4096
MOST_PASSES = 12
TIGHT, NOTHING = 1e-12, 1e-10
SAFE = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """What the fit list says: its size and sums, unit components as columns, their variances and shares."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def size(self) -> int:
        return len(self.sums)


def usable(vector: str, size: int | None = None) -> str:
    """SQL condition for a vector to be in the fit list."""
    known = "size(v) > 0" if size is None else f"size(v) = {size}"
    test = f"{known} AND forall(v, c -> coalesce(abs(c) < 4503599627370496D, false))"
    return f"coalesce({test.replace('(v', f'({vector}')}, false)"


def grid(vectors: pa.Array, size: int) -> np.ndarray:
    """Whole numbers [row, entry] of vectors that all have `size` entries."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * GRID).astype(np.int64).reshape(-1, size) + OFFSET


def scaled(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S, exact: in 64 bits, or in Python's integers where these would not do."""
    largest = int(np.abs(x).max(initial=0))
    if n * largest + max(map(abs, sums)) < SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(difference: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None beyond a long."""
    if difference.dtype != object:
        largest = int(np.abs(difference).max(initial=0))
        if largest * largest * difference.shape[1] < SAFE:
            return (difference * difference).sum(axis=1).tolist()
        difference = difference.astype(object)
    return [x if x < 1 << 63 else None for x in (difference * difference).sum(axis=1).tolist()]


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows / R_1 / R_2 ...: one triangular solve per factor, column after column."""
    for factor in factors:
        out = np.empty_like(rows)
        for j in range(factor.shape[0]):
            out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
        rows = out
    return rows


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.column(0).slice(a, ROWS_AT_ONCE)


def sums_of(vectors: DataFrame) -> DataFrame:
    """size, place, total: sum of x at each place over vectors of each size; place -1 has their number."""

    def summed(batches):
        totals: dict[int, np.ndarray] = {}
        for part in parts_of(batches):
            sizes = part.value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                x = grid(part.filter(pa.array(sizes == size)), size)
                fits = int(np.abs(x).max(initial=0)) * len(x) < SAFE
                total = np.append(x.sum(axis=0) if fits else x.astype(object).sum(axis=0), len(x)).astype(object)
                totals[size] = totals[size] + total if size in totals else total
        for size, total in totals.items():
            places = [*range(size), -1]
            yield pa.record_batch(
                [
                    pa.array([size] * (size + 1), pa.int32()), pa.array(places, pa.int32()),
                    pa.array([Decimal(t) for t in total.tolist()], pa.decimal128(38, 0)),
                ],
                names=["size", "place", "total"],
            )

    found = vectors.mapInArrow(summed, "size int, place int, total decimal(38,0)")
    return found.groupBy("size", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total"))


def products(vectors: DataFrame, size: int, made) -> np.ndarray:
    """Sum over all rows of the outer products of made(x), a function of a block of whole numbers."""

    def multiplied(batches):
        total = None
        for part in parts_of(batches):
            rows = made(grid(part, size))
            total = rows.T @ rows if total is None else total + rows.T @ rows
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "value"])

    summed = vectors.mapInArrow(multiplied, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    i, j, value = (summed[x].to_numpy() for x in ("i", "j", "value"))
    out = np.zeros((int(j.max()) + 1,) * 2)
    out[i, j] = out[j, i] = value
    return out


def factor_of(gram: np.ndarray, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor; the shift starts at the size of the sums' rounding and grows until there is a factor."""
    size = len(gram)
    shift = 11 * size * (size + 1) * np.finfo(float).eps * np.linalg.norm(gram, 2)
    step = shift if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + step * np.eye(size)).T
        except np.linalg.LinAlgError:
            step = 16 * step if step else shift


def fit_whitening(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors, at most `components` of them; None if there is no usable vector."""
    vectors = df.select(quoted(vector_col).cast("array<double>").alias("vector"))
    with Scratch(df.sparkSession, "whitening") as scratch:
        totals = scratch.write(sums_of(vectors.where(usable("vector"))), "sums")
        most = totals.where("place = -1").orderBy(F.desc("total"), F.desc("size")).first()
        if most is None:
            return None
        size, n = most["size"], int(most["total"])
        rows = totals.where((F.col("size") == size) & (F.col("place") >= 0)).collect()  # one for each dimension
    sums = tuple(int(r["total"]) for r in sorted(rows, key=lambda r: r["place"]))
    vectors = vectors.where(usable("vector", size))

    def centred(x: np.ndarray) -> np.ndarray:
        return scaled(x, n, sums).astype(np.float64) / n

    factors: list[np.ndarray] = []
    while True:
        gram = products(vectors, size, lambda x, factors=tuple(factors): solved(centred(x), factors))
        if not factors:
            whole = float(np.trace(gram))
            if whole == 0:
                return Whitening(n, sums, np.zeros((size, 0)), np.zeros(0), np.zeros(0), 0.0)
        else:
            left = np.linalg.eigvalsh(gram)
            if ((np.abs(left - 1) <= TIGHT) | (left <= NOTHING)).all() or len(factors) == MOST_PASSES:
                break
        factors.append(factor_of(gram, shifted=not factors))
    composed = np.eye(size)
    for factor in factors:
        composed = factor @ composed
    values, axes = np.linalg.eigh(gram)
    composed = np.sqrt(np.maximum(values, 0))[:, None] * (axes.T @ composed)
    _, singular, turned = np.linalg.svd(composed)
    count = min(components, int((singular > 4 * size * np.finfo(float).eps * singular[0]).sum()))
    chosen = turned[:count].T
    chosen = chosen * np.where(chosen[np.abs(chosen).argmax(axis=0), np.arange(count)] < 0, -1.0, 1.0)
    variances = singular[:count] ** 2 / n

    def whitened(x: np.ndarray) -> np.ndarray:
        # A column of ones beside them: their sums come with the products.
        return np.hstack((centred(x) @ (chosen / np.sqrt(variances)), np.ones((len(x), 1))))

    second = products(vectors, size, whitened)
    mean = second[-1, :-1] / n
    error = np.abs(second[:-1, :-1] / n - np.outer(mean, mean) - np.eye(count)).max()
    return Whitening(n, sums, chosen, variances, variances * n / whole, float(error))


def whiten(df: DataFrame, model: Whitening, vector_col: str = "embedding") -> DataFrame:
    """`df` with whitened (array of double, by component) and deviation (long)."""
    n, sums, size = model.n, model.sums, model.size
    project = model.components / np.sqrt(model.variances)

    @F.arrow_udf("whitened array<double>, deviation long")
    def made(vectors: pa.Array) -> pa.Array:
        fits = vectors.is_valid().to_numpy(zero_copy_only=False)
        given = vectors.filter(pa.array(fits))
        values, far = [np.zeros((0, project.shape[1]))], []
        for a in range(0, len(given), ROWS_AT_ONCE):
            difference = scaled(grid(given.slice(a, ROWS_AT_ONCE), size), n, sums)
            values.append((difference.astype(np.float64) / n) @ project)
            far += deviations(difference)
        bounds = np.concatenate(([0], np.cumsum(fits * project.shape[1]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(values).ravel()), mask=pa.array(~fits))
        each = np.full(len(fits), None, object)
        each[fits] = far
        return pa.StructArray.from_arrays([lists, pa.array(each.tolist(), pa.int64())], ["whitened", "deviation"])

    name = free_name("_made", df.columns)
    vector = F.when(F.expr(usable(f"`{vector_col.replace('`', '``')}`", size)), quoted(vector_col).cast("array<double>"))
    out = df.withColumn(name, made(vector))
    for column in ("whitened", "deviation"):
        out = out.withColumn(free_name(column, df.columns), F.col(name)[column])
    return out.drop(name)


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each usable vector and each of the first eight components."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    model = fit_whitening(vectors)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    return (
        whiten(vectors, model).where("whitened IS NOT NULL")
        .select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        .select(
            "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
            F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
        )
    )
