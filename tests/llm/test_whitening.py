"""Whitening against a dense eigendecomposition."""

import os

import numpy as np
import pytest

from tablewright.llm import whitening

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, whitened string, _made int"


def dense(vectors):
    """x - mean, eigenvalues (falling) and unit eigenvectors of the covariance, by numpy."""
    x = np.floor(np.asarray(vectors, float) * 1024) + 100000
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    return x, centred, values[::-1], axes[:, ::-1]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not available")
def test_query_matches_a_dense_decomposition(spark):
    source = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    x, centred, values, axes = dense(source.embedding.tolist())
    found = whitening.op13_embedding_whitening(spark, FOLDER).toPandas()
    n = len(source)
    assert len(found) == 8 * n and (found.n == n).all()
    wide = found.pivot(index="vec_id", columns="component", values="whitened").loc[source.vec_id].to_numpy()
    expected = centred @ axes[:, :8] / np.sqrt(values[:8])
    signs = np.sign((wide * expected).sum(axis=0))
    assert np.abs(wide - expected * signs).max() < 1e-9
    shares = found.groupby("component").explained.agg(["min", "max"])
    assert (shares["min"] == shares["max"]).all() and np.allclose(shares["min"], values[:8] / values.sum(), rtol=1e-10)
    whole = [[int(v) for v in row] for row in x]
    sums = [sum(column) for column in zip(*whole)]
    exact = {int(i): sum((n * v - s) ** 2 for v, s in zip(row, sums)) for i, row in zip(source.vec_id, whole)}
    assert dict(zip(found.vec_id, found.deviation)) == exact
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-12


def test_defined_cases_and_dependent_columns(spark):
    base = np.random.default_rng(0).normal(size=(300, 4))
    # Two equal columns, one without variance, one very small: an ill-conditioned, rank-deficient table.
    vectors = np.hstack([base, base[:, :2], np.ones((300, 1)), np.abs(base[:, :1]) * 3e-3])
    rows = [(k, v.tolist(), "x", 1) for k, v in enumerate(vectors)] + [(5, vectors[5].tolist(), "x", 1)]
    odd = [(None, [1.0] + [None] * 7, "x", 1), (7, None, "x", 1), (8, [], "x", 1), (9, [float("nan")] * 8, "x", 1), (10, [1e300] * 8, "x", 1), (11, [1.0, 2.0], "x", 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
    model = whitening.fit_whitening(df, components=20)
    _, _, values, _ = dense([r[1] for r in rows])
    kept = int((values > 1e-6).sum())
    assert model.n == 301 and kept == 5 and np.allclose(model.variances, values[:kept], rtol=1e-9) and model.identity_error < 1e-9
    out = whitening.whiten(df, model)
    assert out.columns == [*df.columns, "whitened_", "deviation"] and out.count() == 307
    assert out.where("whitened_ IS NULL AND deviation IS NULL").count() == len(odd)
    twice = out.where("vec_id = 5").collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_few_and_far_vectors(spark):
    make = lambda vectors: spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    assert whitening.fit_whitening(make([])) is None and whitening.fit_whitening(make([None, [None]])) is None
    same = make([[1.0, 2.0]] * 3)
    model = whitening.fit_whitening(same)
    assert [r["whitened"] for r in whitening.whiten(same, model).collect()] == [[]] * 3
    # Sums of squares beyond 64 bits: exact until they do not fit a long.
    for size, fits in ((1e15, False), (2e5, True)):
        far = make([[size, 2.0], [-size, 3.0], [size / 2, -7.0]])
        model = whitening.fit_whitening(far)
        got = [r["deviation"] for r in whitening.whiten(far, model).orderBy("vec_id").collect()]
        x = [[int(v * 1024) + 100000 for v in row] for row in ([size, 2.0], [-size, 3.0], [size / 2, -7.0])]
        sums = [sum(c) for c in zip(*x)]
        exact = [sum((3 * v - s) ** 2 for v, s in zip(row, sums)) for row in x]
        assert got == ([e if e < 1 << 63 else None for e in exact]) and (got[0] is not None) == fits
        assert model.identity_error < 1e-9
