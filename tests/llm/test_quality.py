"""The quality classifier against plain counting and a plain quadratic discriminant."""

import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import REGISTRY, quality

FOLDER = "/root/testdata/sf0.001"
ODD = [None, "", " ", "One", "a a a\nb", "É É 1!? |x|", "#$% AB ab. " * 50, "word " * 30_000, "x" * 100_000]


def plain_statistics(text: str | None) -> list[float]:
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n = len(words) + quality.DAMPING
    found = [math.sqrt(sum(byte in members for byte in data) / n) for members in quality.CLASSES]
    stutter = sum(a == b for a, b in zip(words, words[1:]))
    return [*found, math.sqrt(stutter / n), math.log((sum(map(len, words)) + 5 * quality.DAMPING) / n)]


def test_statistics_of_odd_texts():
    got = quality.statistics(pa.array(ODD, pa.string()))
    np.testing.assert_allclose(got, [plain_statistics(text) for text in ODD], rtol=1e-12)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not available")
def test_scores_equal_a_plain_discriminant(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs}
    x = {i: np.array(plain_statistics(text)) for i, text in docs.items()}
    taught = [np.array([x[i] for i in docs if not held[i] and labels.get(i) == c]) for c in (0, 1)]
    sizes, width = [len(t) for t in taught], len(x[next(iter(x))])
    spreads = [np.cov(t, rowvar=False, bias=True) for t in taught]
    pooled = sum(n * np.diag(np.diag(s)) for n, s in zip(sizes, spreads)) / sum(sizes) + quality.FLOOR * np.eye(width)
    shrunk = [(1 - quality.SHRINKAGE) * s + quality.SHRINKAGE * pooled + quality.FLOOR * np.eye(width) for s in spreads]

    def log_density(row: np.ndarray, c: int) -> float:
        away = row - taught[c].mean(axis=0)
        return math.log(sizes[c] / sum(sizes)) - 0.5 * np.linalg.slogdet(shrunk[c])[1] - 0.5 * away @ np.linalg.solve(shrunk[c], away)

    got = {r["doc_id"]: r for r in REGISTRY["op3_quality_classifier"].run(spark, FOLDER).collect()}
    assert got.keys() == docs.keys() and {i: r["held_out"] for i, r in got.items()} == held
    for i, row in got.items():
        wanted = 1 / (1 + math.exp(-max(-700.0, min(700.0, log_density(x[i], 1) - log_density(x[i], 0)))))
        assert row["score"] == pytest.approx(wanted, abs=1e-7)
        assert row["predicted"] == (1 if row["score"] >= 0.5 else 0)
