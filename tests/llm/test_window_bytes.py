"""Windows that meet under one hash are told apart by their bytes."""

import numpy as np
import pytest

from tablewright.llm import suffix_array


@pytest.mark.parametrize("spread", [1, 3, 1 << 60])
def test_colliding_hashes_change_nothing(monkeypatch, spread):
    rng = np.random.default_rng(spread % 97)
    mix = suffix_array.mix
    monkeypatch.setattr(suffix_array, "mix", lambda values, seed=0: mix(values, seed) % np.uint64(spread))
    kinds = rng.integers(0, 256, (6, suffix_array.WINDOW)).astype(np.uint8)
    of = rng.integers(0, 6, 60)
    data = kinds[of].ravel()
    count = len(of)
    ones, rank = np.ones(count, np.int64), rng.permutation(count) // 2  # some share a rank
    out = np.zeros(count, bool)
    suffix_array.compare(data, np.arange(count) * suffix_array.WINDOW, 0 * ones, ones, rank, 0 * ones, np.arange(count), np.arange(count), None, out)
    least = {k: rank[of == k].min() for k in range(6)}
    assert out.tolist() == [bool(rank[i] > least[of[i]]) for i in range(count)]
