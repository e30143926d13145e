import itertools

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from tablewright.llm import kernels, setsketch, substring, suffix_array
from tests.llm import brute

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b.", max_size=40)), max_size=8)


@settings(deadline=None, max_examples=60)
@given(TEXTS)
def test_words_of_a_batch(texts):
    data, offsets = kernels.texts_of(pa.array(texts, pa.string()))
    starts, ends, first = kernels.word_edges(data, offsets)
    found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    expected = [brute.words(t) for t in texts]
    assert found == [w for x in expected for w in x]
    assert np.diff(first).tolist() == [len(x) for x in expected]
    folded = kernels.word_hashes(data, starts, ends, fold=True)
    names = [w for t in texts for w in brute.words(t, True)]
    for (a, x), (b, y) in itertools.combinations(zip(folded.tolist(), names), 2):
        assert (a == b) == (x == y)


@settings(deadline=None, max_examples=40)
@given(TEXTS)
def test_shingle_sets(texts):
    data, offsets = kernels.texts_of(pa.array(texts, pa.string()))
    starts, ends, first = kernels.word_edges(data, offsets)
    values, begin = kernels.shingle_sets(kernels.word_hashes(data, starts, ends, fold=True), first)
    sets = [brute.shingles(t) for t in texts]
    assert np.diff(begin).tolist() == [len(s) for s in sets]
    for (a, x), (b, y) in itertools.combinations(enumerate(sets), 2):
        mine = set(values[begin[a] : begin[a + 1]].tolist()) & set(values[begin[b] : begin[b + 1]].tolist())
        assert len(mine) == len(x & y)


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    starts = np.arange(0, 4900, 7)
    whole = kernels.span_hashes(data, starts, starts + 90)
    runs = kernels.sequence_hashes(data.astype(np.uint64), 32)
    monkeypatch.setattr(kernels, "BLOCK", 256)
    assert (kernels.span_hashes(data, starts, starts + 90) == whole).all()
    assert (kernels.sequence_hashes(data.astype(np.uint64), 32) == runs).all()
    assert (kernels.span_hashes(data[70:], starts[10:20] - 70, starts[10:20] + 20) == whole[10:20][:0].sum() + kernels.span_hashes(data, starts[10:20], starts[10:20] + 90)).all()


def test_cover_meets_at_every_shift():
    size, cover = substring.PERIOD, set(substring.COVER)
    for x, y in itertools.product(range(size), repeat=2):
        assert any((x + d) % size in cover and (y + d) % size in cover for d in range(size))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(*[st.integers(0, 2)] * 4), max_size=30))
def test_multikey_order(rows):
    words = np.array(rows, np.uint64).reshape(-1, 4)
    order = suffix_array.multikey_order(words) if rows else []
    assert [tuple(words[k].tolist()) for k in order] == sorted(rows)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 64, 3000, np.uint64)
    a, b = np.unique(pool[:2200]), np.unique(pool[400:3000])
    both = np.unique(np.concatenate((a, b)))
    regs = setsketch.registers(np.concatenate((a, b, both)), np.cumsum([0, len(a), len(b), len(both)]))
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
    true = len(np.intersect1d(a, b)) / len(both)
    estimate, lost = setsketch.similarity_evidence(
        np.array([(regs[0] > regs[1]).sum()]), np.array([(regs[0] < regs[1]).sum()]), np.array([len(a)]), np.array([len(b)]), 0.75
    )
    assert abs(estimate[0] - true) < 0.15


def test_registers_of_small_and_large_sets_agree():
    values = np.random.default_rng(5).integers(0, 1 << 64, 63 + 65, np.uint64)
    small = setsketch.registers(values[:63], np.array([0, 63]))
    large = setsketch.registers(np.concatenate((values[:63], values[:63], values[63:])), np.array([0, 63, 63 + 128]))
    assert (small[0] == large[0]).all() and (large[1] >= small[0]).all()
    assert (setsketch.registers(values[:0], np.array([0, 0])) == 0).all()
