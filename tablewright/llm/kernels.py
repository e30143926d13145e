"""Array helpers that run inside tasks: words, shingles and window hashes of a batch of texts.

All hashes are polynomials modulo 2**64 over bytes (or over word hashes) with a fixed odd base, so a
window's hash depends on its content alone, never on the batch or block it was met in. Work goes block
by block: memory follows the block, not the longest text.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
SLICE_BYTES = 2 << 20

BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def held(key: tuple, make: Callable[[], object]):
    """make(), once in a Python process: functions that travel by value begin with new globals in each task."""
    store = sys.modules.setdefault("_tablewright_held", ModuleType("_tablewright_held")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def _is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SPACES)] = True
    return table


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


IS_SPACE = _is_space()
LOWER = _lower_table()


class remembered:  # noqa: N801  used as a decorator
    """The last results of a function, by its arguments; they stay behind when the function goes to an executor."""

    def __init__(self, function, most: int = 8):
        self.function, self.most, self.known = function, most, {}

    def __call__(self, *arguments):
        if arguments not in self.known:
            if len(self.known) >= self.most:
                del self.known[next(iter(self.known))]
            self.known[arguments] = self.function(*arguments)
        return self.known[arguments]

    def __reduce__(self):
        return remembered, (self.function, self.most)


@remembered
def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base & MASK, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@remembered
def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = values + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and where each text starts (one more offset at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    count = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, count + 1, column.offset * 8) if count else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of one row."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, end
        start = end


def word_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (one more at the end)."""
    inside = ~IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Polynomial hash of data[start:end] of each span; starts and ends must each be in order."""
    unit, back = powers(BASE, BLOCK), powers(inverse(BASE), BLOCK)
    at_start, at_end = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    scale = np.empty(len(starts), np.uint64)
    carry = 0
    for a in range(0, max(len(data), 1), BLOCK):
        block = data[a : a + BLOCK]
        block = (table[block] if table is not None else block).astype(np.uint64)
        block += np.uint64(1)
        block *= unit[: len(block)]
        sums = np.empty(len(block) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(block, out=sums[1:])
        factor = pow(BASE, a, 1 << 64)
        lo, hi = np.searchsorted(starts, (a, a + BLOCK))
        at_start[lo:hi] = sums[starts[lo:hi] - a] * np.uint64(factor) + np.uint64(carry)
        scale[lo:hi] = back[starts[lo:hi] - a] * np.uint64(pow(inverse(BASE), a, 1 << 64))
        lo, hi = np.searchsorted(ends, (a + 1, a + BLOCK + 1))
        at_end[lo:hi] = sums[ends[lo:hi] - a] * np.uint64(factor) + np.uint64(carry)
        carry = (carry + int(sums[-1]) * factor) & MASK
    return (at_end - at_start) * scale


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    hashes = span_hashes(data, starts, ends, LOWER if fold else None)
    return mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(WORD_BASE))


def sequence_hashes(values: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of `size` values by its first index; one entry per run."""
    count = len(values) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    base = mix(np.array([seed + 1], np.uint64), 7)[0] | np.uint64(1)
    if size <= 8:
        out = values[size - 1 :].copy()
        for back in range(size - 2, -1, -1):
            out *= base
            out += values[back : back + count]
        return mix(out, seed)
    # Running sums: the run's hash is the difference of two sums, brought back to position 0.
    forth, back = powers(int(base), BLOCK), powers(inverse(int(base)), BLOCK)
    out = np.empty(count, np.uint64)
    step = BLOCK - size
    for a in range(0, count, step):
        b = min(a + step, count)
        terms = values[a : b + size - 1] * forth[: b - a + size - 1]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        out[a:b] = (sums[size:] - sums[: b - a]) * back[: b - a]
    return mix(out, seed)


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text and where each text's begin.

    A text with fewer words than `size` has its whole sequence as one shingle; without words it has none.
    """
    counts = np.diff(bounds)
    runs = sequence_hashes(hashes, size)
    full = np.maximum(counts - size + 1, 0)
    texts = np.repeat(np.arange(len(counts)), full)
    begin = np.concatenate(([0], np.cumsum(full)))
    index = np.arange(len(texts)) - begin[texts] + bounds[texts]
    values = runs[index]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        base = np.uint64(WORD_BASE)
        for k in range(size - 1):
            has = counts[short] > k
            whole[has] = whole[has] * base + hashes[bounds[short[has]] + k]
        texts, values = np.concatenate((texts, short)), np.concatenate((values, mix(whole, 5) ^ counts[short].astype(np.uint64)))
    order = np.lexsort((values, texts))
    texts, values = texts[order], values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (texts[1:] != texts[:-1]) | (values[1:] != values[:-1])
    texts, values = texts[fresh], values[fresh]
    return values, np.searchsorted(texts, np.arange(len(counts) + 1))
