"""SetSketch registers of shingle sets: making them, their bands, and the joint likelihood of two of them."""

from __future__ import annotations

import numpy as np

from tablewright.llm.kernels import MASK, mix

REGISTERS = 256
BANDS, PER_BAND = 32, 3  # the first 96 registers make bands, all of them estimate
BASE = 1.001  # register values are exponents of this base
RATE = 20.0
LARGEST = (1 << 16) - 1
GRID = np.linspace(0.5, 1.0, 51)
DRAWS = REGISTERS * (np.log(REGISTERS) + 6)  # drawn per set at first: leaves a register empty in one of 400 sets
RUN = 1 << 17  # shingles hashed at once
SMALL = 64


def registers(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One row of registers per set; set k is values[begin[k]:begin[k + 1]]; an empty set has zeros.

    Each shingle has its own sequence of exponentially spaced times, each marked with a register; a register's
    first time over all shingles of a set is exponential with a rate that follows the set's size, and register
    i holds floor(1 - log_b(first time)), cut off at 0 and LARGEST. The larger of two registers is the register
    of the union, so sketches merge. A set is followed until all its registers have a time: large sets look at
    few times per shingle.
    """
    sizes = np.diff(begin)
    first = np.full((len(sizes), REGISTERS), np.inf)
    reach = DRAWS / np.maximum(sizes, 1)
    todo = np.flatnonzero(sizes > 0)
    while len(todo):
        order = todo[np.argsort(-sizes[todo], kind="stable")]
        large = order[sizes[order] >= SMALL]
        ends = np.cumsum(sizes[large])
        at = 0
        while at < len(large):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN, "right")))
            _draw(values, begin, large[at:to], reach, first)
            at = to
        small = order[sizes[order] < SMALL]
        for at in range(0, len(small), RUN // SMALL):
            _draw(values, begin, small[at : at + RUN // SMALL], reach, first)
        todo = todo[~np.isfinite(first[todo]).all(axis=1)]
        reach[todo] *= 4
    first[sizes == 0] = 1.0
    out = np.clip(np.floor(1 - np.log(first / (REGISTERS * RATE)) / np.log(BASE)), 0, LARGEST).astype(np.uint16)
    out[sizes == 0] = 0
    return out


def _draw(values: np.ndarray, begin: np.ndarray, sets: np.ndarray, reach: np.ndarray, first: np.ndarray) -> None:
    counts = begin[sets + 1] - begin[sets]
    for piece in range(0, int(counts.max()), RUN):  # a set larger than RUN goes in pieces
        part = np.clip(counts - piece, 0, RUN)
        owner = np.repeat(np.arange(len(sets)), part)
        x = values[np.arange(len(owner)) + np.repeat(begin[sets] + piece - (np.cumsum(part) - part), part)]
        limit, time = reach[sets][owner], np.zeros(len(owner))
        earliest, step = first[sets].ravel(), 0
        while len(x):
            step = (step + 0xA0761D6478BD642F) & MASK
            h = mix(x ^ np.uint64(step))
            time = time - np.log(((h >> np.uint64(16)).astype(np.float64) + 0.5) * 2.0**-48)
            keep = time <= limit
            x, time, owner, limit, h = x[keep], time[keep], owner[keep], limit[keep], h[keep]
            np.minimum.at(earliest, owner * REGISTERS + (h & np.uint64(REGISTERS - 1)).astype(np.int64), time)
        first[sets] = earliest.reshape(len(sets), REGISTERS)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One number per set and band; equal numbers mean equal registers of the same band."""
    parts = sketches[:, : BANDS * PER_BAND].reshape(len(sketches), BANDS, PER_BAND).astype(np.int64)
    return (np.arange(BANDS)[None, :] << 48) | (parts[:, :, 0] << 32) | (parts[:, :, 1] << 16) | parts[:, :, 2]


def _wins(x: np.ndarray) -> np.ndarray:
    return np.maximum(-np.log1p(-np.minimum(x, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9)


def similarity_evidence(above: np.ndarray, below: np.ndarray, left: np.ndarray, right: np.ndarray, least: float):
    """Most likely similarity, and log-likelihood lost by a similarity of `least` or more.

    above and below count registers in which the left sketch is larger or smaller; left and right are set sizes.
    """
    share = left / np.maximum(left + right, 1)
    top = np.minimum(share, 1 - share) / np.maximum(np.maximum(share, 1 - share), 1e-12)
    best, best_least, arg = np.full(len(share), -np.inf), np.full(len(share), -np.inf), np.zeros(len(share))
    ties = REGISTERS - above - below
    for value in GRID:
        j = np.minimum(value, top)
        more, less = _wins(share - (1 - share) * j), _wins((1 - share) - share * j)
        equal = np.maximum(1 - more - less, 1e-9)
        logs = above * np.log(more) + below * np.log(less) + ties * np.log(equal)
        better = logs > best
        best[better], arg[better] = logs[better], j[better]
        if value >= least:
            best_least = np.where(value <= top + 0.01, np.maximum(best_least, logs), best_least)
    return arg, best - best_least
