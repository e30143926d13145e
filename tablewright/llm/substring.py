"""Removal of passages that stand in an earlier document, found by difference-cover anchors.

A word is a run of non-space bytes. `COVER` is a difference cover modulo `PERIOD`: for any two places there is
a step d below PERIOD that takes both to cover positions. So if two documents share `WINDOW` words, some window
of WINDOW - PERIOD + 1 words lies at cover positions of both, and hashing windows at cover positions alone
finds it: about one word in five is hashed. Anchors met in two documents are then extended to all
WINDOW-word windows around them, whose 96-bit hashes say in which document each window stands first. A word goes
if a window over it stands in a document with a smaller id.

Defined cases: a null text has no words; fewer than WINDOW words: nothing goes; rows that share an id are never
earlier than one another; rows without an id are left out. Extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm.base import Scratch, keyed, query, table
from tablewright.llm.chunks import (
    answered, asked, bucket_count, chunk_batches, chunk_rows, opened, pack, read_bits, removed_runs, unpack, with_answers,
)
from tablewright.llm.kernels import mix, sequence_hashes, word_edges, word_hashes

WINDOW = 50
PERIOD = 21
COVER = (3, 6, 7, 12, 14)  # every difference modulo 21 occurs between two of these
ANCHOR = WINDOW - PERIOD + 1

KEPT = "id long, n_words long, n_removed long, kept binary"


class Words:
    """Word hashes of one chunk; positions count words from the start of their text for the cover."""

    def __init__(self, row: dict):
        self.ids, self.data, self.offsets = opened(row["ids"], row["ends"], row["packed"])
        self.starts, self.ends, self.first = word_edges(self.data, self.offsets)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.text = np.repeat(np.arange(len(self.ids)), np.diff(self.first))

    def fitting(self, size: int) -> np.ndarray:
        """For each word whether `size` words of its text begin at it."""
        return np.arange(len(self.hashes)) + size <= self.first[1:][self.text]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of all anchors, and their keys (63 bits)."""
        cover = np.isin(np.arange(PERIOD), COVER)
        place = np.flatnonzero(self.fitting(ANCHOR) & cover[(np.arange(len(self.hashes)) - self.first[:-1][self.text]) % PERIOD])
        return place, sequence_hashes(self.hashes, ANCHOR)[place] >> np.uint64(1)

    def anchor_keys(self, buckets: int):
        """Sorted distinct keys, whether each stands in two documents here, their buckets, and each anchor's index."""
        place, keys = self.anchors()
        distinct, index = np.unique(keys, return_inverse=True)
        own = self.ids[self.text[place]]
        low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, index, own)
        np.maximum.at(high, index, own)
        return place, index, distinct, low != high, bucket_of(distinct << np.uint64(1), buckets)

    def windows(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all windows around the anchors at `place`, and both parts of their hashes."""
        change = np.zeros(len(self.hashes) + 1, np.int32)
        np.add.at(change, np.maximum(place - (PERIOD - 1), self.first[:-1][self.text[place]]), 1)
        np.add.at(change, place + 1, -1)
        start = np.flatnonzero((np.cumsum(change[:-1]) > 0) & self.fitting(WINDOW))
        high = sequence_hashes(self.hashes, WINDOW, 1)[start]
        low = sequence_hashes(mix(self.hashes, 3), WINDOW, 2)[start].astype(np.uint32)
        return start, high, low

    def window_keys(self, place: np.ndarray, buckets: int):
        """Windows, the index of each one's key, the sorted distinct keys with the smallest id that has them, buckets."""
        start, high, low = self.windows(place)
        order = np.lexsort((low, high))
        h, l = high[order], low[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(fresh) - 1
        smallest = np.full(int(fresh.sum()), np.iinfo(np.int64).max)
        own = self.ids[self.text[start]]
        np.minimum.at(smallest, index, own)
        return start, index, h[fresh], l[fresh], smallest, own, bucket_of(h[fresh], buckets)

    def kept(self, k: int, gone: np.ndarray) -> bytes:
        """Words of text k that stay, joined by one space."""
        a, b = self.first[k], self.first[k + 1]
        stay = np.flatnonzero(~gone[a:b]) + a
        if not len(stay):
            return b""
        sizes = self.ends[stay] - self.starts[stay] + 1  # with a space behind each
        out = np.full(int(sizes.sum()), 32, np.uint8)
        at = np.cumsum(sizes) - sizes
        index = np.repeat(self.starts[stay] - at, sizes - 1) + _but_last(at, sizes)
        out[_but_last(at, sizes)] = self.data[index]
        return out[:-1].tobytes()


def _but_last(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of runs that begin at `at`, but for the last position of each run."""
    size = sizes - 1
    return np.arange(int(size.sum())) + np.repeat(at - (np.cumsum(size) - size), size)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def repeated_anchors(bodies: list[bytes]) -> list[bytes]:
    """For each chunk's keys: does the key stand in two documents?"""
    parts = [unpack(x) for x in bodies]
    keys, many = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    out = many.astype(bool)
    again = np.zeros(len(keys), bool)
    again[1:] |= same
    again[:-1] |= same
    run = np.cumsum(np.concatenate(([True], ~same))) - 1
    any_many = np.zeros(int(run[-1]) + 1, bool)
    np.logical_or.at(any_many, run, out[order])
    out[order] = again | any_many[run]
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return [np.packbits(x).tobytes() if x.any() else None for x in np.split(out, cuts)]


def later_windows(bodies: list[bytes]) -> list[bytes]:
    """For each chunk's windows: does another chunk have the window in a document with a smaller id?"""
    parts = [unpack(x) for x in bodies]
    high, low, smallest = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((low, high))
    h, l = high[order], low[order]
    begin = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (l[1:] != l[:-1]))))
    best = np.minimum.reduceat(smallest[order], begin)
    out = np.empty(len(order), bool)
    out[order] = smallest[order] > np.repeat(best, np.diff(np.append(begin, len(order))))
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return [np.packbits(x).tobytes() if x.any() else None for x in np.split(out, cuts)]


def remove_repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept: the words that stay, joined by one space, as UTF-8 bytes."""
    spark = df.sparkSession
    buckets, partitions = bucket_count(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def ask_anchors(batches):
        for row in chunk_batches(batches):
            _, _, keys, many, bucket = Words(row).anchor_keys(buckets)
            yield asked(row["chunk"], bucket, lambda a, b: pack(keys[a:b], many[a:b]))

    def repeated_place(words: Words, row: dict) -> np.ndarray:
        place, index, keys, _, bucket = words.anchor_keys(buckets)
        return place[read_bits(row["answers0"], bucket)[index]]

    def ask_windows(batches):
        for row in chunk_batches(batches):
            words = Words(row)
            _, _, high, low, smallest, _, bucket = words.window_keys(repeated_place(words, row), buckets)
            yield asked(row["chunk"], bucket, lambda a, b: pack(high[a:b], low[a:b], smallest[a:b]))

    def cut_out(batches):
        for row in chunk_batches(batches):
            words = Words(row)
            start, index, _, _, smallest, own, bucket = words.window_keys(repeated_place(words, row), buckets)
            late = read_bits(row["answers1"], bucket)[index] | (own > smallest[index])
            gone = removed_runs(late, start, WINDOW, len(words.hashes))
            counts = np.bincount(words.text[gone], minlength=len(words.ids))
            texts = [words.kept(k, gone) for k in range(len(words.ids))]
            yield pa.record_batch(
                [
                    pa.array(words.ids), pa.array(np.diff(words.first)), pa.array(counts.astype(np.int64)),
                    pa.array(texts, pa.binary()),
                ],
                names=["id", "n_words", "n_removed", "kept"],
            )

    # The result is made when it is read, from the chunks and the answers: those stay, what was asked goes.
    with Scratch(spark, "substring") as scratch:
        chunks = scratch.keep(chunk_rows(keyed(df, id_col, text_col)), "chunks")
        first = scratch.keep(answered(chunks.mapInArrow(ask_anchors, "bucket int, chunk long, body binary"), repeated_anchors, partitions), "anchors")
        both = with_answers(chunks, first)
        second = scratch.keep(answered(both.mapInArrow(ask_windows, "bucket int, chunk long, body binary"), later_windows, partitions), "windows")
    return with_answers(chunks, first, second).mapInArrow(cut_out, KEPT)


@query("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeated_passages(table(spark, folder, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
