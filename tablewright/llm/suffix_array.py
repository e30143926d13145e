"""Removal of repeated byte strings by a sparse suffix array that is cut into key ranges.

Of all places of a text, those count whose 32-byte hash is the smallest (the first of equals) among the 69 places at
which a 100-byte window can have one: every window has exactly one such place, and equal windows have it at the
same offset, so suffixes that begin there are enough (about 3 in 100 bytes).

1. Splitters from a sample of the suffixes' first eight bytes cut all suffixes into ranges. A bucket sorts its
   suffixes by eight bytes after eight bytes, going on only where they tie, and compares neighbours. Splitters
   lie between different leading tokens, so suffixes that share them meet in one bucket and neighbours across a
   boundary always differ.
2. Suffixes that have an equal neighbour in their first 32 bytes send what surrounds them: the bytes of all windows
   that own the place. Copies inside a chunk are one entry. The bucket compares, offset by offset, the windows
   of entries with equal leading bytes and says which ones stand earlier elsewhere.

A byte goes if a window over it occurs with a smaller (id, start). Windows meet by their leading 32 bytes, their offset
and a 64-bit hash of the whole; what goes is compared byte by byte with the earliest one first.

Defined cases: a null text is empty; fewer than 100 bytes: nothing goes; rows that share an id are not earlier
than one another at the same start; rows without an id are left out. Extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm.base import Scratch, keyed, query, table
from tablewright.llm.chunks import (
    ASKED, answered, asked, bucket_count, chunk_batches, chunk_rows, opened, pack, read_bits, removed_runs, unpack,
    with_answers,
)
from tablewright.llm.kernels import mix, sequence_hashes, span_hashes

WINDOW = 100
LEAD = 32
PLACES = WINDOW - LEAD + 1
WINDOWS_COMPARED = 1 << 14
PLACE_BITS = 28
SAMPLED_CHUNKS = 1000  # at most about this many chunks give splitter samples
SAMPLED_SUFFIXES = 64  # of each
WINDOWS_AT_ONCE = 1 << 19

KEPT = "id long, n_bytes long, n_removed long, n_spans long, kept binary"


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows of 64-bit words: sorted by the first word, and by the next one only where rows tie."""
    order = np.argsort(words[:, 0], kind="stable")
    tied = np.zeros(len(order), bool)
    for k in range(1, words.shape[1]):
        before = words[order, k - 1]
        same = before[1:] == before[:-1]
        if k > 1:
            same &= ~fresh[1:]
        fresh = np.concatenate(([True], ~same))
        tied[:] = False
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(fresh)[where]
        order[where] = order[where][np.lexsort((words[order[where], k], group))]
    return order


def differs_from_previous(words: np.ndarray) -> np.ndarray:
    out = np.ones(len(words), bool)
    out[1:] = (words[1:] != words[:-1]).any(axis=1)
    return out


class Bytes:
    """The sampled places of one chunk: suffix words, the windows that own each place, and their surroundings."""

    def __init__(self, row: dict):
        self.ids, self.data, self.offsets = opened(row["ids"], row["ends"], row["packed"])
        size = len(self.data)
        text = np.repeat(np.arange(len(self.ids)), np.diff(self.offsets))
        end = self.offsets[1:][text]
        at = np.arange(size)
        if size < WINDOW:
            self.place = self.first = self.last = np.zeros(0, np.int64)
        else:
            hashes = sequence_hashes(self.data.astype(np.uint64) + np.uint64(1), LEAD)
            value = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | at[: len(hashes)].astype(np.uint64)
            reach = 1
            while 2 * reach <= PLACES:
                value = np.minimum(value[:-reach], value[reach:])
                reach *= 2
            if reach < PLACES:
                value = np.minimum(value[: len(value) - (PLACES - reach)], value[PLACES - reach :])
            start = np.flatnonzero(at[: len(value)] + WINDOW <= end[: len(value)])
            low = np.uint64((1 << PLACE_BITS) - 1)
            place = start + ((value[start] - start.astype(np.uint64)) & low).astype(np.int64)
            cut = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)))) if len(start) else np.zeros(0, np.int64)
            self.place, self.first = place[cut], start[cut]
            self.last = start[np.append(cut[1:], len(start)) - 1] if len(cut) else self.first
        self.text = text[self.place]
        # Where the place stands in its own text: places of different texts are compared by (id, this).
        self.inner = self.place - self.offsets[:-1][self.text]

    def words(self, which: slice | np.ndarray = slice(None)) -> np.ndarray:
        place = self.place[which]
        if not len(place):
            return np.zeros((0, LEAD // 8), np.uint64)
        return self.data[place[:, None] + np.arange(LEAD)[None, :]].view(">u8").astype(np.uint64)

    def suffixes(self, splitters: np.ndarray):
        """Each place's index among the sorted distinct suffix heads, those, whether they repeat here, buckets."""
        words = self.words()
        order = multikey_order(words) if len(words) else np.zeros(0, np.int64)
        fresh = differs_from_previous(words[order])
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(fresh) - 1
        heads = words[order][fresh]
        return index, heads, np.bincount(index, minlength=len(heads)) > 1, np.searchsorted(splitters, heads[:, 0], "right").astype(np.int32)

    def entries(self, index: np.ndarray, repeated: np.ndarray, heads: np.ndarray, buckets: np.ndarray) -> dict:
        """Places of repeated suffixes, joined where all their windows are the same; ordered by suffix head."""
        which = np.flatnonzero(repeated[index])
        place, first, last = self.place[which], self.first[which], self.last[which]
        content = span_hashes(self.data, first, last + WINDOW)
        key = mix(content ^ (place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (last - first).astype(np.uint64) << np.uint64(40))
        order = np.lexsort((self.inner[which], self.ids[self.text[which]], key, index[which]))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (key[order][1:] != key[order][:-1]) | (index[which][order][1:] != index[which][order][:-1])
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(fresh) - 1
        one = which[order[fresh]]  # the earliest place of each entry
        return {
            "which": which, "entry": entry, "one": one, "bucket": buckets[index[one]], "head": index[one],
            "id": self.ids[self.text[one]], "inner": self.inner[one],
            "left": (self.place - self.first)[one], "windows": (self.last - self.first)[one] + 1,
        }

    def surroundings(self, one: np.ndarray) -> np.ndarray:
        sizes = self.last[one] + WINDOW - self.first[one]
        return self.data[spread(self.first[one], sizes)]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the runs that begin at `starts`, run after run."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def same_suffixes(bodies: list[bytes]) -> list[bytes | None]:
    """For each chunk's suffix heads of one range: is there an equal one?"""
    parts = [unpack(x) for x in bodies]
    words = np.concatenate([p[0].reshape(-1, LEAD // 8) for p in parts])
    many = np.concatenate([p[1] for p in parts]).astype(bool)
    order = multikey_order(words)
    fresh = differs_from_previous(words[order])
    run = np.cumsum(fresh) - 1
    count = np.bincount(run)
    some = np.zeros(len(count), bool)
    np.logical_or.at(some, run, many[order])
    out = np.empty(len(order), bool)
    out[order] = ((count > 1) | some)[run]
    return [np.packbits(x).tobytes() if x.any() else None for x in np.split(out, np.cumsum([len(p[1]) for p in parts])[:-1])]


def later_windows(bodies: list[bytes]) -> list[bytes | None]:
    """For each chunk's entries: which of their windows stand earlier, in whatever chunk?"""
    parts = [unpack(x) for x in bodies]
    ids, inner, left, windows = (np.concatenate([p[k].astype(np.int64) for p in parts]) for k in range(4))
    data = np.concatenate([p[4] for p in parts])
    sizes = windows - 1 + WINDOW
    begin = np.cumsum(sizes) - sizes
    heads = data[(begin + left)[:, None] + np.arange(LEAD)[None, :]].view(">u8").astype(np.uint64)
    order = multikey_order(heads)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(differs_from_previous(heads[order])) - 1
    # Equal ranks: the same place of rows that share an id.
    by = np.lexsort((inner, ids))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(np.concatenate(([True], (ids[by][1:] != ids[by][:-1]) | (inner[by][1:] != inner[by][:-1])))) - 1
    bits_from = np.cumsum(windows) - windows
    out = np.zeros(int(windows.sum()), bool)
    members = np.bincount(group)
    at = 0
    todo = order[members[group[order]] > 1]  # entries in order of their heads; alone, nothing stands earlier
    weight = np.cumsum(windows[todo])
    while at < len(todo):
        to = int(np.searchsorted(weight, (weight[at - 1] if at else 0) + WINDOWS_AT_ONCE, "right"))
        to = max(to, at + 1)
        while to < len(todo) and group[todo[to]] == group[todo[to - 1]]:
            to += 1  # groups stay whole
        some = todo[at:to]
        if weight[to - 1] - (weight[at - 1] if at else 0) <= 4 * WINDOWS_AT_ONCE:
            compare(data, begin, left, windows, rank, group, bits_from, some, None, out)
        else:  # one very large group: a few offsets at a time, as only windows of one offset can be equal
            step = max(1, 4 * WINDOWS_AT_ONCE // len(some))
            for offset in range(0, PLACES, step):
                compare(data, begin, left, windows, rank, group, bits_from, some, (offset, offset + step), out)
        at = to
    cuts = np.cumsum([int(p[3].astype(np.int64).sum()) for p in parts])[:-1]
    return [np.packbits(x).tobytes() if x.any() else None for x in np.split(out, cuts)]


def compare(data, begin, left, windows, rank, group, bits_from, some, offsets, out) -> None:
    """Set the bit of each window of the entries `some` that an entry of lower rank has at the same offset."""
    some = np.sort(some)
    low = np.zeros(len(some), np.int64)
    high = windows[some]
    if offsets:
        low = np.clip(left[some] - (offsets[1] - 1), 0, high)
        high = np.clip(left[some] - offsets[0] + 1, low, high)
    entry = np.repeat(some, high - low)
    start = spread(begin[some] + low, high - low)
    if not len(start):
        return
    content = span_hashes(data, start, start + WINDOW)
    offset = begin[entry] + left[entry] - start
    key = mix(content + group[entry].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + offset.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    run = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    of_run = np.repeat(np.arange(len(run)), np.diff(np.append(run, len(order))))
    ranks = rank[entry][order]
    best = np.minimum.reduceat(ranks, run)
    late = np.flatnonzero(ranks > best[of_run])
    # A late window goes only if its bytes are those of its run's earliest one.
    hits = np.flatnonzero(ranks == best[of_run])[::-1]
    earliest = np.empty(len(run), np.int64)
    earliest[of_run[hits]] = hits
    same = np.empty(len(late), bool)
    windows_of = np.ndarray(len(data) - WINDOW + 1, np.dtype((np.void, WINDOW)), data, strides=(1,))
    for a in range(0, len(late), WINDOWS_COMPARED):
        part = late[a : a + WINDOWS_COMPARED]
        mine, other = (windows_of[start[order[x]]].view(np.uint32).reshape(len(part), -1) for x in (part, earliest[of_run[part]]))
        same[a : a + WINDOWS_COMPARED] = (mine == other).all(axis=1)
    gone = late[same]
    for r in np.unique(of_run[late[~same]]).tolist():  # different windows under one hash: each by its bytes
        first: dict[bytes, int] = {}
        members = np.flatnonzero(of_run == r)
        contents = [data[start[order[k]] : start[order[k]] + WINDOW].tobytes() for k in members]
        for k, content in zip(members, contents):
            first[content] = min(first.get(content, ranks[k]), ranks[k])
        gone = np.setdiff1d(gone, members)
        gone = np.concatenate((gone, [k for k, content in zip(members, contents) if ranks[k] > first[content]])).astype(np.int64)
    out[(bits_from[entry] + start - begin[entry])[order[gone]]] = True


def splitters_of(chunks: DataFrame, buckets: int) -> np.ndarray:
    """Leading tokens that cut the suffixes into `buckets` ranges, from a bounded sample of all chunks."""
    spark = chunks.sparkSession
    share = min(1.0, SAMPLED_CHUNKS / max(chunks.count(), 1))

    def sampled(batches):
        for row in chunk_batches(batches):
            some = Bytes(row)
            pick = mix(np.arange(len(some.place), dtype=np.uint64), int(row["chunk"]) & 0xFFFF)
            words = some.words(np.argsort(pick)[:SAMPLED_SUFFIXES])[:, 0]
            yield pa.record_batch([pa.array(words.view(np.int64))], names=["word"])

    picked = chunks if share == 1.0 else chunks.sample(share, seed=1)
    words = np.sort(picked.mapInArrow(sampled, "word long").toArrow()["word"].to_numpy().view(np.uint64))
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(words[(np.arange(1, buckets) * len(words)) // buckets])


def remove_repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept: the bytes that stay."""
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark, "suffixes") as scratch:
        chunks = scratch.keep(chunk_rows(keyed(df, id_col, text_col)), "chunks")
        splitters = splitters_of(chunks, bucket_count(spark))

        def ask_suffixes(batches):
            for row in chunk_batches(batches):
                _, heads, many, bucket = Bytes(row).suffixes(splitters)
                yield asked(row["chunk"], bucket, lambda a, b: pack(heads[a:b].ravel(), many[a:b]))

        def entries_of(some: Bytes, row: dict) -> dict:
            index, heads, _, bucket = some.suffixes(splitters)
            return some.entries(index, read_bits(row["answers0"], bucket), heads, bucket)

        def ask_windows(batches):
            for row in chunk_batches(batches):
                some = Bytes(row)
                e = entries_of(some, row)

                def body(a, b, e=e, some=some):
                    return pack(
                        e["id"][a:b], e["inner"][a:b], e["left"][a:b].astype(np.uint8), e["windows"][a:b].astype(np.uint8),
                        some.surroundings(e["one"][a:b]),
                    )

                yield asked(row["chunk"], e["bucket"], body)

        def cut_out(batches):
            for row in chunk_batches(batches):
                some = Bytes(row)
                e = entries_of(some, row)
                bits = read_bits(row["answers1"], e["bucket"], e["windows"])
                begin = np.cumsum(e["windows"]) - e["windows"]
                which, entry = e["which"], e["entry"]
                sizes = e["windows"][entry]
                own, mine = some.ids[some.text[which]], some.inner[which]
                later = (own > e["id"][entry]) | ((own == e["id"][entry]) & (mine > e["inner"][entry]))
                late = bits[spread(begin[entry], sizes)] | np.repeat(later, sizes)
                gone = removed_runs(late, spread(some.first[which], sizes), WINDOW, len(some.data))
                yield cut_texts(some, gone)

        first = scratch.keep(answered(chunks.mapInArrow(ask_suffixes, ASKED), same_suffixes, partitions), "same")
        second = answered(with_answers(chunks, first).mapInArrow(ask_windows, ASKED), later_windows, partitions)
        second = scratch.keep(second, "later")
    return with_answers(chunks, first, second).mapInArrow(cut_out, KEPT)


def cut_texts(some: Bytes, gone: np.ndarray) -> pa.RecordBatch:
    offsets = some.offsets
    before = np.concatenate(([0], np.cumsum(gone)))
    opens = gone.copy()
    if len(gone):
        opens[1:] &= ~gone[:-1]
        heads = offsets[:-1][offsets[:-1] < len(gone)]
        opens[heads] = gone[heads]
    runs = np.concatenate(([0], np.cumsum(opens)))
    texts = [some.data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return pa.record_batch(
        [
            pa.array(some.ids), pa.array(np.diff(offsets)), pa.array(np.diff(before[offsets])), pa.array(np.diff(runs[offsets])),
            pa.array(texts, pa.binary()),
        ],
        names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
    )


@query("op8_suffix_array_dedup")
def op8_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeated_bytes(table(spark, folder, "documents"))
    return kept.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
