"""Benchmark decontamination: which documents hold a window that is nearly a benchmark item.

Words are runs of non-space bytes with A-Z lowered. For an item of n words, every n-word window of a document
that shares a shingle (five words; fewer if the item has fewer) with that item gets a 64-bit SimHash of its
weighted shingles; a window that shares none has similarity 0. Items are indexed by four 16-bit blocks of
their SimHash, each under all codes within `BLOCK_RADIUS` bits: two fingerprints that differ in at most
4 * BLOCK_RADIUS + 3 = 23 bits must agree that far in some block, so the index returns every item within
that radius (a pair of similarity 0.75 differs in 11 bits, give or take 3). Candidates are then verified by
exact weighted shingle similarity: sum of minima over sum of maxima of counts times weights, where shingles
of few items weigh more.

A document of fewer words than an item has no such window; it is compared whole, and exactly, with every longer item
that it shares a shingle with and that is light enough to be 0.75 alike.

One pass over the documents, without a shuffle. Items are a stated query set: they go to the tasks in blocks of
at most `ITEMS_PER_BLOCK` and `BYTES_PER_BLOCK`, one pass per block. Weights do not depend on the blocks: an
aggregate counts the items of each shingle over the whole benchmark, and every task gets one table of the shingles
that two and more items hold, 10 bytes each; all others weigh the same. The table grows with the benchmark.

Defined cases: null and empty texts and items without words match nothing, and neither does a document of fewer words
than the item's shingles have; items of the same words match alike
and are reported each; rows without an id are left out; rows that share an id report for that id, and one row
per (id, item) is left, the most similar window and then the first.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.llm.base import keyed, query, table
from tablewright.llm.kernels import remembered, sequence_hashes, signed, slices, texts_of, word_edges, word_hashes

SHINGLE = 5
PERCENT = 75
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 5
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
ITEMS_PER_BLOCK = 1000
BYTES_PER_BLOCK = 8 << 20
WEIGHT_UNIT = 16
GROUP = 2048  # windows whose fingerprints are made at once

FOUND = "id long, item long, similarity double, first_word long, n_words long"


@remembered
def near_codes() -> np.ndarray:
    """All block values with at most BLOCK_RADIUS bits set."""
    return np.array(
        [sum(1 << b for b in bits) for n in range(BLOCK_RADIUS + 1) for bits in combinations(range(BLOCK_BITS), n)], np.uint32
    )


def fingerprints(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes with whole-number weights."""
    out = np.zeros(len(hashes), np.uint64)
    for bit in range(64):
        ones = ((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) * 2 - 1
        out |= ((ones * weights).sum(axis=1) > 0).astype(np.uint64) << np.uint64(bit)
    return out


def item_shingles(texts: pa.Array) -> list[tuple[int, np.ndarray]]:
    """Number of words and shingle hashes of each text; without words it has none."""
    data, offsets = texts_of(texts)
    starts, ends, first = word_edges(data, offsets)
    hashes = word_hashes(data, starts, ends, fold=True)
    words = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
    return [(len(w), sequence_hashes(w, min(SHINGLE, len(w))) if len(w) else w) for w in words]


def shingle_weights(n_items: int, shingles: np.ndarray, holders: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Weight of a shingle of one item or none, and the shingles of more items in order with their weights."""
    order = np.argsort(shingles)
    counts, which = np.unique(holders[order], return_inverse=True)
    weights = np.array([round(WEIGHT_UNIT * (1 + np.log(n_items / n))) for n in counts.tolist()], np.uint16)
    return round(WEIGHT_UNIT * (1 + np.log(max(n_items, 1)))), shingles[order], weights[which]


class Items:
    """A block of items: words, weighted shingles, fingerprints and the multi-index.

    `weights` are the `shingle_weights` of all items that are searched for; without them these items are all.
    """

    def __init__(self, ids: list[int], texts: list[str | None], weights: tuple[int, np.ndarray, np.ndarray] | None = None):
        found = [(item, n, x) for item, (n, x) in zip(ids, item_shingles(pa.array(texts, pa.string()))) if n]
        self.ids, self.shingles = [item for item, _, _ in found], [x for _, _, x in found]
        self.sizes = np.array([n for _, n, _ in found], np.int64)
        self.known, holders = np.unique(
            np.concatenate([np.unique(x) for x in self.shingles] or [np.zeros(0, np.uint64)]), return_counts=True
        )
        self.screen = np.zeros(1 << 18, bool)
        self.screen[(self.known >> np.uint64(46)).astype(np.int64)] = True
        self.most, self.shared, self.weights = weights or shingle_weights(len(self.ids), self.known, holders)
        pairs = [(np.searchsorted(self.known, np.unique(x)), k) for k, x in enumerate(self.shingles)]
        shingle = np.concatenate([p for p, _ in pairs]) if pairs else np.zeros(0, np.int64)
        item = np.repeat([k for _, k in pairs], [len(p) for p, _ in pairs]).astype(np.int64)
        order = np.argsort(shingle, kind="stable")
        # Items that hold each known shingle, one after the other.
        self.holder, self.holder_from = item[order], np.searchsorted(shingle[order], np.arange(len(self.known) + 1))
        self.counts = [Counter(x.tolist()) for x in self.shingles]
        self.totals = np.array([self.weigh(x).sum() for x in self.shingles], np.int64)
        self.prints = np.array([fingerprints(x[None, :], self.weigh(x)[None, :])[0] for x in self.shingles], np.uint64)
        self.index = []
        for b in range(BLOCKS):
            codes = self.block(self.prints, b)[:, None] ^ near_codes()[None, :]
            which = np.repeat(np.arange(len(self.prints)), codes.shape[1])
            order = np.argsort(codes.ravel(), kind="stable")
            self.index.append((which[order], np.searchsorted(codes.ravel()[order], np.arange((1 << BLOCK_BITS) + 1))))

    @staticmethod
    def block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32)

    def weigh(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(shingles.shape, self.most, np.int64)
        if len(self.shared):
            at = np.minimum(np.searchsorted(self.shared, shingles), len(self.shared) - 1)
            has = self.shared[at] == shingles
            out[has] = self.weights[at[has]]
        return out

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) for every item within RADIUS bits of a window's fingerprint."""
        windows, items = [], []
        for b, (which, begin) in enumerate(self.index):
            code = self.block(prints, b)
            sizes = begin[code + 1] - begin[code]
            window = np.repeat(np.arange(len(prints)), sizes)
            at = np.arange(len(window)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin[code], sizes)
            item = which[at]
            near = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
            windows.append(window[near])
            items.append(item[near])
        both = np.unique(np.concatenate(windows) * np.int64(len(self.prints)) + np.concatenate(items))
        return both // len(self.prints), both % len(self.prints)

    def similarity(self, window: np.ndarray, weights: np.ndarray, item: int) -> tuple[int, int]:
        """Weighted intersection and union of a window's shingles and an item's."""
        mine, weights = self.counts[item], dict(zip(window.tolist(), weights.tolist()))
        shared = total = 0
        for shingle, n in Counter(window.tolist()).items():
            total += n * weights[shingle]
            shared += min(n, mine.get(shingle, 0)) * weights[shingle]
        return shared, total + int(self.totals[item]) - shared

    def touched(self, hashes: np.ndarray, first: np.ndarray) -> list[int]:
        """Texts with at least one shingle of an item; the hashes of all texts stand one after the other."""
        found = np.zeros(0, np.int64)
        if not len(self.known):
            return []
        for size in np.unique(np.minimum(self.sizes, SHINGLE)).tolist():
            runs = sequence_hashes(hashes, size)
            # An 18-bit screen first: nearly all runs fail it.
            maybe = np.flatnonzero(self.screen[(runs >> np.uint64(46)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.known, runs[maybe]), len(self.known) - 1)
            hits = maybe[self.known[at] == runs[maybe]]
            text = np.searchsorted(first, hits, "right") - 1
            found = np.union1d(found, text[hits + size <= first[text + 1]])
        return found.tolist()

    def search(self, words: np.ndarray) -> dict[int, tuple[float, int]]:
        """Item index -> (similarity, first word) of the best window of one document, for all verified items."""
        best: dict[int, tuple[float, int]] = {}
        for size in np.unique(np.minimum(self.sizes, SHINGLE)).tolist():
            runs = sequence_hashes(words, size)
            at = np.minimum(np.searchsorted(self.known, runs), max(len(self.known) - 1, 0))
            hits = np.flatnonzero(self.known[at] == runs)
            if not len(hits):
                continue
            # Every window of an item's size around a shingle that the item holds.
            n = self.holder_from[at[hits] + 1] - self.holder_from[at[hits]]
            place = np.repeat(hits, n)
            item = self.holder[np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.holder_from[at[hits]], n)]
            longer = np.unique(item[(self.sizes[item] > len(words)) & (np.minimum(self.sizes[item], SHINGLE) == size)])
            if len(longer):
                self._verify_whole(runs, longer, best)
            fits = (np.minimum(self.sizes[item], SHINGLE) == size) & (self.sizes[item] <= len(words))
            spots = np.unique(np.stack((self.sizes[item[fits]], place[fits])), axis=1)
            for length in np.unique(spots[0]).tolist():
                reach = length - size + 1
                near = spots[1][spots[0] == length]
                begin = np.unique((near[:, None] - np.arange(reach)[None, :]).ravel())
                begin = begin[(begin >= 0) & (begin <= len(words) - length)]
                for a in range(0, len(begin), GROUP):
                    self._verify(runs, begin[a : a + GROUP], reach, best)
        return best

    def _verify_whole(self, runs: np.ndarray, items: np.ndarray, best: dict[int, tuple[float, int]]) -> None:
        """A document's only window against items of more words."""
        weights = self.weigh(runs)
        # No more can be shared than what the document has of known shingles, and no less united than either has.
        most = int((weights * np.isin(runs, self.known)).sum())
        for k in items[100 * most >= PERCENT * np.maximum(self.totals[items], weights.sum())].tolist():
            shared, union = self.similarity(runs, weights, k)
            if 100 * shared >= PERCENT * union:
                best[k] = (shared / union, 0)

    def _verify(self, runs: np.ndarray, begin: np.ndarray, reach: int, best: dict[int, tuple[float, int]]) -> None:
        shingles = runs[begin[:, None] + np.arange(reach)[None, :]]
        weights = self.weigh(shingles)
        known = np.isin(shingles, self.known)
        window, item = self.candidates(fingerprints(shingles, weights))
        # No more can be shared than what the window has of known shingles.
        likely = 100 * (weights * known).sum(axis=1) >= PERCENT * weights.sum(axis=1)
        keep = likely[window] & (self.sizes[item] - np.minimum(self.sizes[item], SHINGLE) + 1 == reach)
        for w, k in zip(window[keep].tolist(), item[keep].tolist()):
            shared, union = self.similarity(shingles[w], weights[w], k)
            if 100 * shared >= PERCENT * union:
                found = (shared / union, int(begin[w]))
                if k not in best or (found[0], -found[1]) > (best[k][0], -best[k][1]):
                    best[k] = found


@remembered
def _prepared(ids: tuple, texts: tuple, weights: Broadcast) -> Items:
    return Items(list(ids), list(texts), weights.value)


def benchmark_weights(items: DataFrame, id_col: str, text_col: str) -> Broadcast:
    """The `shingle_weights` over all items, counted once by an aggregate."""

    def held(batches):
        for batch in batches:
            found = [np.unique(x) for n, x in item_shingles(batch.column(0)) if n]
            shingles = pa.array(signed(np.concatenate(found or [np.zeros(0, np.uint64)])), pa.int64())
            # One null an item: their number is that of the items.
            yield pa.record_batch([pa.concat_arrays([shingles, pa.nulls(len(found), pa.int64())])], names=["shingle"])

    rows = keyed(items, id_col, text_col).where("text IS NOT NULL").select("text").mapInArrow(held, "shingle long")
    counted = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1 OR shingle IS NULL").toArrow()
    n_items = sum(counted["n"].filter(counted["shingle"].is_null()).to_pylist())
    counted = counted.filter(counted["shingle"].is_valid())
    shingles, holders = (counted[name].to_numpy() for name in ("shingle", "n"))
    return items.sparkSession.sparkContext.broadcast(shingle_weights(n_items, shingles.view(np.uint64), holders))


def item_blocks(items: DataFrame, id_col: str, text_col: str):
    """The items in order of their ids, in blocks of bounded rows and bytes, read one by one."""
    block, size = [], 0
    for row in keyed(items, id_col, text_col).where("text IS NOT NULL").orderBy("id", "text").toLocalIterator():
        if block and (len(block) >= ITEMS_PER_BLOCK or size + len(row["text"]) > BYTES_PER_BLOCK):
            yield block
            block, size = [], 0
        block.append((row["id"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def find_contamination(
    documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """id, item, similarity, first_word, n_words: for each document and item the best window of similarity 0.75 and more."""
    rows = keyed(documents, id_col, text_col).where("text IS NOT NULL")
    weights, found = benchmark_weights(items, item_id_col, item_text_col), None
    for block in item_blocks(items, item_id_col, item_text_col):
        ids, texts = tuple(x for x, _ in block), tuple(x for _, x in block)

        def matched(batches, ids=ids, texts=texts):
            prepared = _prepared(ids, texts, weights)
            for batch in batches:
                names, (data, offsets) = batch.column(0).to_pylist(), texts_of(batch.column(1))
                out = []
                for a, b in slices(offsets):
                    part = data[offsets[a] : offsets[b]]
                    starts, ends, first = word_edges(part, offsets[a : b + 1] - offsets[a])
                    hashes = word_hashes(part, starts, ends, fold=True)
                    for k in prepared.touched(hashes, first):
                        words = hashes[first[k] : first[k + 1]]
                        for item, (similarity, begin) in prepared.search(words).items():
                            n_words = min(int(prepared.sizes[item]), len(words))
                            out.append((names[a + k], prepared.ids[item], similarity, begin, n_words))
                columns = list(zip(*out)) or [()] * 5
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                    names=["id", "item", "similarity", "first_word", "n_words"],
                )

        part = rows.mapInArrow(matched, FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return documents.sparkSession.createDataFrame([], FOUND)
    order = F.struct((-F.col("similarity")).alias("s"), "first_word", "n_words")
    return (
        found.groupBy("id", "item").agg(F.min(order).alias("best"))
        .select("id", "item", (-F.col("best.s")).alias("similarity"), "best.first_word", "best.n_words")
    )


def holds_item(text: Column, ids: tuple, texts: tuple, weights: Broadcast) -> Column:
    """Whether a text holds a window that is nearly one of a block of items."""

    @F.arrow_udf("boolean")
    def holds(values: pa.Array) -> pa.Array:
        prepared, (data, offsets) = _prepared(ids, texts, weights), texts_of(values)
        found = np.zeros(len(values), bool)
        for a, b in slices(offsets):
            part = data[offsets[a] : offsets[b]]
            starts, ends, first = word_edges(part, offsets[a : b + 1] - offsets[a])
            hashes = word_hashes(part, starts, ends, fold=True)
            for k in prepared.touched(hashes, first):
                found[a + k] = bool(prepared.search(hashes[first[k] : first[k + 1]]))
        return pa.array(found)

    return holds(text)


def contaminated_column(text: Column, items: DataFrame, item_id_col: str = "item_id", item_text_col: str = "text") -> Column:
    """Whether a text holds a window that is nearly an item; decided row by row, without a shuffle."""
    weights, out = benchmark_weights(items, item_id_col, item_text_col), F.lit(False)
    for block in item_blocks(items, item_id_col, item_text_col):
        out = out | holds_item(text, tuple(x for x, _ in block), tuple(x for _, x in block), weights)
    return out


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document and benchmark item found in it; documents that are not listed are clean."""
    found = find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})
