"""Near-duplicate documents by SetSketch registers, bands, joint likelihood and exact verification.

A document's set are its distinct five-word shingles (A-Z lowered; fewer words: the whole sequence as one).
Equal sets form a class. Classes that agree in a band of registers meet in a bucket; within a bucket pairs whose
joint likelihood allows a similarity of 0.75 are verified on their full sets, each pair in the first band it
shares, and only links that join what the bucket has not yet joined are handed on. So a bucket of g classes
gives at most g - 1 links, never its pairs, and components come out the same. Buckets of more than
`BLOCK_ROWS` classes are cut into blocks, and every two blocks meet in a task of their own.

With 32 bands of 3 of 256 registers, a pair of similarity 0.75 shares no band once in 4 * 10**7 pairs; the
likelihood test keeps what lies within `LOST` (about four standard deviations).

Defined cases: null and empty texts and texts without words have an empty set, are linked with nothing and are
their own component; rows without an id are left out; rows that share an id give one row with the largest
set and the smallest component of them. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.llm import setsketch
from tablewright.llm.base import Scratch, keyed, query, table
from tablewright.llm.graph import components
from tablewright.llm.kernels import shingle_sets, slices, texts_of, word_edges, word_hashes

PERCENT = 75
LOST = 9.0  # log-likelihood a similarity of 0.75 may lose against the best one
BLOCK_ROWS = 1024
ROWS_AT_ONCE = 2048
CACHE_BYTES = 48 << 20


def sets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_edges(data, offsets)
    return shingle_sets(word_hashes(data, starts, ends, fold=True), first)


def sketches(rows: DataFrame) -> DataFrame:
    """id, node, n (set size), digest of the set, sketch of (id, node, text)."""

    def sketched(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(2))
            for a, b in slices(offsets):
                values, begin = sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows = setsketch.registers(values, begin)
                digests = [
                    hashlib.blake2b(values[begin[k] : begin[k + 1]].tobytes(), digest_size=16).digest() for k in range(b - a)
                ]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(begin).astype(np.int64)),
                        pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary()),
                    ],
                    names=["id", "node", "n", "digest", "sketch"],
                )

    return rows.mapInArrow(sketched, "id long, node long, n long, digest binary, sketch binary")


def packed(rows: DataFrame) -> DataFrame:
    """node, packed text of (id, node, text)."""

    def pack(batches):
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [tool.compress((t.as_py() or "").encode()) for t in batch.column(2)]
            yield pa.record_batch([batch.column(1), pa.array(texts, pa.binary())], names=["node", "packed"])

    return rows.mapInArrow(pack, "node long, packed binary")


def band_rows(classes: DataFrame) -> DataFrame:
    """key, node: one row per class and band."""

    def banded(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                regs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(len(ids), setsketch.REGISTERS)
                keys = setsketch.band_keys(regs)
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(ids, setsketch.BANDS))], names=["key", "node"])

    return classes.select("node", "sketch").mapInArrow(banded, "key long, node long")


class Texts:
    """Sets of the members of a bucket, unpacked when asked for and kept up to CACHE_BYTES."""

    def __init__(self, packed_texts: list[bytes]):
        self.packed, self.kept, self.size, self.tool = packed_texts, OrderedDict(), 0, zstandard.ZstdDecompressor()

    def __getitem__(self, k: int) -> np.ndarray:
        if k in self.kept:
            self.kept.move_to_end(k)
            return self.kept[k]
        data = np.frombuffer(self.tool.decompress(self.packed[k]), np.uint8)
        values = sets_of(data, np.array([0, len(data)]))[0]
        self.kept[k] = values
        self.size += values.nbytes
        while self.size > CACHE_BYTES and len(self.kept) > 2:
            self.size -= self.kept.popitem(last=False)[1].nbytes
        return values


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def likely_pairs(group: np.ndarray, band: np.ndarray, side: np.ndarray, across: np.ndarray, sizes: np.ndarray, regs: np.ndarray):
    """Row pairs of the same group that may be similar, and in how many registers they agree; rows are in order of groups.

    Row k meets row k + 1 of its group, then row k + 2, and so on, for all groups at once.
    """
    first, second, closeness = [], [], []
    bands = regs[:, : setsketch.BANDS * setsketch.PER_BAND]
    for lag in range(1, int(np.bincount(group).max())):
        a = np.flatnonzero(group[lag:] == group[:-lag])
        b = a + lag
        fits = ~across[a] | (side[a] != side[b])
        fits &= 100 * np.minimum(sizes[a], sizes[b]) >= PERCENT * np.maximum(sizes[a], sizes[b])
        a, b = a[fits], b[fits]
        for lo in range(0, len(a), 4096):
            x, y = a[lo : lo + 4096], b[lo : lo + 4096]
            equal = (regs[x] == regs[y]).sum(axis=1)
            # Similar pairs agree in nearly three of four registers, none of them in under a half.
            near = equal * 2 >= setsketch.REGISTERS
            x, y, equal = x[near], y[near], equal[near]
            same = (bands[x] == bands[y]).reshape(len(x), setsketch.BANDS, setsketch.PER_BAND).all(axis=2)
            here = same.argmax(axis=1) == band[x]
            first.append(x[here])
            second.append(y[here])
            closeness.append(equal[here])
    if not first:
        none = np.zeros(0, np.int64)
        return none, none, none
    a, b, equal = (np.concatenate(x) for x in (first, second, closeness))
    above = np.concatenate([(regs[a[k : k + 4096]] > regs[b[k : k + 4096]]).sum(axis=1) for k in range(0, len(a), 4096)] or [equal])
    _, lost = setsketch.similarity_evidence(above, setsketch.REGISTERS - equal - above, sizes[a], sizes[b], PERCENT / 100)
    likely = lost <= LOST
    return a[likely], b[likely], equal[likely]


def joining_links(a: np.ndarray, b: np.ndarray, equal: np.ndarray, sizes: np.ndarray, texts: Texts):
    """Of the pairs, the verified ones that join what is not yet joined; the likeliest first."""
    leader: dict[int, int] = {}

    def top(x: int) -> int:
        while leader.setdefault(x, x) != x:
            leader[x] = leader[leader[x]]
            x = leader[x]
        return x

    for k in np.argsort(-equal, kind="stable").tolist():
        i, j = int(a[k]), int(b[k])
        if top(i) == top(j):
            continue
        both = shared(texts[i], texts[j])
        if 100 * both >= PERCENT * (sizes[i] + sizes[j] - both):
            leader[top(i)] = top(j)
            yield i, j


def verified_links(members: DataFrame, partitions: int) -> DataFrame:
    """a, b: links among rows (key, i, j, side, node, n, sketch, packed) of the same (key, i, j)."""

    def linked(batches):
        held: list[pa.RecordBatch] = []

        def solve():
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            key, i, j, side, nodes, sizes = (rows.column(c).to_numpy() for c in ("key", "i", "j", "side", "node", "n"))
            change = np.concatenate(([False], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            regs = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(-1, setsketch.REGISTERS)
            a, b, equal = likely_pairs(np.cumsum(change), key >> 48, side, i != j, sizes, regs)
            found = list(joining_links(a, b, equal, sizes, Texts(rows.column("packed").to_pylist())))
            return pa.record_batch(
                [pa.array([nodes[x] for x, _ in found], pa.int64()), pa.array([nodes[y] for _, y in found], pa.int64())],
                names=["a", "b"],
            )

        # Whole groups are solved together, as soon as there are ROWS_AT_ONCE rows.
        last, size = None, 0
        for batch in batches:
            marks = [batch.column(c).to_numpy() for c in (0, 1, 2)]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in marks], axis=0)) + 1
            begin = 0
            for at in [0, *change.tolist()]:
                group = tuple(int(x[at]) for x in marks) if batch.num_rows else last
                if group != last and size + at - begin >= ROWS_AT_ONCE:
                    if at > begin:
                        held.append(batch.slice(begin, at - begin))
                    if held:
                        yield solve()
                    begin, size = at, 0
                last = group
            if batch.num_rows > begin:
                held.append(batch.slice(begin))
                size += batch.num_rows - begin
        if held:
            yield solve()

    ordered = members.select("key", "i", "j", "side", "node", "n", "sketch", "packed")
    return ordered.repartition(partitions, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(
        linked, "a long, b long"
    )


def row_number(id_column: Column, text_column: Column) -> Column:
    """A row goes by a number made from its id and text, so rows that share an id stay apart."""
    return F.xxhash64(id_column.cast("long"), text_column)


def found_parts(df: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and the part (component) of each digest of a set that is not empty."""
    rows = keyed(df, id_col, text_col).select("id", row_number(F.col("id"), F.col("text")).alias("node"), "text")
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = scratch.write(sketches(rows), "sketches")
    classes = made.where("n > 0").groupBy("digest").agg(F.min(F.struct("node", "n", "sketch")).alias("c"))
    classes = scratch.write(classes.select("digest", "c.node", "c.n", "c.sketch"), "classes")
    band = scratch.write(band_rows(classes).groupBy("key").agg(F.count("*").alias("g")).where("g > 1"), "bands")
    members = band_rows(classes).join(band, "key").select(
        "key", "node", F.ceil(F.col("g") / BLOCK_ROWS).cast("int").alias("blocks")
    )
    members = members.withColumn("side", F.expr("cast(pmod(xxhash64(node), blocks) AS int)"))
    members = scratch.write(
        members.select("key", "node", "side", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        .select("key", "node", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")),
        "members",
    )
    texts = packed(rows).join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    full = scratch.write(classes.select("node", "n", "sketch").join(texts, "node"), "full")
    links = verified_links(members.join(full, "node"), partitions)
    parts = components(links, scratch)
    owner = scratch.write(
        classes.select("digest", F.col("node").alias("class")).join(parts, F.col("class") == F.col("node"), "left")
        .select("digest", F.coalesce("component", "class").alias("part")),
        "owner",
    )
    return made, owner


def repeated_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`row_number` of all rows of a component but the first by id, and of its rows that share that id by the number."""
    with Scratch(df.sparkSession, "setsketch") as scratch:
        made, owner = found_parts(df, id_col, text_col, scratch)
        placed = scratch.write(made.where("n > 0").join(owner, "digest").select("id", "node", "part"), "placed")
        first = scratch.write(placed.groupBy("part").agg(F.min(F.struct("id", "node")).alias("first")), "first")
        gone = placed.join(first, "part").where("node <> first.node").select("node")
        return scratch.keep(gone.distinct(), "gone")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept: one row per id."""
    with Scratch(df.sparkSession, "setsketch") as scratch:
        made, owner = found_parts(df, id_col, text_col, scratch)
        placed = scratch.write(made.where("n > 0").select("id", "n", "digest").join(owner, "digest").select("id", "n", "part"), "placed")
        named = scratch.write(placed.groupBy("part").agg(F.min("id").alias("component")), "named")
        out = placed.join(named, "part").select("id", "n", "component")
        out = out.unionByName(made.where("n = 0").select("id", "n", F.col("id").alias("component")))
        out = out.groupBy("id").agg(F.max("n").alias("n_shingles"), F.min("component").alias("component_id"))
        return scratch.keep(out.withColumn("kept", F.col("id") == F.col("component_id")))


@query("op5_minhash_near_dedup")
def op5_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")
