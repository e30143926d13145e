"""Texts in chunks, and questions about all chunks' windows that buckets answer with bits.

A chunk is a row with some documents (about a megabyte of text, or one longer text), written once. Work on
windows then goes in rounds: every chunk sends the sorted distinct keys of its windows, cut by key range
into buckets; a bucket sees the keys of all chunks and answers each with bits in the order of its keys; the chunk
makes the same keys again and reads its answers. Copies inside a chunk are one key, so a frequent passage
costs a bucket one key per chunk and not one per copy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm.kernels import slices, texts_of

CHUNK_BYTES = 1 << 20
BUCKETS_PER_PARTITION = 4

CHUNK = "chunk long, ids binary, ends binary, packed binary"
ASKED = "bucket int, chunk long, body binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays after one another, compressed; their kinds and sizes come first."""
    head = ";".join(f"{x.dtype.str}{len(x)}" for x in arrays).encode()
    tool = zstandard.ZstdCompressor(level=1)
    return tool.compress(len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays))


def unpack(body: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    size = int.from_bytes(raw[:4], "little")
    at, out = 4 + size, []
    for part in raw[4:at].decode().split(";"):
        kind, count = np.dtype(part[:3]), int(part[3:])
        out.append(np.frombuffer(raw, kind, count, at))
        at += count * kind.itemsize
    return out


def chunk_rows(rows: DataFrame) -> DataFrame:
    """Chunks of (id, text); to be written before use, as chunk numbers come from the tasks that make them."""

    def chunked(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, (data, offsets) = batch.column(0).to_numpy(zero_copy_only=False), texts_of(batch.column(1))
            for a, b in slices(offsets, CHUNK_BYTES):
                yield pa.record_batch(
                    [
                        pa.array([number]), pa.array([pack(ids[a:b].astype(np.int64))], pa.binary()),
                        pa.array([pack(offsets[a + 1 : b + 1] - offsets[a])], pa.binary()),
                        pa.array([pack(data[offsets[a] : offsets[b]])], pa.binary()),
                    ],
                    names=["chunk", "ids", "ends", "packed"],
                )
                number += 1

    return rows.mapInArrow(chunked, CHUNK)


def opened(ids: bytes, ends: bytes, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, bytes and offsets of a chunk's documents."""
    return unpack(ids)[0], unpack(packed)[0], np.concatenate((np.zeros(1, np.int64), unpack(ends)[0]))


def bucket_count(spark: SparkSession) -> int:
    return BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def asked(number: int, buckets: np.ndarray, bodies: Callable[[int, int], bytes]) -> pa.RecordBatch:
    """One row per bucket in `buckets` (in order, one per key); bodies(a, b) packs the keys from a to b."""
    cuts = np.concatenate(([0], np.flatnonzero(buckets[1:] != buckets[:-1]) + 1, [len(buckets)])) if len(buckets) else np.zeros(1, np.int64)
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    return pa.record_batch(
        [
            pa.array([int(buckets[a]) for a, _ in spans], pa.int32()), pa.array([number] * len(spans), pa.int64()),
            pa.array([bodies(a, b) for a, b in spans], pa.binary()),
        ],
        names=["bucket", "chunk", "body"],
    )


def answered(questions: DataFrame, solve: Callable[[list[bytes]], list[bytes | None]], partitions: int) -> DataFrame:
    """chunk, answers: what `solve` says to each row of a bucket, put together by chunk; None says nothing."""

    def answer(batches: Iterator[pa.RecordBatch]):
        bucket, chunks, bodies = None, [], []

        def result():
            said = [(chunk, x) for chunk, x in zip(chunks, solve(bodies)) if x is not None]
            chunks.clear()
            bodies.clear()
            return pa.record_batch(
                [
                    pa.array([c for c, _ in said], pa.int64()), pa.array([bucket] * len(said), pa.int32()),
                    pa.array([x for _, x in said], pa.binary()),
                ],
                names=["chunk", "bucket", "bits"],
            )

        for batch in batches:
            for b, c, body in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if b != bucket and chunks:
                    yield result()
                bucket = b
                chunks.append(c)
                bodies.append(body)
        if chunks:
            yield result()

    rows = questions.repartition(partitions, "bucket").sortWithinPartitions("bucket", "chunk")
    rows = rows.mapInArrow(answer, "chunk long, bucket int, bits binary")
    return rows.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))


def with_answers(chunks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Chunks with the answers of one or more rounds beside them (an empty list where nothing was said)."""
    out = chunks
    for k, answer in enumerate(answers):
        out = out.join(answer.withColumnRenamed("answers", f"answers{k}"), "chunk", "left")
    return out


def read_bits(answers: list | None, buckets: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """One bit per key (or `counts` bits per key) from the answers; `buckets` has each key's bucket, in order."""
    sizes = np.ones(len(buckets), np.int64) if counts is None else counts
    begin = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(int(begin[-1]), bool)
    for row in answers or []:
        a, b = np.searchsorted(buckets, (row["bucket"], row["bucket"] + 1))
        size = int(begin[b] - begin[a])
        out[begin[a] : begin[b]] = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=size).astype(bool)
    return out


def chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, so that a task holds one chunk at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def removed_runs(flags: np.ndarray, starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Mask of all positions covered by windows of `length` that begin at starts[flags]."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, starts[flags], 1)
    np.add.at(change, starts[flags] + length, -1)
    return np.cumsum(change[:-1]) > 0
