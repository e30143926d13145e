"""Alignment of two tokenizers' pieces over all texts, each distinct text tokenised once.

Documents meet by their full text; each distinct text is tokenised and aligned once and counts as often as it occurs.
Byte ends that both tokenizers share cut their tokens into groups; the two tokens that end there are linked. How
often a pair of ids is linked in the whole corpus tells which partner is an id's usual one.

Texts are worked on in chunks of several million bytes. A chunk knows its distinct pairs, so a pair travels once per
chunk and not once per link: to the corpus-wide counts, and then, packed, to buckets of counted pairs that answer. What
a text then says of its links is looked up inside its chunk, and measures go to the documents by the text's SHA-256.

Long texts are tokenised in segments, cut before a single space between ASCII letters: neither tokenizer joins tokens
over such a place (a piece has the space's mark at its start only, or nothing but marks; `Tokenizers` looks).

Defined cases: null and empty texts have no tokens, and neither have texts that one of the tokenizers does not give
back byte by byte (say, with U+2581): all their measures are 0, their groups ''. Rows that repeat, or have a null id,
are documents like others: one row of measures each. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from tablewright.llm.base import Scratch, query, quoted, table
from tablewright.llm.chunks import pack, unpack
from tablewright.llm.kernels import held

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: how byte-level vocabularies of this kind split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "▁"
CHUNK_BYTES = 16 << 20
BATCH_BYTES = 1 << 20
SEGMENT = 1 << 18
PAIRS_PER_BUCKET = 1 << 10
BETWEEN_WORDS = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
LONG_GAP = re.compile(r"\s{50000}")

CHUNK = (
    "chunk string, texts array<struct<digest binary, n_a int, n_b int, n_groups int, n_links int, groups_sha256 string>>, "
    "pairs array<bigint>, weights array<bigint>, begin array<int>, pair_at array<int>, times array<int>"
)
MEASURES = "digest binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_of() -> dict[str, int]:
    """Byte-level alphabets write a printable byte as itself and the others, in order, as the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass(frozen=True)
class Tokenizers:
    """Both tokenizers, and the bytes of each of their ids."""

    first: tiktoken.Encoding
    plain: Tokenizer
    second: sentencepiece.SentencePieceProcessor
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    sizes_a: np.ndarray
    sizes_b: np.ndarray
    written: list[bytes]  # a separator and an id in decimal, at 4 * id + number of the separator

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space + text by either tokenizer, without special tokens; none if their bytes are not those of the text."""
        found: tuple[list, list] = [], []
        for part in segments(text):
            # The fast reader of the vocabulary gives up at very long white space; the other one takes longer.
            a = self.plain.encode(f" {part}", add_special_tokens=False).ids if LONG_GAP.search(part) else self.first.encode_ordinary(f" {part}")
            b, raw = self.second.encode(part), b" " + part.encode()
            if b"".join([self.bytes_a[i] for i in a]) != raw or b"".join([self.bytes_b[i] for i in b]) != raw:
                return np.zeros(0, np.int32), np.zeros(0, np.int32)
            found[0].append(np.array(a, np.int32))
            found[1].append(np.array(b, np.int32))
        return np.concatenate(found[0]), np.concatenate(found[1])


def segments(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > SEGMENT:
        cut = BETWEEN_WORDS.search(text, start + SEGMENT)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def load(byte_path: str, piece_path: str) -> Tokenizers:
    with open(byte_path, encoding="utf-8") as file:
        stated = json.load(file)
    vocabulary, letters = stated["model"]["vocab"], byte_of()
    special = {x["content"] for x in stated["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    merges = [x.split(" ") if isinstance(x, str) else x for x in stated["model"]["merges"]]
    if [vocabulary[left + right] for left, right in merges] != list(range(256, 256 + len(merges))):
        raise ValueError(f"ids of {byte_path} do not follow its merges")
    first = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    plain = Tokenizer.from_file(byte_path)
    plain.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    bytes_a = [b""] * (max(ranks.values()) + 1)
    for raw, i in ranks.items():
        bytes_a[i] = raw
    pieces = [second.id_to_piece(i) for i in range(second.get_piece_size())]
    bytes_b = [
        bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)
    ]
    joined = [p for i, p in enumerate(pieces) if p.lstrip(MARK) and MARK in p.lstrip(MARK) and not second.is_control(i)]
    if joined or not all(bytes_b):
        raise ValueError(f"{piece_path} has pieces over the space between words, or empty ones")
    written = [s + str(i).encode() for i in range(max(len(bytes_a), len(bytes_b))) for s in (b"", b",", b";", b"|")]
    sizes_a, sizes_b = (np.array([len(x) for x in xs], np.int64) for xs in (bytes_a, bytes_b))
    return Tokenizers(first, plain, second, bytes_a, bytes_b, sizes_a, sizes_b, written)


@dataclass(frozen=True)
class Aligned:
    """Some texts: token ids by either tokenizer, where they end together, and which texts and groups they are of."""

    a: np.ndarray
    b: np.ndarray
    begin_a: np.ndarray  # of each text, one more at the end
    begin_b: np.ndarray
    end_a: np.ndarray  # last token of each group
    end_b: np.ndarray
    begin_group: np.ndarray  # of each text, one more at the end

    def pairs(self) -> np.ndarray:
        return self.a[self.end_a].astype(np.int64) << 32 | self.b[self.end_b]

    def groups(self, known: Tokenizers) -> Iterator[Iterator[bytes]]:
        """For each text 'a1,a2|b1;a3|b2,b3', in pieces."""
        size_a, size_b = np.diff(self.end_a, prepend=-1), np.diff(self.end_b, prepend=-1)
        code = np.empty(len(self.a) + len(self.b), np.int32)
        # Group by group: its tokens of the first kind, then those of the second.
        done_a, done_b = np.concatenate(([0], self.end_a + 1)), np.concatenate(([0], self.end_b + 1))
        place_a = np.arange(len(self.a)) + np.repeat(done_b[:-1], size_a)
        place_b = np.arange(len(self.b)) + np.repeat(done_a[1:], size_b)
        code[place_a], code[place_b] = self.a * 4 + 1, self.b * 4 + 1
        code[place_a[done_a[:-1]]] += 1
        code[place_b[done_b[:-1]]] += 2
        filled = np.flatnonzero(np.diff(self.begin_a))
        code[place_a[self.begin_a[filled]]] -= 2
        words, step = known.written, 1 << 18

        def of(start: int, end: int) -> Iterator[bytes]:
            for k in range(start, end, step):
                yield b"".join([words[c] for c in code[k : min(k + step, end)].tolist()])

        begin = (self.begin_a + self.begin_b).tolist()
        for start, end in zip(begin[:-1], begin[1:]):
            yield of(start, end)


def align(texts: list[str], known: Tokenizers) -> Aligned:
    """Token ids and groups of each text; a text that does not come back byte by byte has none."""
    nothing = np.zeros(0, np.int32)
    found = [known.ids(text) if text else (nothing, nothing) for text in texts]
    a, b = (np.concatenate([nothing, *x]) for x in (zip(*found) if found else ((), ())))
    begin_a, begin_b = (np.concatenate(([0], np.cumsum([len(x[k]) for x in found]))).astype(np.int64) for k in (0, 1))
    # Bytes are counted through all texts: a text's last tokens end together, so no group runs into the next.
    stop_a, stop_b = np.cumsum(known.sizes_a[a]), np.cumsum(known.sizes_b[b])
    at = np.searchsorted(stop_b, stop_a)
    hit = stop_b[np.minimum(at, len(stop_b) - 1)] == stop_a if len(stop_b) else np.zeros(len(a), bool)
    end_a = np.flatnonzero(hit)
    return Aligned(a, b, begin_a, begin_b, end_a, at[hit], np.searchsorted(end_a, begin_a))


class Chunk:
    """Measures of texts that are gathered until they have CHUNK_BYTES."""

    def __init__(self):
        self.texts, self.keys, self.times, self.begin, self.copies, self.size = [], [], [], [0], [], 0

    def add(self, texts: list[str], copies: list[int], known: Tokenizers) -> None:
        found = align(texts, known)
        pairs, edges = found.pairs(), found.begin_group.tolist()
        for k, (text, written) in enumerate(zip(texts, found.groups(known))):
            mine, times = np.unique(pairs[edges[k] : edges[k + 1]], return_counts=True)
            self.keys.append(mine)
            self.times.append(times.astype(np.int32))
            self.begin.append(self.begin[-1] + len(mine))
            self.copies.append(copies[k])
            n_a, n_b = (int(x[k + 1] - x[k]) for x in (found.begin_a, found.begin_b))
            links = edges[k + 1] - edges[k]
            raw = text.encode()
            self.size += len(raw)
            digest = hashlib.sha256()
            for piece in written:
                digest.update(piece)
            self.texts.append((hashlib.sha256(raw).digest(), n_a, n_b, links, links, digest.hexdigest() if n_a else ""))

    def row(self) -> pa.RecordBatch:
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        pairs, at = np.unique(keys, return_inverse=True)
        weight = times.astype(np.int64) * np.repeat(np.array(self.copies, np.int64), np.diff(self.begin))
        weights = np.zeros(len(pairs), np.int64)
        np.add.at(weights, at, weight)
        names = ["digest", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        texts = pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*self.texts), kinds)], names)
        # Texts are distinct, so the first one's digest names the chunk.
        columns = [pa.array([self.texts[0][0].hex()]), pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)]
        for values, kind in ((pairs, np.int64), (weights, np.int64), (self.begin, np.int32), (at, np.int32), (times, np.int32)):
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(np.asarray(values, kind))))
        return pa.record_batch(columns, names=["chunk", "texts", "pairs", "weights", "begin", "pair_at", "times"])


def chunks_of(texts: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Chunks of (text, copies), aligned."""

    def aligned(batches):
        known = held(("tokenizers", byte_path, piece_path), lambda: load(byte_path, piece_path))
        chunk, waiting, copies, size = Chunk(), [], [], 0
        for batch in batches:
            for text, count in zip(batch.column(0), batch.column(1)):
                waiting.append(text.as_py())
                copies.append(count.as_py())
                size += len(waiting[-1])
                if size >= BATCH_BYTES:
                    chunk.add(waiting, copies, known)
                    waiting, copies, size = [], [], 0
                    if chunk.size >= CHUNK_BYTES:
                        yield chunk.row()
                        chunk = Chunk()
        if waiting:
            chunk.add(waiting, copies, known)
        if chunk.texts:
            yield chunk.row()

    return texts.mapInArrow(aligned, CHUNK)


def bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return (pairs % buckets).astype(np.int32)


def questions_of(chunks: DataFrame, buckets: int) -> DataFrame:
    """Of each chunk its distinct pairs, a row per bucket."""

    def asked(batches):
        for batch in batches:
            for chunk, pairs in zip(batch.column(0).to_pylist(), batch.column(1)):
                pairs = pairs.values.to_numpy()
                mine = bucket_of(pairs, buckets)
                order = np.argsort(mine, kind="stable")
                found, first = np.unique(mine[order], return_index=True)
                bodies = [pack(x) for x in np.split(pairs[order], first[1:])] if len(found) else []
                yield pa.record_batch(
                    [pa.array(found, pa.int32()), pa.array([chunk] * len(found), pa.string()), pa.array(bodies, pa.binary())], names=["bucket", "chunk", "body"]
                )

    return chunks.select("chunk", "pairs").mapInArrow(asked, "bucket int, chunk string, body binary")


def answers_to(questions: DataFrame, pairs: DataFrame, buckets: int, partitions: int) -> DataFrame:
    """chunk, answers: counts and best of what each chunk asked, by bucket. A bucket's known pairs come before its questions."""

    def answered(batches):
        bucket, parts, known = None, [], None
        for batch in batches:
            of, pair, count, best = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4))
            asking = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | asking[1:] | asking[:-1], [True])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if of[a] != bucket:
                    bucket, parts, known = int(of[a]), [], None
                if not asking[a]:
                    parts.append((pair[a:b].astype(np.int64), count[a:b].astype(np.int64), best[a:b].astype(bool)))
                    continue
                if known is None:
                    known, parts = [np.concatenate(x) for x in zip(*parts)], []
                at = np.searchsorted(known[0], unpack(batch.column(5)[a].as_py())[0])
                body = pack(known[1][at], known[2][at].view(np.int8))
                yield pa.record_batch([batch.column(1).slice(a, 1), batch.column(0).slice(a, 1), pa.array([body], pa.binary())], names=["chunk", "bucket", "body"])

    told = pairs.select(F.expr(f"cast(pair % {buckets} AS int)").alias("bucket"), F.lit(None).cast("string").alias("chunk"), "pair", "count", "best", F.lit(None).cast("binary").alias("body"))
    asked = questions.select("bucket", "chunk", *[F.lit(None).cast(k).alias(n) for n, k in (("pair", "long"), ("count", "long"), ("best", "boolean"))], "body")
    rows = told.unionByName(asked).repartition(partitions, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("chunk"), "pair")
    rows = rows.mapInArrow(answered, "chunk string, bucket int, body binary")
    return rows.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "body")).alias("answers"))  # a chunk's own pairs, packed


def measured(chunks: DataFrame, buckets: int) -> DataFrame:
    """Measures of each text of chunks with their answers."""

    def looked_up(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                texts, begin, at, times, pairs = (batch.column(batch.schema.get_field_index(x))[k].values for x in ("texts", "begin", "pair_at", "times", "pairs"))
                begin, at, times, pairs = begin.to_numpy(), at.to_numpy(), times.to_numpy().astype(np.int64), pairs.to_numpy()
                counts, best, mine = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64), bucket_of(pairs, buckets)
                order = np.argsort(mine, kind="stable")
                for answer in batch.column(batch.schema.get_field_index("answers"))[k].as_py() or []:
                    low, high = np.searchsorted(mine[order], (answer["bucket"], answer["bucket"] + 1))
                    counts[order[low:high]], best[order[low:high]] = unpack(answer["body"])
                until = [np.concatenate(([0], np.cumsum(times * values[at]))) for values in (best, counts)]
                n_best, count_sum = ((x[begin[1:]] - x[begin[:-1]]) for x in until)
                whole = [texts.field(x).cast(pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.record_batch(
                    [texts.field("digest"), *whole, pa.array(n_best), pa.array(count_sum), texts.field("groups_sha256")],
                    names=[x.split(" ")[0] for x in MEASURES.split(", ")],
                )

    return chunks.mapInArrow(looked_up, MEASURES)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair (first id * 2**32 + second id), count of its links in the corpus, best: whether no partner of the second id has more."""
    pairs = chunks.select(F.explode(F.arrays_zip("pairs", "weights")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(
        F.sum("x.weights").alias("count")
    )
    most = pairs.groupBy(F.expr("pair & 4294967295").alias("second")).agg(F.max("count").alias("most"))
    known = pairs.join(most.hint("merge"), F.expr("pair & 4294967295") == F.col("second"))
    return known.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


@dataclass(frozen=True)
class Alignment:
    documents: DataFrame  # id and measures of each row
    pairs: DataFrame  # a_id, b_id, count, best


def align_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_path: str = BYTE_BPE, piece_path: str = PIECE_BPE
) -> Alignment:
    spark = df.sparkSession
    rows = df.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    with Scratch(spark, "alignment") as scratch:
        distinct = rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
        chunks = scratch.write(chunks_of(distinct, byte_path, piece_path), "chunks")
        pairs = scratch.keep(pair_counts(chunks), "pairs")
        buckets = 2 * (pairs.count() // (2 * PAIRS_PER_BUCKET)) + 1
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        answers = scratch.write(answers_to(questions_of(chunks, buckets), pairs, buckets, partitions), "answers")
        ready = chunks.drop("weights").join(answers.hint("merge"), "chunk", "left")
        measures = scratch.write(measured(ready, buckets), "measures")
        digests = rows.select("id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
        found = digests.join(measures.hint("merge"), "digest", "left").drop("digest")
        counts = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
        out = scratch.keep(found.select("id", *counts, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")))
    links = pairs.select(F.expr("cast(shiftright(pair, 32) AS int)").alias("a_id"), F.expr("cast(pair & 4294967295 AS int)").alias("b_id"), "count", "best")
    return Alignment(out, links)


@query("op12_cross_tokenizer_alignment")
def op12_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = align_documents(table(spark, folder, "documents"))
    return found.documents.withColumnRenamed("id", "doc_id")
