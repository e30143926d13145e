"""SentencePiece encoding by sampling from the piece lattice, and decoding that gives the text back.

The lattice of a text has an arc for every piece of the vocabulary at every place it matches, and byte arcs for
characters without a piece of their own; a space is the word mark, one more stands before the text. Forward
filtering sums the weights of all ways to reach each place, backward sampling draws one segmentation with
exactly its share of the total. Draws come from a hash of the row's key, the place and the step, so a row is
segmented alike in every run, partition and order, and differently from other rows.

No piece holds certain neighbour bytes (a letter before a space, say): there the lattice falls apart into
units that are independent. Equal units share one forward pass, per batch of text; units of one length are done together.

A piece's weight is exp(theta * log-probability); vocabularies of the merge kind store ranks instead, whose
order is taken for Zipf ranks: log-probability -log(rank + 2).

Defined cases: a null text has null ids and decodes to null; an empty text has no ids; the mark U+2581 in a text
becomes bytes, so it is not mistaken for a space; a null key counts as key 0. Repeated rows are segmented
alike. Extra columns are kept; new ones get underscores behind names that are taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.llm.base import free_name, query, quoted, table
from tablewright.llm.kernels import BASE, mix, powers, slices, span_hashes, texts_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THETA = 1.0
MARK = "▁"
LONGEST_UNIT = 32  # bytes; longer units are done one by one, in logarithms
CELLS_AT_ONCE = 1 << 20  # (unit, end, length) cells of a lattice held at once
TABLE_BITS = 19
BATCH_BYTES = 2 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes (a space for the mark), log-weights, and two hash tables without collisions from bytes to ids."""

    data: np.ndarray
    begin: np.ndarray
    log_weight: np.ndarray
    byte_ids: np.ndarray
    keys: tuple[np.ndarray, np.ndarray]
    values: tuple[np.ndarray, np.ndarray]
    seeds: tuple[int, int]
    joined: np.ndarray  # whether some piece holds two bytes next to each other
    longest: int

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 if there is none."""
        out = np.full(hashes.shape, -1, np.int32)
        for keys, values, seed in zip(self.keys, self.values, self.seeds):
            slot = slots(hashes, seed)
            hit = keys[slot] == hashes
            out[hit] = values[slot[hit]]
        return out


def slots(hashes: np.ndarray, seed: int) -> np.ndarray:
    return (mix(hashes, seed) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def load_vocabulary(path: str = MODEL, theta: float = THETA) -> Vocabulary:
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    size = processor.get_piece_size()
    scores = np.array([processor.get_score(i) for i in range(size)])
    plain = [
        i for i in range(size)
        if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i) or processor.is_byte(i))
    ]
    byte_ids = np.array([processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    if (scores[plain] == np.round(scores[plain])).all():  # the merge kind: whole numbers, the order of merges
        ranks = np.empty(size)
        ranks[plain] = np.argsort(np.argsort(-scores[plain], kind="stable"))
        ranks[byte_ids] = len(plain)
        logs = -np.log(np.where(np.isin(np.arange(size), [*plain, *byte_ids]), ranks, 0) + 2)
    else:
        logs = scores.copy()
        logs[byte_ids] = scores[plain].min()
    texts = [b""] * size
    for i in plain:
        texts[i] = processor.id_to_piece(i).replace(MARK, " ").encode()
    for b in range(256):
        texts[byte_ids[b]] = bytes([b])
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    hashes = span_hashes(data, begin[:-1], begin[1:])
    joined = np.zeros((256, 256), bool)
    for i in plain:
        raw = np.frombuffer(texts[i], np.uint8)
        joined[raw[:-1], raw[1:]] = True
    keys, values, seeds, left = [], [], [], np.array(plain)
    for table_number in range(2):
        for seed in range(100):
            slot = slots(hashes[left], seed + 100 * table_number)
            first = np.unique(slot, return_index=True)[1]
            if table_number == 0 or len(first) == len(left):
                break
        else:
            raise ValueError("the vocabulary does not fit its tables; raise TABLE_BITS")
        key, value = np.zeros(1 << TABLE_BITS, np.uint64), np.full(1 << TABLE_BITS, -1, np.int32)
        key[slot[first]], value[slot[first]] = hashes[left[first]], left[first]
        keys.append(key)
        values.append(value)
        seeds.append(seed + 100 * table_number)
        left = np.delete(left, first)
    return Vocabulary(
        data, begin, theta * logs, byte_ids, tuple(keys), tuple(values), tuple(seeds), joined,
        max(len(texts[i]) for i in plain),
    )


def arcs(vocabulary: Vocabulary, raw: np.ndarray, longest: int) -> np.ndarray:
    """Piece ids [unit, start, length - 1] for rows of equally long units; byte arcs where a character has no piece."""
    rows, size = raw.shape
    unit = powers(BASE, 1 << 10)
    out = np.full((rows, size, min(size, longest)), -1, np.int32)
    for start in range(size):
        reach = min(size - start, longest)
        terms = (raw[:, start : start + reach].astype(np.uint64) + np.uint64(1)) * unit[:reach]
        out[:, start, :reach] = vocabulary.find(np.cumsum(terms, axis=1, dtype=np.uint64))
    # Characters without a piece: their first byte says how long they are.
    width = np.select([raw < 0x80, raw < 0xC0, raw < 0xE0, raw < 0xF0], [1, 0, 2, 3], 4)
    bare = np.zeros((rows, size), bool)
    for start in range(size):
        for w in range(1, 5):
            # A character may be cut off at a unit's end: then none of its bytes joins the next, and it has no piece.
            whole = w <= min(size - start, out.shape[2])
            missing = (width[:, start] == w) & ((out[:, start, w - 1] < 0) if whole else True)
            for k in range(start, min(start + w, size)):
                bare[missing, k] = True
    # Units that begin within a character.
    lead = np.cumsum(width > 0, axis=1) == 0
    bare |= lead
    single = np.where(bare & (out[:, :, 0] < 0), vocabulary.byte_ids[raw], out[:, :, 0])
    out[:, :, 0] = single
    return out


def choices(vocabulary: Vocabulary, raw: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and cumulative chances [unit, end, length - 1] of the last piece, given that a segmentation ends there."""
    rows, size = raw.shape
    by_start = arcs(vocabulary, raw, longest)
    most = by_start.shape[2]
    ids = np.full((rows, size + 1, most), -1, np.int32)
    for end in range(1, size + 1):
        for length in range(1, min(end, most) + 1):
            ids[:, end, length - 1] = by_start[:, end - length, length - 1]
    weight = np.where(ids >= 0, np.exp(vocabulary.log_weight)[ids], 0.0)
    total = np.zeros((rows, size + 1))
    total[:, 0] = 1.0
    for end in range(1, size + 1):
        reach = min(end, most)
        weight[:, end, :reach] *= total[:, end - reach : end][:, ::-1]
        total[:, end] = weight[:, end].sum(axis=1)
    chances = np.cumsum(weight, axis=2)
    chances /= np.where(total > 0, total, 1.0)[:, :, None]
    return ids, chances


def long_choices(vocabulary: Vocabulary, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long unit [1, end, length - 1], in logarithms and piece by piece of the text."""
    size, most = len(raw), min(len(raw), vocabulary.longest)
    ids = np.full((size + 1, most), -1, np.int32)
    step = 1 << 12
    for a in range(0, size, step):
        # Windows of `most` bytes from each start; starts near the end see zeros, which no piece matches past the end.
        b = min(a + step, size)
        padded = np.zeros(b - a + most + 3, np.uint8)
        padded[: min(size, b + most + 3) - a] = raw[a : b + most + 3]
        windows = np.lib.stride_tricks.sliding_window_view(padded, most)[: b - a]
        terms = (windows.astype(np.uint64) + np.uint64(1)) * powers(BASE, 1 << 10)[:most]
        found = vocabulary.find(np.cumsum(terms, axis=1, dtype=np.uint64))
        for length in range(1, most + 1):
            starts = np.arange(a, min(b, size - length + 1))
            ids[starts + length, length - 1] = found[starts - a, length - 1]
    lead = raw & 0xC0
    heads = np.flatnonzero(lead != 0x80)
    sizes = np.diff(np.append(heads, size))
    for head, width in zip(heads.tolist(), sizes.tolist()):
        if width > most or ids[head + width, width - 1] < 0:
            for k in range(head, head + width):
                if ids[k + 1, 0] < 0:
                    ids[k + 1, 0] = vocabulary.byte_ids[raw[k]]
    for k in range(int(heads[0]) if len(heads) else size):
        if ids[k + 1, 0] < 0:
            ids[k + 1, 0] = vocabulary.byte_ids[raw[k]]
    logs, chances = np.full(size + 1, -np.inf), np.zeros((size + 1, most))
    logs[0] = 0.0
    for end in range(1, size + 1):
        reach = min(end, most)
        here = ids[end, :reach]
        value = np.where(here >= 0, vocabulary.log_weight[here] + logs[end - reach : end][::-1], -np.inf)
        top = value.max()
        share = np.exp(value - top)
        whole = share.sum()
        logs[end] = top + np.log(whole)
        chances[end, :reach] = np.cumsum(share) / whole
        chances[end, reach:] = 1.0
    return ids[None], chances[None]


def draw(ids: np.ndarray, chances: np.ndarray, unit: np.ndarray, seed: np.ndarray, size: int):
    """One segmentation per occurrence, backwards: yields (occurrence, step, piece id) of each step."""
    at, active, step = np.full(len(unit), size), np.arange(len(unit)), 0
    while len(active):
        uniform = (mix(seed[active], 1000 + step) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        here = chances[unit[active], at[active]]
        # The last length that is possible ends the search, whatever rounding did to the sums.
        possible = ids[unit[active], at[active]] >= 0
        pick = np.minimum((here <= uniform[:, None]).sum(axis=1), here.shape[1] - 1)
        wrong = ~possible[np.arange(len(pick)), pick]
        if wrong.any():
            pick[wrong] = possible.shape[1] - 1 - possible[wrong][:, ::-1].argmax(axis=1)
        yield active, step, ids[unit[active], at[active], pick]
        at[active] -= pick + 1
        active, step = active[at[active] > 0], step + 1


def encode(keys: np.ndarray, texts: pa.Array, vocabulary: Vocabulary) -> pa.ListArray:
    """Sampled piece ids of each text."""
    data, offsets = texts_of(texts)
    out_ids, out_sizes = [], []
    for a, b in slices(offsets, BATCH_BYTES):
        ids, sizes = _encode(keys[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], vocabulary)
        out_ids.append(ids)
        out_sizes.append(sizes)
    sizes = np.concatenate(out_sizes) if out_sizes else np.zeros(0, np.int64)
    bounds = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=None)
    values = pa.array(np.concatenate(out_ids) if out_ids else np.zeros(0, np.int32))
    made = pa.ListArray.from_arrays(bounds, values)
    return pa.ListArray.from_arrays(bounds, values, mask=texts.is_null()) if texts.null_count else made


def _encode(keys: np.ndarray, data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary):
    # A space before each text that is not empty.
    sizes = np.diff(offsets)
    extra = (sizes > 0).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + extra)))
    raw = np.full(int(begin[-1]), 32, np.uint8)
    raw[np.arange(len(data)) + np.repeat(np.cumsum(extra), sizes)] = data
    text_of = np.repeat(np.arange(len(sizes)), sizes + extra)
    cut = np.ones(len(raw), bool)
    if len(raw):
        cut[1:] = ~vocabulary.joined[raw[:-1], raw[1:]] | (text_of[1:] != text_of[:-1])
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(raw)) if len(starts) else starts
    lengths, owner = ends - starts, text_of[starts]
    first_unit = np.searchsorted(starts, begin)
    place = np.arange(len(starts)) - first_unit[:-1][owner]
    seed = mix(mix(keys.astype(np.int64).view(np.uint64), 17)[owner] ^ (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), 18)
    hashes = span_hashes(raw, starts, ends)
    drawn: list[tuple[np.ndarray, int, np.ndarray]] = []
    for size in np.unique(lengths).tolist():
        units = np.flatnonzero(lengths == size)
        _, first, which = np.unique(hashes[units], return_index=True, return_inverse=True)
        if size > LONGEST_UNIT:
            for k in range(len(first)):
                ids, chances = long_choices(vocabulary, raw[starts[units[first[k]]] : ends[units[first[k]]]])
                some = units[which == k]
                drawn += [(some[x], s, p) for x, s, p in draw(ids, chances, np.zeros(len(some), np.int64), seed[some], size)]
            continue
        order = np.argsort(which, kind="stable")
        at_once = max(1, CELLS_AT_ONCE // ((size + 1) * min(size, vocabulary.longest)))
        edge = np.searchsorted(which[order], np.arange(0, len(first) + at_once, at_once))
        for n, at in enumerate(range(0, len(first), at_once)):
            some = first[at : at + at_once]
            ids, chances = choices(
                vocabulary, raw[starts[units[some]][:, None] + np.arange(size)[None, :]], vocabulary.longest
            )
            mine = order[edge[n] : edge[n + 1]]
            drawn += [(units[mine[x]], s, p) for x, s, p in draw(ids, chances, which[mine] - at, seed[units[mine]], size)]
    pieces = np.zeros(len(starts), np.int64)
    for occurrence, step, _ in drawn:
        pieces[occurrence] = step + 1
    until = np.cumsum(pieces)
    out = np.empty(int(until[-1]) if len(until) else 0, np.int32)
    for occurrence, step, piece in drawn:  # drawn from the back
        out[until[occurrence] - 1 - step] = piece
    whole = np.concatenate(([0], until))
    return out, whole[first_unit[1:]] - whole[first_unit[:-1]]


def decode(ids: pa.ListArray, vocabulary: Vocabulary) -> pa.Array:
    """Text of each list of piece ids."""
    bounds, pieces = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    nulls, sizes, out = ids.is_null().to_pylist(), vocabulary.begin[1:] - vocabulary.begin[:-1], []
    for a, b in slices(bounds.astype(np.int64), BATCH_BYTES // 4):
        some = pieces[bounds[a] : bounds[b]]
        until = np.concatenate(([0], np.cumsum(sizes[some])))
        place = np.arange(int(until[-1])) + np.repeat(vocabulary.begin[:-1][some] - until[:-1], sizes[some])
        raw = vocabulary.data[place].tobytes()
        edges = until[bounds[a : b + 1] - bounds[a]].tolist()
        out += [None if nulls[a + k] else raw[x + 1 : y].decode() for k, (x, y) in enumerate(zip(edges[:-1], edges[1:]))]
    return pa.array(out, pa.string())


def checked(keys: np.ndarray, texts: pa.Array, vocabulary: Vocabulary) -> pa.StructArray:
    """Sampled piece ids of each text, and whether they decode to it."""
    ids = encode(keys, texts, vocabulary)
    same = pc.equal(decode(ids, vocabulary), texts.cast(pa.string()))
    return pa.StructArray.from_arrays([ids, pc.if_else(texts.is_null(), ids.is_null(), same)], ["ids", "lossless"])


def encode_column(key: Column, text: Column, vocabulary: Vocabulary) -> Column:
    @F.arrow_udf("array<int>")
    def encoded(keys: pa.Array, texts: pa.Array) -> pa.Array:
        return encode(keys.fill_null(0).to_numpy(zero_copy_only=False), texts, vocabulary)

    return encoded(key.cast("long"), text)


def checked_column(key: Column, text: Column, vocabulary: Vocabulary) -> Column:
    """Struct of piece ids and whether they decode to the text: both from one pass."""

    @F.arrow_udf("ids array<int>, lossless boolean")
    def encoded(keys: pa.Array, texts: pa.Array) -> pa.Array:
        return checked(keys.fill_null(0).to_numpy(zero_copy_only=False), texts, vocabulary)

    return encoded(key.cast("long"), text)


def decode_column(ids: Column, vocabulary: Vocabulary) -> Column:
    @F.arrow_udf("string")
    def decoded(values: pa.Array) -> pa.Array:
        return decode(values, vocabulary)

    return decoded(ids)


def sample_pieces(
    df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", check: bool = False
) -> DataFrame:
    """`df` with piece_ids (array of int), sampled by the row's id; with `check` also lossless."""
    if not check:
        return df.withColumn(free_name("piece_ids", df.columns), encode_column(quoted(id_col), quoted(text_col), vocabulary))
    made = free_name("_made", df.columns)
    out = df.withColumn(made, checked_column(quoted(id_col), quoted(text_col), vocabulary))
    out = out.withColumn(free_name("piece_ids", df.columns), F.col(made)["ids"])
    return out.withColumn(free_name("lossless", df.columns), F.col(made)["lossless"]).drop(made)


@query("op1_sentencepiece_sampling")
def op1_sentencepiece_sampling(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return sample_pieces(documents, load_vocabulary(), check=True).select(
        "doc_id",
        F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.sha2(F.concat_ws(" ", F.col("piece_ids").cast("array<string>")), 256).alias("pieces_sha256"),
        "lossless",
    )
