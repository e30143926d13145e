"""Language identification with bit-sliced Bloom filters of n-grams.

Text is lower-cased, everything but letters becomes a space, and every run of four bytes with a letter in it
is an n-gram. Spark counts the n-grams of each language over all labelled rows; those that make up at least
`LEAST_SHARE` of their language go into that language's Bloom filter. All filters have one size and the same
hashes and are stored slot by slot: one slot holds a bit per language, so the AND of a few slots is the mask
of all languages that contain an n-gram. A text counts the bits per language, takes off the hits that the
filter's fill makes by chance, and the largest share of its n-grams decides.

Defined cases: null, or no letter: `und` with score 0; letters but no known n-gram: the most frequent learned
language with score 0; equal shares: the more frequent language; nothing learned: `und`. Rows with a null
language do not teach. Extra columns are kept; new ones get underscores behind names that are taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.llm.base import Scratch, crc_fold, free_name, query, quoted, table
from tablewright.llm.kernels import mix, slices, texts_of

GRAM = 4
LEAST_SHARE = 2e-6  # so a filter holds at most 500,000 n-grams
SLOTS_PER_GRAM = 16
HASHES = 3
UNKNOWN = "und"


def _letters() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    for byte in range(256):
        if chr(byte).isascii():
            if chr(byte).isalpha():
                table[byte] = ord(chr(byte).lower())
        else:
            table[byte] = byte
    return table


LETTERS = _letters()


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of all texts as 32-bit numbers, and the text of each; a space stands on both sides of a text."""
    sizes = np.diff(offsets)
    at = offsets[:-1] + 2 * GRAM * np.arange(len(sizes)) + GRAM
    padded = np.full(len(data) + 2 * GRAM * len(sizes) + GRAM, 32, np.uint8)
    index = np.arange(len(data)) + np.repeat(at - offsets[:-1], sizes)
    padded[index] = LETTERS[data]
    # Latin capitals with accents: the second byte of À to Þ, without the sign at 0x97.
    second = padded[1:]
    upper = (padded[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
    second[upper] += 0x20
    moved = padded.astype(np.uint32)
    count = len(padded) - GRAM + 1
    value = moved[:count].copy()
    for k in range(1, GRAM):
        value <<= np.uint32(8)
        value |= moved[k : k + count]
    letter = padded != 32
    some = letter[:count].copy()
    for k in range(1, GRAM):
        some |= letter[k : k + count]
    where = np.flatnonzero(some)
    return value[where], np.searchsorted(at - GRAM, where, "right") - 1


def gram_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, gram, n over all rows with a language; counted per batch before the shuffle."""
    rows = df.select(quoted(lang_col).cast("string").alias("lang"), quoted(text_col).alias("text"))

    def counted(batches):
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            names, index = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            data, offsets = texts_of(batch.column(1))
            for a, b in slices(offsets, 8 << 20):
                values, of = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                keys, n = np.unique(values.astype(np.uint64) | index[a:b][of].astype(np.uint64) << np.uint64(32), return_counts=True)
                yield pa.record_batch(
                    [
                        pa.array([names[k] for k in range(len(names))], pa.string()).take(pa.array((keys >> np.uint64(32)).astype(np.int64))),
                        pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                        pa.array(n.astype(np.int64)),
                    ],
                    names=["lang", "gram", "n"],
                )

    taught = rows.where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(counted, "lang string, gram long, n long")
    return taught.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """Languages by frequency; slots (one row per slot, 64 languages per column); chance of a false hit per language."""

    languages: list[str]
    slots: np.ndarray
    chance: np.ndarray

    def shares(self, values: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
        """Share of each text's n-grams in each language, without chance hits."""
        places = hashed(values, len(self.slots))
        out = np.zeros((texts, len(self.languages)))
        total = np.maximum(np.bincount(of, minlength=texts), 1)
        for word in range(self.slots.shape[1]):
            column = self.slots[:, word]
            masks = column[places[0]]
            for place in places[1:]:
                masks = masks & column[place]
            for bit, name in enumerate(self.languages[64 * word : 64 * word + 64]):
                hits = (masks >> column.dtype.type(bit)) & column.dtype.type(1)
                k = 64 * word + bit
                share = np.bincount(of, weights=hits, minlength=texts) / total
                out[:, k] = np.clip((share - self.chance[k]) / (1 - self.chance[k]), 0, None)
        return out


def hashed(values: np.ndarray, slots: int) -> list[np.ndarray]:
    """HASHES slots of each n-gram; `slots` is a power of two."""
    h = mix(values.astype(np.uint64), 9)
    bits = np.uint64(slots.bit_length() - 1)
    low = np.uint64(slots - 1)
    return [((h >> (np.uint64(k) * np.uint64(21))) ^ (h >> bits) * np.uint64(k)) & low for k in range(HASHES)]


def filter_bits(grams_of: DataFrame, size: int) -> DataFrame:
    """word, slot, bits of all filters from (k, gram): the bits of 64 languages in a slot, combined before the shuffle."""

    def marked(batches):
        for batch in batches:
            k, values = (batch.column(c).to_numpy().astype(np.uint64) for c in (0, 1))
            slot = np.concatenate(hashed(values, size))
            key = np.tile(k >> np.uint64(6), HASHES) << np.uint64(40) | slot
            bits = np.tile(np.uint64(1) << (k & np.uint64(63)), HASHES)
            order = np.argsort(key, kind="stable")
            keys, starts = np.unique(key[order], return_index=True)
            held = np.bitwise_or.reduceat(bits[order], starts) if len(starts) else bits
            yield pa.record_batch(
                [
                    pa.array((keys >> np.uint64(40)).astype(np.int32)), pa.array((keys & np.uint64((1 << 40) - 1)).astype(np.int64)),
                    pa.array(held.view(np.int64)),
                ],
                names=["word", "slot", "bits"],
            )

    return grams_of.mapInArrow(marked, "word int, slot long, bits long").groupBy("word", "slot").agg(F.bit_or("bits").alias("bits"))


def fit(counts: DataFrame, least_share: float = LEAST_SHARE) -> Model:
    """Filters from (lang, gram, n), made by Spark: the driver gets a row per language, and per slot the bits of 64 languages.

    No n-gram reaches the driver. `least_share` 0 takes all n-grams; the filters' size follows the largest language.
    `counts` is read three times, so let it be written.
    """
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= F.col("total") * least_share)
    known = frequent.groupBy("lang", "total").agg(F.count(F.lit(1)).alias("grams")).collect()
    languages = [row["lang"] for row in sorted(known, key=lambda row: (-row["total"], row["lang"]))]
    size = 1 << int(np.ceil(np.log2(max(1024, SLOTS_PER_GRAM * max((row["grams"] for row in known), default=1)))))
    kind = next(t for t, most_languages in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 1 << 60)) if len(languages) <= most_languages)
    slots = np.zeros((size, -(-max(len(languages), 1) // 64)), kind)
    # One row per language.
    index = counts.sparkSession.createDataFrame(list(enumerate(languages)), "k long, lang string")
    masks = filter_bits(frequent.join(F.broadcast(index), "lang").select("k", "gram"), size).toArrow()
    slots[masks["slot"].to_numpy(), masks["word"].to_numpy()] = masks["bits"].to_numpy().view(np.uint64).astype(kind)
    filled = [np.count_nonzero(slots[:, k // 64] & kind(1 << (k % 64))) / size for k in range(len(languages))]
    return Model(languages, slots, np.array(filled) ** HASHES)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(texts: pa.Array, model: Model) -> pa.StructArray:
    data, offsets = texts_of(texts)
    names, scores = [], []
    for a, b in slices(offsets):
        part = data[offsets[a] : offsets[b]]
        values, of = grams(part, offsets[a : b + 1] - offsets[a])
        shares = model.shares(values, of, b - a) if model.languages else np.zeros((b - a, 1))
        best, whole = shares.argmax(axis=1), shares.sum(axis=1)
        latin = np.concatenate(([0], np.cumsum((LETTERS[part] != 32) & (part < 128))))
        plain = latin[offsets[a + 1 : b + 1] - offsets[a]] > latin[offsets[a:b] - offsets[a]]
        for k in range(b - a):
            if model.languages and (plain[k] or has_letter(texts[a + k].as_py())):
                names.append(model.languages[best[k]])
                scores.append(float(shares[k, best[k]] / whole[k]) if whole[k] else 0.0)
            else:
                names.append(UNKNOWN)
                scores.append(0.0)
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])


def language_column(text: Column, model: Model) -> Column:
    @F.arrow_udf("lang string, score double")
    def predicted(texts: pa.Array) -> pa.Array:
        return predict(texts, model)

    return predicted(text)


def identify_language(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`df` with lang_pred and score."""
    found = free_name("_found", df.columns)
    out = df.withColumn(found, language_column(quoted(text_col), model))
    out = out.withColumn(free_name("lang_pred", df.columns), F.col(found)["lang"])
    return out.withColumn(free_name("score", df.columns), F.col(found)["score"]).drop(found)


@query("op9_language_id")
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = crc_fold(F.col("doc_id"), 4) == 2
    with Scratch(spark, "language") as scratch:
        model = fit(scratch.write(gram_counts(documents.where(~held_out)), "grams"))
    return identify_language(documents.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
