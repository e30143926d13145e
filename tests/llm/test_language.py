"""Language filters against plain sets of n-grams."""

import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import language

FOLDER = "/root/testdata/sf0.001"


def plain_grams(text: str) -> list[bytes]:
    """All runs of four bytes with a letter in them, from the rules in the module's docstring."""
    kept = bytearray()
    for char in text:
        lower = char.lower() if char.isascii() or "À" <= char <= "Þ" and char != "×" else char
        kept += lower.encode() if not lower.isascii() or lower.isalpha() else b" "
    padded = b" " * 4 + bytes(kept) + b" " * 4
    return [padded[i : i + 4] for i in range(len(padded) - 3) if padded[i : i + 4].strip(b" ")]


def number(gram: bytes) -> int:
    return int.from_bytes(gram, "big")


@pytest.fixture(scope="module")
def taught(spark):
    rows = []
    for k in range(70):  # more than one word of 64 languages
        for n in range(3):
            rows.append((f"l{k:02}", " ".join(f"w{chr(97 + (k * 7 + i * n) % 26)}{chr(97 + k % 26)}x{chr(97 + i)}" for i in range(4 + k % 5))))
    return spark.createDataFrame([*rows, (None, "nobody"), ("l00", None)], "lang string, text string").repartition(5)


@pytest.mark.parametrize("least_share", [0.0, 0.02])
def test_filters_hold_the_grams_of_plain_sets(taught, least_share):
    counts = defaultdict(Counter)
    for lang, text in taught.where("lang IS NOT NULL AND text IS NOT NULL").collect():
        counts[lang].update(map(number, plain_grams(text)))
    model = language.fit(language.gram_counts(taught), least_share)
    totals = {lang: sum(c.values()) for lang, c in counts.items()}
    assert model.languages == sorted(totals, key=lambda lang: (-totals[lang], lang))
    wanted = np.zeros_like(model.slots)
    for k, lang in enumerate(model.languages):
        grams = np.array([g for g, n in counts[lang].items() if n >= least_share * totals[lang]], np.int64)
        for place in language.hashed(grams, len(wanted)):
            wanted[place, k // 64] |= wanted.dtype.type(1 << (k % 64))
        share = (wanted[:, k // 64] >> wanted.dtype.type(k % 64) & wanted.dtype.type(1)).mean()
        assert model.chance[k] == pytest.approx(share**language.HASHES)
    assert np.array_equal(model.slots, wanted)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not available")
def test_predictions_equal_those_of_exact_sets(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text", "lang")
    rows = [r for r in docs.collect() if r["lang"] is not None and r["text"]]
    model = language.fit(language.gram_counts(docs), 0.0)
    sets = defaultdict(set)
    for row in rows:
        sets[row["lang"]].update(plain_grams(row["text"]))
    found = language.predict(pa.array([r["text"] for r in rows]), model).to_pylist()
    compared = 0
    for row, said in zip(rows, found):
        grams = plain_grams(row["text"])
        shares = sorted(((sum(g in sets[x] for g in grams) / max(1, len(grams)), x) for x in model.languages), reverse=True)
        if len(shares) > 1 and shares[0][0] - shares[1][0] > 0.02:  # wider apart than chance hits make
            compared += 1
            assert said["lang"] == shares[0][1]
    assert compared > 0.9 * len(rows)


def test_no_gram_reaches_the_driver(spark):
    seen = language.filter_bits(spark.createDataFrame([(0, 5), (65, 5), (1, 5), (1, 9)], "k long, gram long"), 1024)
    assert seen.columns == ["word", "slot", "bits"]
    bits = {(r["word"], r["slot"]): r["bits"] for r in seen.collect()}
    for place in language.hashed(np.array([5]), 1024):
        assert bits[0, int(place[0])] & 3 == 3 and bits[1, int(place[0])] == 2
