"""Alignment of tokenizers against a plain version with both libraries' own readers."""

import hashlib
import os
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablewright.llm import alignment

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id string, chunk int, pairs array<int>, best double"


def plain(rows):
    """rows: (id, text). Sorted measures, token by token."""
    one = Tokenizer.from_file(alignment.BYTE_BPE)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    letters = alignment.byte_of()
    found, counts = [], Counter()
    for key, text in rows:
        a = one.encode(" " + text, add_special_tokens=False) if text else None
        a = list(zip(a.ids, [bytes(letters[c] for c in t) for t in a.tokens])) if text else []
        b = [(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i in (two.encode(text) if text else []) for p in [two.id_to_piece(i)]]
        raw = b" " + (text or "").encode()
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a, b = [], []
        groups, links, x, y = [], [], 0, 0
        while x < len(a):
            start = x, y
            size_a, size_b = len(a[x][1]), len(b[y][1])
            while size_a != size_b:
                if size_a < size_b:
                    x += 1
                    size_a += len(a[x][1])
                else:
                    y += 1
                    size_b += len(b[y][1])
            links.append((a[x][0], b[y][0]))
            x, y = x + 1, y + 1
            groups.append(",".join(str(i) for i, _ in a[start[0] : x]) + "|" + ",".join(str(i) for i, _ in b[start[1] : y]))
        counts.update(links)
        found.append((key, len(a), len(b), links, ";".join(groups)))
    most = Counter()
    for (_, second), n in counts.items():
        most[second] = max(most[second], n)
    return sorted(
        (
            (
                key, n_a, n_b, len(links), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
                hashlib.sha256(text.encode()).hexdigest() if n_a else "",
            )
            for key, n_a, n_b, links, text in found
        ),
        key=repr,
    ), counts


def rows_of(found):
    return sorted((tuple(r[x] for x in ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in found.documents.collect()), key=repr)


def odd_rows():
    rng = random.Random(3)
    words = ["the", "Été", "naïve", "日本語", "don't", "x1", "12345", "<|endoftext|>", "</s>", "<0x0A>", "...", "🙂", "é" * 3]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", " \t ", ""]) for _ in range(n))
    texts = [None, "", " ", "  ", "a", "the cat", "the cat", "The cat", "▁", "a▁b", "\x00", "﻿x", "ﬁ ½ Å", "ä é", "\r\n", " lead", "trail "]
    return list(enumerate(texts + [make(n) for n in (3, 10, 60, 400)])) + [(None, "the cat"), (None, None), (3, "other"), (3, "other")]


@pytest.mark.parametrize("chunk", [1, 300, 1 << 24])
def test_odd_texts(spark, monkeypatch, chunk):
    rows = odd_rows()
    expected, counts = plain(rows)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(alignment, "BATCH_BYTES", 1 + chunk // 3)
    monkeypatch.setattr(alignment, "PAIRS_PER_BUCKET", 4 if chunk < 1000 else 1 << 14)
    df = spark.createDataFrame([(*r, "x", 1, [1], 0.5) for r in rows], SCHEMA).repartition(3)
    found = alignment.align_documents(df)
    assert rows_of(found) == expected
    assert {(r["a_id"], r["b_id"]): r["count"] for r in found.pairs.collect()} == counts


def test_no_rows(spark):
    found = alignment.align_documents(spark.createDataFrame([(1, None, "x", 1, [1], 0.5)], SCHEMA).where("doc_id > 1"))
    assert found.documents.count() == 0 and found.pairs.count() == 0


def test_segments_and_long_gaps_change_nothing(monkeypatch):
    known = alignment.load(alignment.BYTE_BPE, alignment.PIECE_BPE)
    texts = [t for _, t in odd_rows() if t] + ["a b c d  e f 1 2 x y\nz w " * 20, "ab" * 400]
    whole = [tuple(x.tolist() for x in known.ids(t)) for t in texts]
    monkeypatch.setattr(alignment, "SEGMENT", 3)
    assert [tuple(x.tolist() for x in known.ids(t)) for t in texts] == whole
    gap = "x" + " " * 60000 + "y"
    assert known.ids(gap)[0].tolist() == known.first.encode_ordinary(f" {gap}")
    assert len(known.ids(" " * 1_500_000 + "x")[0]) > 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not available")
def test_query_matches_the_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    found = alignment.op12_cross_tokenizer_alignment(spark, FOLDER).withColumnRenamed("doc_id", "id")
    assert rows_of(alignment.Alignment(found, found)) == plain(rows)[0]
