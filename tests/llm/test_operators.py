"""Each operator against its plain version, on the small tables and on a table of odd rows."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tablewright.llm import (
    REGISTRY, decontaminate, embedding_graph, language, line_chunks, minhash, quality, sentencepiece_sampling, substring,
    suffix_array, warc,
)
from tablewright.llm.base import Scratch
from tests.compare import connect, differences
from tests.llm import brute

FOLDER, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not available")
DOCS = "doc_id long, text string, id string, node int, n_lines string, score double, _rid int, chunk string"


def odd_rows():
    """Null ids and texts, empty, blank and long texts, repeated rows, one id with two texts, periods, passages."""
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)] + ["Été", "ÑANDÚ", "x▁y", "日本語"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = make(70), make(200)
    changed = base.split(" ")
    changed[30] = "other"
    texts = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (5, "One TWO"), (6, passage), (7, f"{make(40)} {passage}\n{make(30)}"),
        (8, f"{passage} {passage}"), (9, base), (10, " ".join(changed)), (11, base.upper()), (12, base), (12, make(60)),
        (13, "a" * 700), (14, "ab " * 200), (15, "a" * 350), (None, passage), (None, None), (16, make(3000)), (17, "\n".join([passage, base, passage])),
        (18, "\n".join([make(5), passage, base, make(5)])), (19, "\n" * 9), (20, "日本語 " * 60), (-3, passage + " tail"),
    ]
    return texts


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1, None, 0.5, 2, "c") for i, t in odd_rows()]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def read(spark, name, folder=TINY):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@pytest.mark.parametrize("key", sorted(k for k, e in REGISTRY.items() if e.sql))
def test_query_matches_sql(spark, key):
    assert differences(REGISTRY[key].run(spark, FOLDER), connect(FOLDER), REGISTRY[key].sql) == []


def test_sampling_is_lossless_and_follows_the_key(spark, odd, nothing):
    vocabulary = sentencepiece_sampling.load_vocabulary()
    texts = [t for _, t in odd_rows()] + ["x" * 500 + "é" * 300, "▁ ▁▁", "🙂🙂 a\r\n\x00b", "  two  spaces  "]
    values = pa.array(texts, pa.string())
    keys = np.arange(len(texts))
    first = sentencepiece_sampling.encode(keys, values, vocabulary)
    assert sentencepiece_sampling.decode(first, vocabulary).to_pylist() == texts
    turned = sentencepiece_sampling.encode(keys[::-1].copy(), values.take(pa.array(keys[::-1])), vocabulary)
    assert turned.to_pylist() == first.to_pylist()[::-1]
    assert sentencepiece_sampling.encode(keys + 1, values, vocabulary).to_pylist() != first.to_pylist()
    out = sentencepiece_sampling.sample_pieces(odd, vocabulary)
    assert out.columns == [*odd.columns, "piece_ids"] and out.count() == odd.count()
    checked = sentencepiece_sampling.sample_pieces(odd, vocabulary, check=True)
    assert checked.columns == [*odd.columns, "piece_ids", "lossless"] and checked.where("NOT lossless").count() == 0
    assert out.where("text IS NULL AND piece_ids IS NOT NULL").count() == 0
    assert sentencepiece_sampling.sample_pieces(nothing, vocabulary).count() == 0


@pytest.mark.parametrize("text", ["the", "été", "thin\n", "zzzz"])
def test_sampling_has_the_shares_of_the_lattice(text):
    vocabulary = sentencepiece_sampling.load_vocabulary(theta=0.5)
    pieces = {}
    for i in range(len(vocabulary.begin) - 1):
        raw = vocabulary.data[vocabulary.begin[i] : vocabulary.begin[i + 1]].tobytes()
        if raw and i not in set(vocabulary.byte_ids.tolist()):
            pieces[raw] = i
    raw = b" " + text.encode()
    characters = {}
    at = 0
    for c in " " + text:
        characters[at] = c.encode()
        at += len(c.encode())

    def ways(start):
        if start == len(raw):
            yield ()
            return
        for end in range(start + 1, len(raw) + 1):
            if raw[start:end] in pieces:
                yield from ((pieces[raw[start:end]], *rest) for rest in ways(end))
        head = max(k for k in characters if k <= start)
        if characters[head] not in pieces:
            yield from ((int(vocabulary.byte_ids[raw[start]]), *rest) for rest in ways(start + 1))

    weights = {w: np.exp(sum(vocabulary.log_weight[i] for i in w)) for w in ways(0)}
    total, count = sum(weights.values()), 20_000
    drawn = sentencepiece_sampling.encode(np.arange(count), pa.array([text] * count), vocabulary).to_pylist()
    seen = {}
    for d in drawn:
        seen[tuple(d)] = seen.get(tuple(d), 0) + 1
    assert set(seen) <= set(weights)
    for way, weight in weights.items():
        share = weight / total
        assert abs(seen.get(way, 0) / count - share) < 5 * np.sqrt(share * (1 - share) / count) + 1e-3


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(100 + k, (base[k % 5] + rng.normal(scale=0.12, size=16)).tolist()) for k in range(60)]
    rows += [(200, base[0].tolist()), (201, (2 * base[0]).tolist()), (202, None), (203, []), (204, [0.0] * 16), (205, [None] + [1.0] * 15)]
    rows += [(206, [float("nan")] * 16), (207, [float("inf")] + [1.0] * 15), (208, base[0].tolist()[:8]), (209, base[0].tolist()[:8]), (None, base[0].tolist())]
    df = spark.createDataFrame([(i, v, "z", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, vector int")
    result = embedding_graph.near_duplicate_vectors(df)
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in result.collect()}
    # A row without an id is left out: it neither links nor counts.
    assert got == brute.vector_links(rows)
    assert embedding_graph.audit_recall(df, result) == 1.0
    assert embedding_graph.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vector_query_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in read(spark, "embeddings").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in REGISTRY["op2_embedding_near_dedup"].run(spark, TINY).collect()}
    assert got == brute.vector_links(rows)


def test_many_shards_and_visits(spark, monkeypatch):
    monkeypatch.setattr(embedding_graph, "SHARD_ROWS", 60)
    monkeypatch.setattr(embedding_graph, "CLASSES_PER_CENTRE", 100)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 24))
    rows = [(k, (base[k % 40] + rng.normal(scale=0.1, size=24)).tolist()) for k in range(400)]
    result = embedding_graph.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    expected = brute.vector_links(rows)
    found = sum(r["n_links"] for r in result.collect())
    assert found >= 0.98 * sum(x[0] for x in expected.values())
    assert all(r["n_links"] <= expected[r["id"]][0] for r in result.collect())


def test_quality(spark, odd, nothing):
    held = REGISTRY["op3_quality_classifier"].run(spark, FOLDER).join(read(spark, "labels", FOLDER), "doc_id").where("held_out")
    assert held.where("predicted = quality").count() >= 0.97 * held.count()
    labels = spark.createDataFrame([(9, 1), (10, 0), (4, 1), (6, 0), (14, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit_on(odd, labels)
    out = quality.score_quality(odd, model)
    assert out.columns == [*odd.columns, "score_", "predicted"] and out.count() == odd.count()
    assert out.where("score_ IS NULL OR score_ < 0 OR score_ > 1").count() == 0
    assert quality.fit_on(nothing, labels).share == 0.5
    assert quality.score_quality(odd, quality.fit_on(odd, labels.where("quality = 1"))).where("predicted = 0").count() == 0
    assert quality.score_quality(nothing, model).count() == 0


def test_decontamination(spark, odd, nothing):
    documents, items = read(spark, "documents"), read(spark, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in REGISTRY["op4_decontamination"].run(spark, TINY).collect()}
    assert got == brute.contamination([(r["doc_id"], r["text"]) for r in documents.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    rows = dict((i, t) for i, t in odd_rows() if t)
    some = [(1, rows[6]), (2, " ".join(rows[6].split()[:30])), (3, "one two"), (4, None), (5, ""), (6, " ".join(rows[9].split()[10:55])), (7, rows[6]), (None, "one two")]
    changed = rows[9].split()[100:140]
    changed[7] = "zz"
    some.append((8, " ".join(changed)))
    held = spark.createDataFrame([(i, t, 1) for i, t in some], "item_id long, text string, doc_id int")
    got = {(r["id"], r["item"]) for r in decontaminate.find_contamination(odd, held).collect()}
    assert got == brute.contamination(odd_rows(), some)
    flagged = {r[0] for r in odd.where(decontaminate.contaminated_column(odd["text"], held)).select("doc_id").collect()}
    assert flagged - {None} == {i for i, _ in got}
    assert decontaminate.find_contamination(odd, held.limit(0)).count() == 0
    assert decontaminate.find_contamination(nothing, held).count() == 0


def test_index_returns_all_within_the_radius():
    items = decontaminate.Items(list(range(30)), [" ".join(f"t{k}_{j}" for j in range(12)) for k in range(30)])
    rng = np.random.default_rng(1)
    prints = np.array([items.prints[k % 30] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k % 30, replace=False))) for k in range(300)])
    window, item = items.candidates(prints)
    near = np.bitwise_count(prints[:, None] ^ items.prints[None, :]) <= decontaminate.RADIUS
    assert set(zip(window.tolist(), item.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_near_duplicates(spark, odd, nothing, monkeypatch):
    def found(df):
        return {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}

    assert found(odd) == brute.near_duplicates(odd_rows())
    assert found(nothing) == {}
    rows = [(r["doc_id"], r["text"]) for r in read(spark, "documents", FOLDER).collect()]
    rng = random.Random(3)
    base = rows[1][1].split(" ")
    for k in range(120):  # a large group of near copies
        copy = list(base)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(50)}"
        rows.append((100_000 + k, " ".join(copy)))
    expected = brute.near_duplicates(rows)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == expected


def test_passages(spark, odd, nothing):
    out = substring.remove_repeated_passages(odd)
    got = sorted((r["id"], r["n_words"], r["n_removed"], r["digest"]) for r in out.selectExpr("*", "sha2(kept, 256) AS digest").collect())
    assert got == brute.passages(odd_rows())
    assert substring.remove_repeated_passages(nothing).count() == 0
    got = sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in REGISTRY["op6_substring_dedup"].run(spark, TINY).collect())
    assert got == brute.passages([(r["doc_id"], r["text"]) for r in read(spark, "documents").collect()])


def test_bytes(spark, odd, nothing, monkeypatch):
    monkeypatch.setattr(suffix_array, "WINDOWS_AT_ONCE", 300)
    out = suffix_array.remove_repeated_bytes(odd)
    got = sorted((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["digest"]) for r in out.selectExpr("*", "sha2(kept, 256) AS digest").collect())
    assert got == brute.repeated_bytes(odd_rows())
    assert suffix_array.remove_repeated_bytes(nothing).count() == 0
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = sorted(tuple(r[c] for c in columns) for r in REGISTRY["op8_suffix_array_dedup"].run(spark, TINY).collect())
    assert got == brute.repeated_bytes([(r["doc_id"], r["text"]) for r in read(spark, "documents").collect()])


def test_language(spark, odd, nothing):
    held = REGISTRY["op9_language_id"].run(spark, FOLDER).where("held_out").join(read(spark, "documents", FOLDER).select("doc_id", "lang"), "doc_id")
    assert held.where("lang_pred = lang").count() >= 0.98 * held.count()
    taught = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("x", None), (None, "de")], "text string, lang string")
    model = language.fit(language.gram_counts(taught))
    assert sorted(model.languages) == ["en", "fr"]
    out = language.identify_language(odd, model)
    assert out.columns == [*odd.columns, "lang_pred", "score_"] and out.count() == odd.count()
    said = language.predict(pa.array([None, "", "12 !", "the dog", "le chien", "ÉÉÉ", "日本"]), model).to_pylist()
    assert [x["lang"] for x in said[:5]] == ["und", "und", "und", "en", "fr"]
    assert all(x["lang"] in model.languages for x in said[5:])
    assert language.identify_language(odd, language.fit(language.gram_counts(taught.limit(0)))).where("lang_pred <> 'und'").count() == 0
    assert language.identify_language(nothing, model).count() == 0


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 32, 2000).astype(np.int64)
    slots = np.zeros((1 << 15, 1), np.uint8)
    for place in language.hashed(values, len(slots)):
        slots[place, 0] |= 1
    model = language.Model(["x"], slots, np.array([(slots[:, 0] > 0).mean() ** language.HASHES]))
    assert model.shares(values.astype(np.uint32), np.zeros(len(values), np.int64), 1)[0, 0] == pytest.approx(1.0)
    other = rng.integers(0, 1 << 32, 20_000).astype(np.uint32)
    assert model.shares(other, np.zeros(len(other), np.int64), 1)[0, 0] < 0.01


def test_line_chunks(spark, odd, nothing):
    out = line_chunks.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines_", "n_removed"] and out.count() == odd.count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    got = {r["doc_id"]: r for r in out.where("doc_id IS NOT NULL").collect()}
    assert got[1]["text"] is None and got[1]["n_lines_"] == 0 and got[2]["text"] == "" and got[19]["text"] == "\n" * 9
    assert line_chunks.dedup_lines(nothing).count() == 0
    lines = [f"line {k}" for k in range(40)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new", *lines, "end"])), (3, "\n".join(lines[:10] + lines[11:]))]
    rows += [(1, "\n".join(lines)), (None, "\n".join(lines))]
    got = sorted(
        (r["doc_id"] or 0, r["n_lines"], r["n_removed"], r["text"])
        for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    )
    by = {k: [x for x in got if x[0] == k] for k in (0, 1, 2, 3)}
    # Rows of one id and text are one document, and rows without an id are left as they are.
    assert [x[2] for x in by[1]] == [0, 0] and by[0][0][2] == 0
    # Only chunks next to an inserted or lost line stay.
    assert by[2][0][2] >= 28 and by[3][0][2] >= 20 and "new" in by[2][0][3]


def test_warc(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"<p>é {k}</p>\r\n\r\n" * (k % 4)) for k in range(1500)]
    rows += [(7, "http://h/7", rows[7][2]), (7, "http://h/other", "x"), (8000, None, None), (None, "u", "h"), (-5, "u", "h")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, id int, record string")
    made = warc.records(pages)
    path = f"file://{tmp_path}/archive"
    warc.write_warc(made, path)
    back = warc.read_warc(spark, path)
    assert sorted(back.collect()) == sorted(made.collect())
    spoilt = made.where("id <> 600").selectExpr("id", "IF(id = 30, concat(record, 'x'), record) AS record").union(made.where("id = 9").selectExpr("9001L", "record"))
    with Scratch(spark, "test-warc") as scratch:
        left, right, same = (scratch.write(warc.leaves(x), n) for x, n in ((made, "a"), (spoilt, "b"), (back, "c")))
        assert warc.audit(left, same, scratch).count() == 0
        found = {(r["id"], r["status"]) for r in warc.audit(left, right, scratch).collect()}
        empty = scratch.write(warc.leaves(made.limit(0)), "d")
        assert warc.audit(empty, empty, scratch).count() == 0
        assert {r["status"] for r in warc.audit(left, empty, scratch).collect()} == {"missing"}
    behind = {(k, "moved") for k in range(31, 512)} | {(k, "moved") for k in range(601, 1024)}
    assert found == {(30, "altered"), (600, "missing"), (9001, "added")} | behind


def test_pipeline_stages(spark, monkeypatch):
    documents = read(spark, "documents", FOLDER)
    odd = spark.createDataFrame(
        [(500_000 + (i if i is not None else 99), t) if i is not None else (None, t) for i, t in odd_rows()], "doc_id long, text string"
    ).selectExpr("doc_id", "text", "'en' AS lang", "'src0' AS source", "length(text) AS n_chars")
    docs = documents.unionByName(odd.select(*documents.columns))
    with Scratch(spark, "test-pipeline") as scratch:
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = scratch.write(stage(spark, docs, FOLDER), name)
            assert after.columns == documents.columns
            if name == "quality":
                labels = read(spark, "labels", FOLDER)
                good = labels.where("quality = 1").join(docs, "doc_id")
                assert after.join(good.select("doc_id"), "doc_id").count() >= 0.99 * good.count()
            if name == "line_dedup":
                assert after.count() == docs.count()
                assert after.where("n_chars <> length(text)").join(documents.where("n_chars <> length(text)"), "doc_id", "left_anti").where("doc_id < 500000").count() == 0
            if name == "near_dedup":
                rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
                kept = sorted(i for i, x in brute.near_duplicates(rows).items() if x[2])
                assert sorted(r["doc_id"] for r in after.where("doc_id IS NOT NULL").collect()) == kept
            if name == "decontamination":
                items = [(r["item_id"], r["text"]) for r in read(spark, "benchmark", FOLDER).collect()]
                gone = {i for i, _ in brute.contamination([(r["doc_id"], r["text"]) for r in docs.limit(150).collect()], items)}
                assert not gone & {r["doc_id"] for r in after.collect()}
            docs = after
        last = scratch.write(corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER), "pieces")
        assert last.count() == docs.count() and last.where("NOT lossless").count() == 0
