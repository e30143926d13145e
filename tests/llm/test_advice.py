
import random

import corpus_pipeline
from tablewright.llm import decontaminate
from tests.llm import brute


def contamination(spark, rows, items):
    """{(id, item): (similarity, first word, words)}, after a look that the column of the pipeline finds the same documents."""
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    held = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(documents, held).collect()
    flagged = documents.where(decontaminate.contaminated_column(documents["text"], held)).collect()
    assert {r["doc_id"] for r in flagged} == {r["id"] for r in found}
    return {(r["id"], r["item"]): (r["similarity"], r["first_word"], r["n_words"]) for r in found}


def test_weights_do_not_depend_on_the_blocks(spark, monkeypatch):
    rng = random.Random(5)
    phrases = [[f"p{k}_{j}" for j in range(9)] for k in range(3)]
    items, rows = [], []
    for k in range(21):
        # The first 14 items share a phrase, the others another one; each has words of its own.
        own = [f"i{k}_{j}" for j in range(31)]
        items.append((k, " ".join(phrases[k >= 14] + own)))
        for n in range(8):
            copy = phrases[k >= 14] + own
            for at in rng.sample(range(40), n % 4):
                copy[at] = f"z{rng.randrange(9)}"
            if n % 3 == 0:  # words that only items of other blocks hold
                copy[-9:] = phrases[k < 14]
            rows.append((10 * k + n, " ".join(["before"] * (n % 3) + copy + ["after"])))
    expected = brute.contamination(rows, items)
    assert 0 < len(expected) < len(rows)
    whole = contamination(spark, rows, items)
    assert set(whole) == expected
    for most in (7, 20):
        monkeypatch.setattr(decontaminate, "ITEMS_PER_BLOCK", most)
        assert contamination(spark, rows, items) == whole


def test_documents_shorter_than_an_item(spark):
    item = [f"a{k}" for k in range(39)]
    items = [(1, " ".join(item)), (2, " ".join(item + ["more"] * 3)), (3, "one two three"), (4, "b1 b2 b3 b4 b5 b6 b7 b8"), (5, "x " * 12)]
    rows = [
        (1, " ".join(item[:-2])), (2, " ".join(item[2:])), (3, " ".join(item[:30])), (4, " ".join(item[:20])), (5, "one two"),
        (6, "B2 b3 b4 b5 b6 b7 b8"), (7, "b1 b2 b3 b4"), (8, " ".join(item[:20] + ["z"] + item[21:-1])), (9, "x " * 10), (10, "x " * 8),
        (11, ""), (12, " ".join(item)),
    ]
    found = contamination(spark, rows, items)
    assert set(found) == brute.contamination(rows, items)
    assert found[1, 1][1:] == (0, 37) and (2, 1) in found and (6, 4) in found and found[12, 2][1:] == (0, 39)
    assert not {3, 4, 5, 7} & {i for i, k in found if k != 1} and (4, 1) not in found


def test_rows_that_share_an_id_are_decided_by_their_text(spark):
    rng = random.Random(2)
    make = lambda: [f"w{rng.randrange(10**6)}" for _ in range(40)]
    one, two, three = make(), make(), make()
    rows = [
        (1, " ".join(one), 5), (1, " ".join(two), 6),  # one id, two documents
        (2, " ".join(one[:-1]), 7), (3, " ".join(two[1:]), 8),  # near duplicates of either
        (4, " ".join(three), 9), (4, " ".join(three), 3), (4, " ".join(three[:-1] + ["x"]), 9), (4, " ".join(make()), 1),
        (5, "", 0), (5, "one two", 0), (5, None, 0), (None, " ".join(one), 2), (None, " ".join(one), 2),
    ]
    results = []
    for seed in range(3):
        dealt = random.Random(seed).sample(rows, len(rows))
        docs = spark.createDataFrame(dealt, "doc_id long, text string, n_chars int").repartition(1 + seed)
        after = corpus_pipeline.near_stage(spark, docs, "")
        assert after.columns == docs.columns
        results.append(sorted((tuple(r) for r in after.collect()), key=repr))
    assert results[0] == results[1] == results[2]
    got = results[0]
    assert {rows[0], rows[1], rows[7], rows[8], rows[9], rows[10]} <= set(got) and got.count(rows[11]) == 2
    assert not {2, 3} & {r[0] for r in got}
    # Of the three near copies of `three` one stays; if it is the repeated one, the row with the least other values.
    assert len([r for r in got if r in (rows[5], rows[6])]) == 1 and rows[4] not in [r for r in got if r[1] == rows[5][1]]
    assert len(got) == 9
