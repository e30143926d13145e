"""Archives in which one id holds most of the records."""

from tablewright.llm import warc
from tablewright.llm.base import Scratch
from tests.compare import connect, differences


def test_hot_id_equals_the_sql(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>") for k in range(400, 1300, 3)]
    rows += [(600, f"http://h/600/{k}", "y" * (k % 97)) for k in range(5000)] + [(600, "http://h/600/1", "y")] * 3
    rows += [(None, "u", "h"), (2**60, "far", "x"), (-3, "u", None), (-700, "u", "v")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    duck = connect(str(tmp_path / "none"))
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    result = warc.op7_warc_fixity(spark, str(tmp_path))
    assert differences(result, duck, warc.SQL) == []


def test_one_lost_record_of_a_hot_id(spark):
    rows = [(9, f"u{k}", "p" * (k % 50)) for k in range(5000)] + [(k, "u", "q") for k in range(500, 530)]
    made = warc.records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    lost = made.where("NOT record LIKE '%: u77\r\n%'")
    with Scratch(spark, "hot-warc") as scratch:
        left, right = (scratch.write(warc.leaves(x, scratch), n) for x, n in ((made, "a"), (lost, "b")))
        order = [r["digest"] for r in left.orderBy("volume", "place").collect()]
        found = {r["digest"]: r["status"] for r in warc.audit(left, right, scratch).collect()}
        gone = [d for d, status in found.items() if status == "missing"]
        assert len(gone) == 1 and left.agg({"place": "max"}).first()[0] == 5011
        # All that stood behind it in its volume has moved, nothing before it and nothing in other volumes.
        at = order.index(gone[0])
        assert set(found) == set(order[at:5012]) and set(found.values()) == {"missing", "moved"}
        assert warc.audit(right, left, scratch).where("status = 'added'").count() == 1
