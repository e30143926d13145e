"""Facts from Parquet footers against the same facts from a scan."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tablewright.operators import footers, profile
from tablewright.operators.facts import Facts

KINDS = ("missing", "min", "max", "whole_min", "whole_max", "first", "last")


def table(rows: int = 500) -> pa.Table:
    return pa.table({
        "whole": pa.array([None if i % 7 == 0 else i - 100 for i in range(rows)], pa.int64()),
        "small": pa.array([i % 50 for i in range(rows)], pa.int16()),
        "share": pa.array([float("nan") if i % 5 == 0 else None if i % 3 == 0 else i / 8 for i in range(rows)], pa.float64()),
        "text": pa.array([None if i % 2 else "x" * 3000 + str(i) for i in range(rows)]),
        "day": pa.array([datetime.date(2020, 1, 1) + datetime.timedelta(days=i) for i in range(rows)], pa.date32()),
        "dotted.name": pa.array([i % 3 == 0 for i in range(rows)]),
        "list": pa.array([[i] if i % 4 else None for i in range(rows)]),
    })


def values(facts: Facts):
    rows = facts.table(lambda c: {"column": c.name, "rows": "rows"} | {k: f"CAST({c(k)} AS STRING)" for k in KINDS}).collect()
    return {row["column"]: row.asDict() for row in rows}


def both(spark, path: str):
    return values(footers.parquet_facts(spark, path, KINDS)), values(Facts.of(spark.read.parquet(path), only=KINDS))


@pytest.fixture()
def folder(tmp_path):
    for part in range(3):
        pq.write_table(table(500 + part), tmp_path / f"part-{part}.parquet", row_group_size=120)
    return str(tmp_path)


def plans(monkeypatch) -> list[str]:
    seen = []
    made = footers.footer_row

    def noted(*args):
        row = made(*args)
        seen.append(row._jdf.queryExecution().executedPlan().toString())
        return row

    monkeypatch.setattr(footers, "footer_row", noted)
    return seen


def test_footers_tell_what_a_scan_tells(spark, folder, monkeypatch):
    seen = plans(monkeypatch)
    told, scanned = both(spark, folder)
    assert told == scanned
    assert footers.PUSHED in seen[0] and "MIN(whole)" in seen[0]
    # Fractions and nested columns are none of the footers' business; ends of text are not asked for.
    assert "share" not in seen[0] and "list" not in seen[0] and "MIN(text)" not in seen[0]


def test_nan_counts_as_missing(spark, folder):
    told = values(footers.parquet_facts(spark, folder, KINDS))["share"]
    plain = pa.concat_tables([table(500 + part) for part in range(3)])["share"].to_pylist()
    assert int(told["missing"]) == sum(v is None or v != v for v in plain)
    assert float(told["max"]) == max(v for v in plain if v is not None and v == v)


def test_files_without_statistics_are_scanned(spark, folder, tmp_path):
    pq.write_table(table(77), tmp_path / "bare.parquet", write_statistics=False)
    told, scanned = both(spark, folder)
    assert told == scanned and told["whole"]["rows"] == 1580


def test_columns_of_folder_names(spark, tmp_path):
    for key in ("1", "2"):
        (tmp_path / f"part={key}").mkdir()
        pq.write_table(table(100 * int(key)), tmp_path / f"part={key}" / "x.parquet")
    (tmp_path / "part=__HIVE_DEFAULT_PARTITION__").mkdir()
    pq.write_table(table(10), tmp_path / "part=__HIVE_DEFAULT_PARTITION__" / "x.parquet")
    told, scanned = both(spark, str(tmp_path))
    assert told == scanned
    assert told["part"]["missing"] == "10" and told["part"]["max"] == "2.0"


def test_empty_table(spark, tmp_path):
    pq.write_table(table(0), tmp_path / "none.parquet")
    told, scanned = both(spark, str(tmp_path))
    assert told == scanned and told["whole"]["rows"] == 0


def test_profile_tables_take_them(spark, folder):
    df = spark.read.parquet(folder)
    told = profile.missing_by_column(df, footers.parquet_facts(spark, folder, ("missing",)))
    assert told.collect() == profile.missing_by_column(df).collect()
    with pytest.raises(ValueError):
        footers.parquet_facts(spark, folder, ("missing", "rows_with_missing"))


def test_the_session_keeps_its_settings(spark, folder):
    before = {name: spark.conf.get(name) for name in footers.FOOTER_SETTINGS}
    footers.parquet_facts(spark, folder)
    assert {name: spark.conf.get(name) for name in footers.FOOTER_SETTINGS} == before
