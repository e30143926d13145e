"""Physical plans: pruning, pushdown, no single-partition sorts, no Python in the row path."""

import os
import re

import pytest

from tablewright.catalog.base import Tables
from tablewright.operators import duplicates, missing, ordering, outliers, profile

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not available")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


def scans(text):
    return re.findall(r"ReadSchema: struct<([^>]*)>", text)


def test_profile_reads_only_the_columns_it_needs(tables):
    text = plan(profile.standard_deviations(tables.lineitem.select("l_quantity", "l_tax")))
    assert scans(text) == ["l_quantity:double,l_tax:double"]


def test_outlier_removal_reaches_the_scan(tables):
    text = plan(outliers.remove_outliers_iqr(tables.events, "value"))
    assert "Exchange" not in text and "Join" not in text


def test_fills_by_a_statistic_do_not_shuffle(tables):
    for method in ("mean", "median", "mode", "constant", "drop"):
        df = missing.handle_missing_numeric(tables.events_n, "value_n", method, 1.0)
        assert "Exchange" not in plan(df), method


@pytest.mark.parametrize("fill", [ordering.forward_fill, ordering.backward_fill, ordering.interpolate])
def test_ordered_fills_sort_by_range(tables, fill):
    text = plan(fill(tables.events_n, "value_run", ["event_id"], 100))
    windows = re.findall(r"Window \[[^\n]*\], \[([^\]]*)\]", text)
    over_rows = [line for line in text.split("\n") if "Window [" in line and "[f0#" in line.replace(", f0#", ", [f0#")]
    assert over_rows and all(f"[{ordering.RANGE}" in line for line in over_rows), windows
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_keyed_duplicates_combine_before_the_shuffle(tables):
    text = plan(duplicates.remove_duplicates(tables.events, ["user_id"], "first", ["event_id"]))
    assert "partial_min_by" in text and "Window" not in text


def test_long_duplicates_read_the_table_few_times_and_broadcast_no_text(tables):
    table = tables.documents.select("doc_id", "text", "lang")
    text = plan(duplicates.duplicate_rows(table, ["text", "lang"]))
    # One scan of the table in the plan that lists the rows; two more made the stored hashes and looked for hashes of two keys.
    assert len([x for x in scans(text) if "text:string" in x]) == 1
    broadcasts = [x for x in text.split("\n") if "BroadcastExchange" in x]
    assert broadcasts and all("input[0, bigint" in x or "IdentityBroadcastMode" in x for x in broadcasts), broadcasts
    counts = plan(duplicates.duplicate_counts(table, ["text", "lang"]))
    assert len([x for x in scans(counts) if "text:string" in x]) == 1
