"""Run folders: commit, resume, manifest."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tablewright.plans import runs, steps
from tablewright.sources import storage

STEPS = [
    {"operation": "standardize_column_names"},
    {"operation": "handle_missing_numeric", "column": "x", "parameters": {"method": "forward_fill"}},
    {"operation": "cap_outliers", "column": "x"},
    {"operation": "remove_duplicates", "parameters": {"subset": ["k"], "keep": "first"}},
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(300).selectExpr("id AS ` ID`", "id % 70 AS K", "IF(id % 7 = 3, NULL, id * 1.5D) AS X", "concat('t', id % 5) AS word").repartition(3)


def test_a_stopped_run_goes_on_behind_its_last_step(spark, table, tmp_path, monkeypatch):
    path = f"{tmp_path}/run"
    applied, apply_one, broken = [], runs._apply_one, [True]

    def noted(df, step, order_by):
        applied.append(step["operation"])
        if step["operation"] == "cap_outliers" and broken[0]:
            raise RuntimeError("the power went")
        return apply_one(df, step, order_by)

    monkeypatch.setattr(runs, "_apply_one", noted)
    with pytest.raises(ValueError, match="step 2 .*power"):
        runs.clean_to(path, table, STEPS, [" ID"], profile=False)
    assert sorted(x for x in os.listdir(f"{path}/_steps") if x.endswith("done")) == ["0-done", "1-done"] and not os.path.exists(f"{path}/manifest")
    broken[0] = False
    applied.clear()
    run = runs.clean_to(path, table, STEPS, [" ID"], profile=False)
    assert applied == ["cap_outliers", "remove_duplicates"]
    assert sorted(os.listdir(path)) == ["audit", "cleaned", "manifest", "pipeline"]
    plain = steps.apply_steps(table, STEPS, [" ID"])
    assert run.cleaned.columns == plain.columns and run.cleaned.exceptAll(plain).isEmpty() and run.cleaned.count() == plain.count() == 70
    _, audit = steps.apply_with_audit(table, STEPS, [" ID"])
    assert sorted(map(tuple, run.audit.collect())) == sorted(map(tuple, audit.select(run.audit.columns).collect()))
    assert run.manifest["cleaned"]["rows"] == 70 and run.manifest["input"]["rows"] == 300 and runs.verify_run(run)
    # A finished run is returned, another one in its place refused.
    applied.clear()
    assert runs.clean_to(path, table, STEPS, [" ID"], profile=False).manifest == run.manifest and applied == []
    with pytest.raises(ValueError, match="another table"):
        runs.clean_to(path, table, STEPS[:1], [" ID"], profile=False)


def test_other_steps_start_anew_and_foreign_folders_are_refused(spark, table, tmp_path):
    path = f"{tmp_path}/run"
    bad = [STEPS[0], {"operation": "cap_outliers", "column": "word"}]
    with pytest.raises(ValueError, match="step 1"):
        runs.clean_to(path, table, bad, [" ID"], profile=False)
    run = runs.clean_to(path, table.limit(0), STEPS, [" ID"], data_format="csv", profile=False)
    assert run.manifest["cleaned"]["rows"] == 0 and [r["rows_after"] for r in run.audit.orderBy("step").collect()] == [0] * 4
    (tmp_path / "mine").mkdir()
    with pytest.raises(ValueError, match="no run"):
        runs.clean_to(f"{tmp_path}/mine", table, STEPS[:1], profile=False)
    assert os.listdir(tmp_path / "mine") == []


def test_report_and_profile_belong_to_a_run(spark, table, tmp_path):
    run = runs.clean_to(f"{tmp_path}/run", table, STEPS[:2], [" ID"])
    assert {"profile", "report"} <= set(os.listdir(run.path))
    assert json.loads(runs._read_text(spark, f"{run.path}/pipeline"))["pipeline"] == STEPS[:2]
    assert runs._read_text(spark, f"{run.path}/report").startswith("# Cleaning report\n")


def test_audit_reads_no_stored_table(spark, table):
    after, audit = steps.apply_with_audit(table, STEPS, [" ID"])
    plan = audit._jdf.queryExecution().executedPlan().toString()
    # Only the step that is not stored (capping) is counted by a scan, on either side of the audit's join.
    assert plan.count("Scan parquet") + plan.count("FileScan parquet") <= 2 * 2
    seen = storage.counted(after)
    assert (seen.rows, seen.missing) == tuple(audit.orderBy(F.desc("step")).select("rows_after", "missing_after").first())


def test_session_folder(spark):
    path = storage.new_path(spark, "x")
    assert os.path.dirname(path) == os.path.dirname(storage.new_path(spark, "y"))
    kept = storage.stored(spark.range(3))
    assert kept.count() == 3
