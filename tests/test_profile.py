import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import cardinality, correlation, duplicates, facts, outliers, profile
from tablewright.plans import reports, score
from tablewright.sources.validation import is_valid, validation_findings


def rows(table):
    return [row.asDict() for row in table.collect()]


def by_column(table):
    return {row["column"]: row.asDict() for row in table.collect()}


def test_missing_counts_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (3.0, "b"), (None, "c")], "x double, s string")
    found = by_column(profile.missing_by_column(df))
    assert found["x"]["null_count"] == 2 and found["x"]["null_pct"] == 50.0
    assert rows(profile.missing_totals(df))[0]["rows_with_any_null"] == 2
    assert by_column(cardinality.cardinality(df))["x"]["unique_values"] == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, s string, t timestamp_ntz, b boolean")
    assert rows(profile.missing_totals(df))[0] == {
        "total_cells": 0, "total_missing": 0, "missing_pct": 0.0, "rows_with_any_null": 0, "rows_with_any_null_pct": 0.0,
    }
    assert rows(score.usability_score(df))[0]["score"] == 0
    assert rows(outliers.detect_outliers_iqr(df)) == [{"column": "x", "outliers_iqr": 0, "outliers_iqr_pct": 0.0}]
    assert not is_valid(df)
    assert rows(profile.skewness_kurtosis(df))[0]["skewness"] is None


def test_constant_column(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 2.0), (2.0, 4.0), (2.0, 4.0)], "x double, y double")
    assert by_column(profile.skewness_kurtosis(df))["x"] == {"column": "x", "skewness": 0.0, "kurtosis": 0.0}
    assert rows(outliers.detect_outliers_zscore(df))[0]["outliers_z"] == 0
    found = {(r["col_a"], r["col_b"]): r["r"] for r in correlation.correlation_matrix(df).collect()}
    assert found[("x", "y")] is None and found[("x", "x")] is None and found[("y", "y")] == 1.0


def test_booleans_are_never_numeric(spark):
    df = spark.createDataFrame([(True, 1), (False, 2)], "b boolean, x int")
    assert [r["column"] for r in profile.standard_deviations(df).collect()] == ["x"]
    classes = by_column(profile.column_classes(df))
    assert classes["b"]["categorical"] and not classes["b"]["numeric"]


def test_no_numeric_columns(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    for table in (profile.skewness_kurtosis(df), profile.standard_deviations(df), outliers.detect_outliers_iqr(df),
                  correlation.correlation_matrix(df)):
        assert table.count() == 0
    assert rows(score.usability_score(df))[0]["score"] == 100


def test_decimals_and_dates(spark):
    df = spark.sql(
        "SELECT CAST(id AS DECIMAL(10,2)) / 4 AS d, date_add(DATE '2024-01-30', CAST(id AS INT)) AS day FROM range(5)"
    )
    found = by_column(profile.column_statistics(df))
    assert found["d"]["max"] == 1.0 and found["day"]["max_iso"] == "2024-02-03T00:00:00"


def test_bounds_are_inclusive_for_z_and_strict_for_fences(spark):
    values = [-3.0, 3.0] + [0.0] * 16
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert rows(outliers.detect_outliers_zscore(df, 3.0))[0]["outliers_z"] == 2
    quartiles = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 6, -2)], "x double")
    fence = outliers.fences(quartiles)["x"]
    exact = quartiles.unionAll(spark.createDataFrame([(fence.high,), (fence.low,)], "x double"))
    assert not exact.filter(outliers.iqr_conditions(exact, {"x": fence})["x"]).count()


def test_bands_disagree_at_ten_and_fifty(spark):
    counts = spark.createDataFrame([(str(n), n, 100) for n in (9, 10, 11, 49, 50, 51)],
                                   "column string, unique_values bigint, rows bigint")
    chart = {r["unique_values"]: r["band"] for r in cardinality.chart_bands(counts).collect()}
    table = {r["unique_values"]: r["category"].split()[0].lower() for r in cardinality.table_bands(counts).collect()}
    assert (chart[10], table[10]) == ("medium", "low")
    assert (chart[50], table[50]) == ("high", "medium")
    assert chart[9] == table[9] and chart[51] == table[51]


def test_approximate_cardinality_is_close(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("x"))
    found = rows(cardinality.cardinality(df, approximate=True))[0]["unique_values"]
    assert abs(found - 5000) < 400


def test_wide_tables_use_several_passes(spark, monkeypatch):
    df = spark.range(100).selectExpr(*[f"IF(id % {i + 2} = 0, NULL, id) AS c{i}" for i in range(9)])
    whole = rows(profile.missing_totals(df)), by_column(profile.memory_by_column(df)), rows(profile.missing_by_column(df))
    monkeypatch.setattr(facts, "AGGREGATES_PER_PASS", 40)
    assert len(facts.Facts.of(df).passes) == 3
    monkeypatch.setattr(facts, "AGGREGATES_PER_PASS", 3)
    parts = rows(profile.missing_totals(df)), by_column(profile.memory_by_column(df)), rows(profile.missing_by_column(df))
    assert whole == parts


def test_collected_facts_give_the_same_tables(spark):
    df = spark.range(50).selectExpr("id", "CAST(id AS STRING) AS s", "TIMESTAMP_NTZ '2024-01-01 10:00:00' AS t")
    kept = facts.Facts.of(df).collected()
    for table in (profile.missing_by_column, profile.column_ranges, profile.data_types, profile.memory_by_column):
        assert rows(table(df)) == rows(table(df, kept))


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(None,), (None,), (1,)], "a int")
    assert rows(duplicates.duplicate_counts(df)) == [{"n_duplicate_rows": 2, "n_surplus_rows": 1, "n_groups": 1}]
    assert [r["a"] for r in duplicates.duplicate_rows(df).collect()] == [None, None]
    assert duplicates.remove_duplicates(df).count() == 2
    assert [r["a"] for r in duplicates.remove_duplicates(df, keep=False).collect()] == [1]


def test_hot_and_cold_duplicates_are_both_found(spark):
    # Key 0 holds a third of the rows, 1..1500 occur twice (too rare to be hot), the rest once.
    df = spark.range(9000).selectExpr(
        "id", "CASE WHEN id < 3000 THEN 0 WHEN id < 6000 THEN 1 + id % 1500 ELSE id END AS k",
    ).withColumn("text", F.concat(F.lit("t"), "k"))
    for subset in (["k"], ["text"], ["k", "text"]):
        assert duplicates.duplicate_rows(df, subset).count() == 6000
        counts = rows(duplicates.duplicate_counts(df, subset))[0]
        assert counts == {"n_duplicate_rows": 6000, "n_surplus_rows": 2999 + 1500, "n_groups": 1501}
    kept = duplicates.remove_duplicates(df, ["k"], "first", ["id"])
    assert kept.count() == 1501 + 3000 and kept.agg(F.min("id")).first()[0] == 0
    assert duplicates.remove_duplicates(df, ["k"], "last", ["id"]).filter("k = 0").first()["id"] == 2999


def test_remove_duplicates_arguments(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        duplicates.remove_duplicates(df, keep="any")
    with pytest.raises(TypeError):
        duplicates.remove_duplicates(df, "a")
    with pytest.raises(KeyError):
        duplicates.remove_duplicates(df, ["z"])
    with pytest.raises(ValueError):
        duplicates.remove_duplicates(df, ["a"])


def test_memory_text_and_saving(spark):
    df = spark.createDataFrame([(i, "ab") for i in range(200)], "x bigint, s string")
    found = by_column(profile.memory_by_column(df))
    assert found["x"]["est_bytes"] == 1600 and found["s"]["est_bytes"] == 1200
    saving = by_column(profile.memory_saving(df))
    assert saving["x"]["saving_bytes"] == 1200.0 and saving["s"]["saving_bytes"] == 600.0
    sizes = spark.createDataFrame([(500,), (2048,), (3 * 1024**3,)], "n bigint")
    from tablewright.functions.display import bytes_sql
    assert [r[0] for r in sizes.selectExpr(bytes_sql("n")).collect()] == ["500.0 B", "2.0 KB", "3.0 GB"]


def test_type_distribution(spark):
    df = spark.createDataFrame([(1, 2, "a")], "x bigint, y bigint, s string")
    found = {r["dtype"]: (r["label"], r["columns_count"]) for r in profile.type_distribution(df).collect()}
    assert found == {"bigint": ("Integer", 2), "string": ("Text/Object", 1)}


def test_verification_reports_a_listed_value(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(10), 100]], "x double")
    found = rows(outliers.verify_outlier_detection(df, "x", 100.0))[0]
    assert found["counts_match"] and found["value_is_outlier"] and found["value_found"]
    with pytest.raises(KeyError):
        outliers.verify_outlier_detection(df, "y")
    with pytest.raises(ValueError):
        outliers.verify_outlier_detection(df.select(F.lit(None).cast("double").alias("x")), "x")


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None)], "`a.b` double, `c d` string")
    assert by_column(profile.missing_by_column(df))["c d"]["null_count"] == 1
    assert rows(outliers.detect_outliers_iqr(df))[0]["column"] == "a.b"
    assert set(reports.analysis_report(df)) >= {"usability", "cardinality"}
    assert reports.report_overview(reports.analysis_report(df)).count() == 13


def test_validation_names(spark):
    df = spark.createDataFrame([(1, 2)], ["ok", " "])
    failed = {r["check"] for r in validation_findings(df).collect() if not r["ok"]}
    assert failed == {"names_not_blank"} and not is_valid(df)
    odd = spark.createDataFrame([(1,)], ["x%"])
    assert is_valid(odd) and {r["check"] for r in validation_findings(odd).collect() if not r["ok"]} == {"name_characters"}


def test_results_do_not_depend_on_partitioning(spark):
    df = spark.range(2000).selectExpr("id", "IF(id % 3 = 0, NULL, sin(id)) AS x", "id % 7 AS k")
    for make in (profile.missing_by_column, cardinality.cardinality, outliers.outlier_bounds, duplicates.duplicate_counts):
        assert rows(make(df.repartition(1))) == rows(make(df.repartition(7)))
    assert not math.isnan(rows(profile.skewness_kurtosis(df))[0]["skewness"])


def test_correlation_of_many_columns_is_one_pass_over_pairs(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 6))
    data = base @ rng.normal(size=(6, 200)) + rng.normal(size=(400, 200))
    data[:, 0] = 3.0
    data[rng.random(data.shape) < 0.2] = np.nan
    data[:, 1] = np.where(np.arange(400) < 200, 1e9, np.arange(400) + 1e9)  # constant wherever column 2 has a value
    data[200:, 2] = np.nan
    data[7, 3] = np.inf
    frame = pd.DataFrame(data, columns=[f"c{i}" for i in range(200)])
    df = spark.createDataFrame(frame).repartition(3)
    pairs = correlation.pair_correlations(df)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("Scan parquet") == 1 and plan.count("MapInArrow") == 1
    found = {(r["col_a"], r["col_b"]): r["r"] for r in pairs.collect()}
    assert len(found) == 200 * 199 // 2
    with np.errstate(all="ignore"):
        expected = frame.drop(columns="c3").corr()
    for (a, b), r in found.items():
        if "c0" in (a, b) or "c3" in (a, b) or {a, b} == {"c1", "c2"}:
            assert r is None or "c3" in (a, b) and pd.isna(frame[b if a == "c3" else a][7]), (a, b)
        else:
            assert r == pytest.approx(expected.loc[a, b], abs=1e-9), (a, b)


def test_correlation_of_an_empty_table(spark):
    rows = correlation.correlation_matrix(spark.createDataFrame([], "a double, b int, c string")).collect()
    assert sorted((r["col_a"], r["col_b"], r["r"]) for r in rows) == [("a", "a", None), ("a", "b", None), ("b", "a", None), ("b", "b", None)]


@pytest.mark.parametrize("sent", [1 << 20, 0])
@pytest.mark.parametrize("hashes", [1, 5, None])
def test_duplicates_whose_hashes_meet(spark, monkeypatch, hashes, sent):
    """Different keys under one hash are told apart by the keys; with one hash for all it is the hot one. By broadcast and by bit filter."""
    monkeypatch.setattr(duplicates, "MOST_SENT_HASHES", sent)
    if hashes:
        monkeypatch.setattr(duplicates, "_hash_of", lambda keys: F.pmod(F.xxhash64(*keys), F.lit(hashes)))
    words = ["a", "b", "b", None, None, "c", "d", "d", "d", "e", float("nan")]
    df = spark.createDataFrame([(str(w) if isinstance(w, str) else None, k % 2, k) for k, w in enumerate(words)], "word string, n int, id int").repartition(3)
    for subset in (["word"], ["word", "n"]):
        key = lambda r: tuple(r[x] for x in subset)
        held = df.collect()
        sizes = {}
        for r in held:
            sizes[key(r)] = sizes.get(key(r), 0) + 1
        wanted = sorted(r["id"] for r in held if sizes[key(r)] > 1)
        assert sorted(r["id"] for r in duplicates.duplicate_rows(df, subset).collect()) == wanted
        counts = duplicates.duplicate_counts(df, subset).first()
        many = [n for n in sizes.values() if n > 1]
        assert tuple(counts) == (sum(many), sum(many) - len(many), len(many))
    assert duplicates.duplicate_rows(df.limit(0)).count() == 0 and duplicates.duplicate_counts(df.select("id")).first()[0] == 0


def test_states_of_parts_merge_to_the_state_of_the_whole(spark):
    from tablewright.operators import stored_profile

    df = spark.range(1000).selectExpr(
        "IF(id % 9 = 0, NULL, 1.0E9D + id * 0.25D) AS x", "IF(id < 400, NULL, CAST(id % 50 AS INT)) AS late", "concat('k', id % 300) AS word",
        "IF(id % 2 = 0, double('NaN'), NULL) AS nothing", "map('a', id) AS m", "id % 3 = 0 AS flag",
    )
    whole = stored_profile.profile_of(stored_profile.profile_state(df)).toPandas().set_index("column")
    cuts = [df.limit(0), *(df.filter(f"(late IS NULL) = {side} AND word {sign} 'k2'") for side in ("true", "false") for sign in ("<", ">="))]
    merged = stored_profile.profile_of(stored_profile.merged_states(*map(stored_profile.profile_state, cuts))).toPandas().set_index("column")
    for name in ("rows", "missing", "min", "max", "missing_pct"):
        pd.testing.assert_series_equal(merged[name], whole[name])
    np.testing.assert_allclose(merged[["mean", "std"]].astype(float), whole[["mean", "std"]].astype(float), rtol=1e-9)
    assert abs(merged.loc["word", "distinct_estimate"] - 300) <= 9 and merged.loc["nothing", "missing"] == 1000 and merged.loc["flag", "distinct_estimate"] == 2
