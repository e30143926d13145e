import pytest
from pyspark.sql import functions as F

from tablewright.functions import text
from tablewright.functions.display import display_strings
from tablewright.operators import missing, outliers, types
from tablewright.operators.names import standard_names, standardize_column_names
from tablewright.plans import reports, steps


def values(df, name="x", order="id"):
    return [row[name] for row in df.orderBy(order).collect()]


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame(list(enumerate([1.0, 2.0, None, 4.0])), "id int, x double")


def test_numeric_fills(gaps, spark):
    assert values(missing.handle_missing_numeric(gaps, "x", "mean"))[2] == pytest.approx(7 / 3)
    assert values(missing.handle_missing_numeric(gaps, "x", "median"))[2] == 2.0
    ties = spark.createDataFrame(list(enumerate([3, 1, 3, 1, 2, None])), "id int, x bigint")
    assert values(missing.handle_missing_numeric(ties, "x", "mode"))[5] == 1
    assert values(missing.handle_missing_numeric(gaps, "x", "constant", 9))[2] == 9.0
    assert missing.handle_missing_numeric(gaps, "x", "drop").count() == 3


def test_types_after_fills(spark):
    whole = spark.createDataFrame([(0, 1), (1, None), (2, 4)], "id int, x bigint")
    for method in ("mean", "median", "interpolate"):
        out = missing.handle_missing_numeric(whole, "x", method, order_by=["id"])
        assert out.schema["x"].dataType.simpleString() == "double"
    assert missing.handle_missing_numeric(whole, "x", "mode").schema["x"].dataType.simpleString() == "bigint"
    with pytest.raises(ValueError):
        missing.handle_missing_numeric(whole, "x", "constant", 1.5)


def test_modes_and_constants_keep_exact_types(spark):
    df = spark.sql(
        "SELECT id, IF(id = 3, NULL, TIMESTAMP_NTZ '2024-03-31 02:30:00.000001') AS t, "
        "IF(id = 3, NULL, CAST(1.10 AS DECIMAL(5,2))) AS d, IF(id = 3, NULL, DATE '2024-02-29') AS day, "
        "IF(id = 3, NULL, true) AS b FROM range(4)"
    )
    for name in ("t", "d", "day", "b"):
        out = missing.handle_missing_categorical(df, name, "mode")
        assert out.schema == df.schema or out.schema[name].dataType == df.schema[name].dataType
        assert len(set(values(out, name))) == 1
    filled = missing.handle_missing_categorical(df, "t", "constant", "2020-01-01 00:00:00")
    assert str(values(filled, "t")[3]) == "2020-01-01 00:00:00"
    assert values(missing.handle_missing_categorical(df, "b", "constant", False), "b")[3] is False
    for name in ("b", "d"):
        with pytest.raises(ValueError):
            missing.handle_missing_categorical(df, name, "new_category")


def test_all_missing(spark):
    df = spark.createDataFrame([(0, None), (1, None)], "id int, x double")
    for method in ("mean", "median", "mode", "forward_fill", "backward_fill", "interpolate"):
        assert values(missing.handle_missing_numeric(df, "x", method, order_by=["id"])) == [None, None]
    assert values(missing.handle_missing_numeric(df, "x", "constant", 1.0)) == [1.0, 1.0]
    assert missing.handle_missing_numeric(df, "x", "drop").count() == 0
    assert values(outliers.remove_outliers_iqr(df, "x")) == [None, None]
    assert values(outliers.cap_outliers(df, "x")) == [None, None]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, 3.0), (3, None)], "id int, x double")
    assert values(missing.handle_missing_numeric(df, "x", "mean")) == [1.0, 2.0, 3.0, 2.0]
    assert values(missing.handle_missing_numeric(df, "x", "forward_fill", order_by=["id"])) == [1.0, 1.0, 3.0, 3.0]


def test_fill_errors(gaps):
    with pytest.raises(KeyError):
        missing.handle_missing_numeric(gaps, "y", "mean")
    with pytest.raises(ValueError):
        missing.handle_missing_numeric(gaps, "x", "guess")
    with pytest.raises(ValueError):
        missing.handle_missing_numeric(gaps, "x", "constant")
    with pytest.raises(ValueError):
        missing.handle_missing_numeric(gaps, "x", "forward_fill")
    with pytest.raises(ValueError):
        missing.handle_missing_categorical(gaps, "x", "mean")
    with pytest.raises(ValueError):
        missing.handle_missing_numeric(gaps.withColumn("x", F.lit("a")), "x", "mean")


def test_categorical_fills(spark):
    df = spark.createDataFrame(list(enumerate([None, "b", "a", "b", "a", None])), "id int, x string")
    assert values(missing.handle_missing_categorical(df, "x", "mode"))[0] == "a"
    assert values(missing.handle_missing_categorical(df, "x", "constant"))[0] == "Unknown"
    assert values(missing.handle_missing_categorical(df, "x", "constant", "z"))[0] == "z"
    assert values(missing.handle_missing_categorical(df, "x", "new_category"))[0] == "Missing"
    assert values(missing.handle_missing_categorical(df, "x", "backward_fill", order_by=["id"])) == ["b", "b", "a", "b", "a", None]


def test_capping_truncates_integers(spark):
    df = spark.createDataFrame([(0, 1), (1, 10), (2, 100), (3, None)], "id int, x bigint")
    assert values(outliers.cap_outliers(df, "x")) == [1, 10, 98, None]
    with pytest.raises(ValueError):
        outliers.cap_outliers(df, "x", 0.0, 0.5)
    with pytest.raises(ValueError):
        outliers.cap_outliers(df, "x", 0.6, 0.5)
    constant = df.withColumn("x", F.lit(2.0))
    assert values(outliers.cap_outliers(constant, "x")) == [2.0] * 4


def test_removal(spark):
    df = spark.createDataFrame(list(enumerate([1.0, 2.0, 3.0, 4.0, 100.0, None])), "id int, x double")
    assert values(outliers.remove_outliers_iqr(df, "x")) == [1.0, 2.0, 3.0, 4.0, None]
    for bad in (0, -1, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            outliers.remove_outliers_iqr(df, "x", bad)


@pytest.mark.parametrize(
    "operation,python",
    [
        ("lowercase", str.lower), ("uppercase", str.upper), ("title_case", str.title), ("trim_whitespace", str.strip),
        ("remove_extra_spaces", lambda s: __import__("re").sub(r"\s+", " ", s)),
        ("remove_special_chars", lambda s: __import__("re").sub(r"[^a-zA-Z0-9\s]", "", s)),
        ("standardize_quotes", lambda s: __import__("re").sub("[\"'`´]", '"', s)),
    ],
)
def test_text_operations_equal_python(spark, operation, python):
    samples = [
        "  Hello World  ", "GOODBYE", "o'neil it's a1b x-y", "\t a\n b  ", "say `x´ \"y\" “z”",
        "Ünïcode é à", "سلام دنيا", "a\x1cb\x1f", "", "١٢٣ abc", "e-mail@x.org",
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)] + [(99, None)], "id int, x string")
    out = df.select("id", text.TEXT_OPERATIONS[operation](F.col("x")).alias("x"))
    assert values(out) == [python(s) for s in samples] + [None]


def test_text_operations_run_in_order(spark):
    df = spark.createDataFrame([(0, "  Hello World  "), (1, "GOODBYE")], "id int, x string")
    assert values(steps.clean_text_column(df, "x", ["lowercase", "trim_whitespace"])) == ["hello world", "goodbye"]
    with pytest.raises(ValueError):
        steps.clean_text_column(df, "x", ["shout"])
    with pytest.raises(KeyError):
        steps.clean_text_column(df, "y", ["lowercase"])
    with pytest.raises(ValueError):
        steps.clean_text_column(df, "id", ["lowercase"])


def test_column_names(spark):
    assert standard_names(["  Column Name!  ", "another-col"]) == ["column_name", "another_col"]
    assert standard_names([" 1x", "%%", "A.B-C d", "اسم"]) == ["col_1x", "unnamed_column_1", "a_b_c_d", "unnamed_column_3"]
    assert len(set(standard_names(["a", "a", "a_1"]))) == 3
    assert standard_names(["a", "a", "a"]) == ["a", "a_1", "a_2"]
    df = spark.createDataFrame([(1, 2)], ["A", "b"]).toDF("X y", "X y")
    assert standardize_column_names(df).columns == ["x_y", "x_y_1"]


def test_narrower_types(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "A bigint, B double")
    assert [f.dataType.simpleString() for f in types.optimize_dtypes(df).schema] == ["tinyint", "float"]
    wide = spark.createDataFrame([(40_000, 1e300), (None, None)], "A bigint, B double")
    assert [f.dataType.simpleString() for f in types.optimize_dtypes(wide).schema] == ["int", "double"]
    empty = spark.createDataFrame([(None, None)], "A bigint, B double")
    assert types.optimize_dtypes(empty).schema == empty.schema


def test_text_to_numbers_and_dates(spark):
    df = spark.createDataFrame(
        [(" 3 ", "2024-01-02", "1.5", "1f"), (None, "2024-01-03 10:11:12", "1e3", "NaN"), ("-7", "2024-02-30", ".5", "2")],
        "whole string, day string, part string, word string",
    )
    out = types.optimize_dtypes(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "timestamp_ntz", "double", "string"]
    row = out.collect()
    assert [r["whole"] for r in row] == [3, None, -7] and [r["part"] for r in row] == [1.5, 1000.0, 0.5]
    assert [str(r["day"]) for r in row] == ["2024-01-02 00:00:00", "2024-01-03 10:11:12", "None"]
    lost = {r["column"]: r["values_lost"] for r in types.type_changes(df).collect()}
    assert lost["day"] == 1


def test_date_layouts(spark):
    from tablewright.functions import parsing

    samples = {
        "2024-01-02": "2024-01-02 00:00:00", " 01/02/2024 ": "2024-01-02 00:00:00", "2024/12/31": "2024-12-31 00:00:00",
        "12-31-2024 23:59:58": "2024-12-31 23:59:58", "2024-03-31T02:30:00": "2024-03-31 02:30:00",
        "2024-02-30": None, "13/01/2024": None, "2024-01-02 10:11": None, "2024-01-02x": None, "2024-01-02 25:00:00": None,
        "20240102": None, "1": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in samples], "s string")
    rows = df.selectExpr("s", f"CAST({parsing.timestamp_from_any_layout('s')} AS STRING) AS t").collect()
    assert {r["s"]: r["t"] for r in rows} == samples


def test_dominant_date_layout_wins(spark):
    layouts = ["01/02/2024"] * 17 + ["2024-01-02"] * 3
    df = spark.createDataFrame([(v,) for v in layouts], "day string")
    out = types.optimize_dtypes(df)
    assert out.filter("day IS NOT NULL").count() == 17


def test_display(spark):
    df = spark.createDataFrame([(1, 1.5, "None"), (None, float("nan"), "x"), (3, None, "<NA>")], "a int, b double, c string")
    assert [tuple(r) for r in display_strings(df).collect()] == [("1", "1.5", ""), ("", "", "x"), ("3", "", "")]


SPEC = [
    {"operation": "handle_missing_numeric", "column": "x", "parameters": {"method": "mean"}},
    {"operation": "remove_duplicates", "parameters": {"keep": "first"}},
]


def test_steps_compose(gaps):
    direct = missing.handle_missing_numeric(gaps, "x", "mean").dropDuplicates()
    assert sorted(map(tuple, steps.apply_steps(gaps, SPEC).collect())) == sorted(map(tuple, direct.collect()))
    assert steps.apply_steps(gaps, []) is gaps


@pytest.mark.parametrize(
    "bad", ["text", {}, {"operation": "explode"}, {"operation": "cap_outliers"},
            {"operation": "cap_outliers", "column": "nope"}],
)
def test_bad_steps_name_their_position(gaps, bad):
    with pytest.raises(ValueError, match="1"):
        steps.apply_steps(gaps, [SPEC[0], bad])


def test_order_columns_follow_renaming(spark):
    df = spark.createDataFrame([(0, None), (1, 2.0), (2, None)], "`Row Id` int, `Some Value` double")
    out = steps.apply_steps(
        df,
        [
            {"operation": "standardize_column_names"},
            {"operation": "handle_missing_numeric", "column": "some_value", "parameters": {"method": "forward_fill"}},
        ],
        order_by=["Row Id"],
    )
    assert values(out, "some_value", "row_id") == [None, 2.0, 2.0]


def test_preview_and_audit(gaps):
    after, impact = steps.preview_step(gaps, SPEC[0])
    row = impact.first()
    assert (row["missing_before"], row["missing_after"], after.count()) == (1, 0, 4)
    _, audit = steps.apply_with_audit(gaps, SPEC)
    assert [(r["step"], r["operation"], r["rows_after"]) for r in audit.orderBy("step").collect()] == [
        (1, "handle_missing_numeric", 4), (2, "remove_duplicates", 4),
    ]


def test_report_text(gaps):
    cleaned = steps.apply_steps(gaps, SPEC)
    text_report = reports.cleaning_report_text(reports.cleaning_metrics(gaps, cleaned), SPEC)
    assert "| missing_cells | 1 | 0 | -1 |" in text_report and "handle_missing_numeric on `x`" in text_report
    fewer = reports.cleaning_metrics(gaps, cleaned.drop("x"))
    assert "duplicates" not in {r["metric"] for r in fewer.collect()}


def test_audit_records_failed_steps(spark):
    df = spark.sql("SELECT 1L AS id, 'x' AS word UNION ALL SELECT 2L, NULL")
    spec = [
        {"operation": "remove_outliers_iqr", "column": "word", "parameters": {}},
        {"operation": "handle_missing_categorical", "column": "word", "parameters": {"method": "new_category"}},
    ]
    cleaned, audit = steps.apply_with_audit(df, spec, on_error="record")
    rows = sorted((r["step"], r["status"], r["error"] is not None, r["missing_after"]) for r in audit.collect())
    assert rows == [(1, "failed", True, 1), (2, "success", False, 0)]
    assert cleaned.filter("word IS NULL").count() == 0
    with pytest.raises(ValueError):
        steps.apply_with_audit(df, spec)


def test_chained_fills_read_the_source_a_fixed_number_of_times(spark):
    df = spark.range(200).selectExpr("id", "IF(id % 3 = 0, NULL, id) AS a", "IF(id % 5 = 0, NULL, id) AS b")
    fills = [{"operation": "handle_missing_numeric", "column": c, "parameters": {"method": "forward_fill"}} for c in "abab"]
    scans = [
        steps.apply_steps(df, fills[:n], order_by=["id"])._jdf.queryExecution().optimizedPlan().toString().count("Relation")
        for n in (2, 4)
    ]
    assert scans[0] == scans[1]
