"""Tables whose columns are called like names that operators use themselves."""

import math

import pytest

from tablewright.operators import charts, correlation, duplicates, missing, ordering, profile

NAMES = ["n", "rows", "value", "column", "_hash", "_k0", "_at", "_local", "_carry", "_offset", "_order_range", "_value0"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [[k if c % 2 else (None if k % 4 == 1 else float(k % 7)) for c in range(len(NAMES))] + [k] for k in range(60)]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if c % 2 else 'double'}" for c, n in enumerate(NAMES)) + ", id long")


@pytest.mark.parametrize("name", NAMES[::2])
@pytest.mark.parametrize("fill", [ordering.forward_fill, ordering.backward_fill, ordering.interpolate, missing.fill_mean, missing.fill_median, missing.fill_mode])
def test_fills_leave_other_columns(table, name, fill):
    ordered = fill in (ordering.forward_fill, ordering.backward_fill, ordering.interpolate)
    out = fill(table, name, ["id"], rows_per_range=20) if ordered else fill(table, name)
    assert out.columns == table.columns
    for before, after in zip(sorted(table.collect(), key=lambda r: r["id"]), sorted(out.collect(), key=lambda r: r["id"])):
        assert [before[c] for c in table.columns if c != name] == [after[c] for c in table.columns if c != name]


def test_positions_and_duplicates(table):
    placed = ordering.with_position(table, ["id"], rows_per_range=20)
    assert placed.columns == [*table.columns, "_row_pos"]
    assert all(r["_row_pos"] == r["id"] for r in placed.collect())
    keys = ["n", "value", "_hash"]
    assert duplicates.repeated_groups(table.drop("id"), ["n"]).columns == ["n", "n_"]
    assert duplicates.duplicate_counts(table.select("n"), ["n"]).first()["n_duplicate_rows"] == 60
    assert duplicates.duplicate_rows(table.select(*keys), ["n"]).columns == keys
    assert duplicates.remove_duplicates(table, ["n"], "first", ["id"]).count() == 8
    doubled = table.withColumn("_hash", table["n"].cast("string")).union(table.withColumn("_hash", table["n"].cast("string")))
    assert duplicates.duplicate_counts(doubled).first()["n_surplus_rows"] == 60


def test_profiles(table):
    assert profile.column_ranges(table).count() == len(NAMES) + 1


def test_extreme_scales(spark):
    tiny = spark.createDataFrame([(0.0, 1.0), (1e-170, 2.0), (2e-170, 3.5)], "a double, b double")
    huge = spark.createDataFrame([(1e160, 1.0), (2e160, 2.0), (3e160, 3.5)], "a double, b double")
    endless = spark.createDataFrame([(math.inf, 1.0), (2.0, 2.0), (3.0, 3.5)], "a double, b double")
    for df in (tiny, huge):
        assert correlation.pair_correlations(df).first()["r"] == pytest.approx(0.9934, abs=1e-3)
        assert {r["r"] for r in correlation.correlation_matrix(df).filter("col_a = col_b").collect()} == {1.0}
    assert correlation.pair_correlations(endless).first()["r"] is None
    assert correlation.strong_pairs(endless).count() == 0


def test_histogram_of_infinite_values(spark):
    df = spark.createDataFrame([(float(k),) for k in range(20)] + [(math.inf,), (-math.inf,), (None,), (math.nan,)], "x double")
    bins = {r["bin"]: r for r in charts.histogram(df, "x", 10).collect()}
    assert sum(r["n"] for r in bins.values()) == 22 and bins[10]["bin_low"] == math.inf and bins[-1]["bin_high"] == -math.inf
    assert sum(r["density"] * (r["bin_high"] - r["bin_low"]) for r in charts.density(df, "x", 10).collect()) == pytest.approx(1)


@pytest.mark.parametrize("kind, value", [("decimal(10,2)", 1.239), ("tinyint", 300), ("int", 1.5), ("bigint", 2**63)])
def test_constants_that_do_not_fit(spark, kind, value):
    with pytest.raises(ValueError):
        missing.fill_constant(spark.sql(f"SELECT CAST(NULL AS {kind}) AS x"), "x", value)
