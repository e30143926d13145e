import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import ordering

N = 3000


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"id": np.arange(N) * 3 - 500, "x": rng.normal(size=N).round(3)})
    frame["group"] = np.where(frame.index < N // 3, 5, frame.index % 50)  # one value leads a third of the rows
    frame.loc[rng.random(N) < 0.3, "x"] = None
    frame.loc[:4, "x"] = None
    frame.loc[700:1900, "x"] = None
    frame.loc[N - 7 :, "x"] = None
    frame["word"] = frame["x"].map(lambda v: None if pd.isna(v) else f"w{v}")
    return frame


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data.sample(frac=1, random_state=2)).repartition(5)


@pytest.mark.parametrize("rows_per_range", [100, 10**6])
def test_fills_equal_pandas(data, df, rows_per_range):
    expected = {
        ordering.forward_fill: data["x"].ffill(),
        ordering.backward_fill: data["x"].bfill(),
        ordering.interpolate: data["x"].interpolate(),
    }
    for fill, series in expected.items():
        out = fill(df, "x", ["id"], rows_per_range).toPandas().sort_values("id")
        np.testing.assert_allclose(out["x"].to_numpy(), series.to_numpy(), rtol=1e-12, err_msg=fill.__name__)


def test_text_fill_keeps_type_and_columns(data, df):
    out = ordering.forward_fill(df, "word", ["id"], 100)
    assert out.schema == df.schema
    words = out.toPandas().sort_values("id")["word"].to_list()
    assert [w for w in words if w is not None] == data["word"].ffill().dropna().to_list()


def test_position_over_a_composite_key_with_a_hot_leading_value(data, df):
    order = ["group", "word", "id"]
    placed = ordering.with_position(df, order, "pos", 100)
    expected = df.selectExpr("*", "row_number() OVER (ORDER BY `group`, word, id) - 1 AS wanted")
    both = placed.join(expected.select("id", "wanted"), "id")
    assert both.filter("pos <> wanted").count() == 0
    sizes = ordering.with_ranges(df, order, 100).groupBy(ordering.RANGE).count()
    assert sizes.agg(F.max("count")).first()[0] < N // 6


def test_dates_strings_and_nulls_as_keys(spark):
    rows = spark.range(500).selectExpr(
        "IF(id = 17, NULL, date_add(DATE '2024-01-01', CAST(id AS INT))) AS day",
        "IF(id % 4 = 0, id, NULL) AS x", "concat('k', lpad(id, 4, '0')) AS name",
        "timestampadd(MINUTE, id, TIMESTAMP_NTZ '2024-01-01 00:00:00') AS ts",
        "timestampadd(MINUTE, id, TIMESTAMP '2024-03-31 00:00:00') AS zoned",
        "CAST(id AS DECIMAL(12, 3)) / 8 AS amount", "sqrt(id) AS root",
    )
    for key in ("day", "name", "ts", "zoned", "amount", "root"):
        out = ordering.with_position(rows, [key], "pos", 50)
        wanted = rows.selectExpr(key, f"row_number() OVER (ORDER BY {key}) - 1 AS pos")
        assert out.select(key, "pos").exceptAll(wanted.selectExpr(key, "CAST(pos AS BIGINT) AS pos")).isEmpty()
        filled = ordering.forward_fill(rows, "x", [key], 50)
        wanted = rows.selectExpr(key, f"last_value(x) IGNORE NULLS OVER (ORDER BY {key}) AS x")
        assert filled.select(key, "x").exceptAll(wanted).isEmpty()


def test_fewer_than_two_values_are_not_interpolated(spark):
    df = spark.createDataFrame([(0, None), (1, 2.0), (2, None)], "id int, x double")
    assert [r["x"] for r in ordering.interpolate(df, "x", ["id"]).orderBy("id").collect()] == [None, 2.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "id int, x double")
    found = [r["x"] for r in ordering.interpolate(df, "x", ["id"]).orderBy("id").collect()]
    assert found == [None, 1.0, 2.0, 3.0, 4.0, 4.0]


@pytest.mark.parametrize("rows_per_range", [150, 10**6])
def test_interpolation_stays_in_its_group(spark, rows_per_range):
    """One group holds half of the rows over many ranges; others have no, one or a few values; one key is null."""
    rng = np.random.default_rng(3)
    keys = np.where(rng.random(N) < 0.5, 5, rng.integers(0, 400, N)).astype(float)
    x = np.where(rng.random(N) < np.where(keys == 5, 0.01, 0.4), rng.random(N).round(3), np.nan)
    x[(keys == 7) | (keys == 8)] = np.nan
    x[np.flatnonzero(keys == 8)[:1]] = 4.0
    table = pd.DataFrame({"id": np.arange(N), "k": np.where(keys == 9, np.nan, keys), "x": x})
    df = spark.createDataFrame(table).selectExpr("id", "nanvl(k, NULL) AS k", "x")
    found = ordering.interpolate(df, "x", ["id"], rows_per_range, ["k"]).toPandas().sort_values("id")["x"].to_numpy(float)

    def plain(part: pd.Series) -> pd.Series:
        return part.interpolate() if part.notna().sum() > 1 else part

    wanted = table.groupby("k", dropna=False)["x"].transform(plain).to_numpy()
    np.testing.assert_allclose(found, wanted, rtol=1e-9)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, x double")
    for fill in (ordering.forward_fill, ordering.backward_fill, ordering.interpolate):
        assert fill(df, "x", ["id"]).count() == 0


@pytest.fixture(scope="module")
def hot(spark):
    """20,000 rows, of which three in four have one order key; long texts; some rows are equal."""
    return spark.range(20_000).selectExpr(
        "IF(id % 4 = 0, id, 7) AS k", "id DIV 2 AS n", "IF(xxhash64(id DIV 2) % 3 = 0, NULL, (id DIV 2) * 0.5D) AS x",
        "IF(xxhash64(id DIV 2) % 3 = 1, NULL, concat(repeat('long text ', 40), id DIV 2)) AS word", "map('a', 1) AS m",
    )


def test_a_hot_key_is_cut_and_its_order_is_fixed(spark, hot):
    sizes = ordering.with_ranges(hot, ["k"], 1000).groupBy(ordering.RANGE).count()
    assert sizes.agg(F.max("count")).first()[0] < 3000 and sizes.count() > 12
    results = {}
    for partitions in (2, 3, 11):
        dealt = hot.repartition(partitions, F.rand(partitions))
        for fill, name in ((ordering.forward_fill, "x"), (ordering.backward_fill, "word"), (ordering.interpolate, "x"), (ordering.forward_fill, "word")):
            for size in (1000, 10**6):
                out = fill(dealt, name, ["k"], size)
                digest = out.selectExpr(f"sum(CAST(xxhash64(k, n, {name}) AS DECIMAL(38, 0))) AS s", "count(1) AS n").first()
                results.setdefault((fill.__name__, name), set()).add(tuple(digest))
        placed = ordering.with_position(dealt, ["k"], "pos", 1000)
        assert placed.agg(F.count_distinct("pos"), F.max("pos")).first() == (20_000, 19_999)
        results.setdefault("position", set()).add(placed.selectExpr("sum(CAST(xxhash64(k, n, x) AS DECIMAL(38, 0)) * (pos + 1)) AS s").first()[0])
    assert all(len(found) == 1 for found in results.values()), results


def test_long_values_are_carried_without_a_broadcast(hot):
    text = ordering.forward_fill(hot, "word", ["k"], 1000)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in text
    # The rows are exchanged once, by range; the other exchanges have a row per range.
    rows = [x for x in text.split("\n") if "Exchange hashpartitioning(_order_range" in x]
    assert rows and "SinglePartition" in text
