import numpy as np
import pandas as pd
import pytest

from tablewright.operators import quantiles
from tablewright.operators.quantiles import exact_quantiles

RNG = np.random.default_rng(5)
N = 30_000
COLUMNS = {
    "normal": RNG.normal(size=N),
    "heavy_tail": RNG.pareto(0.5, size=N) * np.where(RNG.random(N) < 0.5, -1, 1),
    "two_values": np.where(np.arange(N) < N // 2, 0.0, 1.0),
    "one_third_equal": np.where(RNG.random(N) < 0.34, 7.0, RNG.random(N) * 14),
    "constant": np.full(N, 3.5),
    "ends_heavy": np.where(np.arange(N) < 0.4 * N, -1.0, np.where(np.arange(N) < 0.8 * N, 1.0, RNG.random(N) - 0.5)),
}
SHARES = [0.0, 0.01, 0.25, 0.4, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def table(spark):
    data = pd.DataFrame(COLUMNS)
    data.loc[::13, "normal"] = None
    data["nothing"] = pd.Series([None] * N, dtype="float64")
    data["whole"] = RNG.integers(-50, 50, size=N)
    return data, spark.createDataFrame(data.sample(frac=1, random_state=1)).repartition(7)


@pytest.mark.parametrize("interval_limit", [1_000_000, 500, 3])
def test_equal_to_pandas_however_small_the_intervals(table, interval_limit):
    data, df = table
    names = list(data.columns)
    found = exact_quantiles(df, {n: SHARES for n in names}, interval_limit)
    for name in names:
        expected = data[name].astype("float64").quantile(SHARES)
        for share in SHARES:
            value = found.value(name, share)
            if name == "nothing":
                assert value is None
            else:
                assert value == pytest.approx(expected[share], rel=1e-12, abs=1e-12), (name, share)
    assert found.counts["normal"] == data["normal"].notna().sum()


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    assert exact_quantiles(df, {"x": [0.25, 0.5]}).values == {("x", 0.25): 1.5, ("x", 0.5): 2.0}


def test_text_is_rejected(spark):
    with pytest.raises(ValueError):
        exact_quantiles(spark.createDataFrame([("a",)], "x string"), {"x": [0.5]})


def test_passes_have_few_columns(spark, monkeypatch):
    df = spark.range(1000).selectExpr(*[f"CAST(id * {k + 1} AS DOUBLE) AS c{k}" for k in range(5)])
    whole = exact_quantiles(df, {f"c{k}": [0.3] for k in range(5)})
    monkeypatch.setattr(quantiles, "COLUMNS_PER_PASS", 2)
    assert exact_quantiles(df, {f"c{k}": [0.3] for k in range(5)}) == whole


def test_rounds_and_rows_are_bounded(spark, monkeypatch):
    """Seven rounds at most without an early finish, and no more digits than stated: what a task can send per column."""
    rng = np.random.default_rng(11)
    n = 6000
    data = pd.DataFrame({
        "all_exponents": np.ldexp(rng.uniform(1, 2, n), rng.integers(-1074, 1024, n)) * rng.choice([-1, 1], n),
        "one_exponent": 1 + rng.integers(0, 2**20, n) * 2.0**-52,
        "neighbours": np.frombuffer((np.float64(1e300).view(np.int64) + rng.integers(0, 3, n)).tobytes()),
        "tiny": rng.integers(0, 5, n) * 5e-324,
        "ends": np.where(rng.random(n) < 0.3, -np.inf, np.where(rng.random(n) < 0.5, np.inf, rng.normal(size=n))),
    })
    rounds = []
    counted = quantiles._counted

    def noted(narrow, cases):
        found = counted(narrow, cases)
        rounds.append(max((len(counts) for counts, _, _ in found), default=0))
        return found

    monkeypatch.setattr(quantiles, "_counted", noted)
    shares = [0.1, 0.37, 0.5, 0.9]
    df = spark.createDataFrame(data).repartition(4)
    found = exact_quantiles(df, {name: shares for name in data}, interval_limit=0)
    assert len(rounds) <= 7 and max(rounds) <= quantiles.MOST_DIGITS
    for name in data:
        ordered = np.sort(data[name].to_numpy())
        for share in shares:
            position = (n - 1) * share
            low, high = ordered[int(np.floor(position))], ordered[int(np.ceil(position))]
            value = found.value(name, share)
            assert value == low if low == high else low <= value <= high


def test_counts_combine_before_the_shuffle(spark, monkeypatch):
    plans = []
    to_arrow = type(spark.range(1)).toArrow

    def noted(self):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return to_arrow(self)

    monkeypatch.setattr(type(spark.range(1)), "toArrow", noted)
    exact_quantiles(spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS x", "id * 2.0D AS y"), {"x": [0.5], "y": [0.1]}, interval_limit=10)
    assert plans and all("partial_count" in p and "hashpartitioning(number" in p and "SinglePartition" not in p for p in plans)
