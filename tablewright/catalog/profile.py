"""Profile tables, quantiles, outliers and duplicates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from tablewright.catalog.base import (
    EVENTS_N, EVENTS_N_COLUMNS, LINEITEM_NUMBERS, SMALL_RANGE, Tables, byte_text, column_bytes,
    fences_sql, numbers, pct, query, union,
)
from tablewright.operators import cardinality, correlation, duplicates, footers, outliers, profile, stored_profile
from tablewright.operators import charts as chart_counts
from tablewright.sources.storage import stored

N_COLUMNS = len(EVENTS_N_COLUMNS)
EVENT_NUMBERS = numbers(EVENTS_N_COLUMNS)
TOTAL_BYTES = "(SELECT sum(b) FROM (" + union(
    EVENTS_N_COLUMNS, lambda n, k: f"SELECT {column_bytes(n, k)} AS b FROM {EVENTS_N}"
) + "))"
TOTAL_MISSING = " + ".join(f"count(*) - count({name})" for name in EVENTS_N_COLUMNS)
ANY_MISSING = " OR ".join(f"{name} IS NULL" for name in EVENTS_N_COLUMNS)


@query(
    "p1_basic_stats",
    f"""SELECT count(*) AS n_rows, {N_COLUMNS}::BIGINT AS n_cols, round({TOTAL_BYTES} / 1048576.0, 3) AS memory_mb,
    '{",".join(EVENTS_N_COLUMNS)}' AS column_names FROM {EVENTS_N}""",
)
def basic_stats(t: Tables) -> DataFrame:
    return profile.basic_stats(t.events_n).withColumn("column_names", F.array_join("column_names", ","))


MISSING_BY_COLUMN = union(
    EVENTS_N_COLUMNS,
    lambda n, k: f"""SELECT '{n}' AS "column", '{k}' AS dtype, count(*) - count({n}) AS null_count,
    {pct(f'count(*) - count({n})', 'count(*)', 2)} AS null_pct, count({n}) AS non_null_count FROM {EVENTS_N}""",
)


@query("p2_missing_by_column", MISSING_BY_COLUMN)
def missing_by_column(t: Tables) -> DataFrame:
    return profile.missing_by_column(t.events_n)


ORDERS_COLUMNS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}


@query(
    "p2_missing_from_footers",
    union(
        ORDERS_COLUMNS,
        lambda n, k: f"""SELECT '{n}' AS "column", '{k}' AS dtype, count(*) - count({n}) AS null_count,
        {pct(f'count(*) - count({n})', 'count(*)', 2)} AS null_pct, count({n}) AS non_null_count FROM orders""",
    ),
)
def missing_from_footers(t: Tables) -> DataFrame:
    return profile.missing_by_column(t.orders, footers.parquet_facts(t.spark, t.path("orders"), ("missing",)))


@query(
    "p14_ranges_from_footers",
    union(
        LINEITEM_NUMBERS,
        lambda n: f"""SELECT '{n}' AS "column", count(*) - count({n}) AS nulls, min({n})::DOUBLE AS "min",
        max({n})::DOUBLE AS "max" FROM lineitem""",
    ),
)
def ranges_from_footers(t: Tables) -> DataFrame:
    facts = footers.parquet_facts(t.spark, t.path("lineitem"), ("missing", "min", "max"))
    numbers_only = profile.column_ranges(t.lineitem, facts).filter("`max` IS NOT NULL")
    return numbers_only.select("column", "nulls", "min", "max")


@query(
    "p3_missing_totals",
    f"""SELECT {N_COLUMNS} * count(*) AS total_cells, {TOTAL_MISSING} AS total_missing,
    {pct(TOTAL_MISSING, f'{N_COLUMNS} * count(*)', 4)} AS missing_pct,
    count(*) FILTER ({ANY_MISSING}) AS rows_with_any_null,
    {pct(f'count(*) FILTER ({ANY_MISSING})', 'count(*)', 4)} AS rows_with_any_null_pct FROM {EVENTS_N}""",
)
def missing_totals(t: Tables) -> DataFrame:
    return profile.missing_totals(t.events_n)


@query(
    "p4_rows_with_missing",
    f"""SELECT count(*) FILTER ({ANY_MISSING}) AS rows_with_any_null,
    {pct(f'count(*) FILTER ({ANY_MISSING})', 'count(*)', 4)} AS rows_with_any_null_pct FROM {EVENTS_N}""",
)
def rows_with_missing(t: Tables) -> DataFrame:
    return profile.rows_with_missing(t.events_n)


@query(
    "p5_columns_with_missing",
    f'SELECT "column", null_count, null_pct FROM ({MISSING_BY_COLUMN}) WHERE null_count > 0',
)
def columns_with_missing(t: Tables) -> DataFrame:
    return profile.columns_with_missing(t.events_n)


MATRIX_BINS = 100


@query(
    "p6_missing_matrix",
    "WITH placed AS (SELECT *, (((row_number() OVER (ORDER BY event_id) - 1) * "
    f"{MATRIX_BINS}) // count(*) OVER ())::BIGINT AS bin FROM {EVENTS_N}) "
    + union(
        EVENTS_N_COLUMNS,
        lambda n, k: f"""SELECT bin, '{n}' AS "column", count(*) - count({n}) AS n_missing, count(*) AS n_rows
        FROM placed GROUP BY bin""",
    ),
)
def missing_matrix(t: Tables) -> DataFrame:
    return chart_counts.missing_matrix(t.events_n, ["event_id"], MATRIX_BINS, SMALL_RANGE)


CARDINALITY = union(
    EVENTS_N_COLUMNS,
    lambda n, k: f"""SELECT '{n}' AS "column", count(DISTINCT {n}) AS unique_values,
    round(count(DISTINCT {n}) / count(*), 4) AS unique_ratio, count(*) AS total FROM {EVENTS_N}""",
)


@query("p7_cardinality", f'SELECT "column", unique_values, unique_ratio FROM ({CARDINALITY})')
def cardinality_table(t: Tables) -> DataFrame:
    return cardinality.cardinality(t.events_n)


@query(
    "p8a_chart_bands",
    f"""SELECT "column", unique_values, CASE WHEN unique_values < 10 THEN 'low' WHEN unique_values < 50 THEN 'medium'
    ELSE 'high' END AS band FROM ({CARDINALITY})""",
)
def chart_bands(t: Tables) -> DataFrame:
    return cardinality.chart_bands(cardinality.distinct_counts(t.events_n))


@query(
    "p8b_table_bands",
    f"""SELECT "column", unique_values, round(100.0 * unique_values / total, 6)::DOUBLE AS cardinality_pct,
    CASE WHEN unique_values <= 10 THEN 'Low (≤10)' WHEN unique_values <= 50 THEN 'Medium (11-50)'
    ELSE 'High (>50)' END AS category FROM ({CARDINALITY})""",
)
def table_bands(t: Tables) -> DataFrame:
    return cardinality.table_bands(cardinality.distinct_counts(t.events_n))


# Text columns of different kinds made from `orders`, in both dialects.
TYPED_TEXTS = {
    "o_orderkey": ("o_orderkey", "o_orderkey"),
    "price_text": ("CAST(o_totalprice AS STRING)", "CAST(o_totalprice AS VARCHAR)"),
    "date_text": ("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
    "us_date_text": ("date_format(o_orderdate, 'MM/dd/yyyy')", "strftime(o_orderdate, '%m/%d/%Y')"),
    "o_orderpriority": ("o_orderpriority", "o_orderpriority"),
    "empty_text": ("CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)"),
    "o_orderdate": ("o_orderdate", "o_orderdate"),
    "is_open": ("o_orderstatus = 'O'", "o_orderstatus = 'O'"),
}
TYPED_KINDS = {"o_orderkey": "bigint", "o_orderdate": "timestamp_ntz", "is_open": "boolean"}
TYPED_SQL = "(SELECT " + ", ".join(f"{sql} AS {n}" for n, (_, sql) in TYPED_TEXTS.items()) + " FROM orders)"
IS_NUMBER = r"regexp_full_match({0}, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*')"
IS_DATE = "coalesce(try_strptime({0}, '%Y-%m-%d'), try_strptime({0}, '%m/%d/%Y')) IS NOT NULL"


def typed_texts(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*[f"{sql} AS {n}" for n, (sql, _) in TYPED_TEXTS.items()])


def _inferred(name: str) -> str:
    kind = TYPED_KINDS.get(name, "string")
    if kind != "string":
        return (
            f"""SELECT '{name}' AS "column", '{kind}' AS dtype, '{kind}' AS inferred, """
            f"{str(kind == 'timestamp_ntz').lower()} AS is_datetime, {str(kind == 'bigint').lower()} AS is_numeric"
        )
    all_numbers = f"count(*) FILTER ({IS_NUMBER.format(name)}) = count({name})"
    all_dates = f"count(*) FILTER ({IS_DATE.format(name)}) = count({name})"
    return f"""SELECT '{name}' AS "column", 'string' AS dtype, CASE WHEN {all_numbers} THEN 'numeric_possible'
        WHEN {all_dates} THEN 'datetime_possible' ELSE 'object' END AS inferred, {all_dates} AS is_datetime,
        false AS is_numeric FROM {TYPED_SQL}"""


INFERRED = " UNION ALL ".join(_inferred(name) for name in TYPED_TEXTS)


@query("p9_data_types", INFERRED)
def data_types(t: Tables) -> DataFrame:
    return profile.data_types(typed_texts(t))


@query("p10_datetime_columns_by_value", f'SELECT "column", is_datetime FROM ({INFERRED})')
def datetime_by_value(t: Tables) -> DataFrame:
    return profile.datetime_columns_by_value(typed_texts(t))


@query(
    "p11_skewness_kurtosis",
    union(
        LINEITEM_NUMBERS,
        lambda n: f"""SELECT '{n}' AS "column",
        round(CASE WHEN min({n}) = max({n}) THEN 0 ELSE skewness({n}) END, 6) AS skewness,
        round(CASE WHEN min({n}) = max({n}) THEN 0 ELSE kurtosis({n}) END, 6) AS kurtosis FROM lineitem""",
    ),
)
def skewness_kurtosis(t: Tables) -> DataFrame:
    return profile.skewness_kurtosis(t.lineitem)


def _pair(source: str, a: str, b: str, digits: int) -> str:
    spread = "stddev_pop(x) * stddev_pop(y)"
    return f"""SELECT '{a}' AS col_a, '{b}' AS col_b,
        round(covar_pop(x, y) / nullif({spread}, 0), {digits}) AS r
        FROM (SELECT {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query(
    "p12_correlation_matrix",
    " UNION ALL ".join(_pair("lineitem", a, b, 4) for a in LINEITEM_NUMBERS for b in LINEITEM_NUMBERS),
)
def correlation_matrix(t: Tables) -> DataFrame:
    return correlation.correlation_matrix(t.lineitem)


@query(
    "p12_correlation_wide",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS "column", """
        + ", ".join(f"(SELECT r FROM ({_pair(EVENTS_N, a, b, 4)})) AS {b}" for b in EVENT_NUMBERS)
        for a in EVENT_NUMBERS
    ),
)
def correlation_wide(t: Tables) -> DataFrame:
    return correlation.correlation_wide(t.events_n)


@query(
    "p13_strong_pairs",
    "SELECT col_a, col_b, round(r, 3) AS r, CASE WHEN r > 0 THEN 'Strong Positive' ELSE 'Strong Negative' END "
    "AS strength FROM ("
    + " UNION ALL ".join(_pair("(SELECT *, -2.0 * value + user_id AS mirrored FROM events)", a, b, 9)
                         for a, b in combinations(["event_id", "user_id", "value", "mirrored"], 2))
    + ") WHERE abs(r) > 0.7",
)
def strong_pairs(t: Tables) -> DataFrame:
    return correlation.strong_pairs(t.events.withColumn("mirrored", F.expr("-2.0D * value + user_id")))


def _iso(value: str) -> str:
    return (
        f"CASE WHEN microsecond({value}) % 1000000 = 0 THEN strftime({value}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({value}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


def _statistics(n: str, kind: str) -> str:
    is_number = kind in ("bigint", "double")
    low, high, mean, std = (
        (f"min({n})::DOUBLE", f"max({n})::DOUBLE", f"round(avg({n}), 6)", f"round(stddev_pop({n}), 6)")
        if is_number else ("NULL::DOUBLE",) * 4
    )
    first, last = (_iso(f"min({n})"), _iso(f"max({n})")) if kind == "timestamp_ntz" else ("NULL::VARCHAR",) * 2
    return f"""SELECT '{n}' AS "column", '{kind}' AS dtype, count(*) - count({n}) AS nulls,
        {pct(f'count(*) - count({n})', 'count(*)', 4)} AS null_pct, count(DISTINCT {n}) AS "unique",
        {low} AS "min", {high} AS "max", {first} AS min_iso, {last} AS max_iso, {mean} AS mean, {std} AS std
        FROM {EVENTS_N}"""


@query("p14_column_statistics", union(EVENTS_N_COLUMNS, _statistics))
def column_statistics(t: Tables) -> DataFrame:
    return profile.column_statistics(t.events_n)


@query(
    "p15_example_values",
    union(
        {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "props": "string", "type_n": "string"},
        lambda n, k: f"""SELECT '{n}' AS "column", string_agg(v, ', ' ORDER BY event_id) AS example_values FROM
        (SELECT event_id, CAST({n} AS VARCHAR) AS v FROM {EVENTS_N} WHERE {n} IS NOT NULL ORDER BY event_id LIMIT 3)""",
    ),
)
def example_values(t: Tables) -> DataFrame:
    return profile.example_values(
        t.events_n.select("event_id", "user_id", "event_type", "props", "type_n"), ["event_id"]
    )


MEMORY = union(
    EVENTS_N_COLUMNS,
    lambda n, k: f"""SELECT '{n}' AS "column", '{k}' AS dtype, {column_bytes(n, k)} AS est_bytes FROM {EVENTS_N}""",
)


@query(
    "p16_memory_by_column",
    f"""SELECT "column", dtype, est_bytes, {byte_text('est_bytes')} AS formatted,
    round(100.0 * est_bytes / sum(est_bytes) OVER (), 2)::DOUBLE AS pct FROM ({MEMORY})""",
)
def memory_by_column(t: Tables) -> DataFrame:
    return profile.memory_by_column(t.events_n)


@query(
    "p16_memory_by_type",
    f"""SELECT dtype, est_bytes, {byte_text('est_bytes')} AS formatted,
    round(100.0 * est_bytes / sum(est_bytes) OVER (), 2)::DOUBLE AS pct, columns_count FROM
    (SELECT dtype, sum(est_bytes)::BIGINT AS est_bytes, count(*) AS columns_count FROM ({MEMORY}) GROUP BY dtype)""",
)
def memory_by_type(t: Tables) -> DataFrame:
    return profile.memory_by_type(t.events_n)


@query(
    "p16_memory_total",
    f"""SELECT est_bytes, {byte_text('est_bytes')} AS formatted
    FROM (SELECT sum(est_bytes)::BIGINT AS est_bytes FROM ({MEMORY}))""",
)
def memory_total(t: Tables) -> DataFrame:
    return profile.memory_total(t.events_n)


def _saving(n: str, kind: str) -> str:
    share = "0.0"
    if kind == "bigint":
        share = f"""CASE WHEN min({n}) >= -128 AND max({n}) <= 127 THEN 0.875
            WHEN min({n}) >= -32768 AND max({n}) <= 32767 THEN 0.75 ELSE 0.0 END"""
    elif kind == "string":
        share = f"CASE WHEN count(DISTINCT {n}) < 0.05 * count(*) THEN 0.5 ELSE 0.0 END"
    size = column_bytes(n, kind)
    return f"""SELECT '{n}' AS "column", {size} AS est_bytes, round({size} * {share}, 1)::DOUBLE AS saving_bytes
        FROM {EVENTS_N}"""


SAVINGS = union(EVENTS_N_COLUMNS, _saving)


@query("p17_memory_saving", SAVINGS)
def memory_saving(t: Tables) -> DataFrame:
    return profile.memory_saving(t.events_n)


@query(
    "p17_memory_saving_total",
    f"""SELECT sum(est_bytes)::BIGINT AS est_bytes, floor(sum(saving_bytes))::BIGINT AS saving_bytes,
    round(100.0 * floor(sum(saving_bytes)) / sum(est_bytes), 2)::DOUBLE AS saving_pct FROM ({SAVINGS})""",
)
def memory_saving_total(t: Tables) -> DataFrame:
    return profile.memory_saving_total(t.events_n)


@query(
    "p18_standard_deviations",
    union(LINEITEM_NUMBERS, lambda n: f"""SELECT '{n}' AS "column", round(stddev_samp({n}), 6) AS std FROM lineitem"""),
)
def standard_deviations(t: Tables) -> DataFrame:
    return profile.standard_deviations(t.lineitem)


def _class(name: str) -> str:
    kind = TYPED_KINDS.get(name, "string")
    if kind != "string":
        return f"""SELECT '{name}' AS "column", {str(kind == 'bigint').lower()} AS "numeric",
            {str(kind == 'boolean').lower()} AS categorical, {str(kind == 'timestamp_ntz').lower()} AS "datetime" """
    layouts = r"regexp_matches({0}, '^\d{{4}}-\d{{2}}-\d{{2}}|^\d{{2}}/\d{{2}}/\d{{4}}|^\d{{2}}-\d{{2}}-\d{{4}}')".format(name)
    return f"""SELECT '{name}' AS "column", is_n AS "numeric", NOT is_n AND NOT is_d AS categorical, is_d AS "datetime"
        FROM (SELECT count({name}) > 0 AND count(*) FILTER ({IS_NUMBER.format(name)}) = count({name}) AS is_n,
        count({name}) > 0 AND (count(*) FILTER ({IS_DATE.format(name)}) = count({name})
        OR count(*) FILTER ({layouts}) > 0.8 * count({name})) AS is_d FROM {TYPED_SQL})"""


CLASSES = " UNION ALL ".join(_class(name) for name in TYPED_TEXTS)


def _register_class(key: str, kind: str) -> None:
    @query(key, f'SELECT "column" FROM ({CLASSES}) WHERE "{kind}"')
    def columns_of_kind(t: Tables) -> DataFrame:
        return profile.column_classes(typed_texts(t)).filter(f"`{kind}`").select("column")


_register_class("p19_numeric_columns", "numeric")
_register_class("p20_categorical_columns", "categorical")
_register_class("p21_datetime_columns", "datetime")


def _describe(source: str, name: str, shares: list[float]) -> str:
    rows = [("count", f"count({name})::DOUBLE"), ("mean", f"avg({name})"), ("std", f"stddev_samp({name})"),
            ("min", f"min({name})::DOUBLE")]
    rows += [(f"{p * 100:g}%", f"quantile_cont({name}::DOUBLE, {p})") for p in shares]
    rows.append(("max", f"max({name})::DOUBLE"))
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", '{label}' AS statistic, round({sql}, 6) AS value FROM {source}"""
        for label, sql in rows
    )


@query(
    "p22_describe_columns",
    " UNION ALL ".join(_describe("lineitem", n, [0.25, 0.5, 0.75]) for n in ("l_quantity", "l_extendedprice")),
)
def describe_columns(t: Tables) -> DataFrame:
    return profile.describe_columns(t.lineitem, ["l_quantity", "l_extendedprice"])


SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@query("p23_percentiles", _describe(EVENTS_N, "value_n", SHARES))
def percentiles(t: Tables) -> DataFrame:
    return profile.describe_columns(t.events_n, ["value_n"], SHARES)


@query(
    "p24_value_counts",
    "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, value LIMIT 10",
)
def value_counts(t: Tables) -> DataFrame:
    return profile.value_counts(t.part, "p_brand", 10)


@query(
    "p26_column_overview",
    union(
        EVENTS_N_COLUMNS,
        lambda n, k: f"""SELECT '{n}' AS "column", '{k}' AS dtype, count({n}) AS non_null_count,
        {byte_text(column_bytes(n, k))} AS memory FROM {EVENTS_N}""",
    ),
)
def column_overview(t: Tables) -> DataFrame:
    return profile.column_overview(t.events_n)


@query(
    "p27_quick_metrics",
    f"""SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM {EVENTS_N}
    UNION ALL SELECT 'columns', {N_COLUMNS}::DOUBLE
    UNION ALL SELECT 'est_bytes', {TOTAL_BYTES}::DOUBLE
    UNION ALL SELECT 'missing_pct', {pct(TOTAL_MISSING, f'{N_COLUMNS} * count(*)', 4)} FROM {EVENTS_N}
    UNION ALL SELECT 'duplicates', (SELECT count(*) FROM {EVENTS_N})::DOUBLE
    - (SELECT count(*) FROM (SELECT DISTINCT * FROM {EVENTS_N}))""",
)
def quick_metrics(t: Tables) -> DataFrame:
    return profile.quick_metrics(t.events_n)


def _iqr(source: str, name: str) -> str:
    return f"""SELECT '{name}' AS "column", count(*) FILTER ({name} < lo OR {name} > hi) AS outliers_iqr,
        {pct(f'count(*) FILTER ({name} < lo OR {name} > hi)', f'count({name})', 4)} AS outliers_iqr_pct
        FROM {source} AS d, {fences_sql(source, name)} AS f"""


@query("q1_outliers_iqr", " UNION ALL ".join(_iqr(EVENTS_N, n) for n in EVENT_NUMBERS))
def outliers_iqr(t: Tables) -> DataFrame:
    return outliers.detect_outliers_iqr(t.events_n)


@query("q1_outliers_iqr_zero_range", " UNION ALL ".join(_iqr("labels", n) for n in ("doc_id", "quality", "toxic")))
def outliers_iqr_labels(t: Tables) -> DataFrame:
    return outliers.detect_outliers_iqr(t.labels)


@query(
    "q2_outlier_values",
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{n}' AS "column", event_id, {n}::DOUBLE AS value
        FROM {EVENTS_N} AS d, {fences_sql(EVENTS_N, n)} AS f WHERE {n} < lo OR {n} > hi ORDER BY event_id LIMIT 100)"""
        for n in EVENT_NUMBERS
    ),
)
def outlier_values(t: Tables) -> DataFrame:
    found = outliers.outlier_values(t.events_n, ["event_id"])
    return found.select("column", F.col("at.k0").alias("event_id"), "value")


@query(
    "q3_outliers_zscore",
    union(
        LINEITEM_NUMBERS,
        lambda n: f"""SELECT '{n}' AS "column", count(*) FILTER (abs(({n} - m) / s) >= 3.0) AS outliers_z,
        {pct(f'count(*) FILTER (abs(({n} - m) / s) >= 3.0)', f'count({n})', 4)} AS outliers_z_pct
        FROM lineitem, (SELECT avg({n}) AS m, nullif(stddev_pop({n}), 0) AS s FROM lineitem)""",
    ),
)
def outliers_zscore(t: Tables) -> DataFrame:
    return outliers.detect_outliers_zscore(t.lineitem)


@query(
    "q3_outliers_zscore_events",
    union(
        EVENT_NUMBERS,
        lambda n: f"""SELECT '{n}' AS "column", count(*) FILTER (abs(({n} - m) / s) >= 2.5) AS outliers_z,
        {pct(f'count(*) FILTER (abs(({n} - m) / s) >= 2.5)', f'count({n})', 4)} AS outliers_z_pct
        FROM {EVENTS_N}, (SELECT avg({n}) AS m, nullif(stddev_pop({n}), 0) AS s FROM {EVENTS_N})""",
    ),
)
def outliers_zscore_events(t: Tables) -> DataFrame:
    return outliers.detect_outliers_zscore(t.events_n, threshold=2.5)


@query(
    "q4_outlier_bounds",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", count(*) FILTER ({n} < lo OR {n} > hi) AS outlier_count,
        {pct(f'count(*) FILTER ({n} < lo OR {n} > hi)', 'count(*)', 2)} AS outlier_pct,
        round(any_value(lo), 2) AS lower_bound, round(any_value(hi), 2) AS upper_bound
        FROM {EVENTS_N} AS d, {fences_sql(EVENTS_N, n)} AS f"""
        for n in EVENT_NUMBERS
    ),
)
def outlier_bounds(t: Tables) -> DataFrame:
    return outliers.outlier_bounds(t.events_n)


@query(
    "q5_removal_statistics",
    f"""SELECT 'value' AS "column", round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3,
    round(any_value(q3 - q1), 6) AS iqr, count(*) FILTER (value < lo OR value > hi) AS outliers,
    {pct('count(*) FILTER (value < lo OR value > hi)', 'count(*)', 6)} AS outlier_pct
    FROM events, {fences_sql('events', 'value', 2.0)} AS f""",
)
def removal_statistics(t: Tables) -> DataFrame:
    return outliers.removal_statistics(t.events, "value", 2.0)


@query(
    "q5_capping_statistics",
    f"""SELECT 'l_extendedprice' AS "column", round(any_value(lo), 6) AS lower_cap, round(any_value(hi), 6) AS upper_cap,
    count(*) FILTER (l_extendedprice < lo) AS n_low, count(*) FILTER (l_extendedprice > hi) AS n_high,
    {pct('count(*) FILTER (l_extendedprice < lo OR l_extendedprice > hi)', 'count(*)', 6)} AS capped_pct
    FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi
    FROM lineitem)""",
)
def capping_statistics(t: Tables) -> DataFrame:
    return outliers.capping_statistics(t.lineitem, "l_extendedprice", 0.05, 0.95)


@query(
    "q6_verify_outliers",
    f"""SELECT 'n_chars' AS "column", count(n_chars) AS filled, round(any_value(q1), 6) AS q1,
    round(any_value(q3), 6) AS q3, round(any_value(q3 - q1), 6) AS iqr, round(any_value(lo), 6) AS lower_fence,
    round(any_value(hi), 6) AS upper_fence, count(*) FILTER (n_chars < lo OR n_chars > hi) AS manual_n,
    count(*) FILTER (n_chars < lo OR n_chars > hi) AS algo_n, true AS counts_match, true AS pct_match,
    any_value(4.0 < lo OR 4.0 > hi) AS value_is_outlier,
    count(*) FILTER ((n_chars < lo OR n_chars > hi) AND n_chars = 4) > 0 AS value_found
    FROM documents, {fences_sql('documents', 'n_chars')} AS f""",
)
def verify_outliers(t: Tables) -> DataFrame:
    return outliers.verify_outlier_detection(t.documents, "n_chars", 4.0)


@query(
    "q7_box_statistics",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", min({n})::DOUBLE AS "min", round(any_value(q1), 6) AS q1,
        round(quantile_cont({n}::DOUBLE, 0.5), 6) AS median, round(any_value(q3), 6) AS q3, max({n})::DOUBLE AS "max",
        min({n}) FILTER ({n} BETWEEN lo AND hi)::DOUBLE AS whisker_low,
        max({n}) FILTER ({n} BETWEEN lo AND hi)::DOUBLE AS whisker_high,
        count(*) FILTER ({n} < lo OR {n} > hi) AS outliers
        FROM {EVENTS_N} AS d, {fences_sql(EVENTS_N, n)} AS f"""
        for n in EVENT_NUMBERS
    ),
)
def box_statistics(t: Tables) -> DataFrame:
    return outliers.box_statistics(t.events_n)


def _duplicate_counts(source: str, keys: str) -> str:
    return f"""SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_duplicate_rows,
        coalesce(sum(n - 1), 0)::BIGINT AS n_surplus_rows, count(*) FILTER (n > 1) AS n_groups
        FROM (SELECT count(*) AS n FROM {source} GROUP BY {keys})"""


@query("d1_duplicate_counts", _duplicate_counts("events", "user_id, event_type"))
def duplicate_counts(t: Tables) -> DataFrame:
    return duplicates.duplicate_counts(t.events, ["user_id", "event_type"])


LINEITEM_KEY = ", ".join(
    LINEITEM_NUMBERS + ["l_returnflag", "l_linestatus", "l_shipdate"]
)


@query("d1_duplicate_counts_whole_rows", _duplicate_counts("lineitem", LINEITEM_KEY))
def duplicate_counts_rows(t: Tables) -> DataFrame:
    return duplicates.duplicate_counts(t.lineitem)


@query("d1_duplicate_counts_long_text", _duplicate_counts("documents", "text, lang"))
def duplicate_counts_text(t: Tables) -> DataFrame:
    return duplicates.duplicate_counts(t.documents, ["text", "lang"])


@query(
    "d2_duplicate_rows",
    """SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM
    (SELECT *, count(*) OVER (PARTITION BY quality, toxic) AS n FROM labels) WHERE n > 1""",
)
def duplicate_rows(t: Tables) -> DataFrame:
    return duplicates.duplicate_rows(t.labels, ["quality", "toxic"])


@query(
    "d2_duplicate_rows_long_text",
    """SELECT doc_id, text, n_chars FROM
    (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1""",
)
def duplicate_texts(t: Tables) -> DataFrame:
    return duplicates.duplicate_rows(t.documents, ["text"]).select("doc_id", "text", "n_chars")


@query(
    "d3_duplicate_sample",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey FROM
    (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5""",
)
def duplicate_sample(t: Tables) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return duplicates.duplicate_sample(t.lineitem, ["l_orderkey", "l_linenumber"], order).select(*order)


def _kept(where: str, order: str) -> str:
    return f"""SELECT event_id, user_id, event_type, value FROM (SELECT *,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {order}) AS place,
        count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE {where}"""


@query("d4_keep_first", _kept("place = 1", "ASC"))
def keep_first(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "event_type", "value")
    return duplicates.remove_duplicates(rows, ["user_id", "event_type"], "first", ["event_id"])


@query("d4_keep_first_whole_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber::BIGINT AS l_linenumber FROM lineitem")
def keep_first_whole(t: Tables) -> DataFrame:
    return duplicates.remove_duplicates(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"))


@query("d5_keep_last", _kept("place = 1", "DESC"))
def keep_last(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "event_type", "value")
    return duplicates.remove_duplicates(rows, ["user_id", "event_type"], "last", ["event_id"])


@query(
    "d6_keep_none",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_extendedprice FROM
    (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1""",
)
def keep_none(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return duplicates.remove_duplicates(rows, ["l_orderkey", "l_linenumber"], False)


@query(
    "p7_merged_profile",
    union(EVENTS_N_COLUMNS, lambda n, k: f"""SELECT "column", dtype, rows, missing, missing_pct, "min", "max", mean, std, true AS distinct_close
        FROM (SELECT "column", dtype, nulls + count AS rows, nulls AS missing, null_pct AS missing_pct, "min", "max", mean, std FROM
        ({_statistics(n, k)}) AS s, (SELECT count({n}) AS count FROM {EVENTS_N}))"""),
)
def merged_profile(t: Tables) -> DataFrame:
    """States of three parts, two of them merged before, give the profile of the whole; distinct counts are estimated within 5 %."""
    parts = [stored(stored_profile.profile_state(t.events_n.filter(f"event_id % 3 = {k}")), "state") for k in range(3)]
    early = stored(stored_profile.merged_states(*parts[:2]), "state")
    found = stored_profile.profile_of(stored_profile.merged_states(early, parts[2]))
    exact = cardinality.distinct_counts(t.events_n).select("column", "unique_values")
    close = "abs(distinct_estimate - unique_values) <= 0.05D * unique_values AS distinct_close"
    return found.join(exact, "column").selectExpr("column", "dtype", "rows", "missing", "missing_pct", "min", "max", "mean", "std", close)
