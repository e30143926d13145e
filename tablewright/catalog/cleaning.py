"""Missing-value and outlier treatment, text, names and types."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablewright.catalog.base import EVENTS_N, EVENTS_N_COLUMNS, SMALL_RANGE, Tables, column_bytes, fences_sql, query, union
from tablewright.operators import footers, missing, ordering, outliers, types
from tablewright.operators.names import standardize_column_names
from tablewright.plans.steps import clean_text_column


def _with(name: str, value: str, source: str = EVENTS_N) -> str:
    """event_id and one treated column."""
    return f"SELECT event_id, {value} AS {name} FROM {source}"


def numeric(t: Tables, column: str, method: str, **options) -> DataFrame:
    rows = t.events_n.select("event_id", column)
    return missing.handle_missing_numeric(rows, column, method, order_by=["event_id"], **options)


def categorical(t: Tables, method: str, **options) -> DataFrame:
    rows = t.events_n.select("event_id", "type_n")
    return missing.handle_missing_categorical(rows, "type_n", method, order_by=["event_id"], **options)


def _mode(name: str) -> str:
    return (
        f"(SELECT {name} FROM {EVENTS_N} WHERE {name} IS NOT NULL GROUP BY {name} "
        f"ORDER BY count(*) DESC, {name} LIMIT 1)"
    )


def _carried(name: str, direction: str) -> str:
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"last_value({name} IGNORE NULLS) OVER (ORDER BY event_id {direction} {frame})"


@query("m1_fill_mean", _with("value_n", f"round(coalesce(value_n, (SELECT avg(value_n) FROM {EVENTS_N})), 6)"))
def fill_mean(t: Tables) -> DataFrame:
    return numeric(t, "value_n", "mean")


@query("m2_fill_median", _with("value_n", f"round(coalesce(value_n, (SELECT median(value_n) FROM {EVENTS_N})), 6)"))
def fill_median(t: Tables) -> DataFrame:
    return numeric(t, "value_n", "median")


@query("m3_fill_mode", _with("value_n", f"coalesce(value_n, {_mode('value_n')})"))
def fill_mode(t: Tables) -> DataFrame:
    return numeric(t, "value_n", "mode")


@query("m4_forward_fill", _with("value_run", _carried("value_run", "ASC")))
def forward_fill(t: Tables) -> DataFrame:
    return numeric(t, "value_run", "forward_fill", rows_per_range=SMALL_RANGE)


@query(
    "m4_forward_fill_by_user",
    f"""SELECT event_id, last_value(value_n IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value_n FROM {EVENTS_N}""",
)
def forward_fill_by_user(t: Tables) -> DataFrame:
    rows = t.events_n.select("event_id", "user_id", "value_n")
    filled = ordering.forward_fill(rows, "value_n", ["event_id"], SMALL_RANGE, ["user_id"])
    return filled.select("event_id", "value_n")


@query("m5_backward_fill", _with("value_run", _carried("value_run", "DESC")))
def backward_fill(t: Tables) -> DataFrame:
    return numeric(t, "value_run", "backward_fill", rows_per_range=SMALL_RANGE)


@query(
    "m6_interpolate",
    f"""WITH placed AS (SELECT event_id, value_run AS v, row_number() OVER (ORDER BY event_id) AS p FROM {EVENTS_N}),
    around AS (SELECT *,
      last_value(v IGNORE NULLS) OVER back AS v0,
      last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER back AS p0,
      first_value(v IGNORE NULLS) OVER ahead AS v1,
      first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER ahead AS p1
      FROM placed WINDOW back AS (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      ahead AS (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0
      ELSE v0 + (v1 - v0) * (p - p0) / (p1 - p0) END, 6) AS value_run FROM around""",
)
def interpolate(t: Tables) -> DataFrame:
    return numeric(t, "value_run", "interpolate", rows_per_range=SMALL_RANGE)


@query(
    "m6_interpolate_by_user",
    f"""WITH placed AS (SELECT event_id, user_id, value_run AS v,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM {EVENTS_N}),
    around AS (SELECT *, count(v) OVER (PARTITION BY user_id) AS known,
      last_value(v IGNORE NULLS) OVER back AS v0,
      last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER back AS p0,
      first_value(v IGNORE NULLS) OVER ahead AS v1,
      first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER ahead AS p1
      FROM placed WINDOW back AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      ahead AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL OR known < 2 THEN NULL WHEN v1 IS NULL THEN v0
      ELSE v0 + (v1 - v0) * (p - p0) / (p1 - p0) END, 6) AS value_run FROM around""",
)
def interpolate_by_user(t: Tables) -> DataFrame:
    rows = t.events_n.select("event_id", "user_id", "value_run")
    filled = ordering.interpolate(rows, "value_run", ["event_id"], SMALL_RANGE, ["user_id"])
    return filled.select("event_id", "value_run")


@query("m7_fill_constant", _with("value_n", "coalesce(value_n, -1.5)::DOUBLE"))
def fill_constant(t: Tables) -> DataFrame:
    return numeric(t, "value_n", "constant", custom_value=-1.5)


@query("m8_drop_missing", _with("value_n", "value_n") + " WHERE value_n IS NOT NULL")
def drop_missing(t: Tables) -> DataFrame:
    return numeric(t, "value_n", "drop")


@query("m10_fill_mode_category", _with("type_n", f"coalesce(type_n, {_mode('type_n')})"))
def fill_mode_category(t: Tables) -> DataFrame:
    return categorical(t, "mode")


@query("m11_fill_constant_category", _with("type_n", "coalesce(type_n, 'Unknown')"))
def fill_constant_category(t: Tables) -> DataFrame:
    return categorical(t, "constant")


@query("m12_forward_fill_category", _with("type_n", _carried("type_n", "ASC")))
def forward_fill_category(t: Tables) -> DataFrame:
    return categorical(t, "forward_fill", rows_per_range=SMALL_RANGE)


@query("m13_backward_fill_category", _with("type_n", _carried("type_n", "DESC")))
def backward_fill_category(t: Tables) -> DataFrame:
    return categorical(t, "backward_fill", rows_per_range=SMALL_RANGE)


@query("m14_new_category", _with("type_n", "coalesce(type_n, 'Missing')"))
def new_category(t: Tables) -> DataFrame:
    return categorical(t, "new_category")


@query("m15_drop_missing_category", _with("type_n", "type_n") + " WHERE type_n IS NOT NULL")
def drop_missing_category(t: Tables) -> DataFrame:
    return categorical(t, "drop")


@query(
    "m16_missing_change",
    f"""SELECT 'value_run' AS "column", count(*) - count(value_run) AS missing_before, count(*) - count(filled) AS
    missing_after, count(filled) - count(value_run) AS missing_fixed, count(*) AS rows_before, count(*) AS rows_after
    FROM (SELECT value_run, {_carried('value_run', 'ASC')} AS filled FROM {EVENTS_N})""",
)
def missing_change(t: Tables) -> DataFrame:
    before = t.events_n.select("event_id", "value_run")
    return missing.missing_change(before, numeric(t, "value_run", "forward_fill"), "value_run")


@query(
    "t1_remove_outliers",
    f"""SELECT event_id, user_id, value_n FROM {EVENTS_N} AS d, {fences_sql(EVENTS_N, 'value_n')} AS f
    WHERE value_n IS NULL OR value_n BETWEEN lo AND hi""",
)
def remove_outliers(t: Tables) -> DataFrame:
    return outliers.remove_outliers_iqr(t.events_n.select("event_id", "user_id", "value_n"), "value_n")


@query("t1_remove_outliers_zero_range", "SELECT doc_id, quality::BIGINT AS quality FROM labels")
def remove_outliers_zero_range(t: Tables) -> DataFrame:
    return outliers.remove_outliers_iqr(t.labels.select("doc_id", "quality"), "quality")


def _capped(source: str, key: str, name: str, low: float, high: float, kind: str) -> str:
    clipped = f"CASE WHEN {name} < lo THEN lo WHEN {name} > hi THEN hi ELSE {name} END"
    result = f"trunc({clipped})::BIGINT" if kind == "bigint" else f"round({clipped}, 6)"
    return f"""SELECT {key}, {result} AS {name} FROM {source} AS d,
        (SELECT quantile_cont({name}::DOUBLE, {low}) AS lo, quantile_cont({name}::DOUBLE, {high}) AS hi FROM {source})"""


@query("t2_cap_outliers", _capped(EVENTS_N, "event_id", "value_n", 0.01, 0.99, "double"))
def cap_outliers(t: Tables) -> DataFrame:
    return outliers.cap_outliers(t.events_n.select("event_id", "value_n"), "value_n")


@query("t2_cap_outliers_integer", _capped("documents", "doc_id", "n_chars", 0.03, 0.9, "bigint"))
def cap_outliers_integer(t: Tables) -> DataFrame:
    return outliers.cap_outliers(t.documents.select("doc_id", "n_chars"), "n_chars", 0.03, 0.9)


@query(
    "t3_capping_counts",
    """SELECT 'c_acctbal' AS "column", count(*) FILTER (c_acctbal < lo) AS n_low,
    count(*) FILTER (c_acctbal > hi) AS n_high FROM customer,
    (SELECT quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi FROM customer)""",
)
def capping_counts(t: Tables) -> DataFrame:
    return outliers.capping_statistics(t.customer, "c_acctbal").select("column", "n_low", "n_high")


DIRTY = "'  ' || upper(p_name) || ' - ' || p_brand || '  '"


def dirty(t: Tables, operations: list[str], text: str = DIRTY) -> DataFrame:
    rows = t.part.selectExpr("p_partkey", f"{text} AS label")
    return clean_text_column(rows, "label", operations)


def _label(sql: str) -> str:
    return f"SELECT p_partkey, {sql} AS label FROM (SELECT p_partkey, {DIRTY} AS v FROM part)"


@query("x0_text_operations", _label("trim(regexp_replace(regexp_replace(lower(v), '[^a-zA-Z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"))
def text_operations(t: Tables) -> DataFrame:
    return dirty(t, ["lowercase", "remove_special_chars", "remove_extra_spaces", "trim_whitespace"])


@query("x1_lowercase", _label("lower(v)"))
def lowercase(t: Tables) -> DataFrame:
    return dirty(t, ["lowercase"])


@query("x2_uppercase", _label("upper(v)"))
def uppercase(t: Tables) -> DataFrame:
    return dirty(t, ["uppercase"])


TITLE = "'o''neil it''s ' || p_name || 'x-y ' || p_brand"


@query(
    "x3_title_case",
    f"""SELECT p_partkey, list_aggregate(list_transform(regexp_extract_all(lower({TITLE}), '[a-z]+|[^a-z]+'),
    lambda w: upper(w[1]) || w[2:]), 'string_agg', '') AS label FROM part""",
)
def title_case(t: Tables) -> DataFrame:
    # Double quotes and doubled apostrophes mean different things in the two dialects.
    return dirty(t, ["title_case"], TITLE.replace("''", "\\'"))


@query("x4_trim_whitespace", _label("trim(v)"))
def trim_whitespace(t: Tables) -> DataFrame:
    return dirty(t, ["trim_whitespace"])


# DuckDB's \\s is ASCII only; these are the other characters that count as whitespace.
MORE_SPACE = r"\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@query(
    "x5_remove_special_chars",
    f"SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9\\s{MORE_SPACE}]', '', 'g') AS text FROM documents",
)
def remove_special_chars(t: Tables) -> DataFrame:
    return clean_text_column(t.documents.select("doc_id", "text"), "text", ["remove_special_chars"])


@query("x6_remove_extra_spaces", _label("regexp_replace(v, '\\s+', ' ', 'g')"))
def remove_extra_spaces(t: Tables) -> DataFrame:
    return dirty(t, ["remove_extra_spaces"])


@query("x7_standardize_quotes", """SELECT conv_id, turn, translate(text, '''`´', '""\"') AS text FROM conversations""")
def standardize_quotes(t: Tables) -> DataFrame:
    return clean_text_column(t.conversations.select("conv_id", "turn", "text"), "text", ["standardize_quotes"])


@query(
    "n1_standard_names",
    """SELECT p_partkey AS part_key, p_name AS part_name, p_brand AS col_1st_brand, p_type AS a_b_c_d,
    p_size::BIGINT AS part_key_1, p_retailprice AS unnamed_column_5 FROM part""",
)
def standard_names(t: Tables) -> DataFrame:
    messy = t.part.toDF("  Part Key!  ", "part-name", "1st brand", "A.B-C d", "Part.Key", "%%")
    return standardize_column_names(messy)


TYPE_TABLE = {
    "o_orderkey": ("o_orderkey", "o_orderkey"),
    "small": ("o_orderkey % 100", "o_orderkey % 100"),
    "o_totalprice": ("o_totalprice", "o_totalprice"),
    "huge": ("o_totalprice * 1.0E300D", "o_totalprice * 1.0E300"),
    "date_text": (
        "CASE WHEN o_orderkey % 10 = 0 THEN 'soon' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END",
        "CASE WHEN o_orderkey % 10 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END",
    ),
    "key_text": ("CAST(o_custkey AS STRING)", "CAST(o_custkey AS VARCHAR)"),
    "o_orderpriority": ("o_orderpriority", "o_orderpriority"),
}
TYPE_SQL = "(SELECT " + ", ".join(f"{sql} AS {n}" for n, (_, sql) in TYPE_TABLE.items()) + " FROM orders)"


def type_table(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*[f"{sql} AS {n}" for n, (sql, _) in TYPE_TABLE.items()])


def _narrowest(name: str) -> str:
    return (
        f"CASE WHEN min({name}) >= -128 AND max({name}) <= 127 THEN 'tinyint' "
        f"WHEN min({name}) >= -32768 AND max({name}) <= 32767 THEN 'smallint' "
        f"WHEN min({name}) >= -2147483648 AND max({name}) <= 2147483647 THEN 'int' ELSE 'bigint' END"
    )


def _changes(name: str, kind: str, to: str, lost: str = "0::BIGINT") -> str:
    return f"""SELECT '{name}' AS "column", '{kind}' AS from_type, {to} AS to_type, {lost} AS values_lost FROM {TYPE_SQL}"""


# A double keeps its type only if some value overflows a float.
FLOAT_OR_DOUBLE = "CASE WHEN max(abs({0})) > 3.4028235e38 THEN 'double' ELSE 'float' END"
DATE_SHARE = r"count(*) FILTER (regexp_matches(date_text, '^\d{4}-\d{2}-\d{2}')) > 0.8 * count(date_text)"
CHANGES = " UNION ALL ".join(
    [
        _changes("o_orderkey", "bigint", _narrowest("o_orderkey")),
        _changes("small", "bigint", _narrowest("small")),
        _changes("o_totalprice", "double", FLOAT_OR_DOUBLE.format("o_totalprice")),
        _changes("huge", "double", FLOAT_OR_DOUBLE.format("huge")),
        _changes("date_text", "string", f"CASE WHEN {DATE_SHARE} THEN 'timestamp_ntz' ELSE 'string' END",
                 "count(*) FILTER (try_strptime(date_text, '%Y-%m-%d') IS NULL)"),
        _changes("key_text", "string", "CASE WHEN count(try_cast(key_text AS BIGINT)) = count(key_text) THEN 'bigint' ELSE 'string' END"),
    ]
)


def _register_changes(key: str, columns: tuple[str, ...]) -> None:
    listed = ", ".join(f"'{c}'" for c in columns)

    @query(key, f"""SELECT * FROM ({CHANGES}) WHERE from_type <> to_type AND "column" IN ({listed})""")
    def changes(t: Tables) -> DataFrame:
        return types.type_changes(type_table(t).select(*columns))


_register_changes("c18_narrow_integers", ("o_orderkey", "small"))

@query(
    "c18_narrow_from_footers",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", 'bigint' AS from_type, to_type, 0::BIGINT AS values_lost
        FROM (SELECT {_narrowest(name)} AS to_type FROM {table}) WHERE to_type <> 'bigint'"""
        for name, table in {"o_orderkey": "orders", "o_custkey": "orders"}.items()
    ),
)
def narrow_from_footers(t: Tables) -> DataFrame:
    facts = footers.parquet_facts(t.spark, t.path("orders"), types.CHOICE_FACTS)
    found = types.type_changes(t.orders, types.choose_types(t.orders, facts))
    return found.filter("from_type = 'bigint'")


_register_changes("c19_narrow_floats", ("o_totalprice", "huge"))
_register_changes("c20_dates_from_text", ("date_text",))
_register_changes("c21_numbers_from_text", ("key_text", "o_orderpriority"))


@query(
    "c20_optimized_values",
    f"""SELECT o_orderkey, small, huge, try_strptime(date_text, '%Y-%m-%d') AS date_text,
    key_text::BIGINT AS key_text, o_orderpriority FROM {TYPE_SQL}""",
)
def optimized_values(t: Tables) -> DataFrame:
    return types.optimize_dtypes(type_table(t).drop("o_totalprice"))


@query(
    "c22_dictionary_advice",
    union(
        {"date_text": "", "key_text": "", "o_orderpriority": ""},
        lambda n, _: f"""SELECT '{n}' AS "column", count(DISTINCT {n}) AS unique_values,
        count(DISTINCT {n}) < 0.05 * count(*) OR count(DISTINCT {n}) < 50 AS dictionary_encode FROM {TYPE_SQL}""",
    ),
)
def dictionary_advice(t: Tables) -> DataFrame:
    return types.dictionary_advice(type_table(t))


@query(
    "c22_dictionary",
    "SELECT row_number() OVER (ORDER BY p_type) - 1 AS code, p_type AS value FROM (SELECT DISTINCT p_type FROM part)",
)
def dictionary(t: Tables) -> DataFrame:
    return types.dictionary(t.part, "p_type")


BEFORE_BYTES = "(" + " + ".join(column_bytes(n, k) for n, k in EVENTS_N_COLUMNS.items()) + ")"
# event_id and user_id fit 4 or 2 bytes depending on the scale; the three doubles become floats.
AFTER_BYTES = "(" + " + ".join(
    f"""(CASE WHEN max({n}) <= 127 THEN 1 WHEN max({n}) <= 32767 THEN 2 WHEN max({n}) <= 2147483647 THEN 4 ELSE 8 END
    * count(*))::BIGINT"""
    if k == "bigint" else "(4 * count(*))::BIGINT" if k == "double" else column_bytes(n, k)
    for n, k in EVENTS_N_COLUMNS.items()
) + ")"


@query(
    "c23_type_change_bytes",
    f"""SELECT b AS bytes_before, a AS bytes_after, b - a AS bytes_saved, round(100.0 * (b - a) / b, 2)::DOUBLE AS saved_pct
    FROM (SELECT {BEFORE_BYTES} AS b, {AFTER_BYTES} AS a FROM {EVENTS_N})""",
)
def type_change_bytes(t: Tables) -> DataFrame:
    return types.type_change_bytes(t.events_n)
