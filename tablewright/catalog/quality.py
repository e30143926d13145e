"""Cleaning steps, audits, reports, score, recommendations and flags."""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import DataFrame

from tablewright.catalog.base import (
    EVENTS_N, EVENTS_N_COLUMNS, Tables, column_bytes, fences_sql, numbers, pct, query, union,
)
from tablewright.catalog.profile import SAVINGS, TOTAL_MISSING, _duplicate_counts, _iqr, _pair, _statistics
from tablewright.operators.correlation import pair_correlations, strong_pairs
from tablewright.operators.duplicates import duplicate_counts
from tablewright.operators.tables import local_table
from tablewright.plans import reports, runs, score, steps
from tablewright.sources.storage import new_path

EVENT_NUMBERS = numbers(EVENTS_N_COLUMNS)
N_COLUMNS = len(EVENTS_N_COLUMNS)

# The published limits of the advice.
PUBLISHED = {"missing_listed": score.MISSING_LISTED, "numeric_checked": score.NUMERIC_CHECKED}

STEPS = [
    {"operation": "handle_missing_numeric", "column": "value_n", "parameters": {"method": "median"}},
    {"operation": "handle_missing_categorical", "column": "type_n", "parameters": {"method": "forward_fill"}},
    {"operation": "remove_outliers_iqr", "column": "value", "parameters": {"multiplier": 2.0}},
    {"operation": "clean_text_column", "column": "event_type", "parameters": {"operations": ["uppercase"]}},
    {"operation": "remove_duplicates", "parameters": {"subset": ["user_id", "event_type"], "keep": "last"}},
]

# The table after each step, as SQL.
AFTER_1 = f"(SELECT * REPLACE (coalesce(value_n, (SELECT median(value_n) FROM {EVENTS_N})) AS value_n) FROM {EVENTS_N})"
AFTER_2 = f"""(SELECT * REPLACE (last_value(type_n IGNORE NULLS) OVER (ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS type_n) FROM {AFTER_1})"""
AFTER_3 = f"""(SELECT d.* FROM {AFTER_2} AS d, {fences_sql('events', 'value', 2.0)} AS f
    WHERE value BETWEEN lo AND hi)"""
AFTER_4 = f"(SELECT * REPLACE (upper(event_type) AS event_type) FROM {AFTER_3})"
AFTER_5 = f"""(SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
    ORDER BY event_id DESC) AS place FROM {AFTER_4}) WHERE place = 1)"""
BOUNDARIES = [EVENTS_N, AFTER_1, AFTER_2, AFTER_3, AFTER_4, AFTER_5]


def cleaned(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.events_n, steps.apply_steps(t.events_n, STEPS, ["event_id"], read_again=True)


@query(
    "l1_cleaning_steps",
    f"SELECT * REPLACE (round(value_n, 6) AS value_n) FROM {AFTER_5}",
)
def cleaning_steps(t: Tables) -> DataFrame:
    return cleaned(t)[1]


@query(
    "l1_renamed_steps",
    """SELECT o_orderkey AS order_key, o_custkey AS customer, coalesce(priority, 'Missing') AS priority FROM
    (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE upper(o_orderpriority) END AS priority FROM orders)""",
)
def renamed_steps(t: Tables) -> DataFrame:
    """Later steps name columns as earlier steps left them."""
    messy = t.orders.selectExpr(
        "o_orderkey AS ` Order Key`", "o_custkey AS `CUSTOMER!`",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS `Priority`",
    )
    return steps.apply_steps(
        messy,
        [
            {"operation": "standardize_column_names"},
            {"operation": "clean_text_column", "column": "priority", "parameters": {"operations": ["uppercase"]}},
            {"operation": "handle_missing_categorical", "column": "priority", "parameters": {"method": "new_category"}},
        ],
    )


@query(
    "l3_preview_step",
    f"""SELECT event_id, round(coalesce(value_n, (SELECT avg(value_n) FROM {EVENTS_N})), 6) AS value_n
    FROM {EVENTS_N}""",
)
def preview_step(t: Tables) -> DataFrame:
    step = {"operation": "handle_missing_numeric", "column": "value_n", "parameters": {"method": "mean"}}
    after, _ = steps.preview_step(t.events_n.select("event_id", "value_n"), step)
    return after


@query(
    "l3_preview_impact",
    f"""SELECT 1::BIGINT AS step, 'cap_outliers' AS operation, 'value_n' AS "column", '{{}}' AS parameters,
    count(*) AS rows_before, count(*) AS rows_after, count(*) - count(value_n) AS missing_before,
    count(*) - count(value_n) AS missing_after, 'success' AS status FROM {EVENTS_N}""",
)
def preview_impact(t: Tables) -> DataFrame:
    rows = t.events_n.select("event_id", "value_n")
    return steps.preview_step(rows, {"operation": "cap_outliers", "column": "value_n"})[1]


COMPARED = (
    f"""SELECT '{{metric}}' AS metric, round(b, 6)::DOUBLE AS "before", round(a, 6)::DOUBLE AS "after",
    round(a - b, 2)::DOUBLE AS delta FROM (SELECT {{value}} AS b FROM {EVENTS_N}), (SELECT {{value}} AS a FROM {AFTER_5})"""
)


def _compared(name: str, detail: tuple[str, str]) -> str:
    rows = [("count", f"count({name})"), ("missing", f"count(*) - count({name})"), detail]
    return " UNION ALL ".join(COMPARED.format(metric=m, value=v) for m, v in rows)


@query("l4_compare_number", _compared("value", ("mean", "round(avg(value), 2)")))
def compare_number(t: Tables) -> DataFrame:
    return reports.compare_column(*cleaned(t), "value")


@query("l4_compare_category", _compared("type_n", ("unique", "count(DISTINCT type_n)")))
def compare_category(t: Tables) -> DataFrame:
    return reports.compare_column(*cleaned(t), "type_n")


@query(
    "l4_compare_distribution",
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{side}' AS side, type_n AS value, count(*) AS n FROM {source}
        WHERE type_n IS NOT NULL GROUP BY type_n ORDER BY n DESC, value LIMIT 10)"""
        for side, source in (("before", EVENTS_N), ("after", AFTER_5))
    ),
)
def compare_distribution(t: Tables) -> DataFrame:
    return reports.compare_distribution(*cleaned(t), "type_n")


EVENT_BYTES = "(" + " + ".join(column_bytes(n, k) for n, k in EVENTS_N_COLUMNS.items()) + ")"


def _metric(name: str, value: str) -> str:
    return f"""SELECT '{name}' AS metric, b::BIGINT AS "before", a::BIGINT AS "after", (a - b)::BIGINT AS change
        FROM (SELECT {value} AS b FROM {EVENTS_N}), (SELECT {value} AS a FROM {AFTER_5})"""


@query(
    "l6_cleaning_metrics",
    " UNION ALL ".join(
        [
            _metric("rows", "count(*)"),
            _metric("columns", f"0 * count(*) + {N_COLUMNS}"),
            _metric("est_bytes", EVENT_BYTES),
            _metric("missing_cells", TOTAL_MISSING),
            _metric("duplicates", f"count(*) - count(DISTINCT ({', '.join(EVENTS_N_COLUMNS)}))"),
        ]
    ),
)
def cleaning_metrics(t: Tables) -> DataFrame:
    return reports.cleaning_metrics(*cleaned(t))


@query(
    "l7_analysis_report",
    f"""SELECT section, n::BIGINT AS n FROM (VALUES ('basic_stats', 1), ('missing_totals', 1), ('duplicates', 1), ('usability', 1),
    ('missing_by_column', {N_COLUMNS}), ('data_types', {N_COLUMNS}), ('cardinality', {N_COLUMNS}),
    ('column_statistics', {N_COLUMNS}), ('outliers_iqr', {len(EVENT_NUMBERS)}), ('outliers_zscore', {len(EVENT_NUMBERS)}),
    ('skewness_kurtosis', {len(EVENT_NUMBERS)}), ('standard_deviation', {len(EVENT_NUMBERS)}),
    ('correlation_matrix', {len(EVENT_NUMBERS) ** 2})) AS sections(section, n)""",
)
def analysis_report(t: Tables) -> DataFrame:
    return reports.report_overview(reports.analysis_report(t.events_n, ["event_id"]))


def _score(source: str, columns: list[str], number_columns: list[str]) -> str:
    missing = " + ".join(f"count(*) - count({c})" for c in columns)
    keys = ", ".join(columns)
    outlier_pct = " UNION ALL ".join(_iqr(source, n) for n in number_columns)
    return f"""WITH parts AS (SELECT
        (SELECT {pct(missing, f'{len(columns)} * count(*)', 4)} FROM {source}) AS missing_pct,
        (SELECT round(100.0 * coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 4)::DOUBLE
          FROM (SELECT count(*) AS n FROM {source} GROUP BY {keys})) AS duplicate_pct,
        (SELECT avg(outliers_iqr_pct) FROM ({outlier_pct})) AS avg_outlier_pct),
      scored AS (SELECT *, greatest(round_even(100.0::DOUBLE - least(missing_pct * 1.2, 40) - least(duplicate_pct * 0.6, 30)
        - least(avg_outlier_pct * 0.4, 20), 0), 0)::BIGINT AS score FROM parts)
      SELECT score, missing_pct, duplicate_pct, round(avg_outlier_pct, 6) AS avg_outlier_pct,
        CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D'
          ELSE 'F' END AS grade,
        CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 80 THEN 'Good' WHEN score >= 70 THEN 'Fair'
          WHEN score >= 60 THEN 'Poor' ELSE 'Failing' END AS description,
        CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS band FROM scored"""


REPORT_SQL = {
    "basic_stats": (None, ("n_rows", "n_cols"), f"SELECT count(*) AS n_rows, {N_COLUMNS} AS n_cols FROM {EVENTS_N}"),
    "missing_by_column": ("column", ("null_count", "null_pct", "non_null_count"), union(EVENTS_N_COLUMNS, lambda n, _: f"""SELECT '{n}' AS "column",
        count(*) - count({n}) AS null_count, {pct(f'count(*) - count({n})', 'count(*)', 2)} AS null_pct, count({n}) AS non_null_count FROM {EVENTS_N}""")),
    "cardinality": ("column", ("unique_values", "unique_ratio"), union(EVENTS_N_COLUMNS, lambda n, _: f"""SELECT '{n}' AS "column",
        count(DISTINCT {n}) AS unique_values, round(count(DISTINCT {n}) / count(*), 4) AS unique_ratio FROM {EVENTS_N}""")),
    "outliers_iqr": ("column", ("outliers_iqr", "outliers_iqr_pct"), union(EVENT_NUMBERS, lambda n: _iqr(EVENTS_N, n))),
    "outliers_zscore": ("column", ("outliers_z",), union(EVENT_NUMBERS, lambda n: f"""SELECT '{n}' AS "column",
        count(*) FILTER (abs(({n} - m) / s) >= 3.0) AS outliers_z FROM {EVENTS_N},
        (SELECT avg({n}) AS m, nullif(stddev_pop({n}), 0) AS s FROM {EVENTS_N})""")),
    "skewness_kurtosis": ("column", ("skewness", "kurtosis"), union(EVENT_NUMBERS, lambda n: f"""SELECT '{n}' AS "column",
        skewness({n}) AS skewness, kurtosis({n}) AS kurtosis FROM {EVENTS_N}""")),
    "duplicates": (None, ("n_duplicate_rows", "n_surplus_rows", "n_groups"), _duplicate_counts(EVENTS_N, ", ".join(EVENTS_N_COLUMNS))),
    "correlation_matrix": ("col_a || '~' || col_b", ("r",), " UNION ALL ".join(_pair(EVENTS_N, a, b, 4) for a in EVENT_NUMBERS for b in EVENT_NUMBERS)),
    "column_statistics": ("column", ("nulls", "null_pct", "unique", "min", "max", "mean", "std"), union(EVENTS_N_COLUMNS, _statistics)),
    "usability": (None, ("score", "missing_pct", "duplicate_pct", "avg_outlier_pct"), f"SELECT * FROM ({_score(EVENTS_N, list(EVENTS_N_COLUMNS), EVENT_NUMBERS)})"),
    "standard_deviation": ("column", ("std",), union(EVENT_NUMBERS, lambda n: f"""SELECT '{n}' AS "column", stddev_samp({n}) AS std FROM {EVENTS_N}""")),
}


@query(
    "l7_report_contents",
    " UNION ALL ".join(
        f"""SELECT '{section}' AS section, {"''" if item is None else item if "'" in item else '"' + item + '"'} AS item, '{measure}' AS measure,
        round("{measure}"::DOUBLE, 3) + 0.0 AS value FROM ({sql})"""
        for section, (item, measures, sql) in REPORT_SQL.items() for measure in measures
    ),
)
def report_contents(t: Tables) -> DataFrame:
    """Every number of eleven sections of the report."""
    values = reports.report_values(reports.analysis_report(t.events_n, ["event_id"]))
    wanted = [f"(section = '{s}' AND measure IN ({', '.join(repr(m) for m in measures)}))" for s, (_, measures, _) in REPORT_SQL.items()]
    return values.filter(" OR ".join(wanted)).selectExpr("section", "item", "measure", "round(value, 3) AS value")


@query(
    "l9_step_audit",
    " UNION ALL ".join(
        f"""SELECT {i}::BIGINT AS step, '{step['operation']}' AS operation,
        {"NULL::VARCHAR" if 'column' not in step else "'" + step['column'] + "'"} AS "column",
        '{json.dumps(step["parameters"], sort_keys=True)}' AS parameters,
        b.n AS rows_before, a.n AS rows_after, b.m AS missing_before, a.m AS missing_after, 'success' AS status
        FROM (SELECT count(*) AS n, {TOTAL_MISSING} AS m FROM {BOUNDARIES[i - 1]}) AS b,
        (SELECT count(*) AS n, {TOTAL_MISSING} AS m FROM {BOUNDARIES[i]}) AS a"""
        for i, step in enumerate(STEPS, start=1)
    ),
)
def step_audit(t: Tables) -> DataFrame:
    return steps.apply_with_audit(t.events_n, STEPS, ["event_id"])[1]


def _measured(part: str, item: str, measure: str, value: str, source: str) -> str:
    return f"SELECT '{part}' AS part, '{item}' AS item, '{measure}' AS measure, ({value})::DOUBLE AS value FROM {source}"


@query(
    "s9_run_manifest",
    " UNION ALL ".join(
        [
            _measured("manifest", item, measure, value, source)
            for item, source in [("input", EVENTS_N), ("cleaned", AFTER_5), *((f"step {i}", b) for i, b in enumerate(BOUNDARIES[1:], 1))]
            for measure, value in (("rows", "count(*)"), ("missing", TOTAL_MISSING))
        ]
        + [
            _measured("audit", f"step {i}", f"{measure}_{side}", value, BOUNDARIES[i - (side == "before")])
            for i in range(1, len(BOUNDARIES)) for side in ("before", "after") for measure, value in (("rows", "count(*)"), ("missing", TOTAL_MISSING))
        ]
        + [_measured("cleaned", name, "sum", f"round(sum({name}), 3)", AFTER_5) for name in EVENT_NUMBERS]
        + [_measured("cleaned", name, "distinct", f"count(DISTINCT {name})", AFTER_5) for name in ("event_type", "type_n")]
    ),
)
def run_manifest(t: Tables) -> DataFrame:
    """Manifest, audit and cleaned table of a run folder, read back from it."""
    run = runs.clean_to(new_path(t.spark, "run"), t.events_n, STEPS, ["event_id"], profile=False)
    assert runs.verify_run(run)
    noted = {"input": run.manifest["input"], "cleaned": run.manifest["cleaned"]} | {f"step {i}": x for i, x in enumerate(run.manifest["steps"], 1)}
    rows = [("manifest", item, measure, float(counters[measure])) for item, counters in noted.items() for measure in ("rows", "missing")]
    cells = ", ".join(
        f"struct('{measure}_{side}' AS measure, CAST({measure}_{side} AS DOUBLE) AS value)" for side in ("before", "after") for measure in ("rows", "missing")
    )
    audit = run.audit.selectExpr("'audit'", "concat('step ', step)", f"inline(array({cells}))")
    sums = [f"struct('{n}' AS item, 'sum' AS measure, CAST(round(sum({n}), 3) AS DOUBLE) AS value)" for n in EVENT_NUMBERS]
    sums += [f"struct('{n}' AS item, 'distinct' AS measure, CAST(count(DISTINCT {n}) AS DOUBLE) AS value)" for n in ("event_type", "type_n")]
    cleaned = run.cleaned.selectExpr(f"array({', '.join(sums)}) AS cells").selectExpr("'cleaned'", "inline(cells)")
    return local_table(t.spark, rows, "part string, item string, measure string, value double").unionAll(audit).unionAll(cleaned)


FAILING = [
    {"operation": "remove_outliers_iqr", "column": "event_type", "parameters": {}},
    {"operation": "handle_missing_categorical", "column": "type_n", "parameters": {"method": "new_category"}},
]


@query(
    "l9_failed_step",
    f"""SELECT 1::BIGINT AS step, 'remove_outliers_iqr' AS operation, 'failed' AS status, count(*) AS rows_after,
    {TOTAL_MISSING} AS missing_after, true AS explained FROM {EVENTS_N}
    UNION ALL SELECT 2, 'handle_missing_categorical', 'success', count(*), {TOTAL_MISSING}, false
    FROM (SELECT * REPLACE (coalesce(type_n, 'Missing') AS type_n) FROM {EVENTS_N})""",
)
def failed_step(t: Tables) -> DataFrame:
    """Numbers are asked of a text column: the step fails, is recorded, and the next one goes on."""
    audit = steps.apply_with_audit(t.events_n, FAILING, ["event_id"], on_error="record")[1]
    return audit.selectExpr("step", "operation", "status", "rows_after", "missing_after", "error IS NOT NULL AS explained")


EVENTS_SCORE = _score(EVENTS_N, list(EVENTS_N_COLUMNS), EVENT_NUMBERS)
LABELS = "(SELECT quality, toxic, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality END AS checked FROM labels)"
LABELS_SCORE = _score(LABELS, ["quality", "toxic", "checked"], ["quality", "toxic", "checked"])


def labels(t: Tables) -> DataFrame:
    return t.labels.selectExpr("quality", "toxic", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality END AS checked")


@query("u1_usability_score", f"SELECT score, missing_pct, duplicate_pct, avg_outlier_pct FROM ({EVENTS_SCORE})")
def usability(t: Tables) -> DataFrame:
    return score.usability_score(t.events_n).select("score", "missing_pct", "duplicate_pct", "avg_outlier_pct")


@query("u2_score_grade", f"SELECT score, grade, description FROM ({LABELS_SCORE})")
def score_grade(t: Tables) -> DataFrame:
    return score.usability_score(labels(t)).select("score", "grade", "description")


@query("u3_score_band", f"SELECT score, band FROM ({LABELS_SCORE})")
def score_band(t: Tables) -> DataFrame:
    return score.usability_score(labels(t)).select("score", "band")


def _missing_rule(name: str, place: int, source: str) -> str:
    share = f"100.0 * (count(*) - count({name})) / count(*)"
    return f"""SELECT {place} AS place, CASE WHEN {share} > 50 THEN 'high_missing_drop_column'
        WHEN {share} > 20 THEN 'moderate_missing_impute' ELSE 'low_missing_safe_to_impute' END AS rule,
        '{name}' AS "column", round({share}, 4)::DOUBLE AS value FROM {source} HAVING count(*) > count({name})"""


def _outlier_rule(name: str, place: int, source: str) -> str:
    return f"""SELECT {place} AS place, 'cap_or_remove_outliers' AS rule, '{name}' AS "column",
        {pct(f'count(*) FILTER ({name} < lo OR {name} > hi)', 'count(*)', 2)} AS value
        FROM {source} AS d, {fences_sql(source, name)} AS f
        HAVING count(*) FILTER ({name} < lo OR {name} > hi) > 0.05 * count(*)"""


def _with_message(sql: str) -> str:
    """The advice of `sql` in words."""
    share = "CAST(round(value, 1) AS VARCHAR)"
    missing = """ "column" || ': ' || """ + share + """ || ' % of the values are missing, """
    return f"""SELECT *, CASE rule WHEN 'high_missing_drop_column' THEN {missing}drop the column'
        WHEN 'moderate_missing_impute' THEN {missing}fill them in' WHEN 'low_missing_safe_to_impute' THEN {missing}any fill is safe'
        WHEN 'remove_duplicates' THEN CAST(CAST(value AS BIGINT) AS VARCHAR) || ' rows repeat earlier ones, remove them'
        WHEN 'optimize_types' THEN 'narrower types save ' || {share} || ' % of the memory'
        WHEN 'cap_or_remove_outliers' THEN "column" || ': ' || {share} || ' % of the rows lie outside the fences, cap or remove them'
        END AS message FROM ({sql})"""


@query(
    "u4_recommendations",
    _with_message("SELECT row_number() OVER (ORDER BY place) AS rank, rule, \"column\", value FROM ("
    + " UNION ALL ".join(
        ["SELECT * FROM (" + " UNION ALL ".join(
            _missing_rule(n, i, EVENTS_N) for i, n in enumerate(EVENTS_N_COLUMNS)
        ) + " ORDER BY place LIMIT 3)"]
        + [f"""SELECT 100000, 'remove_duplicates', NULL, s::DOUBLE FROM
            (SELECT sum(n - 1) AS s FROM (SELECT count(*) AS n FROM {EVENTS_N} GROUP BY {", ".join(EVENTS_N_COLUMNS)})) WHERE s > 0"""]
        + [f"""SELECT 200000, 'optimize_types', NULL, p FROM (SELECT
            round(100.0 * floor(sum(saving_bytes)) / sum(est_bytes), 2)::DOUBLE AS p FROM ({SAVINGS})) WHERE p > 10"""]
        + [_outlier_rule(n, 300000 + i, EVENTS_N) for i, n in enumerate(EVENT_NUMBERS[:2])]
    )
    + ")"),
)
def recommendations(t: Tables) -> DataFrame:
    return score.recommendations(t.events_n, **PUBLISHED)


@query(
    "u4_recommendations_labels",
    _with_message("SELECT row_number() OVER (ORDER BY place) AS rank, rule, \"column\", value FROM ("
    + " UNION ALL ".join(
        [_missing_rule("checked", 2, LABELS)]
        + [f"""SELECT 100000, 'remove_duplicates', NULL, s::DOUBLE FROM
            (SELECT sum(n - 1) AS s FROM
            (SELECT count(*) AS n FROM {LABELS} GROUP BY quality, toxic, checked)) WHERE s > 0"""]
        + [_outlier_rule(n, 300000 + i, LABELS) for i, n in enumerate(["quality", "toxic"])]
    )
    + ")"),
)
def recommendations_labels(t: Tables) -> DataFrame:
    return score.recommendations(labels(t), **PUBLISHED)


def _flag(subject: str, flag: str, value: str, test: str, threshold: float, source: str) -> str:
    return f"""SELECT {subject} AS "column", '{flag}' AS flag, round(v, 4)::DOUBLE AS value, {threshold}::DOUBLE AS threshold
        FROM (SELECT {value} AS v FROM {source}) WHERE v {test} {threshold}"""


def _column_flags(name: str) -> str:
    ratio = f"count(DISTINCT {name})::DOUBLE / count(*)"
    rules = [
        ("high_missing", f"(count(*) - count({name}))::DOUBLE / count(*)", ">", 0.5),
        ("high_cardinality", ratio, ">", 0.9), ("low_cardinality", ratio, "<", 0.05), ("id_like", ratio, ">=", 0.95),
        ("few_values", f"count(DISTINCT {name})", "<=", 10.0),
    ]
    if name in EVENT_NUMBERS:
        rules += [("skewed", f"abs(skewness({name}))", ">", 1.0), ("heavy_tails", f"abs(kurtosis({name}))", ">", 3.0)]
    return " UNION ALL ".join(_flag(f"'{name}'", f, v, test, limit, EVENTS_N) for f, v, test, limit in rules)


def _pair_flags(a: str, b: str) -> str:
    strength = f"abs(corr({a}, {b}))"
    return " UNION ALL ".join(
        _flag(f"'{a}~{b}'", flag, strength, ">", limit, EVENTS_N)
        for flag, limit in (("correlated", 0.5), ("closely_correlated", 0.8))
    )


@query(
    "u5_threshold_flags",
    " UNION ALL ".join(
        [_column_flags(n) for n in EVENTS_N_COLUMNS]
        + [_pair_flags(a, b) for a, b in combinations(EVENT_NUMBERS, 2)]
        + [_flag("NULL", "duplicates", f"(count(*) - count(DISTINCT ({', '.join(EVENTS_N_COLUMNS)})))::DOUBLE / count(*)", ">", 0.01, EVENTS_N)]
    ),
)
def threshold_flags(t: Tables) -> DataFrame:
    return score.threshold_flags(t.events_n)


@query(
    "u6_dashboard",
    f"""SELECT 'size' AS panel, 'rows' AS item, count(*)::DOUBLE AS value FROM {EVENTS_N}
    UNION ALL SELECT 'size', 'columns', {N_COLUMNS}::DOUBLE
    UNION ALL SELECT 'missing', 'total', {pct(TOTAL_MISSING, f'{N_COLUMNS} * count(*)', 4)} FROM {EVENTS_N}
    UNION ALL """
    + union(EVENTS_N_COLUMNS, lambda n, k: f"SELECT 'missing', '{n}', {pct(f'count(*) - count({n})', 'count(*)', 2)} FROM {EVENTS_N}")
    + f""" UNION ALL SELECT 'types', dtype, count(*)::DOUBLE FROM (VALUES
      {", ".join(f"('{k}')" for k in EVENTS_N_COLUMNS.values())}) AS kinds(dtype) GROUP BY dtype
    UNION ALL SELECT 'outliers', "column", outliers_iqr::DOUBLE FROM (
      {" UNION ALL ".join(_iqr(EVENTS_N, n) for n in EVENT_NUMBERS)}) WHERE outliers_iqr > 0
    UNION ALL SELECT 'score', 'score', score::DOUBLE FROM ({EVENTS_SCORE})""",
)
def dashboard(t: Tables) -> DataFrame:
    return reports.dashboard(t.events_n)


@query(
    "d1_duplicate_counts_named_n",
    """SELECT coalesce(sum(c), 0)::BIGINT AS n_duplicate_rows, coalesce(sum(c - 1), 0)::BIGINT AS n_surplus_rows,
    count(*) AS n_groups FROM (SELECT count(*) AS c FROM events GROUP BY user_id, event_type HAVING count(*) > 1)""",
)
def duplicate_counts_named_n(t: Tables) -> DataFrame:
    """Keys whose names are those that counting uses itself."""
    return duplicate_counts(t.events.selectExpr("user_id AS n", "event_type AS _hash", "value AS rows"), ["n", "_hash"])


@query(
    "u4_recommendations_all_columns",
    _with_message("SELECT row_number() OVER (ORDER BY place) AS rank, rule, \"column\", value FROM ("
    + " UNION ALL ".join(
        [_missing_rule(n, i, EVENTS_N) for i, n in enumerate(EVENTS_N_COLUMNS)]
        + [f"""SELECT 100000, 'remove_duplicates', NULL, s::DOUBLE FROM
            (SELECT sum(n - 1) AS s FROM (SELECT count(*) AS n FROM {EVENTS_N} GROUP BY {", ".join(EVENTS_N_COLUMNS)})) WHERE s > 0"""]
        + [f"""SELECT 200000, 'optimize_types', NULL, p FROM (SELECT
            round(100.0 * floor(sum(saving_bytes)) / sum(est_bytes), 2)::DOUBLE AS p FROM ({SAVINGS})) WHERE p > 10"""]
        + [_outlier_rule(n, 300000 + i, EVENTS_N) for i, n in enumerate(EVENT_NUMBERS)]
    )
    + ")"),
)
def recommendations_all_columns(t: Tables) -> DataFrame:
    return score.recommendations(t.events_n)


@query(
    "p12_correlation_extremes",
    """SELECT 'small' AS col_a, 'large' AS col_b, round(corr(l_quantity, l_extendedprice), 4)::DOUBLE AS r FROM lineitem""",
)
def correlation_extremes(t: Tables) -> DataFrame:
    """Scales whose squares leave the range of doubles."""
    rows = t.lineitem.selectExpr("CAST(l_quantity AS DOUBLE) * 1e-170D AS small", "CAST(l_extendedprice AS DOUBLE) * 1e155D AS large")
    return pair_correlations(rows).selectExpr("col_a", "col_b", "round(r, 4) AS r")


@query(
    "p13_strong_pairs_infinite",
    """SELECT 'quantity' AS col_a, 'marked' AS col_b, round(corr(l_quantity, l_quantity + 20 * l_tax), 3)::DOUBLE AS r,
    'Strong Positive' AS strength FROM lineitem""",
)
def strong_pairs_infinite(t: Tables) -> DataFrame:
    """A column with one infinite value has no correlation."""
    return strong_pairs(t.lineitem.selectExpr(
        "CAST(l_quantity AS DOUBLE) AS quantity", "CAST(l_quantity + 20 * l_tax AS DOUBLE) AS marked",
        "IF(l_orderkey = 1, CAST('infinity' AS DOUBLE), CAST(l_quantity AS DOUBLE)) AS endless",
    ))
