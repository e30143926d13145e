"""Quality score, grade, flags and recommendations from profile tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tablewright.functions.columns import numeric_columns, percentage_sql, text_literal
from tablewright.operators.cardinality import distinct_counts
from tablewright.operators.correlation import pair_correlations
from tablewright.operators.duplicates import duplicate_counts
from tablewright.operators.facts import FieldFacts, Facts
from tablewright.operators.outliers import Fence, detect_outliers_iqr, fences, outlier_bounds
from tablewright.operators.profile import memory_saving_total, missing_totals

# Penalty per percent and largest penalty of missing cells, duplicates and outliers.
MISSING_WEIGHT, MISSING_CAP = 1.2, 40.0
DUPLICATE_WEIGHT, DUPLICATE_CAP = 0.6, 30.0
OUTLIER_WEIGHT, OUTLIER_CAP = 0.4, 20.0

# Lowest score of each grade.
GRADES = ((90, "A", "Excellent"), (80, "B", "Good"), (70, "C", "Fair"), (60, "D", "Poor"))
LOWEST_GRADE = ("F", "Failing")
BANDS = ((80, "good"), (60, "fair"))
LOWEST_BAND = "poor"

# Limits of the recommendations.
DROP_ABOVE, IMPUTE_ABOVE = 50.0, 20.0
SAVING_ABOVE, OUTLIERS_ABOVE = 10.0, 0.05
MISSING_LISTED, NUMERIC_CHECKED = 3, 2

# Thresholds of the flags.
FLAG_MISSING = 0.5
FLAG_HIGH_CARDINALITY, FLAG_LOW_CARDINALITY = 0.9, 0.05
FLAG_DUPLICATES = 0.01
FLAG_CORRELATION, FLAG_SKEWNESS, FLAG_KURTOSIS = 0.5, 1.0, 3.0
FLAG_ID_LIKE, FLAG_FEW_VALUES, FLAG_CLOSE_PAIR = 0.95, 10, 0.8


def score_components(
    df: DataFrame,
    facts: Facts | None = None,
    duplicates: DataFrame | None = None,
    bounds: dict[str, Fence] | None = None,
) -> DataFrame:
    """One row: rows, missing percent, duplicate percent (all members) and mean outlier percent."""
    duplicates = duplicate_counts(df) if duplicates is None else duplicates
    outliers = detect_outliers_iqr(df, bounds=bounds)
    average = outliers.selectExpr("coalesce(avg(outliers_iqr_pct), 0D) AS pct").scalar()
    repeated = duplicates.select("n_duplicate_rows").scalar()
    rows = f"(total_cells DIV {max(len(df.columns), 1)})"
    return missing_totals(df, facts).select(
        F.expr(f"{rows} AS rows"), "missing_pct",
        repeated.alias("n_duplicate_rows"), average.alias("avg_outlier_pct"),
    ).selectExpr(
        "rows", "missing_pct", f"{percentage_sql('n_duplicate_rows', 'rows', 4)} AS duplicate_pct", "avg_outlier_pct"
    )


# What the advice says in words, as SQL over column and value.
SHARE_TEXT = "CAST(round(value, 1) AS STRING)"
MESSAGES = {
    "high_missing_drop_column": f"concat(column, ': ', {SHARE_TEXT}, ' % of the values are missing, drop the column')",
    "moderate_missing_impute": f"concat(column, ': ', {SHARE_TEXT}, ' % of the values are missing, fill them in')",
    "low_missing_safe_to_impute": f"concat(column, ': ', {SHARE_TEXT}, ' % of the values are missing, any fill is safe')",
    "remove_duplicates": "concat(CAST(CAST(value AS BIGINT) AS STRING), ' rows repeat earlier ones, remove them')",
    "optimize_types": f"concat('narrower types save ', {SHARE_TEXT}, ' % of the memory')",
    "cap_or_remove_outliers": f"concat(column, ': ', {SHARE_TEXT}, ' % of the rows lie outside the fences, cap or remove them')",
}


def _case(score: str, steps: Sequence[tuple[int, str]], otherwise: str) -> str:
    cases = " ".join(f"WHEN {score} >= {lowest} THEN '{name}'" for lowest, name in steps)
    return f"CASE {cases} ELSE '{otherwise}' END"


def usability_score(
    df: DataFrame,
    facts: Facts | None = None,
    duplicates: DataFrame | None = None,
    bounds: dict[str, Fence] | None = None,
) -> DataFrame:
    """Score from 0 to 100 (0 for an empty table) with its components, grade and band."""
    penalties = " - ".join(
        f"least({part} * {weight}D, {cap}D)"
        for part, weight, cap in (
            ("missing_pct", MISSING_WEIGHT, MISSING_CAP),
            ("duplicate_pct", DUPLICATE_WEIGHT, DUPLICATE_CAP),
            ("avg_outlier_pct", OUTLIER_WEIGHT, OUTLIER_CAP),
        )
    )
    score = f"CAST(IF(rows = 0, 0D, greatest(bround(100D - {penalties}, 0), 0D)) AS INT) AS score"
    return (
        score_components(df, facts, duplicates, bounds)
        .selectExpr("*", score)
        .selectExpr(
            "score", "missing_pct", "duplicate_pct", "avg_outlier_pct",
            f"{_case('score', [(low, letter) for low, letter, _ in GRADES], LOWEST_GRADE[0])} AS grade",
            f"{_case('score', [(low, text) for low, _, text in GRADES], LOWEST_GRADE[1])} AS description",
            f"{_case('score', BANDS, LOWEST_BAND)} AS band",
        )
    )


def recommendations(
    df: DataFrame,
    facts: Facts | None = None,
    duplicates: DataFrame | None = None,
    bounds: dict[str, Fence] | None = None,
    missing_listed: int | None = None,
    numeric_checked: int | None = None,
) -> DataFrame:
    """Ranked advice (rank, rule, column, value, message): missing data, duplicates, types, outliers.

    All columns are looked at; `missing_listed` and `numeric_checked` limit the first and the last kind
    to that many columns (MISSING_LISTED and NUMERIC_CHECKED are the published limits).
    """
    facts = facts or Facts.of(df, only=("missing", "octets", "whole_min", "whole_max")).collected()
    duplicates = duplicate_counts(df) if duplicates is None else duplicates
    with_nulls = facts.table(
        lambda c: {
            "place": str(c.ordinal), "column": c.name, "missing": c("missing"),
            "value": percentage_sql(c("missing"), "rows", 4),
        }
    )
    rule = (
        f"CASE WHEN value > {DROP_ABOVE}D THEN 'high_missing_drop_column' "
        f"WHEN value > {IMPUTE_ABOVE}D THEN 'moderate_missing_impute' ELSE 'low_missing_safe_to_impute' END"
    )
    # One row per column at most.
    listed = with_nulls.filter("missing > 0")
    if missing_listed is not None:
        listed = listed.orderBy("place").limit(missing_listed)
    parts = [
        listed.selectExpr("place", f"{rule} AS rule", "column", "value"),
        duplicates.filter("n_surplus_rows > 0").selectExpr(
            "100000", "'remove_duplicates'", "CAST(NULL AS STRING)", "CAST(n_surplus_rows AS DOUBLE)"
        ),
        memory_saving_total(df, facts).filter(f"saving_pct > {SAVING_ABOVE}D").selectExpr(
            "200000", "'optimize_types'", "CAST(NULL AS STRING)", "saving_pct"
        ),
    ]
    checked = numeric_columns(df)[:numeric_checked]
    if checked:
        bounds = {n: f for n, f in (bounds or fences(df, checked)).items() if n in checked}
        names = ", ".join(text_literal(n) for n in checked)
        parts.append(
            outlier_bounds(df, checked, bounds).filter(f"outlier_pct > {OUTLIERS_ABOVE * 100}D").selectExpr(
                f"CAST(300000 + array_position(array({names}), column) AS INT)",
                "'cap_or_remove_outliers'", "column", "outlier_pct",
            )
        )
    advice = reduce(DataFrame.unionAll, parts)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("place"))
    cases = " ".join(f"WHEN {text_literal(rule)} THEN {text}" for rule, text in MESSAGES.items())
    return advice.select(rank.alias("rank"), "rule", "column", "value", F.expr(f"CASE rule {cases} END").alias("message"))


def threshold_flags(df: DataFrame, facts: Facts | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """(column, flag, value, threshold) for every profile value beyond its threshold."""
    facts = facts or Facts.of(df, only=("missing", "skewness", "kurtosis")).collected()
    duplicates = duplicate_counts(df) if duplicates is None else duplicates

    def rules(value: str, *tests: tuple[str, str, float]) -> str:
        """SQL array of (flag, value, threshold), null where the test fails."""
        return ", ".join(
            f"IF({value} {test} {limit}D, struct('{flag}' AS flag, round({value}, 4) AS value, "
            f"{float(limit)}D AS threshold), NULL)"
            for flag, test, limit in tests
        )

    def flagged(table: DataFrame, column: str, checks: str) -> DataFrame:
        return table.selectExpr(f"{column} AS column", f"inline(array_compact(array({checks})))")

    def column_checks(c: FieldFacts) -> dict[str, str]:
        return {
            "column": c.name,
            "rows": "rows",
            "missing_share": f"try_divide({c('missing')}, rows)",
            "skewness": f"abs(CAST({c('skewness')} AS DOUBLE))",
            "kurtosis": f"abs(CAST({c('kurtosis')} AS DOUBLE))",
        }

    shapes = facts.table(column_checks)
    counts = distinct_counts(df).selectExpr(
        "column", "CAST(unique_values AS DOUBLE) AS unique_values", "try_divide(unique_values, rows) AS ratio"
    )
    strengths = pair_correlations(df).selectExpr("concat_ws('~', col_a, col_b) AS pair", "abs(r) AS r")
    rows = facts.totals(rows="rows").scalar()
    surplus = duplicates.select(F.try_divide("n_surplus_rows", rows).alias("surplus_share"))
    parts = [
        flagged(shapes, "column", ", ".join((
            rules("missing_share", ("high_missing", ">", FLAG_MISSING)),
            rules("skewness", ("skewed", ">", FLAG_SKEWNESS)),
            rules("kurtosis", ("heavy_tails", ">", FLAG_KURTOSIS)),
        ))),
        flagged(counts, "column", ", ".join((
            rules("ratio", ("high_cardinality", ">", FLAG_HIGH_CARDINALITY),
                  ("low_cardinality", "<", FLAG_LOW_CARDINALITY), ("id_like", ">=", FLAG_ID_LIKE)),
            rules("unique_values", ("few_values", "<=", FLAG_FEW_VALUES)),
        ))),
        flagged(strengths, "pair", rules("r", ("correlated", ">", FLAG_CORRELATION),
                                         ("closely_correlated", ">", FLAG_CLOSE_PAIR))),
        flagged(surplus, "CAST(NULL AS STRING)", rules("surplus_share", ("duplicates", ">", FLAG_DUPLICATES))),
    ]
    return reduce(DataFrame.unionAll, parts)
