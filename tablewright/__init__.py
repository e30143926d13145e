"""Table profiling and cleaning on Spark DataFrames."""

from tablewright.operators.cardinality import cardinality, distinct_counts
from tablewright.operators.correlation import correlation_matrix, strong_pairs
from tablewright.operators.duplicates import duplicate_counts, duplicate_rows, remove_duplicates
from tablewright.operators.footers import parquet_facts
from tablewright.operators.missing import handle_missing_categorical, handle_missing_numeric
from tablewright.operators.names import standardize_column_names
from tablewright.operators.outliers import (
    cap_outliers, detect_outliers_iqr, detect_outliers_zscore, remove_outliers_iqr,
)
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.types import optimize_dtypes
from tablewright.plans.reports import analysis_report, cleaning_metrics, cleaning_report_text
from tablewright.plans.runs import clean_to, verify_run
from tablewright.plans.score import recommendations, usability_score
from tablewright.plans.steps import apply_steps, apply_with_audit, clean_text_column, preview_step
from tablewright.sources.delimited import read_delimited
from tablewright.sources.sinks import write_delimited, write_run
from tablewright.sources.validation import is_valid, validation_findings

__all__ = [
    "analysis_report", "apply_steps", "apply_with_audit", "cap_outliers", "cardinality", "clean_text_column", "clean_to",
    "cleaning_metrics", "cleaning_report_text", "correlation_matrix", "detect_outliers_iqr",
    "detect_outliers_zscore", "distinct_counts", "duplicate_counts", "duplicate_rows", "exact_quantiles",
    "handle_missing_categorical", "handle_missing_numeric", "is_valid", "optimize_dtypes", "parquet_facts", "preview_step",
    "read_delimited", "recommendations", "remove_duplicates", "remove_outliers_iqr",
    "standardize_column_names", "strong_pairs", "usability_score", "validation_findings",
    "verify_run", "write_delimited", "write_run",
]
