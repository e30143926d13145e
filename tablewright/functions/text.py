"""Text normalisation as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Whitespace as Python counts it: Java's Unicode class plus the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"


def lowercase(value: Column) -> Column:
    return F.lower(value)


def uppercase(value: Column) -> Column:
    return F.upper(value)


def title_case(value: Column) -> Column:
    """Capital after every non-letter, as in `O'Neil It'S A1B`; initcap only looks at blanks."""
    runs = F.regexp_extract_all(F.lower(value), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    capitalised = F.transform(
        runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.substring(run, 2, 2147483647))
    )
    return F.array_join(capitalised, "")


def trim_whitespace(value: Column) -> Column:
    return F.regexp_replace(value, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def remove_special_chars(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)[^a-zA-Z0-9\s\x1c-\x1f]", "")


def remove_extra_spaces(value: Column) -> Column:
    return F.regexp_replace(value, rf"(?U){SPACE}+", " ")


def standardize_quotes(value: Column) -> Column:
    """Apostrophe, backtick and acute accent become a double quote; curly quotes stay."""
    return F.translate(value, "'`´", '"""')


# Operation names.
TEXT_OPERATIONS: dict[str, Callable[[Column], Column]] = {
    "lowercase": lowercase,
    "uppercase": uppercase,
    "title_case": title_case,
    "trim_whitespace": trim_whitespace,
    "remove_special_chars": remove_special_chars,
    "remove_extra_spaces": remove_extra_spaces,
    "standardize_quotes": standardize_quotes,
}
