"""Recognising numbers, dates and booleans that arrive as text, as SQL over a text expression."""

from __future__ import annotations

from tablewright.functions.columns import text_literal

# Text forms accepted as numbers and as whole numbers.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"

# Date layouts as the shape of a text's first ten characters (each digit as 0), with the
# places where year, month and day start.
DATE_LAYOUTS = (
    ("0000-00-00", 1, 6, 9),
    ("00/00/0000", 7, 1, 4),
    ("00-00-0000", 7, 1, 4),
    ("0000/00/00", 1, 6, 9),
)

# Shapes of what may follow the date.
TIME_SHAPES = ("", " 00:00:00", "T00:00:00")

# Shares of recognised values above which a text column is taken as dates.
DATETIME_SHARE = 0.8


def number_from_text(value: str) -> str:
    """Text to double; null unless the text is a plain decimal or exponent number."""
    return f"IF({value} RLIKE {text_literal(NUMBER_PATTERN)}, try_cast({value} AS DOUBLE), NULL)"


def integer_from_text(value: str) -> str:
    """Text to bigint; null unless the text is a whole number that fits."""
    return f"IF({value} RLIKE {text_literal(INTEGER_PATTERN)}, try_cast({value} AS BIGINT), NULL)"


def _shape(text: str) -> str:
    return f"translate({text}, '123456789', '000000000')"


def date_shape(value: str) -> str:
    return _shape(f"left(trim({value}), 10)")


def has_layout(shape: str, layouts: range = range(len(DATE_LAYOUTS))) -> str:
    return f"{shape} IN ({', '.join(text_literal(DATE_LAYOUTS[i][0]) for i in layouts)})"


def _parsed(value: str, layout: int) -> str:
    """The text put in year-month-day order and read without any time zone; null for an impossible date."""
    _, year, month, day = DATE_LAYOUTS[layout]
    text = f"trim({value})"
    parts = f"substr({text}, {year}, 4), '-', substr({text}, {month}, 2), '-', substr({text}, {day}, 2)"
    return f"try_cast(concat({parts}, substr({text}, 11)) AS TIMESTAMP_NTZ)"


def _ends_in_time_or_date(value: str) -> str:
    text = f"trim({value})"
    shapes = ", ".join(map(text_literal, TIME_SHAPES))
    return f"(length({text}) = 10 OR {_shape(f'substr({text}, 11)')} IN ({shapes}))"


def timestamp_from_text(value: str, layout: int) -> str:
    """Text to timestamp_ntz by one layout, with or without a time of day; null if it does not fit."""
    fits = has_layout(date_shape(value), range(layout, layout + 1))
    return f"IF({fits} AND {_ends_in_time_or_date(value)}, {_parsed(value, layout)}, NULL)"


def timestamp_from_any_layout(value: str, shape: str | None = None) -> str:
    """Text to timestamp_ntz by whichever layout it has; `shape` names a ready `date_shape` of it."""
    shape = shape or date_shape(value)
    cases = " ".join(
        f"WHEN {shape} = {text_literal(layout[0])} THEN {_parsed(value, i)}" for i, layout in enumerate(DATE_LAYOUTS)
    )
    return f"IF({has_layout(shape)} AND {_ends_in_time_or_date(value)}, CASE {cases} END, NULL)"


def boolean_from_text(value: str) -> str:
    """`True`/`False` in the usual capitalisations; null otherwise."""
    return (
        f"CASE WHEN {value} IN ('True', 'TRUE', 'true') THEN true "
        f"WHEN {value} IN ('False', 'FALSE', 'false') THEN false END"
    )
