"""Counts behind charts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablewright.catalog.base import Tables, query
from tablewright.operators import charts


def _bins(source: str, name: str, bins: str) -> str:
    """Bins of `name` with low edge, width and count."""
    return f"""WITH bounds AS (SELECT min({name})::DOUBLE AS lo, max({name})::DOUBLE AS hi, {bins} AS k FROM {source}),
        widths AS (SELECT lo, k, (hi - lo) / k AS w FROM bounds)
        SELECT least(floor(({name} - lo) / w), k - 1)::BIGINT AS bin, any_value(lo) AS lo, any_value(w) AS w,
        count(*) AS n, (SELECT count({name}) FROM {source}) AS total FROM {source}, widths
        WHERE {name} IS NOT NULL GROUP BY 1"""


BIN_RULE = "least(50, greatest(10, count(DISTINCT {0})))"
HISTOGRAM = """SELECT bin, round(lo + bin * w, 6) AS bin_low, round(lo + bin * w + w, 6) AS bin_high, n FROM ({0})"""


@query("h1_histogram", HISTOGRAM.format(_bins("orders", "o_totalprice", BIN_RULE.format("o_totalprice"))))
def histogram(t: Tables) -> DataFrame:
    return charts.histogram(t.orders, "o_totalprice")


@query("h1_histogram_few_values", HISTOGRAM.format(_bins("lineitem", "l_linenumber", BIN_RULE.format("l_linenumber"))))
def histogram_few_values(t: Tables) -> DataFrame:
    return charts.histogram(t.lineitem, "l_linenumber")


@query(
    "h2_category_bars",
    "SELECT p_type AS value, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, value LIMIT 20",
)
def category_bars(t: Tables) -> DataFrame:
    return charts.category_bars(t.part, "p_type")


@query(
    "h3_density",
    f"""SELECT bin, round(lo + bin * w, 6) AS bin_low, round(lo + bin * w + w, 6) AS bin_high,
    round(n / (total * w), 6)::DOUBLE AS density FROM ({_bins("events", "value", BIN_RULE.format("value"))})""",
)
def density(t: Tables) -> DataFrame:
    return charts.density(t.events, "value")
