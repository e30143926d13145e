"""Reading, checking and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.catalog.base import EVENTS_N, EVENTS_N_COLUMNS, Tables, pct, query, union
from tablewright.functions.display import display_strings
from tablewright.operators import ordering
from tablewright.operators.ordering import POSITION
from tablewright.operators.tables import local_table
from tablewright.plans.steps import apply_steps, apply_with_audit
from tablewright.sources import delimited, sinks
from tablewright.sources.storage import new_path
from tablewright.sources.validation import validation_findings


@query("s1_read_delimited", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_back_customers(t: Tables) -> DataFrame:
    path = new_path(t.spark, "customers")
    sinks.write_delimited(t.customer, path, separator=";")
    return delimited.read_delimited(t.spark, path)[0]


@query("s1_read_single_byte_encoding", "SELECT p_partkey, 'é' || p_name AS p_name, p_size::BIGINT AS p_size FROM part")
def read_back_latin(t: Tables) -> DataFrame:
    path = new_path(t.spark, "parts")
    parts = t.part.select("p_partkey", F.concat(F.lit("é"), "p_name").alias("p_name"), "p_size")
    sinks.write_delimited(parts, path, separator="\t", encoding="ISO-8859-1")
    return delimited.read_delimited(t.spark, path)[0]


@query(
    "s1_read_quoted_newlines",
    "SELECT event_id, event_type || chr(10) || '\"' || props AS note FROM events",
)
def read_back_newlines(t: Tables) -> DataFrame:
    path = new_path(t.spark, "notes")
    notes = t.events.select("event_id", F.concat("event_type", F.lit('\n"'), "props").alias("note"))
    sinks.write_delimited(notes, path)
    return delimited.read_delimited(t.spark, path)[0]


# Every third note ends in an inch mark, every fifth begins with one inside quotes and holds a line break.
NOTE = {
    "spark": "CASE WHEN event_id % 5 = 0 THEN concat('\"', event_type, '\\n', event_id, '\"') "
             "WHEN event_id % 3 = 0 THEN concat(event_id, '\"') ELSE event_type END",
    "duck": "CASE WHEN event_id % 5 = 0 THEN '\"' || event_type || chr(10) || event_id || '\"' "
            "WHEN event_id % 3 = 0 THEN event_id || '\"' ELSE event_type END",
}


def _with_header(t: Tables, lines: DataFrame, header: str, label: str) -> str:
    """Lines (line, place) as text files that each begin with the header."""
    path = new_path(t.spark, label)
    heads = lines.select(F.spark_partition_id().alias("part")).distinct().selectExpr(f"'{header}' AS line", "-1L AS place", "part")
    body = lines.withColumn("part", F.spark_partition_id())
    parts = heads.unionByName(body).repartition(8, "part").sortWithinPartitions("part", "place")
    parts.select("part", "line").write.partitionBy("part").text(path)
    return f"{path}/*"


@query("s1_read_stray_quotes", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id || '\" pipe' ELSE event_type END AS note, props FROM events")
def read_back_stray_quotes(t: Tables) -> DataFrame:
    """Inch marks inside unquoted fields open nothing."""
    note = "IF(event_id % 3 = 0, concat(event_id, '\" pipe'), event_type)"
    quoted_props = "concat('\"', replace(props, '\"', '\"\"'), '\"')"
    lines = t.events.repartition(3).selectExpr(f"concat_ws(',', event_id, {note}, {quoted_props}) AS line", "event_id AS place")
    table, rejected = delimited.read_delimited(t.spark, _with_header(t, lines, "event_id,note,props", "stray"))
    assert rejected.isEmpty()
    return table


@query("s1_read_mixed_quotes", f"SELECT event_id, {NOTE['duck']} AS note, event_type AS kind FROM events")
def read_back_mixed_quotes(t: Tables) -> DataFrame:
    """Inch marks in unquoted fields next to quoted fields with line breaks and quotes, over several files."""
    note = NOTE["spark"]
    written = f"IF(event_id % 5 = 0, concat('\"', replace({note}, '\"', '\"\"'), '\"'), {note})"
    lines = t.events.repartition(3).selectExpr(f"concat_ws(';', event_id, {written}, event_type) AS line", "event_id AS place")
    table, rejected = delimited.read_delimited(t.spark, _with_header(t, lines, "event_id;note;kind", "mixed"))
    assert rejected.isEmpty()
    return table


@query("s1_read_late_encoding", "SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'caf' || chr(233) ELSE o_orderstatus END AS note FROM orders")
def read_back_late_encoding(t: Tables) -> DataFrame:
    """A single byte above 127 in the last line decides the encoding of all files."""
    last = t.orders.agg(F.max("o_orderkey")).first()[0]
    path = new_path(t.spark, "late")
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") == last, "café").otherwise(F.col("o_orderstatus")).alias("note"))
    sinks.write_delimited(rows, path, encoding="ISO-8859-1")
    table, _ = delimited.read_delimited(t.spark, path)
    # The first encoding that fits reads this byte as a letter of its own; what counts is that no byte is lost.
    return table.withColumn("note", F.replace("note", F.lit(bytes([0xE9]).decode("windows-1256")), F.lit("é")))


@query("s1_read_header_order", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def read_back_header_order(t: Tables) -> DataFrame:
    """Two files that name the same columns in different orders."""
    path = new_path(t.spark, "orders")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    sinks.write_delimited(rows.filter("o_orderkey % 2 = 0"), f"{path}/even")
    sinks.write_delimited(rows.filter("o_orderkey % 2 <> 0").select("o_orderstatus", "o_orderkey", "o_custkey"), f"{path}/odd")
    table, _ = delimited.read_delimited(t.spark, [f"{path}/even", f"{path}/odd"])
    return table.select("o_orderkey", "o_custkey", "o_orderstatus")


def _one_file(t: Tables, lines: DataFrame, label: str) -> str:
    """Lines (line, place) as one text file, in order."""
    path = new_path(t.spark, label)
    lines.repartition(1).sortWithinPartitions("place").select("line").write.text(path)
    return path


@query(
    "s1_read_unclosed_quote",
    """SELECT event_id, CASE WHEN event_id % 50 = 7 AND event_id < 900 THEN event_type || chr(10) || 'more' ELSE event_type END AS note,
    (SELECT count(*) FROM events WHERE event_id = 1500) AS rejected FROM events WHERE event_id <> 1500""",
)
def read_back_unclosed_quote(t: Tables) -> DataFrame:
    """A quote that is never closed: the rows behind it stay, as do the records over two lines before it."""
    note = (
        "CASE WHEN event_id % 50 = 7 AND event_id < 900 THEN concat('\"', event_type, '\n', 'more\"') "
        "WHEN event_id = 1500 THEN concat('\"', event_type) ELSE event_type END"
    )
    lines = t.events.selectExpr(f"concat_ws(',', event_id, {note}) AS line", "event_id AS place").union(t.spark.sql("SELECT 'event_id,note', -1L"))
    table, rejected = delimited.read_delimited(t.spark, _one_file(t, lines, "unclosed"))
    reasons = rejected.groupBy(delimited.REASON).count().collect()
    assert [r[delimited.REASON] for r in reasons] == [delimited.NEVER_CLOSED]
    return table.withColumn("rejected", F.lit(reasons[0]["count"]))


@query(
    "s1_read_late_separator",
    "SELECT event_id, CASE WHEN event_id < 5000 THEN event_type || ', late' ELSE event_type || ', or' || ', more' END AS \"note, if any\" FROM events",
)
def read_back_late_separator(t: Tables) -> DataFrame:
    """Another separator has as many fields as the header in thousands of lines; in the end it has not."""
    note = "IF(event_id < 5000, concat(event_type, ', late'), concat(event_type, ', or, more'))"
    lines = t.events.selectExpr(f"concat_ws(';', event_id, {note}) AS line", "event_id AS place").union(t.spark.sql("SELECT 'event_id;note, if any', -1L"))
    table, rejected = delimited.read_delimited(t.spark, _one_file(t, lines, "late"))
    assert rejected.isEmpty()
    return table


@query("s1_read_blank_start", "SELECT o_orderkey, o_orderstatus FROM orders")
def read_back_blank_start(t: Tables) -> DataFrame:
    """Thousands of blank lines before the header, some with spaces."""
    blank = t.spark.range(3000).selectExpr("IF(id % 3 = 0, '  ', '') AS line", "id - 10000 AS place")
    lines = t.orders.selectExpr("concat_ws('|', o_orderkey, o_orderstatus) AS line", "o_orderkey AS place")
    lines = lines.union(blank).union(t.spark.sql("SELECT 'o_orderkey|o_orderstatus', -1L"))
    return delimited.read_delimited(t.spark, _one_file(t, lines, "blank"))[0]


@query("s1_read_inferred_separator", "SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part")
def read_back_inferred_separator(t: Tables) -> DataFrame:
    """A separator that is none of the usual ones."""
    path = new_path(t.spark, "parts")
    sinks.write_delimited(t.part.select("p_partkey", "p_name", "p_size"), path, separator="~")
    table, _ = delimited.read_delimited(t.spark, path)
    assert delimited.sniff(t.spark, path).separator == "~"
    return table


@query(
    "s2_null_tokens",
    "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type "
    "FROM events",
)
def null_tokens(t: Tables) -> DataFrame:
    text = t.events.selectExpr(
        "event_id",
        "CASE WHEN event_id % 7 = 0 THEN 'N/A' WHEN event_id % 11 = 0 THEN '-1.#IND' ELSE event_type END AS event_type",
    )
    return delimited.nulls_from_tokens(text)


ORDER_TEXTS = {
    "order_key": ("CAST(o_orderkey AS STRING)", "CAST(o_orderkey AS VARCHAR)"),
    "price": ("CAST(o_totalprice AS STRING)", "CAST(o_totalprice AS VARCHAR)"),
    "is_open": ("CASE WHEN o_orderstatus = 'O' THEN 'True' ELSE 'False' END",) * 2,
    "priority": ("o_orderpriority", "o_orderpriority"),
}


@query(
    "s3_infer_types",
    union(
        {name: sql for name, (_, sql) in ORDER_TEXTS.items()},
        lambda name, sql: f"""SELECT '{name}' AS "column", CASE
            WHEN count(*) FILTER (regexp_full_match(v, '\\s*[+-]?\\d+\\s*')) = count(v) THEN 'bigint'
            WHEN count(try_cast(v AS DOUBLE)) = count(v) THEN 'double'
            WHEN count(*) FILTER (v IN ('True', 'False', 'TRUE', 'FALSE', 'true', 'false')) = count(v) THEN 'boolean'
            ELSE 'string' END AS type FROM (SELECT {sql} AS v FROM orders)""",
    ),
)
def infer_types(t: Tables) -> DataFrame:
    text = t.orders.selectExpr(*[f"{sql} AS {name}" for name, (sql, _) in ORDER_TEXTS.items()])
    found = delimited.inferred_types(text)
    return local_table(t.spark, [(n, k.simpleString()) for n, k in found.items()], "column string, type string")


@query(
    "s4_malformed_rows",
    "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS p_name, "
    "(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END)::BIGINT AS p_size, "
    "(SELECT count(*) FROM part WHERE p_partkey % 10 = 0 AND p_partkey % 7 <> 0) AS rejected "
    "FROM part WHERE p_partkey % 10 <> 0 OR p_partkey % 7 = 0",
)
def malformed_rows(t: Tables) -> DataFrame:
    """Rows divisible by 7 lack two fields, others divisible by 10 have one too many."""
    line = (
        "CASE WHEN p_partkey % 7 = 0 THEN CAST(p_partkey AS STRING) "
        "ELSE concat_ws('|', p_partkey, p_name, p_size, IF(p_partkey % 10 = 0, 'extra', NULL)) END"
    )
    whole = delimited.TextFormat("utf-8", "|", ("p_partkey", "p_name", "p_size"))
    lines = t.part.repartition(3).selectExpr(f"{line} AS line", "p_partkey AS place")
    path = _with_header(t, lines, "p_partkey|p_name|p_size", "ragged")
    assert delimited.sniff(t.spark, path) == whole
    table, rejected = delimited.read_delimited(t.spark, path)
    return table.withColumn("rejected", F.lit(rejected.count()))


@query(
    "s6_validate_table",
    """SELECT * FROM (VALUES ('column_count', true, true, '9'), ('names_not_blank', true, true, ''),
    ('names_unique', true, true, ''), ('types_supported', true, true, ''), ('name_length', false, true, ''),
    ('name_characters', false, true, '')) AS checks("check", required, ok, detail)
    UNION ALL SELECT 'min_rows', true, count(*) > 0, CASE WHEN count(*) > 0 THEN '' ELSE 'the table has no rows' END
    FROM events""",
)
def validate_table(t: Tables) -> DataFrame:
    return validation_findings(t.events_n)


@query(
    "s8_write_delimited",
    """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _row_pos, o_orderkey, o_orderstatus,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders""",
)
def write_and_read(t: Tables) -> DataFrame:
    path = new_path(t.spark, "orders")
    kept = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate")
    sinks.write_delimited(kept, path, include_index=True, order_by=["o_orderkey"], separator="|")
    schema = f"{POSITION} bigint, o_orderkey bigint, o_orderstatus string, o_orderdate string"
    return t.spark.read.csv(path, schema=schema, header=True, sep="|")


@query(
    "s9_write_run",
    union(
        EVENTS_N_COLUMNS,
        lambda name, kind: f"""SELECT '{name}' AS "column", '{kind}' AS dtype, count(*) - count({name}) AS null_count,
        {pct(f'count(*) - count({name})', 'count(*)', 2)} AS null_pct, count({name}) AS non_null_count
        FROM (SELECT * REPLACE (coalesce(type_n, 'Missing') AS type_n) FROM {EVENTS_N})""",
    ),
)
def write_run_directory(t: Tables) -> DataFrame:
    """The missing-value table of a run directory, read back from it."""
    steps = [{"operation": "handle_missing_categorical", "column": "type_n", "parameters": {"method": "new_category"}}]
    path = new_path(t.spark, "run")
    sinks.write_run(path, t.events_n, apply_steps(t.events_n, steps), steps)
    return t.spark.read.parquet(f"{path}/profile/missing_by_column")


@query("s9_write_run_cleaned", f"SELECT event_id, coalesce(type_n, 'Missing') AS type_n, value_n FROM {EVENTS_N}")
def write_run_cleaned(t: Tables) -> DataFrame:
    """The cleaned table of a run directory, whose audit has a row per step."""
    steps = [{"operation": "handle_missing_categorical", "column": "type_n", "parameters": {"method": "new_category"}}]
    path = new_path(t.spark, "run")
    cleaned, audit = apply_with_audit(t.events_n, steps)
    sinks.write_run(path, t.events_n, cleaned, steps, profile={}, audit=audit)
    assert t.spark.read.parquet(f"{path}/audit").filter("missing_after < missing_before").count() == 1
    return t.spark.read.parquet(f"{path}/cleaned").select("event_id", "type_n", "value_n")


@query("s11_preview_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20")
def preview_rows(t: Tables) -> DataFrame:
    return ordering.preview_rows(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 20)


@query(
    "s12_display_strings",
    f"""SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(type_n, '') AS type_n, props,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS word FROM {EVENTS_N}""",
)
def display(t: Tables) -> DataFrame:
    shown = t.events_n.selectExpr(
        "event_id", "type_n", "props",
        "CASE WHEN event_id % 6 = 0 THEN 'NaN' WHEN event_id % 3 = 0 THEN '<NA>' ELSE event_type END AS word",
    )
    return display_strings(shown)
