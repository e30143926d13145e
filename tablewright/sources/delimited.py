"""Delimited text of unknown encoding, separator and types.

The encoding is the first one that all lines of all files can be read in, the separator the one by which most lines have
as many fields as the header, and both come from all lines (`dialect`). Files whose headers name the same
columns in another order are mapped by name; others are refused. The data is scanned by Spark, first as text
and then, after one aggregate pass over all values, with the types that fit.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablewright.functions import parsing
from tablewright.functions.columns import quoted, text_literal
from tablewright.operators.facts import Facts
from tablewright.sources.dialect import (
    ENCODINGS, LATIN, LINE_POSITION, SEPARATORS, UNICODE, Dialect, TextFormat, dialect, line_text, opens, outside_quotes, paths, quote_map, segments,
    states,
)

__all__ = [
    "CORRUPT", "ENCODINGS", "EXTRA_NULL_TOKENS", "FILE_POSITION", "NULL_TOKENS", "REASON", "SEPARATORS", "TextFormat", "inferred_types",
    "nulls_from_tokens", "read_as_text", "read_delimited", "sniff", "with_inferred_types",
]

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Texts read as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Further texts that may be read as missing on request.
EXTRA_NULL_TOKENS = ("#VALUE!", "#NULL!")

CORRUPT = "_corrupt_record"
FILE_POSITION = "_file_position"
REASON = "_reason"
OPEN = "_open_quote"

# Why a row is rejected.
TOO_LONG, NEVER_CLOSED = "more fields than the header", "a quote that is never closed"

# Splits whose states are sent to every task (about 80 bytes each); with more, lines are sorted to them.
MOST_SENT_SPLITS = 1_000_000

# What becomes of a line or some lines: a record, a part of one that goes on in another split, or a line read by itself.
WHOLE, PART, ALONE = 0, 1, 2


def sniff(spark: SparkSession, path: str | Sequence[str], separator: str | None = None) -> TextFormat | None:
    """Encoding, separator and header of the text (of its first file); None if it is empty."""
    found = dialect(spark, path, separator)
    return found.format if found else None


def _upper_half(encoding: str) -> tuple[str, str]:
    """The 128 upper characters of Latin-1 and what they stand for in `encoding`."""
    codes = bytes(range(128, 256))
    kept = [(a, b) for a, b in zip(codes.decode("latin-1"), (bytes([c]).decode(encoding, "replace") for c in codes))]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


def _text_schema(width: int) -> T.StructType:
    fields = [T.StructField(f"_{i}", T.StringType()) for i in range(width)]
    return T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])


def _options(text_format: TextFormat) -> dict[str, str]:
    return {
        "sep": text_format.separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT, "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
    }


def _scanned(spark: SparkSession, path: str | Sequence[str], text_format: TextFormat) -> DataFrame:
    """One record per line, parsed by the scan."""
    # A pruned parser does not see the length of a row, so it would mark nothing.
    scan = spark.read.option("columnPruning", False).options(**_options(text_format)).csv(
        path if isinstance(path, str) else list(path),
        schema=_text_schema(len(text_format.header)), header=True, enforceSchema=True,
        encoding="UTF-8" if text_format.encoding in UNICODE else LATIN,
    )
    return scan.selectExpr("*", f"{LINE_POSITION} AS {FILE_POSITION}")


def assembled(batches):
    """Records of the lines of a split, in the order of the lines.

    Lines come with their quote map and what is known of their split; a record that the split's end cuts leaves a part,
    as does what the split has of a record from before it.
    """
    split, ordinal, state = None, 0, 0
    held: list[str] = []  # lines of a record that goes on
    held_at = 0
    schema = pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("text", pa.string()), ("kind", pa.int32()),
        ("of_block", pa.int64()), ("of_line", pa.int64()),
    ])

    def made(texts, lines, kind, known, of_line=None):
        """Rows at `lines`; a part names the line of its record, or the open one."""
        count = len(lines)
        if of_line is None:
            of_block, of_line = known["open_block"], known["open_line"]
        else:
            of_block = known["block"]
        fill = lambda value: pa.array([value] * count, pa.int64())
        return pa.record_batch(
            [pa.array([known["file"]] * count, pa.string()), fill(known["block"]), pa.array(lines, pa.int64()), texts, pa.array([kind] * count, pa.int32()),
             fill(of_block if kind == PART else None), fill(of_line if kind == PART else None)], schema,
        )

    def closing(known):
        """What is held when a split ends: a part of a record from before it or of one that goes on."""
        if held:
            begun = held_at >= 0
            yield made(pa.array(["\n".join(held)], pa.string()), [max(held_at, 0)], PART, known, held_at if begun else None)
            held.clear()

    known: dict = {}
    for batch in batches:
        for file, block, lines in segments(batch):
            if (file, block) != split:
                yield from closing(known)
                names = ("carry", "open_block", "open_line", "head_block", "head_line", "alone_from")
                known = {"file": file, "block": block} | {n: lines.column(n)[0].as_py() for n in names}
                split, ordinal, state, held_at = (file, block), 0, known["carry"], -1
            text, count = lines.column("text"), lines.num_rows
            together = count if known["alone_from"] is None else min(count, max(0, known["alone_from"] - ordinal))
            fresh, inside = (lines.column(n).to_numpy(zero_copy_only=False)[:together] for n in ("fresh", "inside"))
            before, after = states(fresh, inside, state)
            begins = np.flatnonzero(before == 0)
            first = int(begins[0]) if len(begins) else together
            held += text.slice(0, first).to_pylist()
            if first < together or together < count:  # what was held ends before this line
                if held and held_at >= 0:
                    if (known["head_block"], known["head_line"]) != (block, held_at):
                        yield made(pa.array(["\n".join(held)], pa.string()), [held_at], WHOLE, known)
                    held.clear()
                yield from closing(known)
            if first < together:
                edges = np.append(begins, together)
                last = int(edges[-2])
                goes_on = after == 1
                done = len(begins) - goes_on
                if done:
                    stop = int(edges[done])
                    offsets = pa.array((edges[: done + 1] - first).astype(np.int32))
                    rows = pa.ListArray.from_arrays(offsets, text.slice(first, stop - first))
                    at = ordinal + begins[:done]
                    if known["head_block"] == block:
                        kept = at != known["head_line"]
                        rows, at = rows.filter(pa.array(kept)), at[kept]
                    yield made(pc.binary_join(rows, "\n"), at, WHOLE, known)
                if goes_on:
                    held += text.slice(last, together - last).to_pylist()
                    held_at = ordinal + last
            state = after
            if together < count:
                at = ordinal + np.arange(together, count)
                kept = at != known["head_line"] if known["head_block"] == block else np.ones(len(at), bool)
                yield made(text.slice(together).filter(pa.array(kept)), at[kept], ALONE, known)
                state = 0
            ordinal += count
    yield from closing(known)


def _joined_lines(spark: SparkSession, path: str | Sequence[str], text_format: TextFormat, carried: DataFrame) -> DataFrame:
    """Records that may span lines, put together where their lines are read.

    What a split begins in is sent to its lines; only parts of records that a split's end cuts meet in an exchange.
    """
    fresh, inside = quote_map("text", text_format.separator)
    lines = (
        spark.read.text(paths(path))
        .selectExpr("_metadata.file_path AS file", "_metadata.file_block_start AS block", f"{line_text(text_format.encoding)} AS text", "monotonically_increasing_id() AS at")
        .selectExpr("file", "block", "text", f"{fresh} AS fresh", f"{inside} AS inside", "at")
    )
    if carried.count() <= MOST_SENT_SPLITS:
        placed = lines.join(F.broadcast(carried), ["file", "block"])
    else:
        placed = lines.join(carried.hint("merge"), ["file", "block"]).sortWithinPartitions("file", "block", "at")
    records = placed.drop("at", "spans").mapInArrow(assembled, "file string, block long, line long, text string, kind int, of_block long, of_line long")
    cut = records.filter(f"kind = {PART}").groupBy("file", "of_block", "of_line").agg(
        F.expr("array_join(transform(sort_array(collect_list(struct(block, line, text))), l -> l.text), '\n')").alias("text")
    )
    headed = carried.groupBy("file").agg(F.first("head_block").alias("of_block"), F.first("head_line").alias("of_line"))
    cut = cut.join(headed, ["file", "of_block", "of_line"], "left_anti")
    body = records.filter(f"kind <> {PART}").select("file", "block", "line", "text", (F.col("kind") == ALONE).alias("alone")).unionByName(
        cut.select("file", F.col("of_block").alias("block"), F.col("of_line").alias("line"), "text", F.lit(False).alias("alone"))
    ).filter("trim(text) <> ''")
    row = F.from_csv("text", F.lit(_text_schema(len(text_format.header)).simpleString()), _options(text_format))
    return body.select(
        row.alias("row"), F.struct("file", "block", "line").alias(FILE_POSITION), F.expr(f"alone AND {opens('text', text_format.separator)}").alias(OPEN), "text"
    ).select("row.*", FILE_POSITION, OPEN, "text")


def _rows(spark: SparkSession, path: str | Sequence[str], text_format: TextFormat, carried: DataFrame | None) -> DataFrame:
    """All columns as text, `_corrupt_record`, whether a quote of the row is never closed, and the position; `carried` if records may span lines."""
    if carried is None:
        rows = _scanned(spark, path, text_format).withColumns({OPEN: F.lit(False), "text": F.lit(None).cast("string")})
    else:
        rows = _joined_lines(spark, path, text_format, carried)

    def decoded(value: Column) -> Column:
        if text_format.encoding in (*UNICODE, "latin-1"):
            return value
        return F.translate(value, *_upper_half(text_format.encoding))

    columns = [decoded(F.col(f"_{i}")).alias(name) for i, name in enumerate(text_format.header)]
    # Spark refuses queries that read nothing but the corrupt record, so a data column is named too.
    marked = F.when(F.col(OPEN), F.col("text")).when(F.col(CORRUPT).isNotNull(), F.coalesce(F.col(CORRUPT), F.col("_0")))
    return rows.select(*columns, decoded(marked).alias(CORRUPT), OPEN, FILE_POSITION)


def _spanning(found: Dialect) -> DataFrame | None:
    """States of the splits, if some record spans lines or never ends."""
    carried = found.carried()
    return None if carried.filter("spans").isEmpty() else carried


def _read(spark: SparkSession, path: str | Sequence[str], found: Dialect) -> DataFrame:
    carried = _spanning(found)
    groups = [_rows(spark, files or path, f, carried) for f, files in found.formats(spark, path)]
    return reduce(DataFrame.unionByName, groups)


def read_as_text(
    spark: SparkSession, path: str | Sequence[str], text_format: TextFormat | None = None, with_position: bool = False
) -> DataFrame:
    """All columns as text, with rows of the wrong length and those with a quote that is never closed marked in `_corrupt_record`.

    Without `text_format` each group of files with a header of its own is read by it, and columns are put
    together by name. `with_position` adds a struct that sorts rows in file order.
    """
    found = dialect(spark, path, text_format.separator if text_format else None)
    if found is None:
        raise ValueError(f"no text to read at {path!r}")
    rows = _read(spark, path, found) if text_format is None else _rows(spark, path, text_format, _spanning(found))
    return rows.drop(OPEN) if with_position else rows.drop(OPEN, FILE_POSITION)


def nulls_from_tokens(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Texts that stand for a missing value become null."""
    tokens = ", ".join(text_literal(token) for token in (*NULL_TOKENS, *extra))

    def kept(field: T.StructField) -> str:
        name = quoted(field.name)
        if not isinstance(field.dataType, T.StringType) or field.name == CORRUPT:
            return name
        return f"IF({name} IN ({tokens}), NULL, {name}) AS {name}"

    return df.selectExpr(*[kept(field) for field in df.schema.fields])


def inferred_types(df: DataFrame) -> dict[str, T.DataType]:
    """bigint, double, boolean or text for each text column, whichever all of its values fit."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != CORRUPT]
    if not names:
        return {}
    facts = Facts.of(df, names, ("missing", "numbers", "integers", "booleans"))
    rows = facts.table(
        lambda c: {
            "column": c.name, "filled": c.filled, "numbers": c("numbers"),
            "integers": c("integers"), "booleans": c("booleans"),
        }
    ).collect()
    out: dict[str, T.DataType] = {}
    for row in rows:
        if row["integers"] == row["filled"] and row["filled"]:
            out[row["column"]] = T.LongType()
        elif row["numbers"] == row["filled"]:
            out[row["column"]] = T.DoubleType()
        elif row["booleans"] == row["filled"]:
            out[row["column"]] = T.BooleanType()
        else:
            out[row["column"]] = T.StringType()
    return out


def with_inferred_types(df: DataFrame, types: dict[str, T.DataType] | None = None) -> DataFrame:
    types = inferred_types(df) if types is None else types

    def typed(name: str) -> str:
        kind, value = types.get(name, T.StringType()), quoted(name)
        if isinstance(kind, T.BooleanType):
            value = parsing.boolean_from_text(value)
        elif not isinstance(kind, T.StringType):
            value = f"try_cast({value} AS {kind.simpleString()})"
        return f"{value} AS {quoted(name)}"

    return df.selectExpr(*[typed(name) for name in df.columns])


def is_accepted(record: str, separator: str, width: int) -> str:
    """SQL: whole rows, and short rows (padded with nulls); rows with too many fields are not accepted."""
    rest = outside_quotes(record, separator)
    return f"({record} IS NULL OR length({rest}) - length(replace({rest}, {text_literal(separator)}, '')) + 1 < {width})"


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    extra_null_tokens: Sequence[str] = (),
    with_position: bool = False,
    separator: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The typed table and the rejected rows (as `_corrupt_record`, with a `_reason`) of delimited text.

    A record whose quotes are still open where its file ends is no record: from its first line on the file's lines are
    read by themselves, and those among them that leave a quote open are rejected.
    """
    found = dialect(spark, path, separator)
    if found is None:
        raise ValueError(f"no text to read at {path!r}")
    text = _read(spark, path, found)
    accepted = F.expr(f"NOT {OPEN} AND {is_accepted(CORRUPT, found.format.separator, len(found.format.header))}")
    table = text.filter(accepted).drop(CORRUPT, OPEN)
    table = nulls_from_tokens(table if with_position else table.drop(FILE_POSITION), extra_null_tokens)
    reason = F.when(F.col(OPEN), NEVER_CLOSED).otherwise(TOO_LONG).alias(REASON)
    return with_inferred_types(table), text.filter(~accepted).select(CORRUPT, reason)
