"""Encoding, separator and open quotes of delimited text, decided by all lines of all files.

One aggregate gives, per file, its first line that is not blank and the encodings that all of its lines can be read in.
One pass over the lines then gives a row per split: for each separator how many lines have how many fields, and
what the split does to quotes. Each line is a map of two states (it ends inside quotes or not, if it begins a field
or inside quotes); the maps of a split's lines compose to one map, and only these meet: the state that a split
begins in follows from the splits before it. The lines themselves are never exchanged.
"""

from __future__ import annotations

import csv
import sys
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablewright.functions.columns import text_literal
from tablewright.sources.storage import stored_if_shared

# The functions of this module that run in tasks travel by value: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Encodings and separators in the order they are tried.
ENCODINGS = ("utf-8", "utf-8-sig", "windows-1256", "cp1256", "cp1252", "latin-1")
SEPARATORS = (",", ";", "\t", "|")

# Looked at where no line of the header has one of these; taken if all lines have as many fields as the header.
FURTHER_SEPARATORS = (":", "^", "~", "\x01", "#", "!")

# Different headers that the files of one table may have.
MOST_HEADERS = 100

# Spark reads these directly; other single-byte encodings are read as Latin-1 and translated.
UNICODE = ("utf-8", "utf-8-sig")
LATIN = "ISO-8859-1"

# Where a line stands: its file, the start of its split in the file, and its place in the scan.
LINE_POSITION = (
    "struct(_metadata.file_path AS file, _metadata.file_block_start AS block, "
    "monotonically_increasing_id() AS line)"
)

SPLIT_FACTS = (
    "file string, block long, filled long, first_filled long, "
    "quotes array<struct<separator int, end0 int, end1 int, open0 long, open1 long, spans0 boolean, spans1 boolean>>, "
    "widths array<struct<separator int, fields int, lines long>>"
)


@dataclass(frozen=True)
class TextFormat:
    encoding: str
    separator: str
    header: tuple[str, ...]


def paths(path: str | Sequence[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def undefined(encoding: str) -> str:
    """Latin-1 characters of the bytes that mean nothing in a single-byte encoding."""
    out = []
    for code in range(128, 256):
        try:
            bytes([code]).decode(encoding)
        except UnicodeDecodeError:
            out.append(chr(code))
    return "".join(out)


def fitting_encodings(value: str) -> str:
    """SQL: bit k is set if the undecoded line can be read in encoding k; those behind one that reads all are not looked at."""
    bits = []
    for k, encoding in enumerate(ENCODINGS):
        if encoding in UNICODE:
            fits = f"is_valid_utf8(CAST({value} AS STRING))"
        elif missing := undefined(encoding):
            fits = f"NOT rlike(decode(CAST({value} AS BINARY), '{LATIN}'), '[{missing}]')"
        else:
            return " + ".join([*bits, str(1 << k)])
        bits.append(f"IF({fits}, {1 << k}, 0)")
    return " + ".join(bits)


def decoded(raw: bytes, encoding: str) -> str:
    """Text of a line; the first line of a file may begin with a mark of its encoding."""
    return raw.decode(encoding, "replace").removeprefix("﻿").rstrip("\r")


def unique_header(names: Sequence[str]) -> tuple[str, ...]:
    """Blank names become `Unnamed: i`; repeats get `.1`, `.2`, ..."""
    taken: set[str] = set()
    out = []
    for i, raw in enumerate(names):
        base = raw if raw.strip() else f"Unnamed: {i}"
        name, suffix = base, 0
        while name.lower() in taken:  # Spark does not tell names apart by case
            suffix += 1
            name = f"{base}.{suffix}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def in_class(separator: str) -> str:
    """The separator inside a character class of a pattern."""
    return f"\\x{ord(separator):02x}"


def opens(line: str, separator: str) -> str:
    """SQL: whether a line that begins with a new field ends inside quotes.

    A quote opens only at the start of a field; elsewhere in an unquoted field it is text, as is whatever
    follows a closing quote up to the separator. All loops are possessive, so a line is read once.
    """
    sep = in_class(separator)
    quoted_field = '"(?:[^"]|"")*+'
    field = f'(?:{quoted_field}"[^{sep}]*+|[^"{sep}][^{sep}]*+)?+'
    return f"rlike({line}, {text_literal(f'^(?:{field}{sep})*+{quoted_field}$')})"


def outside_quotes(line: str, separator: str) -> str:
    """SQL: the line without its quoted fields."""
    pattern = f'(^|{in_class(separator)})"(?:[^"]|"")*+"'
    return f"regexp_replace({line}, {text_literal(pattern)}, '$1')"


def field_count(line: str, separator: str) -> str:
    rest = f"IF(contains({line}, '\"'), {outside_quotes(line, separator)}, {line})"
    return f"length({rest}) - length(replace({rest}, {text_literal(separator)}, '')) + 1"


def line_text(encoding: str) -> str:
    """SQL: a line as text, without a mark of the encoding; upper bytes of single-byte encodings as Latin-1 has them."""
    if encoding not in UNICODE:
        return f"decode(CAST(value AS BINARY), '{LATIN}')"
    return "IF(startswith(value, '﻿'), substr(value, 2), value)"


def quote_map(text: str, separator: str) -> tuple[str, str]:
    """SQL: whether a line ends inside quotes if it begins a field, and if it begins inside quotes."""
    quote = "'\"'"
    return (
        f"contains({text}, {quote}) AND {opens(text, separator)}",
        f"NOT contains({text}, {quote}) OR {opens(f'concat({quote}, {text})', separator)}",
    )


def states(fresh: np.ndarray, inside: np.ndarray, begin: int) -> tuple[np.ndarray, int]:
    """State before each line (1: inside quotes) and after the last, if the first line begins in `begin`."""
    count = len(fresh)
    sets, turned = fresh == inside, np.cumsum(fresh & ~inside)
    last = np.maximum.accumulate(np.where(sets, np.arange(count), -1))
    since_set = fresh[last].astype(np.int64) + turned - turned[last]
    after = np.where(last >= 0, since_set, begin + turned) & 1
    return np.concatenate(([begin], after[:-1])), int(after[-1]) if count else begin


def segments(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Runs of lines of one split: file, block, lines. The first two columns name the split."""
    blocks = batch.column(1).to_numpy()
    files = batch.column(0).dictionary_encode()
    codes = files.indices.to_numpy()
    cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1])) + 1
    edges = [0, *cuts.tolist(), len(blocks)]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield files.dictionary[codes[a]].as_py(), int(blocks[a]), batch.slice(a, b - a)


class SplitFacts:
    """What the lines of one split say, in the order they are met."""

    def __init__(self, separators: int):
        self.lines = self.filled = 0
        self.first = -1
        # For each separator and state at the begin: state at the end, line that opened it (-1: one before), records over lines.
        self.quotes = [[[begin, -1, False] for begin in (0, 1)] for _ in range(separators)]
        self.widths: Counter = Counter()

    def add(self, lines: pa.RecordBatch) -> None:
        filled = ~lines.column(2).to_numpy(zero_copy_only=False)
        if self.first < 0 and filled.any():
            self.first = self.lines + int(filled.argmax())
        self.filled += int(filled.sum())
        for k, held in enumerate(self.quotes):
            fresh, inside = (lines.column(3 + 3 * k + j).to_numpy(zero_copy_only=False) for j in (0, 1))
            for known in held:
                before, end = states(fresh, inside, known[0])
                begun = np.flatnonzero(before == 0)
                if len(begun):
                    known[1] = self.lines + int(begun[-1])
                known[0], known[2] = end, known[2] or bool(before.any())
            fields, count = np.unique(lines.column(5 + 3 * k).to_numpy()[filled], return_counts=True)
            self.widths.update({(k, int(f)): int(c) for f, c in zip(fields, count)})
        self.lines += lines.num_rows

    def row(self, file: str, block: int) -> dict:
        quotes = [
            {f"{name}{begin}": known[place] for begin, known in enumerate(held) for place, name in enumerate(("end", "open", "spans"))} | {"separator": k}
            for k, held in enumerate(self.quotes)
        ]
        widths = [{"separator": k, "fields": f, "lines": n} for (k, f), n in sorted(self.widths.items())]
        return {"file": file, "block": block, "filled": self.filled, "first_filled": self.first, "quotes": quotes, "widths": widths}


def split_facts(spark: SparkSession, path: str | Sequence[str], encoding: str, separators: Sequence[str]) -> DataFrame:
    """A row per split; `quotes` and `widths` name separators by their number."""
    columns = ["_metadata.file_path AS file", "_metadata.file_block_start AS block", f"{line_text(encoding)} AS text"]
    found = []
    for k, separator in enumerate(separators):
        fresh, inside = quote_map("text", separator)
        found += [f"{fresh} AS fresh{k}", f"{inside} AS inside{k}", f"{field_count('text', separator)} AS fields{k}"]
    count = len(separators)
    lines = spark.read.text(paths(path)).selectExpr(*columns).selectExpr("file", "block", "trim(text) = '' AS blank", *found)

    def composed(batches):
        split, known = None, None
        schema = pa.schema([
            ("file", pa.string()), ("block", pa.int64()), ("filled", pa.int64()), ("first_filled", pa.int64()),
            ("quotes", pa.list_(pa.struct([
                ("separator", pa.int32()), ("end0", pa.int32()), ("end1", pa.int32()), ("open0", pa.int64()), ("open1", pa.int64()),
                ("spans0", pa.bool_()), ("spans1", pa.bool_()),
            ]))),
            ("widths", pa.list_(pa.struct([("separator", pa.int32()), ("fields", pa.int32()), ("lines", pa.int64())]))),
        ])
        for batch in batches:
            for file, block, lines in segments(batch):
                if (file, block) != split:
                    if known is not None:
                        yield pa.RecordBatch.from_pylist([known.row(*split)], schema)
                    split, known = (file, block), SplitFacts(count)
                known.add(lines)
        if known is not None:
            yield pa.RecordBatch.from_pylist([known.row(*split)], schema)

    return lines.mapInArrow(composed, SPLIT_FACTS)


@dataclass(frozen=True)
class Heads:
    """Different first lines of the files, in order of a file that has them, and the encodings that all lines fit."""

    lines: list[bytes]
    encodings: int

    @property
    def encoding(self) -> str:
        return next(e for k, e in enumerate(ENCODINGS) if self.encodings >> k & 1)


def by_file(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file, head (its first line that is not blank) and encodings of each file."""
    lines = spark.read.text(paths(path)).selectExpr("CAST(value AS BINARY) AS value", f"{LINE_POSITION} AS at", "trim(value) = '' AS blank")
    return lines.groupBy("at.file").agg(
        F.expr("min_by(value, at) FILTER (WHERE NOT blank)").alias("head"), F.expr(f"bit_and({fitting_encodings('value')})").alias("encodings")
    )


def heads(spark: SparkSession, path: str | Sequence[str]) -> Heads | None:
    """None if there is no text."""
    files = by_file(spark, path).filter("head IS NOT NULL")
    found = files.groupBy("head").agg(F.min("file").alias("file"), F.bit_and("encodings").alias("encodings")).limit(MOST_HEADERS + 1).collect()
    if not found:
        return None
    if len(found) > MOST_HEADERS:
        raise ValueError(f"the files at {path!r} begin with more than {MOST_HEADERS} different headers")
    together = found[0]["encodings"]
    for row in found:
        together &= row["encodings"]
    return Heads([bytes(r["head"]) for r in sorted(found, key=lambda r: r["file"])], together)


def headers(lines: Sequence[bytes], encoding: str, separator: str) -> list[tuple[str, ...]]:
    return [unique_header(next(csv.reader([decoded(line, encoding)], delimiter=separator), [])) for line in lines]


def chosen_separator(facts: DataFrame, known: Heads, separators: Sequence[str], all_lines: bool) -> str | None:
    """The separator by which most lines have as many fields as the header, of those that cut all headers into the same names.

    Ties go to the one with more fields, then to the earlier one. With `all_lines` no other line may stand against it.
    """
    widths = {}
    for k, separator in enumerate(separators):
        names = headers(known.lines, known.encoding, separator)
        if len({frozenset(x) for x in names}) == 1 and len(names[0]) > 1:
            widths[k] = len(names[0])
    if not widths:
        return None
    total = facts.agg(F.sum("filled")).first()[0]
    wanted = " OR ".join(f"(separator = {k} AND fields = {n})" for k, n in widths.items())
    counts = facts.select(F.inline("widths")).filter(wanted).groupBy("separator").agg(F.sum("lines").alias("lines")).collect()
    lines = {r["separator"]: r["lines"] for r in counts}
    fit = [k for k in widths if not all_lines or lines.get(k, 0) == total]
    return separators[max(fit, key=lambda k: (lines.get(k, 0), widths[k], -k))] if fit else None


@dataclass(frozen=True)
class Dialect:
    """Format of the first file, the headers of all files, and what each split does to quotes by the format's separator."""

    format: TextFormat
    known: Heads
    facts: DataFrame
    number: int

    def formats(self, spark: SparkSession, path: str | Sequence[str]) -> list[tuple[TextFormat, list[str] | None]]:
        """Format of each group of files that share a header; without a list of files it is all of them."""
        found = headers(self.known.lines, self.format.encoding, self.format.separator)
        if len(found) == 1:
            return [(self.format, None)]
        files = by_file(spark, path).filter("head IS NOT NULL").groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
        listed = {bytes(r["head"]): list(r["files"]) for r in files}
        return [(TextFormat(self.format.encoding, self.format.separator, h), listed[line]) for line, h in zip(self.known.lines, found)]

    def carried(self) -> DataFrame:
        """Per split: its state at the begin, where the record open there began, the file's header, and from where lines stand alone.

        A file that ends inside quotes has a record that never ends: from its first line on lines are read by themselves.
        """
        quote = self.facts.select("file", "block", "first_filled", F.expr(f"filter(quotes, q -> q.separator = {self.number})[0]").alias("q"))
        quote = quote.selectExpr(
            "file", "block", "first_filled", "q", "IF(q.end0 = q.end1, q.end0, NULL) AS sets", "IF(q.end0 = 1 AND q.end1 = 0, 1, 0) AS turns"
        )
        whole = Window.partitionBy("file").orderBy("block")
        earlier, all_of_it = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        quote = quote.withColumn("turned", F.coalesce(F.sum("turns").over(earlier), F.lit(0)))
        quote = quote.withColumn("set", F.last(F.expr("IF(sets IS NULL, NULL, struct(sets AS state, turned + turns AS turned))"), ignorenulls=True).over(earlier))
        quote = quote.withColumn("carry", F.expr("CAST(IF(set IS NULL, turned, set.state + turned - set.turned) % 2 AS INT)"))
        quote = quote.selectExpr(
            "file", "block", "carry", "first_filled", "IF(carry = 0, q.spans0, q.spans1) AS spans", "IF(carry = 0, q.end0, q.end1) AS end",
            "IF(IF(carry = 0, q.end0, q.end1) = 1 AND IF(carry = 0, q.open0, q.open1) >= 0, "
            "struct(block, IF(carry = 0, q.open0, q.open1) AS line), NULL) AS begun",
        )
        quote = quote.select(
            "file", "block", "carry", "spans", F.last("begun", ignorenulls=True).over(earlier).alias("open"),
            F.first(F.expr("IF(first_filled >= 0, struct(block, first_filled AS line), NULL)"), ignorenulls=True).over(all_of_it).alias("head"),
            F.last("begun", ignorenulls=True).over(all_of_it).alias("last_begun"), F.last("end").over(all_of_it).alias("file_end"),
        )
        return quote.selectExpr(
            "file", "block", "carry", "spans OR file_end = 1 AS spans", "open.block AS open_block", "open.line AS open_line",
            "head.block AS head_block", "head.line AS head_line",
            "CASE WHEN file_end = 0 OR block < last_begun.block THEN NULL WHEN block = last_begun.block THEN last_begun.line ELSE 0L END AS alone_from",
        )


def dialect(spark: SparkSession, path: str | Sequence[str], separator: str | None = None) -> Dialect | None:
    """What all lines of all files say; None if there is no text. `separator` is taken as given if it is stated."""
    known = heads(spark, path)
    if known is None:
        return None
    choices = SEPARATORS if separator is None else (separator,)
    facts = stored_if_shared(split_facts(spark, path, known.encoding, choices), "splits")
    chosen = separator or chosen_separator(facts, known, choices, all_lines=False)
    if chosen is None:
        more = stored_if_shared(split_facts(spark, path, known.encoding, FURTHER_SEPARATORS), "splits")
        chosen = chosen_separator(more, known, FURTHER_SEPARATORS, all_lines=True)
        if chosen is not None:
            choices, facts = FURTHER_SEPARATORS, more
    if chosen is None:
        chosen = SEPARATORS[0]
    names = headers(known.lines, known.encoding, chosen)
    if len({frozenset(x) for x in names}) > 1:
        listed = "; ".join(decoded(line, known.encoding) for line in known.lines[:3])
        raise ValueError(f"the files at {path!r} do not have the same columns ({listed}); read them one by one")
    return Dialect(TextFormat(known.encoding, chosen, names[0]), known, facts, choices.index(chosen))
