"""Row order at scale: positions, fills and interpolation without a single-partition sort.

A window without `partitionBy` sorts the whole table in one task. Here the order key and, behind it, a digest of the
row are cut into ranges by split points from a bounded sample. So a repeated leading column is split by the columns
after it, and a repeated key by the rows that have it: their order is fixed by what they hold, not by where they
lie. Only rows that are equal in all columns stay together, and any order of these is the same table. Each range
is sorted on its own. Positions and numbers go across ranges in a table with one row per range (at most
MAX_RANGES), which is broadcast; values to be filled, which may be long, are joined from the range they come from.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablewright.functions.columns import (
    as_double, by_position, column, field_of, missing_sql, positions, present, present_sql, quoted, require_columns, require_numeric,
    text_literal, type_class,
)

ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 32_768
SAMPLE_PER_RANGE = 16

RANGE = "_order_range"
TIE = "_order_tie"
POSITION = "_row_pos"


def _has_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _has_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(_has_map(f.dataType) for f in data_type.fields)
    return isinstance(data_type, T.MapType)


def with_tie(df: DataFrame) -> DataFrame:
    """Add a digest of the row (of its columns without maps, which have no order), the last part of every order key."""
    names = [quoted(f.name) for f in df.schema.fields if not _has_map(f.dataType)]
    return df.selectExpr("*", f"{f'xxhash64({', '.join(names)})' if names else '0L'} AS {TIE}")


def _split_points(df: DataFrame, order_by: Sequence[str], rows_per_range: int) -> DataFrame | None:
    """Ascending keys that cut the table into ranges of about `rows_per_range` rows, as a small table."""
    keys = df.select(*[column(name) for name in order_by])
    rows = keys.count()
    ranges = min(MAX_RANGES, -(-rows // rows_per_range))
    if ranges < 2:
        return None
    fraction = min(1.0, ranges * SAMPLE_PER_RANGE / rows)
    sample = keys.sample(fraction=fraction, seed=7).orderBy(*[column(name) for name in order_by]).toArrow()
    step = max(1, sample.num_rows // ranges)
    if sample.num_rows <= step:
        return None
    return keys.sparkSession.createDataFrame(sample.take(list(range(step, sample.num_rows, step))), keys.schema)


def with_ranges(
    df: DataFrame, order_by: Sequence[str], rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame | None:
    """Add the ordinal of the key range of each row, a pure function of the row's key.

    The key ends in the row's digest, which is added too. None if the table is counted to be small enough to be one range.
    """
    require_columns(df, order_by)
    if TIE not in df.columns:
        df = with_tie(df)
    order_by = [*(name for name in order_by if name != TIE), TIE]
    points = _split_points(df, order_by, rows_per_range)
    if points is None:
        return None
    count = points.count()
    splits = points.agg(
        F.array_sort(F.collect_list(F.struct(*[column(name) for name in order_by]))).alias("splits")
    ).scalar()
    # Binary search over the split points, one generated projection per step.
    out = df.withColumns({"_key": F.struct(*[column(n) for n in order_by]), RANGE: F.lit(0)})
    step = 1 << (count.bit_length() - 1)
    while step:
        probe = F.get(splits, F.col(RANGE) + F.lit(step - 1))
        out = out.withColumn(
            RANGE, F.col(RANGE) + F.when(F.col("_key") >= probe, F.lit(step)).otherwise(F.lit(0))
        )
        step >>= 1
    return out.drop("_key")


def _window(order_by: Sequence[str], backwards: bool = False, ranged: bool = True):
    order = [column(n).desc() if backwards else column(n).asc() for n in order_by]
    return Window.partitionBy(F.col(RANGE) if ranged else F.lit(0)).orderBy(*order)


def _running(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _across(backwards: bool = False):
    """Window over the table of ranges (one row per range), excluding the current range."""
    order = F.col(RANGE).desc() if backwards else F.col(RANGE).asc()
    return Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def with_position(
    df: DataFrame, order_by: Sequence[str], name: str = POSITION, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Add the 0-based position of each row in the order of the key; rows with one key follow one another by their digests."""
    require_columns(df, order_by)
    plain = by_position(df)
    placed = _with_position(with_tie(plain), [*positions(df, order_by), TIE], POSITION, rows_per_range)
    kept = [plain_name for plain_name, c in zip(plain.columns, df.columns) if c != name]
    return placed.select(*kept, POSITION).toDF(*[c for c in df.columns if c != name], name)


def _with_position(df: DataFrame, order_by: Sequence[str], name: str, rows_per_range: int) -> DataFrame:
    ranged = with_ranges(df, order_by, rows_per_range)
    if ranged is None:
        position = F.row_number().over(_window(order_by, ranged=False)).cast("bigint") - 1
        return df.select(*[column(c) for c in df.columns if c != name], position.alias(name))
    offsets = (
        ranged.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_rows"))
        .select(RANGE, F.coalesce(F.sum("_rows").over(_across()), F.lit(0)).alias("_offset"))
    )
    numbered = ranged.withColumn(name, F.row_number().over(_window(order_by)).cast("bigint"))
    joined = numbered.join(F.broadcast(offsets), RANGE)
    position = F.col("_offset") + column(name) - 1
    return joined.select(*[column(c) for c in df.columns if c != name], position.alias(name))


def _edge(order_by: Sequence[str], value: Column, last: bool) -> Column:
    """Value of the first or last row of the group (by key) in which it is not null."""
    by = F.max_by if last else F.min_by
    return by(value, F.when(value.isNotNull(), F.struct(*[column(n) for n in order_by])))


def _filled(
    df: DataFrame, name: str, order_by: Sequence[str], backwards: bool, rows_per_range: int,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    field_of(df, name)
    require_columns(df, order_by)
    if name in order_by:
        raise ValueError(f"{name!r} orders the rows, so it cannot be filled by that order")
    require_columns(df, partition_by)
    keys = positions(df, partition_by)
    names, df, name, order_by = df.columns, with_tie(by_position(df)), *positions(df, [name]), [*keys, *positions(df, order_by), TIE]
    value = present(field_of(df, name))
    if keys:
        # Groups follow one another in the order; a value goes on with its group's key and stops where that changes.
        value = F.when(value.isNotNull(), F.struct(value.alias("value"), *[F.col(k) for k in keys]))
    ranged = with_ranges(df, order_by, rows_per_range)

    def replaced(table: DataFrame, treated: Column) -> DataFrame:
        if keys:
            same = reduce(lambda a, b: a & b, [treated[k].eqNullSafe(F.col(k)) for k in keys])
            treated = F.when(same, treated["value"])
        return table.select(*[treated.alias(name) if c == name else column(c) for c in df.columns if c != TIE]).toDF(*names)

    if ranged is None:
        return replaced(df, F.last(value, ignorenulls=True).over(_running(_window(order_by, backwards, False))))
    edges = ranged.groupBy(RANGE).agg(_edge(order_by, value, last=not backwards).alias("_edge"))
    # Which range a value comes from is found over all ranges; the value itself is joined from there.
    source = F.last(F.when(F.col("_edge").isNotNull(), F.col(RANGE)), ignorenulls=True).over(_across(backwards))
    carried = edges.select(RANGE, source.alias("_source")).join(
        edges.select(F.col(RANGE).alias("_source"), F.col("_edge").alias("_carry")).hint("merge"), "_source", "left"
    )
    local = F.last(value, ignorenulls=True).over(_running(_window(order_by, backwards)))
    # The rows are dealt by range already: only the table of ranges moves.
    filled = ranged.withColumn("_local", local).join(carried.hint("merge"), RANGE)
    return replaced(filled, F.coalesce(F.col("_local"), F.col("_carry")))


def forward_fill(
    df: DataFrame, name: str, order_by: Sequence[str], rows_per_range: int = ROWS_PER_RANGE,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Missing values take the last value before them (of the same `partition_by`); leading ones stay missing."""
    return _filled(df, name, order_by, False, rows_per_range, partition_by)


def backward_fill(
    df: DataFrame, name: str, order_by: Sequence[str], rows_per_range: int = ROWS_PER_RANGE,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Missing values take the next value after them; trailing ones stay missing.

    Runs as a forward fill in descending order: a frame that grows from its start is linear, while
    a frame that ends at the partition's end is evaluated again for every row.
    """
    return _filled(df, name, order_by, True, rows_per_range, partition_by)


def interpolate(
    df: DataFrame, name: str, order_by: Sequence[str], rows_per_range: int = ROWS_PER_RANGE,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Linear interpolation by row position (within `partition_by`); leading missing values stay, trailing ones repeat the last.

    A column, or a group of it, with fewer than two values stays as it is. The result is double.
    """
    require_numeric(df, name)
    require_columns(df, order_by)
    require_columns(df, partition_by)
    if name in order_by or name in partition_by:
        raise ValueError(f"{name!r} orders the rows, so it cannot be filled by that order")
    keys = positions(df, partition_by)
    within = [*positions(df, order_by), TIE]
    names, df, name = df.columns, with_tie(by_position(df)), *positions(df, [name])
    order_by = [*keys, *within]
    value = as_double(field_of(df, name))
    ranged = with_ranges(df, order_by, rows_per_range)
    many = ranged is not None
    # Groups follow one another in the order, so a group's rows of one range are sorted already.
    group = Window.partitionBy(F.col(RANGE) if many else F.lit(0), *keys).orderBy(*[column(n).asc() for n in within])
    placed = (ranged if many else df).withColumn(
        "_at", F.row_number().over(_window(order_by, ranged=many)).cast("bigint")
    ).withColumn("_nth", F.count(value).over(_running(group)))
    known = F.when(value.isNotNull(), F.struct(
        F.col("_at").alias("at"), value.alias("value"), (F.col("_nth") > 1).alias("second"), *[F.col(k) for k in keys],
    ))
    # Backwards by place, not by key: equal rows have to come in the opposite order, too.
    local = placed.withColumn("_before", F.last(known, ignorenulls=True).over(_running(_window(order_by, ranged=many)))).withColumn(
        "_after", F.last(known, ignorenulls=True).over(_running(_window(["_at"], True, many)))
    )
    at, before, after = F.col("_at"), F.col("_before"), F.col("_after")
    if many:
        local = local.join(F.broadcast(_neighbours_across(placed, known, keys)), RANGE)
        at = F.col("_offset") + at
        carried = F.col("_carry_before")
        second = before["second"] | _same_group(carried, before, keys)
        before = F.coalesce(_moved(before, F.col("_offset"), second, keys), carried)
        after = F.coalesce(_moved(after, F.col("_offset"), after["second"], keys), F.col("_carry_after"))
    for k in keys:
        before, after = (F.when(side[k].eqNullSafe(F.col(k)), side) for side in (before, after))
    around = local.withColumns({"_p": at, "_b": before, "_a": after})
    low, high = F.col("_b"), F.col("_a")
    between = low["value"] + (high["value"] - low["value"]) * (
        (F.col("_p") - low["at"]).cast("double") / (high["at"] - low["at"])
    )
    estimate = (
        F.when(value.isNotNull(), value)
        .when(low.isNotNull() & high.isNotNull(), between)
        .when(high.isNull() & low["second"], low["value"])
    )
    return around.select(*[estimate.alias(name) if c == name else column(c) for c in df.columns if c != TIE]).toDF(*names)


def _same_group(one: Column, other: Column, keys: Sequence[str]) -> Column:
    """Whether both known values exist and are of one group."""
    return reduce(lambda a, b: a & b, [one[k].eqNullSafe(other[k]) for k in keys], one.isNotNull() & other.isNotNull())


def _moved(known: Column, offset: Column, second: Column, keys: Sequence[str]) -> Column:
    """A known value with its place in the whole table; `second`: its group has a known value before it."""
    return F.when(known.isNotNull(), F.struct(
        (known["at"] + offset).alias("at"), known["value"].alias("value"), second.alias("second"), *[known[k].alias(k) for k in keys],
    ))


def _neighbours_across(placed: DataFrame, known: Column, keys: Sequence[str]) -> DataFrame:
    """Per range: row offset and the nearest known values before and behind it."""
    place = known["at"]
    per_range = placed.groupBy(RANGE).agg(
        F.count(F.lit(1)).alias("_rows"), F.max_by(known, place).alias("_last"), F.min_by(known, place).alias("_first")
    )
    placed_ranges = per_range.withColumn("_offset", F.coalesce(F.sum("_rows").over(_across()), F.lit(0)))
    last, first = F.col("_last"), F.col("_first")
    earlier = placed_ranges.withColumn("_earlier", F.last(last, ignorenulls=True).over(_across()))
    second = last["second"] | _same_group(F.col("_earlier"), last, keys)
    edges = earlier.select(
        RANGE, "_offset",
        _moved(last, F.col("_offset"), second, keys).alias("_last"),
        _moved(first, F.col("_offset"), first["second"], keys).alias("_first"),
    )
    return edges.select(
        RANGE, "_offset",
        F.last("_last", ignorenulls=True).over(_across()).alias("_carry_before"),
        F.last("_first", ignorenulls=True).over(_across(True)).alias("_carry_after"),
    )


def preview_rows(df: DataFrame, order_by: Sequence[str], k: int = 20) -> DataFrame:
    """The first `k` rows in row order; every task keeps `k` rows of what it scans."""
    require_columns(df, order_by)
    return df.orderBy(*[column(name) for name in order_by]).limit(k)


def first_values(
    df: DataFrame,
    names: Sequence[str],
    order_by: Sequence[str],
    k: int,
    where: dict[str, str] | None = None,
) -> DataFrame:
    """First `k` non-missing values of each column in row order, as rows (column, entry).

    One top-k per column: every task keeps `k` rows of the column it scans, nothing is sorted whole.
    `where` gives another SQL condition per column than not being missing. `entry` holds the order
    key, the text and (for numeric columns) the value as double, so sorting the entries of a column
    puts them in row order.
    """
    require_columns(df, order_by)
    at = ", ".join(f"{quoted(n)} AS k{i}" for i, n in enumerate(order_by))
    parts = []
    for name in names:
        field = field_of(df, name)
        wanted = f"NOT {missing_sql(field)}" if where is None else where[name]
        number = "value" if type_class(field.dataType) == "numeric" else "NULL"
        top = df.filter(wanted).selectExpr(f"struct({at}) AS at", f"{present_sql(field)} AS value")
        parts.append(
            top.orderBy("at").limit(k).selectExpr(
                f"{text_literal(name)} AS column",
                f"struct(at, CAST(value AS STRING) AS text, CAST({number} AS DOUBLE) AS number) AS entry",
            )
        )
    return reduce(DataFrame.unionAll, parts)
