"""Duplicate rows: counting, listing and removing them.

Missing values are equal to each other. All grouping is by keyed aggregation with map-side
combining, so a group holding a third of the table costs one row per task in the shuffle.

Keys of unbounded length are counted by a 64-bit hash first. The hashes that repeat are stored once and counted. Up to
MOST_SENT_HASHES of them are sent to all tasks, more become a bit filter: either way rows without an equal are dropped where
they are read, and what passes is grouped by its whole key. Listing duplicates then needs no keys at all but
for hashes that two keys share: a hash whose keys all repeat names its rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.columns import (
    INTEGRAL, by_position, column, field_of, free_name, nan_to_null, positions, quoted, require_columns, type_class,
)
from tablewright.sources.storage import has_storage, stored_counted, stored_if_shared

# A hash with at least 1/HOT_KEYS of all rows is hot, so there are at most HOT_KEYS hot hashes of eight bytes.
HOT_KEYS = 1000

# Repeated hashes that are broadcast as they are (8 bytes each).
MOST_SENT_HASHES = 1 << 20

# Bits of the filter per repeated hash, and the most that it may have (8 MB): beyond, it lets more rows pass.
BITS_PER_HASH, MOST_FILTER_BITS = 16, 26


def _keys(df: DataFrame, subset: Sequence[str] | None) -> list[str]:
    if subset is None:
        return list(df.columns)
    if not isinstance(subset, (list, tuple)):
        raise TypeError(f"give the subset as a list of column names, not as {type(subset).__name__}")
    require_columns(df, subset)
    return list(subset)


def _is_wide(df: DataFrame, keys: Sequence[str]) -> bool:
    """Text and nested keys have no bound on their length."""
    kinds = {f.name: type_class(f.dataType) for f in df.schema.fields}
    return any(kinds[k] in ("text", "other") for k in keys)


def _sizes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*[column(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))


def _hash_of(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def _repeated_hashes(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """_hash of the keys and its rows `n`, where there are several, and how many hashes these are: eight bytes a row in the shuffle."""
    hashes = _sizes(rows.select(_hash_of(keys).alias("_hash")), ["_hash"]).filter("n > 1")
    if has_storage(rows.sparkSession):
        hashes, seen = stored_counted(hashes, "repeated-hashes")
        return hashes, seen.rows
    return hashes, hashes.count()


def _passing(rows: DataFrame, keys: Sequence[str], hashes: DataFrame, count: int) -> DataFrame:
    """Rows, with their `_hash`, that may have an equal: all with a repeated hash, and few others if these are many."""
    hashed = rows.withColumn("_hash", _hash_of(keys))
    if count <= MOST_SENT_HASHES:
        return hashed.join(F.broadcast(hashes.select("_hash")), "_hash", "left_semi").select(*rows.columns, "_hash")
    bits = min(MOST_FILTER_BITS, max(10, (BITS_PER_HASH * count - 1).bit_length()))
    slot = f"shiftrightunsigned(_hash, {64 - bits})"
    words = hashes.groupBy(F.expr(f"{slot} DIV 64").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, CAST({slot} % 64 AS INT)))").alias("bits"))
    whole = rows.sparkSession.range(1 << (bits - 6)).join(words, F.col("id") == F.col("word"), "left")
    filled = whole.agg(F.expr("transform(array_sort(collect_list(struct(id, coalesce(bits, 0L) AS bits))), w -> w.bits)").alias("words")).scalar()
    word = F.get(filled, F.expr(f"CAST({slot} DIV 64 AS INT)"))
    return hashed.filter(F.getbit(word, F.expr(f"CAST({slot} % 64 AS INT)")) == 1)


def _repeated(rows: DataFrame, keys: Sequence[str], wide: bool) -> DataFrame:
    """Keys of a table named by position that occur more than once, with their row counts `n`."""
    rows = rows.select(*keys)
    if wide:
        rows = _passing(rows, keys, *_repeated_hashes(rows, keys))
    return _sizes(rows, keys).filter("n > 1")


def _repeated_of(df: DataFrame, subset: Sequence[str] | None) -> tuple[list[str], DataFrame]:
    keys = _keys(df, subset)
    return keys, _repeated(by_position(nan_to_null(df, keys)), positions(df, keys), _is_wide(df, keys))


def repeated_groups(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Keys that occur more than once, with their row counts `n` (`n_` if a key is called so).

    Long keys are grouped by hash first: only rows whose hash occurs twice are compared in full,
    so unique rows cost eight bytes each in the shuffle.
    """
    keys, groups = _repeated_of(df, subset)
    return groups.toDF(*keys, free_name("n", keys))


def duplicate_counts(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows in groups of more than one, rows beyond the first of each group, and such groups."""
    return _repeated_of(df, subset)[1].agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_duplicate_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_surplus_rows"),
        F.count(F.lit(1)).alias("n_groups"),
    )


def duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Every row that has an equal row on the keys."""
    keys = positions(df, _keys(df, subset))
    rows = by_position(nan_to_null(df, _keys(df, subset)))
    hashes, count = _repeated_hashes(rows, keys)
    passing = _passing(rows, keys, hashes, count)
    # Of each hash its keys, and those with several rows; two keys under one hash are a rare meeting.
    groups = _sizes(passing.select(*keys), keys).withColumn("_hash", _hash_of(keys))
    seen = groups.groupBy("_hash").agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") > 1).alias("repeated")).filter("repeated < keys")
    if count <= MOST_SENT_HASHES:
        odd = seen
    else:  # what the bit filter let pass by chance stands alone under its hash
        odd = seen.filter("repeated > 0 OR keys > 1")
        passing = _of_hashes(passing, hashes, df.agg(F.count(F.lit(1)).alias("rows")).scalar())
    mixed = odd.select("_hash")
    if mixed.isEmpty():
        return passing.drop("_hash").toDF(*df.columns)
    mixed = stored_if_shared(mixed, "mixed-hashes")
    named = _sizes(passing.join(mixed.hint("merge"), "_hash", "left_semi").select(*keys), keys).filter("n > 1").select(*[F.col(k).alias(f"_k{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys])
    plain = passing.join(mixed.hint("merge"), "_hash", "left_anti").select(*rows.columns)
    told = passing.join(mixed.hint("merge"), "_hash", "left_semi").select(*rows.columns).join(named.hint("merge"), same, "left_semi")
    return plain.unionAll(told).toDF(*df.columns)


def _of_hashes(passing: DataFrame, hashes: DataFrame, total: Column) -> DataFrame:
    """Rows with one of the hashes; hot ones are matched by a broadcast (at most HOT_KEYS of them), so none is gathered."""
    is_hot = F.col("n") * F.lit(HOT_KEYS) >= total
    hot = F.broadcast(hashes.filter(is_hot).select("_hash"))
    cold = hashes.filter(~is_hot).select("_hash").hint("merge")
    kept = passing.join(hot, "_hash", "left_semi").unionAll(passing.join(hot, "_hash", "left_anti").join(cold, "_hash", "left_semi"))
    return kept.select(*passing.columns)


def duplicate_sample(df: DataFrame, subset: Sequence[str], order_by: Sequence[str], k: int = 5) -> DataFrame:
    """First `k` duplicated rows in row order."""
    require_columns(df, order_by)
    return duplicate_rows(df, subset).orderBy(*[column(c) for c in order_by]).limit(k)


def remove_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = "first",
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """One row per group (`first` or `last` in row order), or with `keep=False` only rows without an equal.

    Whole-row duplicates are identical, so only a subset of columns needs `order_by`.
    """
    if keep is not False and keep not in ("first", "last"):
        raise ValueError(f"keep={keep!r} is not known; say 'first', 'last' or False")
    keys = _keys(df, subset)
    whole_row = set(keys) == set(df.columns)
    clean = nan_to_null(df, keys)
    if keep is not False and whole_row:
        return clean.dropDuplicates()
    groups = clean.groupBy(*[column(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    if keep is False:
        members = [F.count(F.lit(1)).alias("_n"), *_picked(clean, "any_value({})")]
        return groups.agg(*members).filter("_n = 1").selectExpr(*_unpacked(clean))
    if not order_by:
        raise ValueError("keeping the first or last row of a subset needs order_by")
    require_columns(df, order_by)
    pick = "min_by" if keep == "first" else "max_by"
    return groups.agg(*_picked(clean, f"{pick}({{}}, {_order_sql(df, order_by)})")).selectExpr(*_unpacked(clean))


def _order_sql(df: DataFrame, order_by: Sequence[str]) -> str:
    """An order without nulls (min_by and max_by skip those): nulls come first.

    A single whole-number key stays a number, which keeps the aggregate hash-based.
    """
    if len(order_by) == 1 and isinstance(field_of(df, order_by[0]).dataType, INTEGRAL):
        return f"coalesce(CAST({quoted(order_by[0])} AS BIGINT), CAST('{-(2**63)}' AS BIGINT))"
    return f"struct({', '.join(map(quoted, order_by))})"


def _hash_aggregated(df: DataFrame) -> bool:
    """Whether all columns have a fixed width, so that aggregates of them need no sort."""
    return not any(type_class(f.dataType) in ("text", "other") for f in df.schema.fields)


def _picked(df: DataFrame, pick: str) -> list[Column]:
    """One row of a group: column by column if that stays hash-aggregated, else as one struct."""
    names = [quoted(c) for c in df.columns]
    if _hash_aggregated(df):
        return [F.expr(f"{pick.format(name)} AS _c{i}") for i, name in enumerate(names)]
    return [F.expr(f"{pick.format('struct(' + ', '.join(names) + ')')} AS _row")]


def _unpacked(df: DataFrame) -> list[str]:
    if _hash_aggregated(df):
        return [f"_c{i} AS {quoted(c)}" for i, c in enumerate(df.columns)]
    return ["_row.*"]
