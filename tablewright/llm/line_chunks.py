"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

Each line gets a 48-bit hash. A rolling hash over the last two line hashes cuts the document wherever it
falls into one of `CUT_EVERY` classes, so a passage of lines is cut alike wherever it stands and an
inserted line moves only the cuts next to it. Chunks of two and more lines that occur again, anywhere, go;
the first occurrence (smallest id, then position) stays. Hashes only propose: a chunk is removed after its
bytes equalled those of an earlier chunk.

Defined cases: a null text has no lines and stays null; an empty text is one empty line; chunks of empty
lines stay; rows that share an id are one document each but share an order place, so of two equal chunks at
the same place of the same id the ones of one row stay by the order of their texts. Rows without an id are
left as they are. Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm.base import Scratch, free_name, query, quoted, table

LINE_HASH_HEX = 12
ROLL_FACTOR = 8191
CUT_EVERY = 3
LEAST_LINES = 2

# Line numbers (from 0) at which a chunk begins.
CUTS = f"""filter(sequence(0, size(lines) - 1), i -> i = 0 OR
    pmod(hashes[i - 1] * {ROLL_FACTOR} + hashes[i], 1000003) % {CUT_EVERY} = 0)"""
LENGTH = "coalesce(try_element_at(cuts, k + 2), size(lines)) - at"


def chunked(rows: DataFrame) -> DataFrame:
    """One row per chunk of `rows` (rid, id, text): rid, id, first line `at`, n_lines, chunk."""
    lines = rows.select("rid", "id", F.split("text", "\n", -1).alias("lines"))
    hashed = lines.select(
        "*", F.expr(f"transform(lines, x -> cast(conv(substr(md5(x), 1, {LINE_HASH_HEX}), 16, 10) AS long))").alias("hashes")
    )
    cuts = hashed.select("rid", "id", "lines", F.expr(CUTS).alias("cuts"))
    # Chunks are put together before they become rows, so that no row carries the lines of its whole document.
    chunks = F.expr(
        f"transform(cuts, (at, k) -> struct(at, {LENGTH} AS n_lines, array_join(slice(lines, at + 1, {LENGTH}), '\n') AS chunk))"
    )
    # Each text has a chunk, so the outer form gives the same rows; the other form has Spark put a test of the array,
    # with all that makes it, into a filter at the scan.
    return cuts.select("rid", "id", chunks.alias("chunks")).select("rid", "id", F.inline_outer("chunks"))


def repeated_chunks(chunks: DataFrame, scratch: Scratch) -> DataFrame:
    """rid, id, at, n_lines of every multi-line chunk whose bytes stand earlier in the table."""
    proposed = chunks.where(f"n_lines >= {LEAST_LINES} AND length(chunk) >= n_lines").select(
        "*", F.xxhash64("chunk").alias("h")
    )
    again = scratch.write(proposed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    # Only chunks whose hash repeats travel with their text; grouping by the text itself compares bytes.
    # Merge joins at every size: what is sent follows the input, and hot chunks are split at run time.
    repeated = scratch.write(proposed.join(again.hint("merge"), "h", "left_semi"), "repeated")
    first = scratch.write(
        repeated.groupBy("h", "chunk").agg(F.min(F.struct("id", "at", "rid")).alias("first"), F.count("*").alias("n"))
        .where("n > 1").drop("n"),
        "first",
    )
    return (
        repeated.join(first.hint("merge"), ["h", "chunk"])
        .where(F.struct("id", "at", "rid") != F.col("first"))
        .select("rid", "id", "at", "n_lines")
    )


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with repeated multi-line chunks taken out of its text column, and n_lines, n_removed (lines).

    A document whose chunks all went keeps its row, with an empty text. If `df` has columns of these names,
    underscores are put behind the new ones.
    """
    key, rid, gone, lines = (free_name(x, df.columns) for x in ("_key", "_rid", "_gone", "_lines"))
    # Rows of one id and text are one document, in whatever table they are met.
    tagged = df.withColumn(key, quoted(id_col).cast("long")).withColumn(rid, F.xxhash64(text_col_or_empty(text_col)))
    rows = tagged.select(F.col(rid).alias("rid"), F.col(key).alias("id"), quoted(text_col).alias("text"))
    with Scratch(df.sparkSession, "line-chunks") as scratch:
        found = repeated_chunks(chunked(rows.where("id IS NOT NULL AND text IS NOT NULL")), scratch)
        found = found.groupBy("id", "rid").agg(
            F.flatten(F.collect_list(F.expr("sequence(at, at + n_lines - 1)"))).alias("gone")
        )
        found = scratch.keep(found).toDF(key, rid, gone)
    out = tagged.join(found.hint("merge"), [key, rid], "left").withColumn(lines, F.split(quoted(text_col), "\n", -1))
    kept = F.expr(
        f"array_join(transform(array_except(sequence(0, size(`{lines}`) - 1), `{gone}`), i -> `{lines}`[i]), '\n')"
    )
    return out.select(
        *[
            F.when(F.col(gone).isNull(), quoted(name)).otherwise(kept).alias(name) if name == text_col else quoted(name)
            for name in df.columns
        ],
        F.coalesce(F.when(quoted(text_col).isNotNull(), F.size(lines)), F.lit(0)).cast("long")
        .alias(free_name("n_lines", df.columns)),
        F.coalesce(F.when(F.col(gone).isNotNull(), F.size(gone)), F.lit(0)).cast("long")
        .alias(free_name("n_removed", df.columns)),
    )


def text_col_or_empty(name: str):
    return F.coalesce(quoted(name), F.lit(""))


SQL = f"""
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
line AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM lines),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, {LINE_HASH_HEX}))::BIGINT AS h FROM line),
cut AS (
  SELECT *, coalesce((((lag(h) OVER w) * {ROLL_FACTOR} + h) % 1000003) % {CUT_EVERY} = 0, true) AS starts
  FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM cut),
chunk AS (
  SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM numbered GROUP BY doc_id, k),
judged AS (
  SELECT *, n >= {LEAST_LINES} AND length(chunk) >= n
    AND row_number() OVER (PARTITION BY chunk, n >= {LEAST_LINES} ORDER BY doc_id, k) > 1 AS gone FROM chunk),
kept AS (
  SELECT doc_id, sum(n)::BIGINT AS n_lines,
    coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed,
    coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines,  coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""


@query("op10_line_dedup", SQL)
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    out = dedup_lines(documents)
    return out.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )
