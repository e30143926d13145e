"""WARC archives of pages, and a Merkle fixity audit of their replicas.

Pages become WARC response records, ordered by id within volumes of `VOLUME_IDS` ids. A leaf of the tree hashes a
record's digest with its offset range in the volume; a node hashes its up to 256 children in order with the range
they span, up to one root. Two replicas are compared from the root down: of each level only the children of
nodes that differ are looked at, so an intact replica costs one comparison and a damaged one the branches
that lead to the damage. What is left are places; they are told apart by record: altered, missing, added, or
moved (same bytes, other offset, as behind a lost record).

Everything is joins and small groups: a node has at most 256 children, a volume window holds counts, not pages.
Records of one id (pages that differ) are counted in parts by the head of their digest, so a hot id is many groups.

Defined cases: a null url or page counts as empty; equal records of one id are one record; rows without an id are
left out; an empty table has an empty tree, equal to another empty tree. Extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablewright.llm.base import Scratch, query, quoted, table

VOLUME_IDS = 512
VOLUME_RECORDS = 4096
FAN_BITS = 8
PART_DIGITS = 3
DATE = "1970-01-01T00:00:00Z"
BREAK = "\r\n"


def record_text(key: Column, url: Column, page: Column, date: str = DATE) -> Column:
    """One WARC response record as text; it ends with two line breaks."""
    url, page = F.coalesce(url, F.lit("")), F.coalesce(page, F.lit(""))
    lines = [
        F.lit("WARC/1.0"), F.lit("WARC-Type: response"), F.concat(F.lit("WARC-Record-ID: <urn:page:"), key.cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.lit(date)), F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.octet_length(page).cast("string")),
    ]
    return F.concat(F.concat_ws(BREAK, *lines), F.lit(BREAK * 2), page, F.lit(BREAK * 2))


def records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", page_col: str = "html") -> DataFrame:
    """id, record text."""
    rows = df.where(quoted(id_col).isNotNull())
    key = quoted(id_col).cast("long")
    return rows.select(key.alias("id"), record_text(key, quoted(url_col), quoted(page_col)).alias("record"))


def write_warc(rows: DataFrame, path: str) -> None:
    """Records (id, record) as WARC files, one folder per volume and no file across two of them."""
    volumes = rows.select(F.floor(F.col("id") / VOLUME_IDS).alias("volume"), "id", F.expr("left(record, length(record) - 4)").alias("value"))
    volumes.repartition("volume").sortWithinPartitions("volume", "id").select("volume", "value").write.partitionBy("volume").option(
        "lineSep", BREAK * 2
    ).option("maxRecordsPerFile", VOLUME_RECORDS).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """id, record of all records of WARC files written by `write_warc`; records are found by their stated lengths."""

    def parsed(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                raw, at, ids, texts = batch.column(0)[k].as_py(), 0, [], []
                while at < len(raw):
                    body = raw.index(b"\r\n\r\n", at) + 4
                    head = dict(x.split(": ", 1) for x in raw[at : body - 4].decode().split("\r\n")[1:])
                    end = body + int(head["Content-Length"]) + 4
                    ids.append(int(head["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")))
                    texts.append(raw[at:end].decode())
                    at = end
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["id", "record"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.select("content").mapInArrow(parsed, "id long, record string")


def leaves(rows: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Manifest of a replica: id, volume, place in the volume, offset, length and digest of each record.

    Records of a volume are ordered by id and digest. Those of one id are counted in parts by the head of the digest,
    and parts start where the parts before them end, so no group holds all records of an id. Without `scratch`
    the records are hashed twice.
    """
    digests = rows.select(
        "id", F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("digest")
    ).distinct()
    digests = digests.select(F.floor(F.col("id") / VOLUME_IDS).alias("volume"), "id", F.left("digest", F.lit(PART_DIGITS)).alias("part"), "length", "digest")
    if scratch is not None:
        digests = scratch.write(digests, "digests")
    key = ["volume", "id", "part"]
    earlier = Window.partitionBy("volume").orderBy("id", "part").rowsBetween(Window.unboundedPreceding, -1)
    totals = digests.groupBy(*key).agg(F.count("*").alias("count"), F.sum("length").alias("size"))
    starts = totals.select(*key, *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_before") for x in ("count", "size")])
    order = Window.partitionBy(*key).orderBy("digest")
    inside = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = digests.select(*key, "length", "digest", (F.row_number().over(order) - 1).alias("rank"), inside.alias("inside"))
    return placed.join(starts.hint("merge"), key).select(
        "id", "volume", (F.col("count_before") + F.col("rank")).cast("long").alias("place"),
        (F.col("size_before") + F.col("inside")).cast("long").alias("offset"), "length", "digest",
    )


@dataclass(frozen=True)
class Shape:
    """What two replicas' trees have in common: levels within a volume, and levels over volumes up to one root."""

    within: int
    over: int

    @classmethod
    def of(cls, *manifests: DataFrame) -> Shape | None:
        """None if there are no records at all."""
        found = [m.agg(F.max("place"), F.min("volume"), F.max("volume")).first() for m in manifests]
        found = [x for x in found if x[0] is not None]
        if not found:
            return None
        high, first, last, within, over = max(x[0] for x in found), min(x[1] for x in found), max(x[2] for x in found), 0, 0
        while high >> FAN_BITS * within:
            within += 1
        while first >> FAN_BITS * over != last >> FAN_BITS * over:
            if (first >> FAN_BITS * over, last >> FAN_BITS * over) == (-1, 0):  # shifting leaves these two apart
                return cls(within, over + 1)
            over += 1
        return cls(within, over)

    def parent(self, level: int) -> list[Column]:
        """Key of the node above one of this level."""
        if level < self.within:
            return [F.col("volume"), F.shiftright("place", FAN_BITS)]
        last = level == self.within + self.over - 1
        return [F.lit(0).cast("long") if last else F.shiftright("volume", FAN_BITS), F.lit(0).cast("long")]


def tree(manifest: DataFrame, shape: Shape, scratch: Scratch, name: str) -> list[DataFrame]:
    """Levels of (volume, place, hash), leaves first, up to a single root; a level is written before the next is made."""
    level = manifest.select(
        "volume", "place", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"),
        F.sha2(F.concat_ws(":", "offset", "length", "digest"), 256).alias("hash"),
    )
    levels = [scratch.write(level, f"{name}-0")]
    for k in range(shape.within + shape.over):
        volume, place = shape.parent(k)
        children = F.array_sort(F.collect_list(F.struct("volume", "place", "hash")))  # 256 at most
        level = levels[-1].groupBy(volume.alias("volume"), place.alias("place")).agg(
            children.alias("children"), F.min("start").alias("start"), F.max("stop").alias("stop")
        )
        child = "transform(children, c -> concat_ws('=', c.volume, c.place, c.hash))"
        level = level.select("volume", "place", "start", "stop", F.sha2(F.concat_ws(":", F.expr(child), "start", "stop"), 256).alias("hash"))
        levels.append(scratch.write(level, f"{name}-{len(levels)}"))
    return levels


def mismatched_places(left: list[DataFrame], right: list[DataFrame], shape: Shape, scratch: Scratch) -> DataFrame:
    """volume, place of every leaf that differs, found from the roots down."""
    key = ["volume", "place"]
    roots = [x[-1].select("hash").collect() for x in (left, right)]  # one row each, or none
    if roots[0] == roots[1]:
        return left[0].select(*key).limit(0)
    suspect = None
    for level in range(len(left) - 1, -1, -1):
        a, b = left[level].select(*key, "hash"), right[level].select(*key, F.col("hash").alias("other"))
        if suspect is not None and level + 2 < len(left):  # below the root every branch is a child
            volume, place = shape.parent(level)
            parents = suspect.select(F.col("volume").alias("above_volume"), F.col("place").alias("above_place"))
            a, b = (x.join(parents, (volume == F.col("above_volume")) & (place == F.col("above_place")), "left_semi") for x in (a, b))
        suspect = a.join(b, key, "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select(*key)
        suspect = scratch.write(suspect, f"differs-{level}")
    return suspect


def audit(left: DataFrame, right: DataFrame, scratch: Scratch) -> DataFrame:
    """id, digest, status of the records at places where the replicas differ; `left` and `right` are manifests.

    altered: the id is in both with other bytes; missing or added: in the left or right one only; moved: the same
    record elsewhere.
    """
    shape = Shape.of(left, right) or Shape(0, 0)
    places = mismatched_places(tree(left, shape, scratch, "left"), tree(right, shape, scratch, "right"), shape, scratch)
    a, b = (x.join(places, ["volume", "place"], "left_semi").select("id", "digest") for x in (left, right))
    same = a.join(b, ["id", "digest"]).select("id", "digest", F.lit("moved").alias("status"))
    lost, new = a.join(b, ["id", "digest"], "left_anti"), b.join(a, ["id", "digest"], "left_anti")
    changed = lost.join(new.select("id").distinct(), "id", "left_semi").select("id", "digest", F.lit("altered").alias("status"))
    missing = lost.join(new, "id", "left_anti").select("id", "digest", F.lit("missing").alias("status"))
    added = new.join(lost, "id", "left_anti").select("id", "digest", F.lit("added").alias("status"))
    return same.union(changed).union(missing).union(added)


def damaged(rows: DataFrame) -> DataFrame:
    """A replica with stated damage, for the query: of every 997 ids one record is lost and three have a byte changed."""
    spoilt = F.expr("overlay(record placing '#' from 1 + length(record) div 2 for 1)")
    kept = rows.where("pmod(id, 997) <> 13")
    return kept.select("id", F.when(F.expr("pmod(id, 997) IN (101, 355, 700)"), spoilt).otherwise(F.col("record")).alias("record"))


_SQL_RECORD = (
    "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' "
    f"|| chr(13) || chr(10) || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) "
    "|| 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) "
    "|| chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"
)
SQL = f"""
WITH record AS (SELECT DISTINCT page_id, {_SQL_RECORD} AS record FROM pages WHERE page_id IS NOT NULL),
manifest AS (
  SELECT page_id, floor(page_id / {VOLUME_IDS})::BIGINT AS volume, strlen(record)::BIGINT AS record_length,
    sha256(record) AS record_sha256,
    -- Where its middle character is '#' already, the change leaves a record as it was.
    substr(record, (1 + length(record) // 2)::BIGINT, 1) <> '#' AS changes FROM record),
placed AS (
  SELECT *, coalesce(sum(record_length) OVER before, 0)::BIGINT AS record_offset,
    coalesce(sum((page_id % 997 = 13)::INT) OVER before, 0) AS lost FROM manifest
  WINDOW before AS (PARTITION BY volume ORDER BY page_id, record_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT page_id, volume, record_offset, record_length, record_sha256,
  CASE WHEN page_id % 997 = 13 THEN 'missing' WHEN page_id % 997 IN (101, 355, 700) AND changes THEN 'altered'
    WHEN lost > 0 THEN 'moved' ELSE 'intact' END AS status
FROM placed
"""


@query("op7_warc_fixity", SQL)
def op7_warc_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archive of `pages` with its place, digest and state in a damaged replica."""
    pages = records(table(spark, folder, "pages"))
    with Scratch(spark, "warc") as scratch:
        left = scratch.keep(leaves(pages, scratch), "left")
        right = scratch.write(leaves(damaged(pages), scratch), "right")
        found = scratch.keep(audit(left, right, scratch).where("status <> 'added'"), "found")
    return left.join(found, ["id", "digest"], "left").select(
        F.col("id").alias("page_id"), "volume", F.col("offset").alias("record_offset"), F.col("length").alias("record_length"),
        F.col("digest").alias("record_sha256"), F.coalesce("status", F.lit("intact")).alias("status"),
    )
