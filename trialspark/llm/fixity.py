"""Merkle fixity audit of WARC replicas; DataFrame functions only.

The leaves are record digests. Records are hashed into ranges of file offsets, ranges into wider ranges and
files, files into groups by name hash, groups into one root for each replica. An audit compares the roots
and goes down only below nodes that differ, so equal parts of the replicas are never joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialspark.llm.common import held

#: Bits of the offset ranges, narrow to wide: 64 KiB, 4 MiB, 256 MiB, 16 GiB.
RANGE_BITS = (16, 22, 28, 34)
#: Groups of files by hash, narrow to wide.
FILE_GROUPS = (1 << 20, 1 << 12, 1 << 6)


def record_bytes(url: Column, body: Column) -> Column:
    """A WARC resource record as text: header, blank line, body, two line ends; nulls are empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def lay_out(records: DataFrame, per_file: int = 512) -> DataFrame:
    """Records (record_id, length, digest, ...) with the file and the offset at which they stand.

    A file holds the record ids of one range of per_file, in order of id and digest; records without id are
    spread over files by their digest. A file is no larger than its ids allow, and rows that repeat a record
    are one record with a number of copies.
    """
    more = [c for c in records.columns if c not in ("record_id", "length", "digest")]
    rows = records.groupBy("record_id", "length", "digest", *more).agg(F.count("*").alias("copies"))
    name = F.when(F.col("record_id").isNull(), F.concat(F.lit("none-"), F.substring("digest", 1, 3))).otherwise(
        F.concat(F.lit("part-"), F.floor(F.col("record_id") / per_file).cast("string")))
    place = Window.partitionBy("file").orderBy("record_id", "digest", *more).rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("length") * F.col("copies")
    return rows.withColumn("file", name).withColumn("offset", F.coalesce(F.sum(size).over(place), F.lit(0)))


def _node(children: str) -> Column:
    """Digest of the ordered (key, digest) pairs of a node's children."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(children).cast("string").alias("key"), "hash")))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: F.concat(x["key"], F.lit(":"), x["hash"])), ",").cast("binary"), 256)


class Tree:
    """The levels of one replica, root first; each level has the keys of its nodes, their parents' keys, and `hash`."""

    def __init__(self, inventory: DataFrame, label: str):
        self.spark = inventory.sparkSession
        leaf = F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), F.col("copies").cast("string"), "digest").cast("binary"), 256)
        ranges = [F.shiftright("offset", bits).alias(f"r{bits}") for bits in RANGE_BITS]
        groups = [F.pmod(F.xxhash64("file"), F.lit(n)).alias(f"g{n}") for n in FILE_GROUPS]
        self.records = held(inventory.select("file", "offset", "length", "record_id", "copies", "digest", *ranges, *groups, leaf.alias("hash")), label)
        path = [f"g{n}" for n in reversed(FILE_GROUPS)] + ["file"] + [f"r{bits}" for bits in reversed(RANGE_BITS)] + ["offset"]
        self.paths = [path[:i] for i in range(len(path) + 1)]
        level, self.levels = self.records.select(*path, "hash"), []
        for keys in reversed(self.paths[:-1]):
            child = path[len(keys)]
            level = level.groupBy(*keys).agg(_node(child).alias("hash"))
            level = held(level, f"{label}-{child}") if len(keys) in (4, 8) else level
            self.levels.insert(0, level)


def audit(replica_a: DataFrame, replica_b: DataFrame) -> DataFrame:
    """Where two inventories (file, offset, length, record_id, copies, digest) of one collection differ.

    One row for each differing record: file, offset, record_id, fault (changed, lost: only in a, added: only in
    b), digest_a, digest_b. Equal inventories, empty ones too, give no row. Null files or offsets are not
    allowed; a null digest equals only a null digest. Other columns are ignored.
    """
    a, b = Tree(replica_a, "replica-a"), Tree(replica_b, "replica-b")
    if a.levels[0].first() == b.levels[0].first():  # equal roots: nothing below is compared
        return a.spark.createDataFrame([], "file string, offset long, record_id long, fault string, digest_a string, digest_b string")
    bad: DataFrame | None = None
    for keys, la, lb in list(zip(a.paths, a.levels, b.levels))[1:]:
        if bad is not None:
            la, lb = (x.join(bad, keys[:-1], "left_semi") for x in (la, lb))
        both = la.select(*keys, F.col("hash").alias("ha")).join(lb.select(*keys, F.col("hash").alias("hb")), keys, "full_outer")
        bad = both.filter(~F.col("ha").eqNullSafe(F.col("hb"))).select(*keys)
        if len(keys) in (4, 8):
            bad = held(bad, "differing")
    keys = a.paths[-2]
    left, right = (t.records.join(bad, keys, "left_semi") for t in (a, b))
    left = left.select("file", "offset", "record_id", F.col("digest").alias("digest_a"), F.col("hash").alias("ha"))
    right = right.select("file", "offset", F.col("record_id").alias("id_b"), F.col("digest").alias("digest_b"), F.col("hash").alias("hb"))
    both = left.join(right, ["file", "offset"], "full_outer").filter(~F.col("ha").eqNullSafe(F.col("hb")))
    fault = F.when(F.col("hb").isNull(), "lost").when(F.col("ha").isNull(), "added").otherwise("changed")
    return both.select("file", "offset", F.coalesce("record_id", "id_b").alias("record_id"), fault.alias("fault"), "digest_a", "digest_b")


def replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inventories of two copies of the pages as WARC files, the second with planted damage.

    By a hash of page_id, about one record in 97 has its first body character overwritten and one in 89 is lost.
    """
    draw = lambda word, n: F.conv(F.substring(F.md5(F.concat(F.lit(word), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).cast("binary")), 1, 4), 16, 10).cast("long") % n == 0
    body = F.coalesce(F.col("html"), F.lit(""))
    broken = F.concat(F.lit("~"), F.substring(body, 2, 2147483647))
    good = record_bytes(F.col("url"), body)
    records = pages.select(
        F.col("page_id").cast("long").alias("record_id"), F.octet_length(good).cast("long").alias("length"), F.sha2(good.cast("binary"), 256).alias("digest"),
        F.when(draw("rot", 97), F.sha2(record_bytes(F.col("url"), broken).cast("binary"), 256)).alias("damaged"), draw("lost", 89).alias("lost"))
    files = held(lay_out(records), "warc-files")
    second = files.filter("NOT lost").withColumn("digest", F.coalesce("damaged", "digest"))
    return files.drop("damaged", "lost"), second.drop("damaged", "lost")


FIXITY_SQL = r"""
WITH rec AS (
  SELECT page_id AS record_id, coalesce(html, '') AS body,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' AS head,
         chr(13) || chr(10) || chr(13) || chr(10) AS gap,
         CAST('0x' || substr(md5('rot' || coalesce(CAST(page_id AS VARCHAR), '')), 1, 4) AS INT) % 97 = 0 AS rot,
         CAST('0x' || substr(md5('lost' || coalesce(CAST(page_id AS VARCHAR), '')), 1, 4) AS INT) % 89 = 0 AS lost
  FROM pages),
bytes AS (
  SELECT *, head || strlen(body) || gap || body || gap AS good, '~' || substr(body, 2) AS bad FROM rec),
dig AS (
  SELECT record_id, CAST(strlen(good) AS BIGINT) AS length, sha256(good) AS digest,
         CASE WHEN rot THEN sha256(head || strlen(bad) || gap || bad || gap) END AS damaged, lost FROM bytes),
one AS (SELECT record_id, length, digest, damaged, lost, count(*) AS copies FROM dig GROUP BY ALL),
named AS (
  SELECT *, CASE WHEN record_id IS NULL THEN 'none-' || substr(digest, 1, 3) ELSE 'part-' || CAST(CAST(floor(record_id / 512) AS BIGINT) AS VARCHAR) END AS file FROM one),
laid AS (
  SELECT *, CAST(coalesce(sum(length * copies) OVER (PARTITION BY file ORDER BY record_id NULLS FIRST, digest, damaged NULLS FIRST, lost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM named)
SELECT file, "offset", record_id, CASE WHEN lost THEN 'lost' ELSE 'changed' END AS fault, digest AS digest_a, CASE WHEN NOT lost THEN damaged END AS digest_b
FROM laid WHERE lost OR damaged <> digest
"""
