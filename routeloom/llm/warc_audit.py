"""Merkle fixity audit of WARC replicas, in DataFrame operations.

Records of an archive are kept in segments.  Within a segment a record has a slot, and its
offset is the total length of the records before it.  Level 0 of the tree holds the hash of
each record with its slot and length; a node of level k covers FANOUT^k consecutive slots,
that is one ordered range of offsets: it hashes the range's extent in bytes and its children
in order.  The root of a segment is the top level.  A variant is taken on purpose: a range's
start follows from the extents before it and is no part of its own hash, for one shortened
record would else unsettle every range behind it.

``audit`` compares two replicas, each node table written once: roots first, then the children
of differing nodes only, one join on the node key for each level.  What is shuffled is 32-byte
hashes of records, and from there on less by a factor of FANOUT at each level; payloads are
hashed where they are read.  Missing and additional records are found the same way, since
slots don't move.

Segments come from the id range, so a segment holds at most SEGMENT distinct ids.  Rows that
repeat an id, or have none, become one leaf: sums of four 60-bit parts of their hashes, which
add up before the shuffle and over any split of the rows, however many there are.

Defined results: a null url or payload counts as empty but hashes apart from an empty one
(its length field is -1); equal replicas give no rows; empty tables give no rows; records
with a null id form segment -1; additional columns are ignored.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

FANOUT_BITS = 4
LEVELS = 3
#: Slots of a segment: FANOUT ** LEVELS.
SEGMENT = 1 << (FANOUT_BITS * LEVELS)
#: Bytes read, and bytes of records handed on, at a time.
PIECE = 1 << 22
#: Fixed value: how a gzip member starts.
MEMBER_HEAD = b"\x1f\x8b\x08"


def record_text(uri, payload):
    """The WARC record of a payload, without its id and date lines, as a text column."""
    size = F.coalesce(F.octet_length(payload), F.lit(-1)).cast("string")
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Length: "), size, F.lit("\r\n\r\n"), F.coalesce(payload, F.lit("")), F.lit("\r\n\r\n"))


def leaves(records: DataFrame, id_col: str, uri_col: str, payload_col: str) -> DataFrame:
    """segment, slot, length, h: one leaf for each id; only lengths and hashes leave the scan."""
    text = record_text(F.col(uri_col), F.col(payload_col))
    hashed = records.select(F.col(id_col).cast("long").alias("record_id"), F.octet_length(text).cast("long").alias("n"), F.sha2(text, 256).alias("h"))
    slot = F.coalesce(F.pmod("record_id", F.lit(SEGMENT)), F.lit(0)).cast("int")
    part = [F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(part)]
    one = hashed.groupBy("record_id").agg(F.sum("n").alias("n"), F.count("*").alias("copies"), F.min("h").alias("h"), *sums)
    several = F.sha2(F.concat_ws(",", "copies", "s0", "s1", "s2", "s3"), 256)
    return one.select(F.coalesce(F.floor(F.col("record_id") / SEGMENT), F.lit(-1)).cast("long").alias("segment"), slot.alias("slot"), "record_id", "n", F.when(F.col("copies") == 1, F.col("h")).otherwise(several).alias("h"))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Node tables of level 0 (records, with offsets) to LEVELS (segment roots): segment, node, length, h; each is written once."""
    from pyspark.sql import Window

    so_far = Window.partitionBy("segment").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # at most SEGMENT rows
    level0 = leaf.withColumn("offset", F.coalesce(F.sum("n").over(so_far), F.lit(0)).cast("long"))
    base = level0.select("segment", F.col("slot").alias("node"), "record_id", "offset", F.col("n").alias("length"), F.sha2(F.concat_ws(":", "slot", "n", "h"), 256).alias("h"), F.col("h").alias("content"))
    levels = [checkpointed(base)]
    for _ in range(LEVELS):
        children = F.transform(F.array_sort(F.collect_list(F.struct("node", "h"))), lambda x: F.concat_ws("=", x["node"], x["h"]))  # at most FANOUT
        above = levels[-1].groupBy("segment", F.shiftright("node", FANOUT_BITS).alias("node")).agg(F.sum("length").alias("length"), F.concat_ws("|", children).alias("children"))
        levels.append(checkpointed(above.select("segment", "node", "length", F.sha2(F.concat_ws(":", "length", "children"), 256).alias("h"))))
    return levels


def descend(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """Records whose leaf differs, reached through differing nodes only."""

    def differ(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.alias("x").join(y.alias("y"), ["segment", "node"], "full").where(~F.col("x.h").eqNullSafe(F.col("y.h")))

    open_nodes = differ(a[-1], b[-1]).select("segment", F.col("node").alias("parent"))
    for level in range(LEVELS - 1, -1, -1):
        up = open_nodes

        def under(nodes: DataFrame, up: DataFrame = up) -> DataFrame:
            return nodes.withColumn("parent", F.shiftright("node", FANOUT_BITS)).join(up, ["segment", "parent"], "left_semi")

        found = differ(under(a[level]), under(b[level]))
        if level:
            open_nodes = found.select("segment", F.col("node").alias("parent"))
    return found.select(
        F.coalesce("x.record_id", "y.record_id").alias("record_id"),
        "segment",
        F.col("node").cast("long").alias("slot"),
        F.col("x.offset").alias("offset"),
        F.col("x.length").alias("length"),
        F.when(F.col("y.content").isNull(), "missing").when(F.col("x.content").isNull(), "additional").otherwise("content").alias("kind"),
    )


def audit(original: DataFrame, replica: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """record_id, segment, slot, offset, length, kind of every record that the replica doesn't hold as the original does; offset and length are the original's."""
    return descend(tree(leaves(original, id_col, uri_col, payload_col)), tree(leaves(replica, id_col, uri_col, payload_col)))


def roots(records: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """segment and root hash, what a replica publishes."""
    return tree(leaves(records, id_col, uri_col, payload_col))[-1].select("segment", F.col("h").alias("root"))


def write_warc(records: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> None:
    """One gzip stream for each file, SEGMENT ids to a folder; records can't be read by offset, and damage to a file loses what is behind it."""
    text = record_text(F.col(uri_col), F.col(payload_col))
    # the writer ends each record with the line break that is taken off here
    with_segment = records.select(F.coalesce(F.floor(F.col(id_col) / SEGMENT), F.lit(-1)).alias("segment"), F.col(id_col).alias("k"), F.substring(text, F.lit(1), F.length(text) - 2).alias("value"))
    with_segment.repartition("segment").sortWithinPartitions("segment", "k").drop("k").write.partitionBy("segment").option("compression", "gzip").option("lineSep", "\r\n").text(path)


def _members(raw: bytes) -> Iterator[tuple[bytes, str | None]]:
    """The plain bytes of each gzip member and what is wrong with it; after damage the next member's head is looked for."""
    at = 0
    while 0 <= at < len(raw):
        d, out, end = zlib.decompressobj(31), [], at
        try:
            while end < len(raw) and not d.eof:
                out.append(d.decompress(raw[end : end + PIECE]))
                end += PIECE
            yield b"".join(out), None if d.eof else "truncated member"
            at = min(end, len(raw)) - len(d.unused_data)
        except zlib.error as e:
            yield b"".join(out), f"damaged member: {e}"
            at = raw.find(MEMBER_HEAD, at + 1)


def warc_records(raw: bytes) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """(uri, payload, damage) of the records in a plain or gzip WARC file; what can't be read gives a row that says so, and reading goes on behind it."""
    for plain, damage in _members(raw) if raw[:2] == b"\x1f\x8b" else [(raw, None)]:
        stream = io.BytesIO(plain)
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                if line.strip():
                    yield None, None, "no record where one should start"
                    found = plain.find(b"\nWARC/", stream.tell() - 1)
                    if found < 0:
                        break
                    stream.seek(found + 1)
                continue
            head = {}
            while (line := stream.readline()).strip() != b"":
                name, _, value = line.partition(b":")
                head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
            uri, size = head.get(b"warc-target-uri"), head.get(b"content-length", "")
            if not re.fullmatch(r"-?\d+", size):
                yield uri, None, "no content length"
                continue
            payload = stream.read(int(size)) if int(size) >= 0 else None
            short = payload is not None and len(payload) < int(size)
            yield uri, payload, (damage or "truncated record") if short else None
        if damage:
            yield None, None, damage


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """url, html, file and damage of the records of gzip or plain WARC files.

    A file is one task's work; it is held packed, and beside it the member that is being read; a record whose payload isn't UTF-8 says so in
    ``damage`` and reads with replacement characters; unreadable members and records give a row
    with their damage instead of ending the audit.
    """

    def text(payload: bytes | None, damage: str | None) -> tuple[str | None, str | None]:
        if payload is None:
            return None, damage
        try:
            return payload.decode("utf-8"), damage
        except UnicodeDecodeError:
            return payload.decode("utf-8", "replace"), damage or "payload is not UTF-8"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], pa.string()) for i in range(4)], names=["url", "html", "file", "damage"])

        for batch in batches:
            for i in range(batch.num_rows):
                file, held, size = batch.column("path")[i].as_py(), [], 0
                for uri, payload, damage in warc_records(batch.column("content")[i].as_py()):
                    html, damage = text(payload, damage)
                    held.append((uri, html, file, damage))
                    size += len(payload or b"")
                    if size > PIECE:
                        yield rows(held)
                        held, size = [], 0
                yield rows(held)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(parse, "url string, html string, file string, damage string")


def damaged_replica(pages: DataFrame) -> DataFrame:
    """The replica that the query audits: known damage at known ids (changed byte, cut payload, lost record)."""
    html = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("~"), F.col("html"))).when(F.col("page_id") % 193 == 7, F.expr("left(html, length(html) div 2)")).otherwise(F.col("html"))
    return pages.where(F.coalesce(F.col("page_id") % 389 != 11, F.lit(True))).withColumn("html", html)


def op1_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged_replica(pages))


#: Brute force: the records of both replicas compared one by one.
OP1_SQL = """
WITH b AS (
  SELECT page_id AS record_id, page_id // 4096 AS segment, page_id % 4096 AS slot, url, html,
    CASE WHEN page_id % 389 = 11 THEN NULL WHEN page_id % 97 = 13 THEN '~' || html
      WHEN page_id % 193 = 7 THEN left(html, length(html) // 2) ELSE html END AS other,
    page_id % 389 = 11 AS lost,
    strlen('WARC/1.1__WARC-Type: resource__WARC-Target-URI: ' || url || '__Content-Length: ' || strlen(html) || '____' || html || '____') AS length
  FROM pages),
o AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY segment ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM b)
SELECT record_id, segment, slot, "offset", length, CASE WHEN lost THEN 'missing' ELSE 'content' END AS kind
FROM o WHERE lost OR other <> html
"""
