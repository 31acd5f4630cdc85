"""Sharding by global byte-size prefix sums: contiguous runs in id order, cut at equal targets.

Rows are dealt to partitions of neighbouring ids, as many as the rows need; each partition's total is summed, the running totals of the partitions (one
row each) give every partition its start, and a window inside each partition finishes the prefix sum. Ties go by the text's CRC, the size and the row's
own number, so an id that a third of all rows share is dealt to several partitions like any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, running_totals, written


def shard_of(before: Column, size: Column, total: Column, shards: int) -> Column:
    """The shard in which the middle of the row's bytes falls, so a cut is off its target by half a row at most."""
    return F.least(F.lit(shards - 1), F.floor((2 * before + size) * F.lit(shards) / F.greatest(2 * total, F.lit(1)).cast("decimal(38,0)"))).cast("int")


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(id, size, text_crc32, shard, slot): contiguous shards of nearly equal bytes, in order of id; slots count from 0 in each.

    Size is the text's UTF-8 bytes plus `overhead`; a null text has no bytes and the CRC of none. Null ids come first; ties are
    ordered by CRC and size, and rows equal in these may swap places. A text larger than a shard's target leaves neighbouring
    shards empty. An empty table gives no rows. Other columns aren't read.
    """
    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(column(id_col).alias("id"), (F.octet_length(text) + F.lit(overhead)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = written(rows.withColumn("own", F.monotonically_increasing_id()))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    rows = running_totals(rows, ["id", "text_crc32", "size", "own"], "size")
    dec = lambda c: c.cast("decimal(20,0)")  # noqa: E731  products beyond 2^63 stay exact
    rows = written(rows.select("id", "size", "text_crc32", "nth", shard_of(dec(F.col("before")), dec(F.col("size")), dec(F.lit(total)), shards).alias("shard")))
    first = rows.groupBy("shard").agg(F.min("nth").alias("first"))  # one row for each shard
    return rows.join(F.broadcast(first), "shard").select("id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot"))


#: The same by one window over all rows; the CRC is worked out byte by byte from its polynomial.
SHARDS_SQL = """
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS crc),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, t),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id) AS upto, sum(size) OVER () AS total FROM c),
s AS (SELECT *, least(39, (2 * upto - size) * 40 // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM s
"""
