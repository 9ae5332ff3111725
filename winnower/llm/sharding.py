"""Contiguous shards of nearly equal byte size, by global prefix sums.

Rows are ordered by id over range partitions; each partition's total gives the bytes before it, a running sum
inside the partition gives the bytes before each row, and the line of all bytes is cut at equal targets.
DataFrame functions only; the one table that is gathered has a row for each partition.

Defined results: a null text has size 1, as an empty one; null ids come first; rows with equal id go by size
and checksum, and rows equal in all three are interchangeable; an empty table gives an empty result; columns
besides doc_id and text are not read. Sizes differ by at most the largest row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnower.llm.common import materialize


def byte_shards(documents: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    # the last key parts rows that are equal otherwise, so that no one of them fills a partition
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("doc_id", "size", "text_crc32", "_row")
    parts = materialize(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    offsets = (
        parts.groupBy("_part")
        .agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
            F.sum("_bytes").over(whole).alias("_all"),
        )
    )
    inside = Window.partitionBy("_part").orderBy("doc_id", "size", "text_crc32", "_row")
    placed = (
        parts.withColumn("_sum", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_nth", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_part")  # one row for each partition
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"((_bytes_before + _sum - size) * {shards}) div _all").cast("int")))
        .withColumn("_at", F.col("_rows_before") + F.col("_nth") - 1)
    )
    firsts = placed.groupBy("shard").agg(F.min("_at").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row for each shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_at") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


#: CRC-32 is folded over a text's bytes with a table made by its rule.
ORACLE_SQL = """
WITH RECURSIVE bits AS (
  SELECT n AS byte, CAST(n AS BIGINT) AS c, 0 AS k FROM range(256) t(n)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
raw AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, CAST(n + 1 AS BIGINT) AS size,
    xor(list_reduce(list_transform(range(0, 2 * n, 2), lambda i: CAST('0x' || h[i + 1:i + 2] AS BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM raw, crc_table
),
placed AS (
  SELECT *, row_number() OVER w AS nth, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS whole
  FROM sized WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32)
),
dealt AS (SELECT *, CAST(least(7, before * 8 // whole) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY nth) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt
"""
