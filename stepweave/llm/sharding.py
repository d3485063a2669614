"""Contiguous balanced shards from global byte-size prefix sums.

Every row gets the number of bytes ahead of it in the order of doc_id (per-partition totals, accumulated, plus a running
sum inside the partition), and the shard whose equal share of the total holds the row's midpoint. Shards are contiguous
in that order, and each is within one row's size of total / n_shards. Only ids, sizes and checksums move; texts don't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import cut, prefix_sums, text_bytes, text_crc32

#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def shard_rows(rows: DataFrame, order: list[str], size: str, n_shards: int) -> DataFrame:
    """Add shard (0 to n_shards - 1) and slot (gapless from 0 in each shard) to rows with a positive long `size`.

    The order should end in a unique column; rows that tie in it are exchangeable. An empty table gives an empty
    result; with fewer rows than shards some shards stay empty. Nulls in the order come first.
    """
    summed = prefix_sums(rows, order, size)
    total = rows.agg(F.sum(size)).first()[0] or 1
    placed = cut(summed.withColumn("shard", F.expr(f"cast(least({n_shards - 1}, ((2 * _before + {size}) * {n_shards}) div {2 * total}) as int)")))
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("_rank") - F.col("_first")).drop("_first", "_before", "_rank")


def shard_documents(docs: DataFrame, n_shards: int, carry: list[str] = ()) -> DataFrame:
    """Shards of documents by UTF-8 bytes of text plus ROW_BYTES: doc_id, size, text_crc32, shard, slot and `carry`.

    A null text counts as none; a null doc_id comes first. Repeated rows are separate rows of the shards. Other columns
    of docs play no part unless named in `carry` (they then move with the rows).
    """
    rows = docs.select(
        "doc_id", text_bytes(F.col("text")).alias("_bytes"), text_crc32(F.col("text")).alias("text_crc32"), F.monotonically_increasing_id().alias("_id"), *[F.col(c).alias(f"_carry_{c}") for c in carry]
    ).withColumn("size", F.col("_bytes") + ROW_BYTES).drop("_bytes")
    out = shard_rows(cut(rows), ["doc_id", "text_crc32", "size", "_id"], "size", n_shards).drop("_id")
    return out.withColumnsRenamed({f"_carry_{c}": c for c in carry if c not in ("doc_id", "size", "text_crc32", "shard", "slot")})


def write_shards(docs: DataFrame, n_shards: int, path: str) -> None:
    """Write texts as Parquet, one folder per shard, rows in slot order."""
    out = shard_documents(docs, n_shards, ["text"])
    out.repartitionByRange(n_shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs, 40).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))



#: The checksum is a fold over the bytes, with the table of the polynomial made by its rule.
ORACLE = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
b AS (SELECT doc_id, n, list_transform(range(n), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT) AS b FROM h),
d AS (SELECT doc_id, n + 16 AS size, xor(list_reduce(b, lambda a, x: xor(a // 256, t[(xor(a, x) % 256) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32 FROM b, tab),
s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM d),
p AS (SELECT doc_id, size, text_crc32, least(39, ((2 * before + size) * 40) // (2 * total))::INTEGER AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM p
"""
