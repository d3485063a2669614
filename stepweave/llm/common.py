"""Shared parts of the training-data operators: cutting lineage, global prefix sums, text measures."""

from __future__ import annotations

import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the contracts: space and \t \n \v \f \r. Everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set, a local one is, if the driver
    is the only executor; on a cluster its executors wouldn't see each other's files, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stepweave-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that a lost executor costs no recomputation and later reads agree."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_STORED: list[str] = []


def drop_stored(spark: SparkSession) -> None:
    """Remove the tables that this driver's operators have written; results that still read them become unreadable."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _STORED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(conf).delete(path, True)


def dropped_with_stored(path: str) -> str:
    """The path, noted for drop_stored."""
    _STORED.append(path)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Like cut, as a Parquet table: smaller, and read column by column."""
    path = dropped_with_stored(f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    df.write.option("parquet.block.size", 16 << 20).parquet(path)  # texts in small row groups: a writer holds one in memory
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have shuffle files removed that no DataFrame refers to any more: Spark does so when the driver collects its garbage,
    which it may not do for as long as a job runs. For use after a shuffle about as large as the input."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def prefix_sums(rows: DataFrame, order: list[str], amount: str | None = None, also: dict[str, str] | None = None) -> DataFrame:
    """Add `_before` (sum of amount over all rows ahead in the global order), `_rank` (their number) and, for each name in
    `also`, the sum of its column over these rows.

    Rows are dealt into ranges of the order, each range is summed by itself, and the few range totals (one row per
    range) are accumulated and joined back: no task ever sees more than a range. Rows that tie in the whole order
    come in any order among themselves, so give it a last column that is unique where that matters.
    """
    values = {"_before": F.col(amount) if amount else F.lit(0).cast("long"), "_rank": F.lit(1).cast("long"), **{k: F.col(c) for k, c in (also or {}).items()}}
    ranged = cut(rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("_range", F.spark_partition_id()))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(*[F.sum(v).alias(f"_sum{k}") for k, v in values.items()])
    heads = sums.select("_range", *[F.coalesce(F.sum(f"_sum{k}").over(ahead), F.lit(0)).alias(f"_ahead{k}") for k in values])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.withColumns({f"_run{k}": F.sum(v).over(inside) for k, v in values.items()})
        .join(F.broadcast(heads), "_range")
        .withColumns({k: F.col(f"_ahead{k}") + F.col(f"_run{k}") - v for k, v in values.items()})
        .drop("_range", *[f"_ahead{k}" for k in values], *[f"_run{k}" for k in values])
    )


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of so many rows for what runs meanwhile: texts are long, and a batch of each task is in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before) if int(before) > 0 else rows, rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sliced(batches: Iterator, rows: int = 1000) -> Iterator:
    """Arrow batches cut to so many rows, for functions whose DataFrame is run when small_batches no longer holds."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it is connected to) for edges (a, b) of longs, by least labels and pointer jumps.

    Each round takes the least label among neighbours and then that label's own label, so distances shrink
    exponentially; rounds are cut in the shared folder and end when no label changes.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("_near"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "_near").alias("_to"), F.col("root").alias("_was"))
        jump = labels.select(F.col("node").alias("_at"), F.col("root").alias("_next"))
        new = stored(new.join(jump, F.col("_to") == F.col("_at")).select("node", F.least("_to", "_next").alias("root"), "_was"), "labels")
        labels = new.select("node", "root")
        if new.filter("root <> _was").isEmpty():
            return labels


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives freed memory back when its task ends: Python workers live on and idle."""

    @functools.wraps(run)
    def out(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # not every C library can

    return out
