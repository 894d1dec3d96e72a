"""What the operators of this package share: reading tables, written intermediate tables, dense row numbers."""

from __future__ import annotations

import ctypes
import functools
import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import scratch_path
from ..session import shared_dir

BATCH_ROWS = 1024


def batches_of(spark: SparkSession, rows: int) -> None:
    """Bound the Arrow batches of queries planned from now on. Texts can be very long, so bytes are bounded as well."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def tidied(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Work of a task on its batches, after which the memory it has used goes back to the machine. Python workers live on
    between tasks, and an executor has several of them, so what one keeps for nothing the others lack."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return run


def hash_share(hashed: Column, share: float | Column) -> Column:
    """Whether a 64-bit hash falls into the given share of all hashes; the same rows on every run."""
    return F.pmod(hashed, F.lit(1 << 31)) < (F.lit(share) if isinstance(share, float) else share) * float(1 << 31)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, read whole, with Arrow batches small enough for texts."""
    batches_of(spark, BATCH_ROWS)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, keeping partitions and their order."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and go on from its files: columns are pruned and compressed. What a process
    has written goes when it ends."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that are no longer referred to. What a frame held is free for the
    second pass only."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def numbered(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Add `number`, the row's place from 0 in the order of `keys` over the whole frame.

    A range sort, a written copy and one count per partition; no task sees more than its range. Rows equal in all
    keys are told apart by where they were read, so they spread over partitions as well. Null keys come first."""
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    order = [*keys, "_tie"]
    ranged = checkpointed(tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie"))
    placed = ranged.withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    return placed.join(F.broadcast(starts), "_part").withColumn(number, F.col("_start") + F.col("_at")).drop(
        "_part", "_at", "_start"
    )
