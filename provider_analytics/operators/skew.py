"""Joins and groupings that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import atexit
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

MAX_HOT_KEYS = 256


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys holding more than 1/256 of all rows, with the number of salts each needs.

    At most 256 keys can pass that test, so the result is safe to broadcast at any scale. The count is
    a partial aggregate: the hot key costs one row per task, not one task."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return (
        counts.crossJoin(F.broadcast(total))  # one row
        .filter((F.col("_n") * MAX_HOT_KEYS > F.col("_total")) & (F.col("_n") > 10_000))
        .select(*keys, F.least(F.ceil(F.col("_n") * MAX_HOT_KEYS / F.col("_total")), F.lit(MAX_HOT_KEYS))
                .cast("int").alias("_salts"))
    )


def salted_join(big: DataFrame, other: DataFrame, keys: list[str], how: str, spread_by: list[str],
                counted: DataFrame | None = None) -> DataFrame:
    """Equi-join `big` (any distribution of keys) with `other`, whose rows per key are few.

    Hot keys of `big` are spread over several partitions by a hash of `spread_by`, and the matching
    rows of `other` are repeated once per salt. Cold keys keep salt 0, so nothing is repeated for them.
    `counted` is a cheaper frame with the same distribution of keys, for when `big` is itself derived."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join does not support {how}")
    hot = F.broadcast(reuse(hot_keys(counted if counted is not None else big, keys)))
    left = big.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*spread_by), F.col("_salts").cast("bigint")).cast("int")
        ),
    ).drop("_salts")
    right = other.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))
    ).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows of each group. The rank filter sits right on the window, so Spark cuts every
    group to k rows per task before the shuffle; a hot group never lands whole in one task."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= k)
    return kept.withColumn(name, F.col(name).cast("bigint")) if rank else kept.drop(name)


def place_in_group(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Add `name`: the place of every row in its group, from 1, in the given order, which must be total.

    One range sort of the whole frame, written to the shared folder with the number of each row in its range; a row's place
    is that and what lies before. The rows of a large group spread over as many ranges as they need. Where groups start is
    written too, so that few of them are broadcast and the rows are not dealt again."""
    sort = [*[F.col(g) for g in group], *order]
    ranged = settle(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_id", F.monotonically_increasing_id()), "ranged")
    placed = ranged.withColumn("_part", F.shiftright("_id", 33)).withColumn(
        "_at", F.col("_id").bitwiseAND((1 << 33) - 1)
    ).drop("_id")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    numbered = placed.join(F.broadcast(starts), "_part").withColumn("_row", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
    heads = settle(numbered.groupBy(*group).agg(F.min("_row").alias("_head")), "heads")
    return numbered.join(heads, group).withColumn(name, F.col("_row") - F.col("_head") + 1).drop("_row", "_head")


def reuse(df: DataFrame) -> DataFrame:
    """Keep a frame that one plan reads several times. Blocks spill to disk, and a lost block is computed
    again from its lineage; call `spark.catalog.clearCache()` when a batch of work is done."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def scratch_path(spark, name: str) -> str:
    """A new folder below the one the cluster shares. What this process wrote there goes when it ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


_written: list = []


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the folder the cluster shares and go on from the files: the plan stays
    short, sizes are known, and a lost executor costs a task, not the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
