"""Tables in versions: rows lie in hash buckets of their key, a write replaces the buckets it touches and no others.

A table is a folder. `data/<write>/_bucket=<n>` holds the Parquet files of one write, `versions/<number>` a small list
that names the folder of every bucket as of that version. A version counts once Spark has marked its list as complete, so
a write that fails anywhere before leaves the version before it as it was. One writer at a time; a second one that got the
same number finds the list taken and fails. Old versions stay readable."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .skew import settle
from .writes import upsert

MAX_BUCKETS = 4096
_LIST = "bucket int, path string, keys array<string>, buckets int, layout string"
_BUCKET = "_bucket"


def _bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write_buckets(df: DataFrame, folder: str, keys: list[str], buckets: int) -> dict[int, str]:
    """Files of one write; where each of its buckets lies. A bucket is one task's work: keys are unique, so buckets are
    even, and their number is chosen by the size of the table."""
    place = f"{folder}/data/{uuid.uuid4().hex}"
    rows = df.withColumn(_BUCKET, _bucket_of(keys, buckets))
    rows.repartition(F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(place)
    found = _glob(df.sparkSession, f"{place}/{_BUCKET}=*")
    return {int(path.rsplit("=", 1)[1]): path for path in found}


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    statuses = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return [status.getPath().toString() for status in statuses or []]


def _commit(spark: SparkSession, folder: str, number: int, paths: dict[int, str], keys: list[str], buckets: int, layout: StructType) -> int:
    # At most MAX_BUCKETS rows; a table without rows has one line without a folder, which keeps its layout.
    lines = [(bucket, path, keys, buckets, layout.json()) for bucket, path in sorted(paths.items())]
    listed = spark.createDataFrame(lines or [(None, None, keys, buckets, layout.json())], _LIST)
    listed.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/versions/{number:012d}")
    return number


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions, ascending."""
    return sorted(int(path.rsplit("/", 2)[1]) for path in _glob(spark, f"{folder}/versions/*/_SUCCESS"))


def _listed(spark: SparkSession, folder: str, version: int | None):
    known = versions(spark, folder)
    number = version if version is not None else (known[-1] if known else None)
    if number not in known:
        raise ValueError(f"{folder} has no version {'at all' if number is None else number}")
    lines = spark.read.schema(_LIST).parquet(f"{folder}/versions/{number:012d}").collect()
    first = lines[0]
    paths = {line["bucket"]: line["path"] for line in lines if line["path"]}
    return number, paths, list(first["keys"]), first["buckets"], StructType.fromJson(json.loads(first["layout"]))


def _rows_of(spark: SparkSession, paths: list[str], layout: StructType) -> DataFrame:
    return spark.read.schema(layout).parquet(*paths) if paths else spark.createDataFrame([], layout)


def create_versioned(df: DataFrame, folder: str, keys: list[str], buckets: int = 64) -> int:
    """Version 1 of a table. Keys must be unique in df (see `assert_unique`); a null is a key value like others."""
    if not 1 <= buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be from 1 to {MAX_BUCKETS}")
    spark = df.sparkSession
    if versions(spark, folder):
        raise ValueError(f"{folder} holds a table already")
    return _commit(spark, folder, 1, _write_buckets(df, folder, keys, buckets), keys, buckets, df.schema)


def read_versioned(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The newest version, or the one asked for."""
    _, paths, _, _, layout = _listed(spark, folder, version)
    return _rows_of(spark, list(paths.values()), layout)


def merge_versioned(incoming: DataFrame, folder: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Next version: `merge(rows, incoming)` over the buckets that incoming rows fall into, every other bucket by name.
    `merge` must answer per key. Incoming columns are cast to those of the table; missing ones stay missing, others are
    left out. No incoming row: no new version. Returns the number of the newest version."""
    spark = incoming.sparkSession
    number, paths, keys, buckets, layout = _listed(spark, folder, None)
    wanted = [F.col(f.name).cast(f.dataType).alias(f.name) for f in layout.fields if f.name in incoming.columns]
    # Read twice below, and what is written must be what the buckets were chosen by.
    fresh = settle(incoming.select(*wanted), "incoming")
    touched = sorted(r[0] for r in fresh.select(_bucket_of(keys, buckets).alias("b")).distinct().collect())  # at most `buckets`
    if not touched:
        return number
    present = _rows_of(spark, [paths[b] for b in touched if b in paths], layout)
    merged = merge(present, fresh).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in layout.fields])
    written = _write_buckets(merged, folder, keys, buckets)
    kept = {bucket: path for bucket, path in paths.items() if bucket not in set(touched)}
    return _commit(spark, folder, number + 1, kept | written, keys, buckets, layout)


def upsert_versioned(incoming: DataFrame, folder: str, update: dict[str, Column] | None = None) -> int:
    """`upsert` into the table: incoming rows (unique per key) are inserted, or merged as `update` says."""
    _, _, keys, _, _ = _listed(incoming.sparkSession, folder, None)
    return merge_versioned(incoming, folder, lambda old, new: upsert(old, new, keys, update).drop("action"))
