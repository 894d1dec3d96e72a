"""Parquet tables as DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


# Tables of long texts: work per row is heavy, so a scan of a few large row groups is spread out first.
TEXT_TABLES = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that has fewer splits than the session has slots; larger scans stay as they are."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None,
               where: str | None = None, schema: str | None = None) -> DataFrame:
    """One table, with the column list and the predicate handed to the Parquet scan."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(os.path.join(folder, f"{name}.parquet"))
    if name in TEXT_TABLES:
        df = spread(df)
    if where:
        df = df.filter(where)
    return df.select(*columns) if columns else df
