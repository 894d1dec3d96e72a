"""Captured pages as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """A capture folder of HTML files: the path stands for the URL."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html"))


def page_facts(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.length("html").cast("bigint").alias("chars"), F.sha2("html", 256).alias("html_hash"))
