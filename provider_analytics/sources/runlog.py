"""Run logs of batch jobs and reports about runs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "event string, slug string, status string, score double, error string"


def parse_log_lines(lines: DataFrame, column: str = "value", schema: str = LOG_SCHEMA) -> DataFrame:
    """JSON lines to columns; lines that are not JSON objects are left out."""
    kept = lines.filter(F.trim(column).startswith("{"))
    parsed = kept.withColumn("_r", F.from_json(column, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    return parsed.filter("_r IS NOT NULL AND _r._bad IS NULL").select(*[c for c in lines.columns if c != column], "_r.*").drop("_bad")


def read_run_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """Log files with JSON lines among plain text."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad IS NULL").drop("_bad")


def count_events(log: DataFrame) -> DataFrame:
    return log.groupBy("event").agg(F.count("*").alias("n"))


def report_rows(results: DataFrame) -> DataFrame:
    """One JSON document per result row."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("line"))


def write_report(results: DataFrame, summary: DataFrame, folder: str) -> None:
    """Row report and summary as JSON files."""
    results.write.json(os.path.join(folder, "rows"))
    summary.write.json(os.path.join(folder, "summary"))
