"""URL lists in sitemap documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = r"(?s)<{tag}>(.*?)</{tag}>"


def _unescape(value):
    # The five predefined XML entities, the ampersand last.
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def parse_documents(documents: DataFrame, column: str, tag: str = "url") -> DataFrame:
    """Rows of documents held in a column to one row per entry with loc and lastmod; tag is url, or sitemap
    for an index. Entries without a loc are left out."""
    entries = documents.withColumn("_entry", F.explode(F.regexp_extract_all(column, F.lit(_ENTRY.format(tag=tag)), 1))).drop(column)
    inner = lambda name: F.nullif(F.trim(F.regexp_extract("_entry", rf"(?s)<{name}>(.*?)</{name}>", 1)), F.lit(""))
    return entries.withColumn("loc", _unescape(inner("loc"))).withColumn("lastmod", _unescape(inner("lastmod"))).drop(
        "_entry"
    ).filter("loc IS NOT NULL")


def sitemap_locs(spark: SparkSession, path: str, tag: str = "url") -> DataFrame:
    """Entries of sitemap files through the XML source, one task per file split."""
    rows = spark.read.format("xml").option("rowTag", tag).schema("loc string, lastmod string").load(path)
    return rows.select(F.trim("loc").alias("loc"), F.trim("lastmod").alias("lastmod")).filter("loc IS NOT NULL")


def child_sitemaps(index: DataFrame, pattern: str) -> DataFrame:
    """Index entries whose name fits the pattern."""
    return index.filter(F.col("loc").rlike(pattern)).select("loc").distinct()
