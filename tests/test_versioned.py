"""Tables in versions: what a write touches, what a failed one leaves, old versions."""

import os

import pytest
from pyspark.sql import functions as F

from provider_analytics.operators.reviews import review_upsert
from provider_analytics.operators.versioned import (
    create_versioned, merge_versioned, read_versioned, upsert_versioned, versions,
)


def files(folder):
    return {os.path.join(at, f) for at, _, names in os.walk(f"{folder}/data") for f in names if f.endswith(".parquet")}


def buckets_of(paths):
    return {part for path in paths for part in path.split("/") if part.startswith("_bucket=")}


def test_an_upsert_of_one_bucket_writes_that_bucket_only(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.range(4000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    assert create_versioned(rows, folder, ["k"], 16) == 1
    before = files(folder)
    assert len(buckets_of(before)) == 16
    home = F.pmod(F.xxhash64("k"), F.lit(16))
    few = rows.filter(home == 5).orderBy("k").limit(2).withColumn("v", F.lit("new"))  # 1 % of a bucket
    assert upsert_versioned(few, folder) == 2
    assert buckets_of(files(folder) - before) == {"_bucket=5"} and before <= files(folder)
    keys = {r["k"] for r in few.collect()}
    assert {r["k"]: r["v"] for r in read_versioned(spark, folder).collect()} == {k: "new" if k in keys else f"v{k}" for k in range(4000)}
    assert {r["v"] for r in read_versioned(spark, folder, 1).collect()} == {f"v{k}" for k in range(4000)}


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    folder = str(tmp_path / "t")
    create_versioned(spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string"), folder, ["k"], 4)
    new = spark.createDataFrame([(1, "x"), (3, "y")], "k bigint, v string")

    def broken(old, fresh):
        return fresh.withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))

    with pytest.raises(Exception, match="lost"):
        merge_versioned(new, folder, broken)
    assert versions(spark, folder) == [1]
    assert sorted(read_versioned(spark, folder).collect()) == [(1, "a"), (2, "b")]
    assert upsert_versioned(new, folder) == 2
    assert sorted(read_versioned(spark, folder).collect()) == [(1, "x"), (2, "b"), (3, "y")]


def test_nulls_empty_tables_types_and_refusals(spark, tmp_path):
    folder = str(tmp_path / "t")
    layout = "k bigint, part string, v string"
    assert create_versioned(spark.createDataFrame([], layout), folder, ["k", "part"], 8) == 1
    assert read_versioned(spark, folder).columns == ["k", "part", "v"] and read_versioned(spark, folder).count() == 0
    assert upsert_versioned(spark.createDataFrame([], layout), folder) == 1
    # Keys of another type land in the same bucket; a null is a key value; further columns are left out.
    assert upsert_versioned(spark.createDataFrame([(1, None, "a", 0), (None, "p", "b", 0)], "k int, part string, v string, extra int"), folder) == 2
    assert upsert_versioned(spark.createDataFrame([(1, None, "c"), (None, "p", None)], layout), folder) == 3
    assert {tuple(r) for r in read_versioned(spark, folder).collect()} == {(1, None, "c"), (None, "p", None)}
    with pytest.raises(ValueError, match="already"):
        create_versioned(spark.createDataFrame([], layout), folder, ["k"], 8)
    with pytest.raises(ValueError, match="no version 9"):
        read_versioned(spark, folder, 9)
    with pytest.raises(ValueError, match="no version"):
        read_versioned(spark, str(tmp_path / "none"))


def test_reviews_go_into_a_versioned_table(spark, tmp_path):
    folder = str(tmp_path / "reviews")
    layout = "provider_id bigint, source string, author string, published_day int, text_hash string, rating int"
    key = ["provider_id", "source", "author", "published_day", "text_hash"]
    create_versioned(spark.createDataFrame([(1, "a", "x", 1, "h", 3), (2, "a", "y", 1, "h", 4)], layout), folder, key, 8)
    fresh = spark.createDataFrame([(1, "a", "x", 1, "h", 5), (1, "a", "x", 1, "h", 2), (3, "b", "z", 1, "h", 1)], layout)
    merge_versioned(fresh, folder, lambda old, new: review_upsert(old, new, [F.col("rating").desc()]))
    got = {(r["provider_id"], r["rating"]) for r in read_versioned(spark, folder).collect()}
    assert got == {(1, 5), (2, 4), (3, 1)}
