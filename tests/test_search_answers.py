"""Answers of text searches that have far more rows than the tables: whole, and dealt over all tasks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from provider_analytics.operators import filters


@pytest.fixture
def small_blocks(spark, monkeypatch):
    monkeypatch.setattr(filters, "BLOCK", 16)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_term_many_ask_for_is_answered_by_many_tasks(spark, small_blocks):
    requests = spark.range(300).select(F.col("id").alias("request_id"), F.concat(F.lit("7"), F.expr("repeat(' ', CAST(id % 3 AS INT))")).alias("term"))
    rows = spark.range(200).select(F.col("id").alias("key"), F.concat(F.lit("n7 "), F.col("id").cast("string")).alias("name"))
    found = filters.search_texts(requests, rows, "key", ["name"])
    by_task = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(by_task) == 300 * 200 == found.distinct().count()
    assert len(by_task) > 4 and max(by_task) < 30_000


@pytest.mark.parametrize("joined", [False, True])
def test_answers_keep_repeated_and_missing_ids(spark, small_blocks, joined):
    terms = ["a", " B ", "ab", "x", "", None, "c d"]
    requests = [(None if i % 13 == 0 else i % 40, terms[i % 7]) for i in range(150)]
    rows = [(None if i % 11 == 0 else i % 50, None if i % 9 == 0 else "Ab" * (i % 3) + "c", None if i % 5 == 0 else f"d{'a' * (i % 2)}") for i in range(90)]
    found = filters.search_texts(spark.createDataFrame(requests, "request_id bigint, term string"),
                                 spark.createDataFrame(rows, "key bigint, name string, city string"), "key", ["name", "city"], joined)

    def holds(term, name, city):
        texts = [" ".join(t for t in (name, city) if t is not None)] if joined else [name or "", city or ""]
        return any(term in t.lower() for t in texts)

    expected = Counter()
    for request, term in requests:
        needle = (term or "").strip().lower()
        for key in {k for k, name, city in rows if needle and holds(needle, name, city)}:
            expected[request, key] += 1
    assert Counter(tuple(r) for r in found.collect()) == expected and None in {k for _, k in expected} and None in {r for r, _ in expected}


def test_a_search_without_answers_has_no_rows(spark):
    requests = spark.createDataFrame([(1, "zz"), (2, " ")], "request_id bigint, term string")
    rows = spark.createDataFrame([(1, "abc")], "key bigint, name string")
    found = filters.search_texts(requests, rows, "key", ["name"])
    assert found.count() == 0 and found.columns == ["request_id", "key"]


def test_a_row_becomes_one_block_of_rows_at_a_time(spark, small_blocks):
    requests = spark.range(40).select(F.col("id").alias("request_id"), F.lit("7").alias("term"))
    rows = spark.range(50).select(F.col("id").alias("key"), F.lit("n7").alias("name"))
    found = filters.search_texts(requests, rows, "key", ["name"])
    plan = [line.strip(" +-:") for line in found._jdf.queryExecution().executedPlan().toString().splitlines()]
    made = [i for i, line in enumerate(plan) if "Generate explode(_" in line]
    # Both lists in one piece of generated code would hold all rows of a meeting, 16 times 16, before one is taken.
    assert len(made) == 2 and any("Coalesce" in line for line in plan[made[0]:made[1]])
    tasks = lambda df: len({r[0] for r in df.select(F.spark_partition_id()).distinct().collect()})
    assert found.count() == 40 * 50 and tasks(found) > 4
