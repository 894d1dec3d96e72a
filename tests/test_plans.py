"""What the physical plans must and must not hold."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from provider_analytics.operators.skew import top_per_group
from provider_analytics.sources.tables import read_table

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "geo_radius_join", "knn_join", "search_near_me", "related_services", "candidate_pairs", "token_similarity",
    "autocomplete_score", "provider_services_resolved", "request_recipients", "cross_city_service",
])
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(entry.queries()[name](spark, FOLDER))


def test_scan_reads_what_is_asked(spark):
    text = plan(read_table(spark, FOLDER, "lineitem", ["l_orderkey"], "l_quantity > 49"))
    assert "GreaterThan(l_quantity,49.0)" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_top_k_is_cut_before_the_shuffle(spark):
    rows = read_table(spark, FOLDER, "orders")
    text = plan(top_per_group(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 3))
    assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning") < text.rindex("WindowGroupLimit")


def test_views_are_reread_per_folder(spark):
    small = entry.queries()["published"](spark, FOLDER)
    large = entry.queries()["published"](spark, "/root/testdata/sf0.01")
    assert small.count() < large.count()
