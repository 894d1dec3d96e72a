"""How often the keys of requests are dealt, and how much of a batch of pages is held at once."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from provider_analytics.operators import extraction, requests
from provider_analytics.plans.domain import VIEWS, Domain


def test_ids_of_a_submission_are_gathered_where_they_were_joined(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        submissions = spark.createDataFrame([(i, f" A{i % 3}@x.it ", "s", "Roma", "m") for i in range(6)], "submission_id bigint, email string, service_slug string, comune string, message string")
        targets = spark.createDataFrame([(i % 6, i % 4) for i in range(40)], "submission_id bigint, provider_id bigint")
        properties = spark.createDataFrame([(10 + i, f"a{i % 3}@X.it") for i in range(6)], "property_id bigint, owner_email string")
        links = spark.createDataFrame([(i % 6, 10 + i % 5) for i in range(30)] * 2, "submission_id bigint, property_id bigint")
        owned = requests.owned_properties(links, submissions, properties)
        expected = {(i % 6, 10 + i % 5) for i in range(30) if (i % 6) % 3 == (i % 5) % 3}
        assert {(r["submission_id"], r["property_id"]) for r in owned.collect()} == expected and owned.count() == len(expected)
        keyed = requests.request_keys(submissions, targets, owned)
        plan = keyed._jdf.queryExecution().executedPlan().toString()
        # Submissions twice, links and properties by property, owned ones with their email and by submission, targets.
        assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 7
        again = requests.request_keys(submissions, targets.distinct(), owned)
        assert {tuple(r) for r in keyed.select("submission_id", "idempotency_hash").collect()} == {tuple(r) for r in again.select("submission_id", "idempotency_hash").collect()}
        assert keyed.select(F.count_distinct("idempotency_hash")).first()[0] == 6
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_records_of_a_batch_are_handed_on_in_parts():
    page = "<p>x</p>" * 25_000
    batch = pd.DataFrame({"page_id": range(24), "url": ["u"] * 24, "html": [page] * 23 + [None]})
    parts = list(extraction._batches(lambda p: {"n": len(p)}, ["n"])(iter([batch])))
    assert max(len(p) for p in parts) <= 5 and list(pd.concat(parts)["page_id"]) == list(range(24))
    assert list(pd.concat(parts)["n"]) == [200_000] * 23 + [0]


@pytest.fixture()
def dealt(spark):
    """Plans as large tables have them."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    for k, v in before.items():
        spark.conf.set(k, v)


def test_equal_ticks_are_found_without_hash_tables(spark, dealt):
    asked = spark.createDataFrame([(1,), (2,), (2,), (None,)], "request_id bigint")
    ticks = spark.createDataFrame([(1, 5, 0), (1, 5, 1), (1, 6, 2), (2, 5, 0), (3, 5, 0), (None, 5, 0), (2, None, 1), (1, 7, 3)], "submission_id bigint, provider_id bigint, pos int")
    providers = spark.createDataFrame(
        [(5, "a", "published", "a@x.it", "A@y.it", "verified"), (6, "b", "published", "", "B@y.it", None), (7, "c", "draft", "c@x.it", None, None)],
        "provider_id bigint, full_name string, status string, email string, owner_email string, profile_status string")
    out = requests.fan_out_recipients(asked, ticks, providers)
    assert "HashAggregate" not in dealt(out)
    assert sorted((r.request_id, r.provider_id, r.recipient_email) for r in out.collect()) == [(1, 5, "A@y.it"), (1, 6, None), (2, 5, "A@y.it"), (2, 5, "A@y.it")]


def test_a_case_deals_plain_rows(spark, dealt):
    """What all properties have alike, and lists of them, are made after the rows are dealt."""
    none = F.lit(None).cast("string")
    asked = spark.createDataFrame([(1, "now"), (2, "later")], "request_id bigint, message string").select(
        "request_id", "message", *[F.lit("x").alias(n) for n in ("urgency", "property_value", "parties", "documents_ready", "intake_profile")])
    held = spark.createDataFrame([(1, 12, "B"), (1, 11, "A"), (1, 12, "B")], "request_id bigint, id bigint, nickname string").select(
        "*", *[none.alias(n) for n in requests.PROPERTY_FIELDS[2:-2]], F.array(F.lit("mutuo")).alias("usable_for"), F.lit("user").alias("data_source"))
    targets = spark.createDataFrame([(1, 8, 2), (1, 9, 1)], "request_id bigint, provider_id bigint, place bigint")
    out = requests.case_snapshot(asked, targets, held, [F.col("message").alias("timing_preference")])
    shown = dealt(out)
    lists = re.search(r"ObjectHashAggregate\(keys=\[request_id#\d+L\], functions=\[collect_list\((?:named_)?struct\(id.*\n(.*\n)(.*\n)?.*Exchange", shown)
    assert lists and "user" not in shown[shown.index("Exchange", lists.start()):]
    cases = {r.request_id: r.case_details for r in out.collect()}
    assert '"selected_notary_ids":[9,8],"selected_property_ids":[11,12,12]' in cases[1] and '"selected_property_ids":[],"properties_snapshot":[]' in cases[2]
    assert cases[1].count('"usable_for":["mutuo"],"data_source":"user"') == 3


def test_properties_of_clients_stay_where_their_order_is(spark, dealt, tmp_path):
    frames = {
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(1, "N", 0)]),
        "customer": ("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(1, "C1", 1, 0.0, "M"), (1, "C1", 1, 0.0, "M"), (2, "C2", None, 0.0, "M")]),
        "orders": ("o_orderkey bigint, o_custkey bigint", [(7, 1), (8, 2), (9, None), (None, 1)]),
        "lineitem": ("l_orderkey bigint, l_linenumber int, l_linestatus string, l_suppkey bigint, l_partkey bigint, l_returnflag string, l_quantity double",
                     [(7, 1, "O", 3, 4, "R", 2.5), (7, 1, "F", 5, 1, "A", 1.0), (7, 2, None, None, 2, "N", 3.0), (8, 1, "O", 1, 1, "R", 1.0), (None, 1, "O", 1, 1, "R", 1.0)]),
    }
    for name, (schema, rows) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    d = Domain(spark, str(tmp_path))
    out = d.client_properties
    assert sorted((r.property_id, r.owner_email, r.foglio, r.rendita) for r in out.collect()) == [(71, "C1@EXAMPLE.ORG", "5", "2,5"), (72, "C1@EXAMPLE.ORG", None, "3,5")]
    as_named = spark.sql(VIEWS["client_properties"])
    assert sorted(map(str, out.collect())) == sorted(map(str, as_named.collect()))
    count = lambda df: len(re.findall(r"Exchange hashpartitioning", dealt(df)))
    assert count(out) < count(as_named)
