"""Suggestions while typing against plain loops, and how many rows the index and the candidates take."""

import random

import pytest
from pyspark.sql import functions as F

from provider_analytics.operators import search


def frame(spark, texts, name):
    return spark.createDataFrame([(t,) for t in texts], f"{name} string")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["atto", "att", "casa", "cas", "mutuo", "mutuoipotecario", "di", "d", "successione", "succ", "rogito"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(1, n)))
    labels = sorted({make(6) for _ in range(80)} | {"x" * 300, "aaaa", "d"})
    asked = sorted({make(9) for _ in range(80)} | {"aa", "aaa", "aaaaa", "o c", "x" * 129, "x" * 301, "d d", "di di di", "asa", "tuo", "y" * 40})
    return asked, labels


def test_contained_pairs(spark, texts):
    asked, labels = texts
    found = search.contained_pairs(frame(spark, asked, "q"), frame(spark, labels, "c")).collect()
    got = {(r.q, r.c) for r in found}
    assert len(found) == len(got) and got == {(q, c) for q in asked for c in labels if len(q) >= 2 and q in c}


def test_covered_pairs(spark, texts):
    asked, labels = texts
    want = {}
    for q in asked:
        typed = [t for t in q.split(" ") if len(t) > 1]
        for c in labels:
            hits = sum(any(p.startswith(t) or t.startswith(p) for p in c.split(" ")) for t in typed)
            if typed and hits / len(typed) >= 0.66:
                want[q, c] = hits / len(typed)
    found = search.covered_pairs(frame(spark, asked, "q"), frame(spark, labels, "c")).collect()
    assert {(r.q, r.c): r.share for r in found} == want and len(found) == len(want)


def test_a_word_of_every_label_brings_no_pairs_of_its_own(spark):
    """Sentences that share one word with all labels: what is met stays near what is kept."""
    labels = [f"atto w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    asked = [f"atto w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50)] + [f"atto per la vicina numero {i}" for i in range(200)]
    pairs = search.covered_pairs(frame(spark, asked, "q"), frame(spark, labels, "c"))
    assert pairs.count() == 50
    plan = pairs._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan.replace("BroadcastNestedLoopJoin Cross", "")


def test_empty_sides(spark):
    none = frame(spark, [], "q"), frame(spark, [], "c")
    some = frame(spark, ["casa"], "q"), frame(spark, ["casa"], "c")
    for q, c in ((none[0], some[1]), (some[0], none[1]), none):
        assert search.contained_pairs(q, c).count() == 0 and search.covered_pairs(q, c).count() == 0
    services = spark.createDataFrame([(1, "Casa", "casa")], "service_id bigint, name string, slug string")
    terms = spark.createDataFrame([], "service_id bigint, term string")
    got = search.autocomplete(frame(spark, ["cas", None, "", "c"], "query"), services, terms).select("q", "slug", F.col("score").cast("int"), "place").collect()
    assert [tuple(r) for r in got] == [("cas", "casa", 85, 1)]
