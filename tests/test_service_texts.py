"""How often search texts are normalised, and what is dealt where words of texts meet."""

import re

import pytest
from pyspark.sql import functions as F

from provider_analytics.operators import search


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def texts(spark):
    long = " ".join(f"parola{i}" for i in range(200))
    queries = [("Mutuo casa",), ("mutuo  CASA",), (f"mutuo {long}",), (f"rogito {long}",), ("rogitto",), ("!?",), (None,)]
    return spark.createDataFrame(queries * 3, "query string")


def test_each_query_is_normalised_once(spark, texts):
    """Grouped raw rows come first: no raw row is normalised, and what follows reads the result."""
    asked = search.asked_texts(texts.groupBy("query").agg(F.count("*").alias("asked")))
    assert "regexp_replace" not in plan(asked) and "LocalTableScan" not in plan(asked)
    assert sorted(r.query for r in asked.collect() if len(r.query) < 20) == ["Mutuo casa", "mutuo  CASA", "rogitto"]
    assert asked.count() == 5 and asked.filter("q = 'mutuo casa'").count() == 2


def test_labels_are_normalised_after_their_grouping(spark):
    taxonomy = spark.createDataFrame([(1, "Mutuo Casa", "mutuo-casa"), (2, "...", "-")], "service_id bigint, name string, slug string").groupBy(
        "name").agg(F.min("service_id").alias("service_id"), F.min("slug").alias("slug")).withColumn("plain_language_name", F.lit(None).cast("string"))
    raw = spark.createDataFrame([(1, "Rogito!", "alias", 3), (1, "Rogito!", "alias", 5), (2, "", "intent", 1), (9, "Altro", "alias", 1)], "service_id bigint, term string, term_type string, weight int")
    terms = raw.groupBy("service_id", "term", "term_type").agg(F.max("weight").alias("weight")).withColumn("normalized_term", F.lit(None).cast("string"))
    found = search.labels(taxonomy, terms)
    assert "Aggregate" not in plan(found)
    assert sorted((r.service_id, r.kind, r.section, r.label, r.weight, r.normalized) for r in found.collect()) == [
        (1, "alias", 3, "Rogito!", 5, "rogito"), (1, "canonical", 0, "Mutuo Casa", 0, "mutuo casa"), (1, "canonical", 2, "mutuo casa", 0, "mutuo casa")]


@pytest.mark.parametrize("least", [None, 0.01])
def test_words_are_dealt_without_their_texts(spark, texts, least):
    """Where rows are dealt by words, a number stands for a text, however long it is."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    q = search.asked_texts(texts).select("q")
    c = spark.createDataFrame([("mutuo casa",), ("rogito",), ("rogito",)], "c string")
    typos = search.similar_tokens(search._vocabulary(q.distinct(), "q"), search._vocabulary(c.distinct(), "c"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        if least is None:
            out = search.token_similarity(q, c, typos, search.equivalent_tokens(spark))
            shown = plan(out)
            by_word = re.findall(r"Exchange hashpartitioning\((?:l|r|token)#.*\n(?:.*\n){1}.*Project \[(.*)\]", shown)
            assert by_word and not any(re.search(r"\b[qc]#", columns) for columns in by_word)
        else:
            out = search.similar_texts(q, c, typos, search.equivalent_tokens(spark), least)
        got = {(r.q[:6], r.c): round(r.similarity, 6) for r in out.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    share = lambda met, of, answered, named: round(met / of * 0.55 + answered / named * 0.45, 6)
    assert got == {("mutuo ", "mutuo casa"): got["mutuo ", "mutuo casa"], ("rogito", "rogito"): share(1, 201, 1, 1), ("rogitt", "rogito"): 1.0}
    assert sorted(round(r.similarity, 6) for r in out.filter("c = 'mutuo casa'").collect()) == [share(1, 201, 1, 2), 1.0] and out.count() == 4
