"""Word-set similarity against plain loops, and how many pairs are met when one word is in every label."""

import random

import pytest

from provider_analytics.functions.text import normalize_query, service_tokens  # noqa: F401  the words the join compares
from provider_analytics.operators import search


def plain(queries, candidates, close, least):
    out = {}
    for q, a in queries.items():
        for c, b in candidates.items():
            if not a or not b:
                continue
            fits = lambda x, y: x == y or (x, y) in close
            met = sum(any(fits(x, y) for y in b) for x in a)
            answered = sum(any(fits(x, y) for x in a) for y in b)
            value = met / len(a) * 0.55 + answered / len(b) * 0.45
            if met and value >= least:
                out[q, c] = value
    return out


def words_of(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", service_tokens("t").alias("w")).collect()
    return {r.t: list(r.w) for r in rows}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    vocabulary = ["common"] + [f"{a}{b}" for a in ("rogit", "mutuo", "credit", "testam") for b in ("ale", "are", "oni", "enti", "ico")] + ["figlio", "figli", "casa", "immobile"]
    make = lambda n, always: {" ".join(always + [rng.choice(vocabulary) for _ in range(rng.randint(0 if always else 1, n))]) for _ in range(150)}
    return sorted(make(6, []) | {"common", "common common", "rogitale rogitale casa"}), sorted(make(5, ["common"]) | {"casa casa", "figli"})


@pytest.mark.parametrize("least", [0.05, 0.42, 0.5, 0.9])
def test_similar_texts(spark, texts, least):
    queries, labels = texts
    q = spark.createDataFrame([(t,) for t in queries], "q string")
    c = spark.createDataFrame([(t,) for t in labels], "c string")
    typos = search.similar_tokens(search._vocabulary(q, "q"), search._vocabulary(c, "c")).cache()
    groups = search.equivalent_tokens(spark)
    close = {(r.l, r.r) for r in typos.select("l", "r").union(groups).collect()}
    want = plain(words_of(spark, queries), words_of(spark, labels), close, least)
    got = {(r.q, r.c): r.similarity for r in search.similar_texts(q, c, typos, groups, least).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_word_in_every_label(spark, monkeypatch):
    """All texts share the word 'common'. Pairs met stay within five times the pairs kept."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    own = [[word() for _ in range(4)] for _ in range(400)]
    c = spark.createDataFrame([(" ".join(["common", *w]),) for w in own], "c string")
    q = spark.createDataFrame([(" ".join(["common", *w[:3], word()]),) for w in own], "q string")
    met = {}
    real = search.settle
    monkeypatch.setattr(search, "settle", lambda df, name: met.__setitem__(name, (out := real(df, name)).count()) or out)
    none = spark.createDataFrame([], "l string, r string")
    kept = search.similar_texts(q, c, none, none, 0.42).count()
    assert kept >= 400 and met["pairs"] <= 5 * kept


def test_empty(spark):
    none, q = spark.createDataFrame([], "l string, r string"), spark.createDataFrame([("casa",)], "q string")
    assert search.similar_texts(q, spark.createDataFrame([], "c string"), none, none, 0.42).collect() == []
