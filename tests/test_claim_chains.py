"""Claims in order: chains of claims that wait for each other, against taking them one by one."""

import random

import pytest

from provider_analytics.operators import claims


def plain(pairs):
    emails, providers, won = set(), set(), set()
    for email, provider, moment in sorted(pairs, key=lambda p: p[2]):
        if email not in emails and provider not in providers:
            emails.add(email), providers.add(provider), won.add((email, provider, moment))
    return won


def settled(spark, pairs, how):
    df = spark.createDataFrame(pairs, "_email string, provider_id int, _moment int")
    return {tuple(r) for r in how(df).select("_email", "provider_id", "_moment").collect()}


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_one_by_one(spark, seed):
    rng = random.Random(seed)
    sides = [(3, 60), (25, 25), (60, 4), (200, 200)][seed]
    pairs = {(f"e{rng.randrange(sides[0])}", rng.randrange(sides[1])) for _ in range(250)}
    moments = rng.sample(range(10_000), len(pairs))
    rows = [(e, p, m) for (e, p), m in zip(sorted(pairs), moments, strict=True)]
    assert settled(spark, rows, claims._chained_pairs) == plain(rows)
    assert settled(spark, rows, claims._settled_pairs) == plain(rows)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Each claim shares its provider with the one before and its email with the one after."""
    rows = [(f"e{(i + 1) // 2}", i // 2, i) for i in range(10_000)]
    written = []
    real = claims.settle
    monkeypatch.setattr(claims, "settle", lambda df, name: written.append(name) or real(df, name))
    assert settled(spark, rows, claims._settled_pairs) == plain(rows)
    assert len(written) < 40


def test_a_hot_email(spark):
    rows = [("hot", i, i * 2) for i in range(400)] + [(f"e{i}", i, i * 2 - 1) for i in range(400)]
    assert settled(spark, rows, claims._chained_pairs) == plain(rows)
