"""Linkage of many offices at one address: pairs, scores and assignment."""

import random

from pyspark.sql import functions as F

from provider_analytics.operators import linkage

_SCHEMA = "name string, phone string, address string, comune string, lat double, lng double"


def _town(spark, n):
    """n offices of one street and number in one town, each with its own phone and surname; every second far from the others."""
    rows = [(i, f"Anna Office{chr(97 + i // 26)}{chr(97 + i % 26)}", f"02{1000000 + i}", "Via Dante 3, Milano" if i % 3 else "Via Dante 3", "Milano",
             45.44 + (0.029 if i % 2 else 0.0), 9.2) for i in range(n)]
    side = lambda key: spark.createDataFrame(rows, f"{key} bigint, " + _SCHEMA)
    return side("provider_id"), side("listing_id")


def test_pairs_that_share_only_a_place_are_near_and_in_the_comune(spark):
    register, listings = _town(spark, 60)
    p, l = (linkage.signatures(linkage.prepare(df, key), key) for df, key in ((register, "provider_id"), (listings, "listing_id")))
    pairs = linkage.candidate_pairs(p, l)
    got = {(r["p_first_key"], r["l_first_key"]) for r in pairs.collect()}
    assert got == {(a, b) for a in range(60) for b in range(60) if a == b or (a % 2 == b % 2 and b % 3)}
    assert len(got) == pairs.count()
    # The pairs are not dealt again, neither to tell them apart nor to look up their columns.
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_scores_are_told_in_one_pass(spark):
    register, listings = _town(spark, 4)
    p, l = (linkage.signatures(linkage.prepare(df, key), key) for df, key in ((register, "provider_id"), (listings, "listing_id")))
    plan = linkage.match_score_places(linkage.candidate_pairs(p, l), 70)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Union" not in plan


def test_pairs_with_a_phone_are_assigned_before_others_are_looked_for(spark, monkeypatch):
    register, listings = _town(spark, 60)
    sizes, real = [], linkage.settle

    def counted(df, name):
        out = real(df, name)
        if name == "edges":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(linkage, "settle", counted)
    got = {tuple(r)[:2] for r in linkage.link(register, listings).collect()}
    # Equal phone, surname, name, number, street and distance, with or without the comune: more than 105 points each.
    assert got == {(i, i) for i in range(60)} and sizes == [60, 0]


def test_assignment_in_two_steps_equals_one_by_one(spark):
    rng = random.Random(5)
    rows = lambda n, key: spark.createDataFrame([(
        i, f"{rng.choice(['Anna', 'Marco'])} {rng.choice(['Rossi', 'Verdi', 'Neri'])}", f"02{1000000 + rng.randrange(25)}" if rng.random() < 0.6 else None,
        f"Via Dante {rng.randint(1, 2)}, Milano", "Milano", 45.44, 9.2 + rng.choice([0.0, 0.004, 0.03])) for i in range(n)], f"{key} bigint, " + _SCHEMA)
    register, listings = rows(70, "provider_id"), rows(60, "listing_id")
    p, l = linkage.prepare(register, "provider_id"), linkage.prepare(listings, "listing_id")
    prefix = lambda df, m: df.select(*[F.col(c).alias(f"{m}_{c}") for c in df.columns])
    sp, sl = linkage.signatures(p, "provider_id"), linkage.signatures(l, "listing_id")
    edges = linkage.match_score_places(prefix(sp, "p").crossJoin(prefix(sl, "l")), 70).select(
        "p_sig", "l_sig", "score", "p_copies", "l_copies", F.col("p_first_key").alias("p"), F.col("l_first_key").alias("l"),
        F.md5(F.concat_ws("|", "p_first_key", "l_first_key")).alias("tie")).collect()
    keys = {"p": {}, "l": {}}
    for mark, df, key in (("p", p, "provider_id"), ("l", l, "listing_id")):
        for r in df.orderBy(key).collect():
            keys[mark].setdefault(r["sig"], []).append(r[key])
    expected = set()
    for e in sorted(edges, key=lambda e: (-e["score"], e["tie"])):
        while keys["p"][e["p_sig"]] and keys["l"][e["l_sig"]]:
            expected.add((keys["p"][e["p_sig"]].pop(0), keys["l"][e["l_sig"]].pop(0), e["score"]))
    assert {tuple(r) for r in linkage.link(register, listings).collect()} == expected
    assert any(s > 105 for *_, s in expected) and any(s <= 105 for *_, s in expected)


def test_pairs_with_a_surname_are_assigned_before_others_meet_at_places(spark, monkeypatch):
    register, listings = (df.withColumn("phone", F.lit(None).cast("string")) for df in _town(spark, 60))
    sizes, real = {}, linkage.settle

    def counted(df, name):
        out = real(df, name)
        if name.startswith("edges"):
            sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(linkage, "settle", counted)
    got = {tuple(r)[:2] for r in linkage.link(register, listings).collect()}
    # Surname, name, number, street and distance, with or without the comune, are 91 points; without the surname there are at most 81.
    assert got == {(i, i) for i in range(60)} and sizes == {"edges": [0, 0], "edges-by-name": [60]}
