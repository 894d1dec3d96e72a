"""Top-k text search against plain loops: every tier, several rounds of reading, nulls, and how much is read."""

import random

import pytest

from provider_analytics.operators import directory, filters, postings

PROVIDERS = "provider_id bigint, full_name string, comune string, district string, address string, lat double, lng double, status string, owner_email string"


@pytest.fixture(scope="module")
def people():
    rng = random.Random(6)
    first, last = ["anna", "Bo", "Carla", "di Noè"], ["Rossi", "rossini", "Bianchi", "O'Neil", "100%_x"]
    rows = []
    for i in range(400):
        city = rng.choice(["Roma", "Romano", "San Romano", "Milano", None, ""])
        rows.append((i, None if rng.random() < 0.03 else f"{rng.choice(first)} {rng.choice(last)}", city, rng.choice(["Roma", "Milano", None]),
                     rng.choice([None, "Via Roma 1", "via Bo 22", ""]), None if rng.random() < 0.2 else 41.0, 12.0, rng.choice(["published"] * 5 + ["draft"]),
                     "x@y" if rng.random() < 0.4 else None))
    return rows


def low(x):
    return (x or "").lower()


def plain_search(people, declared, term, city, service, limit):
    out = []
    for i, name, comune, district, address, lat, lng, status, _ in people:
        if status != "published" or not any(term in low(x) for x in (name, comune, address)) or not (city in low(comune) or city in low(district)):
            continue
        kind = declared.get((service, i))
        out.append(({"exact": 0, "related": 1}.get(kind, 2), bool(city) and low(comune) != city, bool(city) and city not in low(comune),
                    lat is None or lng is None, (name is not None, name or ""), i, kind))
    return [(r[5], r[6]) for r in sorted(out)[:limit]]


@pytest.mark.parametrize("first, growth", [(2, 2), (64, 32)])
def test_searches_by_name(spark, people, monkeypatch, first, growth):
    monkeypatch.setattr(postings, "FIRST", first)
    monkeypatch.setattr(postings, "GROWTH", growth)
    rng = random.Random(2)
    terms = [None, " ", "ROSSI", "o", "an", "via", "100%_x", "romano", "zzz", "di noè b", "bo 22", "'"]
    asked = [(n, rng.choice(terms), rng.choice(["", None, "roma", "Romano", "san-romano", "o", "nowhere"]), rng.choice([None, "", "deed", "will", "unknown"]))
             for n in range(150)] + [(1, "o", "roma", "deed")]
    offers = [(i, rng.choice([1, 2, 3]), rng.choice([None, 0.5, 0.9]), rng.choice("ab")) for i in rng.sample(range(400), 200)]
    wanted = [("deed", 1, "exact"), ("deed", 2, "related"), ("will", 3, "exact")]
    declared = {(s, i): kind for i, service, _, _ in offers for s, k, kind in wanted if k == service}
    found = directory.searches_by_name(
        spark.createDataFrame(asked, "request_id int, term string, city string, service string"), spark.createDataFrame(people, PROVIDERS),
        spark.createDataFrame(offers, "provider_id bigint, service_id int, confidence double, source string"),
        spark.createDataFrame(wanted, "service string, service_id int, match_kind string"), 12)
    want = [(n, p, kind, place) for n, term, city, service in asked for place, (p, kind) in enumerate(
        plain_search(people, declared, low(term).strip(), low(city).replace("-", " ").strip(), service or None, 12), 1)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("first", [1, 64])
def test_claimable_searches(spark, people, monkeypatch, first):
    monkeypatch.setattr(postings, "FIRST", first)
    asked = [(n, t) for n, t in enumerate([None, "a", "ro", "ROSSI", "anna rossi", "Bo Bianchi ", "zzz", "roma", "ro"])]
    found = filters.claimable_searches(spark.createDataFrame(asked, "request_id int, term string"), spark.createDataFrame(people, PROVIDERS), 5)
    want = []
    for n, term in asked:
        t = low(term).strip()
        hits = sorted((p[8] is not None, low(p[1]) != t, (p[1] is not None, p[1] or ""), p[0]) for p in people
                      if p[7] == "published" and len(t) >= 2 and (t in low(p[1]) or t in low(p[2])))
        want += [(n, h[3], place) for place, h in enumerate(hits[:5], 1)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_reads_no_more_than_it_needs(spark, monkeypatch):
    """A term that every row holds reads one window, however many rows there are."""
    read = []
    real = postings.settle
    monkeypatch.setattr(postings, "settle", lambda df, name: read.append((name, (out := real(df, name)).count())) or out)
    for n in (500, 5000):
        people = spark.range(n).selectExpr("id AS provider_id", "concat('studio ', id) AS full_name", "'Roma' AS comune", "'Roma' AS district",
                                           "'' AS address", "41.0 AS lat", "12.0 AS lng", "'published' AS status", "CAST(NULL AS STRING) AS owner_email")
        asked = spark.createDataFrame([(1, "studio"), (2, "roma"), (3, "udi")], "request_id int, term string")
        assert filters.claimable_searches(asked, people).count() == 36
    found = [c for name, c in read if name == "found"]
    assert sum(found) == 2 * 36


def test_nobody_and_nothing_asked(spark, people):
    providers = spark.createDataFrame(people, PROVIDERS)
    none = spark.createDataFrame([], "request_id int, term string")
    assert filters.claimable_searches(none, providers).collect() == []
    assert filters.claimable_searches(spark.createDataFrame([(1, "rossi")], none.schema), providers.limit(0)).collect() == []
