"""The most relevant places around points against plain loops, and how many are scored in a crowded city."""

import random

import pytest

from provider_analytics.functions.geo import distance_km
from provider_analytics.operators import directory, nearbest
from pyspark.sql import functions as F

PLACES = "provider_id bigint, full_name string, lat double, lng double, status string"
FIGURES = "provider_id bigint, services_count bigint, rating_avg double, review_count bigint"


def city(n, seed, spread):
    rng = random.Random(seed)
    places = [(i, rng.choice(["Anna", "Bo", "Zoe"]), None if rng.random() < 0.05 else 45 + rng.gauss(0, spread), 9 + rng.gauss(0, spread), "published") for i in range(n)]
    figures = [(i, rng.randint(0, 3), rng.choice([None, 4.0, 4.5]), rng.choice([0, 1, 5, 40])) for i in range(n) if rng.random() < 0.8]
    return places, figures


def plain(spark, points, places, figures, radius):
    from provider_analytics.operators.directory import _places, _with_score, with_figures

    pairs = points.crossJoin(with_figures(_places(places.filter("lat IS NOT NULL")), figures)).withColumn(
        "distance_km", distance_km(F.col("lat"), F.col("lng"), F.col("place_lat"), F.col("place_lng"))).filter(F.col("distance_km") <= radius)
    out = {}
    for r in _with_score(pairs).collect():
        out.setdefault(r.point_id, []).append((-r.relevance_score, r.distance_km, r.full_name, r.provider_id))
    return {p: sorted(rows) for p, rows in out.items()}


@pytest.mark.parametrize("first, growth, spread", [(2, 2, 0.3), (64, 16, 0.05), (3, 4, 1.5)])
def test_pages(spark, monkeypatch, first, growth, spread):
    monkeypatch.setattr(nearbest, "FIRST", first)
    monkeypatch.setattr(nearbest, "GROWTH", growth)
    rows, facts = city(600, first, spread)
    places, figures = spark.createDataFrame(rows, PLACES), spark.createDataFrame(facts, FIGURES)
    points = spark.createDataFrame([("a", 45.0, 9.0), ("b", 45.2, 9.1), ("far", -20.0, 100.0), ("again", 45.0, 9.0), ("nowhere", None, 9.0)], "point_id string, lat double, lng double")
    want = plain(spark, points, places, figures, 30)
    for page in (1, 3, 90):
        found = directory.search_near_me(points, places, figures, 30, page, 15).collect()
        for point in ("a", "b", "again"):
            every = want.get(point, [])
            last = max(1, -(-len(every) // 15))
            at = min(page, last)
            got = sorted((r.place, r.provider_id) for r in found if r.point_id == point)
            assert got == [(n, row[3]) for n, row in enumerate(every, 1) if (at - 1) * 15 < n <= at * 15]
            assert all((r.total, r.total_pages, r.page) == (len(every), last, at) for r in found if r.point_id == point)
        assert not [r for r in found if r.point_id in ("far", "nowhere")]


def test_a_crowded_city_is_not_scored_whole(spark, monkeypatch):
    monkeypatch.setattr(nearbest, "FIRST", 16)
    read, real = [], nearbest.top_per_group
    monkeypatch.setattr(nearbest, "top_per_group", lambda df, *a: read.append(df.count()) or real(df, *a))
    rows, facts = city(8000, 1, 0.02)
    points = spark.createDataFrame([("a", 45.0, 9.0)], "point_id string, lat double, lng double")
    found = directory.search_near_me(points, spark.createDataFrame(rows, PLACES), spark.createDataFrame(facts, FIGURES), 30).collect()
    assert len(found) == 15 and found[0].total > 7000
    assert sum(read) < 2000


def test_nobody(spark):
    none = spark.createDataFrame([], PLACES)
    points = spark.createDataFrame([("a", 45.0, 9.0)], "point_id string, lat double, lng double")
    assert directory.search_near_me(points, none, spark.createDataFrame([], FIGURES)).collect() == []
