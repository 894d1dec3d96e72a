"""Places around many points on one spot."""

import random

from pyspark.sql import functions as F

from provider_analytics.functions.geo import haversine_km
from provider_analytics.operators import geojoin, skew


def test_places_around_points_on_one_spot(spark, monkeypatch):
    rng = random.Random(3)
    spots = [(45 + rng.random() / 10, 9 + rng.random() / 10) for _ in range(4)]
    points = [(f"v{i}", *spots[i % 4]) for i in range(80)] + [("nowhere", None, 9.0)]
    places = [(i, f"n{rng.randrange(9)}", *((45.05, 9.05) if i % 3 == 0 else (45 + rng.random() / 5, 9 + rng.random() / 5))) for i in range(60)] + [(99, "n", None, None)]
    sizes, real = {}, skew.settle

    def counted(df, name):
        out = real(df, name)
        sizes.setdefault(name, []).append((out.count(), set(out.columns)))
        return out

    monkeypatch.setattr(skew, "settle", counted)
    p = spark.createDataFrame(points, "point_id string, lat double, lng double")
    q = spark.createDataFrame(places, "provider_id bigint, full_name string, place_lat double, place_lng double")
    got = {(r["point_id"], r["provider_id"], r["place"]) for r in geojoin.places_around(p, q, 8.0, ["full_name", "provider_id"], ["provider_id"]).collect()}
    km = p.crossJoin(q).select("point_id", "provider_id", "full_name", F.round(haversine_km(F.col("lat"), F.col("lng"), F.col("place_lat"), F.col("place_lng")), 6).alias("km"))
    near = {}
    for r in km.filter("km <= 8").collect():
        near.setdefault(r["point_id"], []).append((r["km"], r["full_name"], r["provider_id"]))
    assert got == {(point, row[2], n) for point, rows in near.items() for n, row in enumerate(sorted(rows), 1)} and len(got) > 1000
    # Rows are sorted once a spot, and without the names.
    rows, columns = sizes["ranged"][-1]
    assert rows * 20 == len(got) and "full_name" not in columns
