"""The measures of linkage against what they stand for: the sequence ratio, the distance and the letters two names lack."""

import difflib
import math
import random

from pyspark.sql import functions as F

from provider_analytics.functions.geo import distance_km
from provider_analytics.functions.phones import street_number
from provider_analytics.functions.text import address_tokens, name_tokens, normalize_query
from provider_analytics.operators import linkage

_SCHEMA = "name string, phone string, address string, comune string, lat double, lng double"


def _pairs(spark, rows):
    side = lambda key, mark, i: linkage.prepare(spark.createDataFrame([(n, *r[i]) for n, r in enumerate(rows)], f"{key} bigint, " + _SCHEMA), key).select(
        F.col(key).alias("n"), "*").drop(key).withColumnsRenamed({c: f"{mark}_{c}" for c in ("lat", "lng", "cos")} | {c: f"{mark}_{c}" for c in (
            "name_norm", "name_tokens", "name_size", "phones", "phone_bits", "address_norm", "street", "plain", "plain_bits", "number", "comune_norm",
            "surname", "surname_bit", "name_bits", "sig", *[f"letters_{i}" for i in range(len(linkage._SKETCH))])})
    return side("p", "p", 0).join(side("l", "l", 1), "n")


def test_ratios_of_many_pairs_are_those_of_difflib():
    rng = random.Random(3)
    text = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randrange(most)))
    left = [text("ab 0", 70) for _ in range(600)] + [text("abcdefgh è\U0001f600", 40) for _ in range(300)] + ["", "a", "a\0", "x" * 250]
    right = [text("ab 0", 70) for _ in range(600)] + [text("abcdefgh è\U0001f600", 40) for _ in range(300)] + ["", "", "a", "x" * 249 + "y"]
    edited = lambda t: "".join(c for c in t if rng.random() > 0.2) + text("ab", 5)
    left, right = left + left[:300], right + [edited(t) for t in left[:300]]
    expected = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)]
    assert list(linkage._ratios_of(left, right, 0.0)) == expected
    assert list(linkage._ratios_of(left, right, 0.72)) == [r if r >= 0.72 else 0.0 for r in expected] and sum(r >= 0.72 for r in expected) > 5


def test_names_that_cannot_be_similar_are_not_handed_to_the_measure(spark, monkeypatch):
    rng = random.Random(4)
    name = lambda: " ".join("".join(rng.choice("abcde01") for _ in range(rng.randint(3, 7))) for _ in range(rng.randint(1, 3)))
    place = (None, "Via Dante 3, Milano", "Milano", 45.44, 9.2)
    names = [(a, a[1:] + "x" if i % 8 == 0 else name()) for i, a in enumerate(name() for _ in range(400))]
    rows = [((a, *place), (b, *place)) for a, b in names]
    handed = []
    real = linkage.sequence_ratio
    monkeypatch.setattr(linkage, "sequence_ratio", lambda a, b, *rest: handed.append(a) or real(a, b, *rest))
    pairs = _pairs(spark, rows)
    got = {r["n"]: r["reasons"] for r in linkage.match_score_places(pairs).select("n", "reasons").collect()}
    norm = {r["n"]: (r["p_name_norm"], r["l_name_norm"]) for r in pairs.select("n", "p_name_norm", "l_name_norm").collect()}
    similar = {n for n, (a, b) in norm.items() if difflib.SequenceMatcher(None, a, b).ratio() >= 0.72}
    assert {n for n, r in got.items() if "similar name +12" in r} == {n for n in similar if "name +18" not in got[n]} and len(similar) > 3
    needed = pairs.withColumn("_hit_2", F.lit(False)).select(handed[0].alias("a")).filter("a IS NOT NULL").count()
    assert len(similar) <= needed < 200


def test_distances_are_told_without_the_angle(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(2000):
        lat, lng, km, way = rng.uniform(-91, 91), rng.uniform(-181, 181), rng.choice([0.5, 2, 20]) * rng.uniform(0.999, 1.001), rng.uniform(0, 7)
        up, aside = km / 111.195 * math.cos(way), km / 111.195 * math.sin(way) / max(0.01, math.cos(math.radians(lat)))
        rows.append((lat, lng, lat + up, lng + aside))
    rows += [(None, 9.0, 45.0, 9.0), (45.0, 9.0, 45.0, 9.0), (float("nan"), 9.0, 45.0, 9.0)]
    df = spark.createDataFrame(rows, "p_lat double, p_lng double, l_lat double, l_lng double").withColumns({
        "p_cos": F.cos(F.radians("p_lat")), "l_cos": F.cos(F.radians("l_lat"))})
    km = distance_km(F.col("p_lat"), F.col("p_lng"), F.col("l_lat"), F.col("l_lng"))
    for limit in (0.5, 2, 20):
        said = df.select(linkage._within(limit).alias("a"), (km <= limit).alias("b"))
        assert said.filter("NOT a <=> b").count() == 0 and 100 < said.filter("a").count() < 1900


def test_a_listing_looks_only_into_cells_that_are_near(spark):
    rng = random.Random(7)
    rows = [(i, rng.uniform(-83, 83), rng.uniform(-179, 179)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, lat double, lng double").withColumn("cos", F.cos(F.radians("lat")))
    cells = {r["i"]: {(c["y"], c["x"]) for c in r["c"]} for r in df.select("i", linkage._cells_around(2.0).alias("c")).collect()}
    cell = lambda v: math.floor(v / linkage._CELL)
    for i, lat, lng in rows:
        for way in range(24):
            up, aside = math.cos(way * math.pi / 12), math.sin(way * math.pi / 12) / math.cos(math.radians(lat))
            assert (cell(lat + 1.999 / 111.195 * up), cell(lng + 1.999 / 111.195 * aside)) in cells[i]
    box = lambda lat: 3 * (2 * math.ceil(2.02 / 111.19 / linkage._CELL / math.cos(math.radians(lat))) + 1)
    assert sum(len(cells[i]) for i, _, _ in rows) < 0.8 * sum(box(lat) for _, lat, _ in rows)


def test_texts_of_a_row_are_normalised_once(spark):
    texts = ["Notaio Anna  ROSSI-Verdi", "Via Dante, 3/b  Milano", "Perché 12345 Łódź 7 a", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("n", normalize_query(F.col("t")))
    pairs = [(name_tokens(F.col("t")), name_tokens(F.col("n"), normal=True)), (address_tokens(F.col("t")), address_tokens(F.col("n"), normal=True)),
             (street_number(F.col("t")), street_number(F.col("n"), normal=True))]
    assert all(df.filter(~a.eqNullSafe(b)).count() == 0 for a, b in pairs)
    rows = spark.createDataFrame([(1, "Anna Rossi", "02 123456", "Via Dante 3", "Milano", 45.4, 9.2)], "id bigint, " + _SCHEMA)
    plan = linkage.prepare(rows, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 3
