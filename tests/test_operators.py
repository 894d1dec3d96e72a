import math
import random

import pytest
from pyspark.sql import functions as F

from provider_analytics.operators import claims, crawl, directory, extraction, geojoin, linkage, requests, reviews, search, skew, taxonomy, writes
from provider_analytics.sources import pages, runlog, sitemap
from provider_analytics.streaming import metrics


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return round(12742 * math.atan2(math.sqrt(h), math.sqrt(1 - h)), 6)


def scatter(n, seed):
    """Places of which a third share one spot and a third crowd one town."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            lat, lng = 45.4642, 9.19
        elif i % 3 == 1:
            lat, lng = 41.9 + rng.random() / 50, 12.5 + rng.random() / 50
        else:
            lat, lng = rng.uniform(36.5, 46.9), rng.uniform(6.6, 18.4)
        rows.append((i, f"name {i * 7919 % n:05d}", lat, lng))
    return rows


@pytest.mark.parametrize("k, radius", [(1, None), (5, None), (40, 30.0), (7, 100.0), (200, 5.0)])
def test_nearest_within_equals_brute_force(spark, k, radius):
    rows = scatter(600, 3)
    rng = random.Random(5)
    points = [(str(i), rng.uniform(36, 47), rng.uniform(6, 19)) for i in range(40)] + [("spot", 45.4642, 9.19), ("far", 36.0, 19.0), ("town", 41.91, 12.51)]
    places = spark.createDataFrame(rows, "provider_id bigint, full_name string, place_lat double, place_lng double")
    p = spark.createDataFrame(points, "point_id string, lat double, lng double")
    got = geojoin.nearest_within(p, places, k, ["full_name", "provider_id"], None if radius is None else F.lit(radius))
    got = {(r["point_id"], r["place"]): r["provider_id"] for r in got.collect()}
    expected = {}
    for key, lat, lng in points:
        near = sorted((km(lat, lng, r[2], r[3]), r[1], r[0]) for r in rows)
        near = [x for x in near if radius is None or x[0] <= radius][:k]
        expected.update({(key, i): x[2] for i, x in enumerate(near, 1)})
    assert got == expected


def test_neighbours_on_one_spot(spark):
    rows = [(i, f"n{i:03d}", 45.0, 9.0) for i in range(50)] + [(99, "n099", 45.001, 9.0)]
    df = spark.createDataFrame(rows, "provider_id bigint, full_name string, lat double, lng double")
    got = geojoin.neighbours(df, 3).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["place"]):
        by.setdefault(r["provider_id"], []).append(r["neighbour_id"])
    assert by[0] == [1, 2, 3] and by[1] == [0, 2, 3] and by[40] == [0, 1, 2] and by[99] == [0, 1, 2] and len(by) == 51


def test_salted_join_spreads_hot_keys(spark):
    big = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id") % 100).cast("bigint").alias("k"), "id")
    other = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = skew.hot_keys(big, ["k"]).collect()
    assert [r["k"] for r in hot] == [7] and hot[0]["_salts"] > 1
    joined = skew.salted_join(big, other, ["k"], "left", ["id"])
    assert joined.count() == 60_000 and joined.filter("v <> k * 2 OR v IS NULL").count() == 0


def test_places_in_groups_of_any_size(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 5000).alias("v")).unionByName(
        spark.range(3).select(F.lit(2).alias("g"), F.col("id").alias("v"))).repartition(5)
    placed = skew.place_in_group(df, ["g"], [F.col("v").desc()], "place").collect()
    assert sorted((r["g"], r["place"], r["v"]) for r in placed) == [(1, i + 1, 4999 - i) for i in range(5000)] + [(2, i + 1, 2 - i) for i in range(3)]


def test_no_cut_on_one_spot(spark):
    """More providers on one spot, and more recipients of one request, than any list used to hold."""
    schema = "provider_id bigint, full_name string, comune string, district string, lat double, lng double, status string, slug string"
    rows = [(i, f"N{i:05d}", "Roma", "Roma", 41.9, 12.5, "published", f"s{i}") for i in range(1001)]
    providers = spark.createDataFrame(rows, schema)
    figures = spark.createDataFrame([], "provider_id bigint, services_count bigint, rating_avg double, review_count bigint")
    visitor = spark.createDataFrame([("v", 41.9, 12.51)], "point_id string, lat double, lng double")
    found = directory.search_near_me(visitor, providers, figures, 30, page=67)
    assert [(r["total"], r["total_pages"], r["place"]) for r in found.orderBy("place").collect()] == [(1001, 67, p) for p in range(991, 1002)]
    asked = spark.createDataFrame([("roma", None, 67), ("roma", 10, 2)], "comune string, radius_km int, page int")
    pages = directory.search_location(asked, providers, figures).groupBy("mode").agg(F.max("total"), F.min("place"), F.count("*")).collect()
    assert sorted(tuple(r) for r in pages) == [("comune", 1001, 991, 11), ("raggio", 1001, 16, 15)]
    recipients = spark.createDataFrame([(1, i) for i in range(1001)], "request_id bigint, provider_id bigint")
    listed = requests.request_recipients(spark.createDataFrame([(1,), (2,)], "request_id bigint"), recipients, providers).collect()
    assert sorted((r["request_id"], r["place"] or 0, r["recipient_count"]) for r in listed) == [(1, i + 1, 1001) for i in range(1001)] + [(2, 0, 0)]


def test_sparse_points_beside_a_dense_city(spark):
    rng = random.Random(8)
    places = [(i, f"n{i}", 45 + rng.random() / 50, 9 + rng.random() / 50) for i in range(800)] + [(1000 + i, "x", 45.5 + i, 9.7 - i) for i in range(5)]
    df = spark.createDataFrame(places, "provider_id bigint, full_name string, place_lat double, place_lng double")
    points = [(str(i), 44 + 2 * rng.random(), 8 + 2 * rng.random()) for i in range(60)] + [("pole", 89.9, 0.0), ("far", -40.0, 170.0)]
    asked = spark.createDataFrame(points, "point_id string, lat double, lng double")
    near = geojoin.nearest_within(asked, df, 3, ["full_name", "provider_id"]).collect()
    inside = geojoin.within(asked, df, F.lit(40.0)).collect()

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 12742 * math.asin(math.sqrt(h))

    for point, lat, lng in points:
        order = sorted((round(km(lat, lng, y, x), 5), name, i) for i, name, y, x in places)
        assert [r["provider_id"] for r in sorted(near, key=lambda r: r["place"]) if r["point_id"] == point] == [i for *_, i in order[:3]]
        assert {r["provider_id"] for r in inside if r["point_id"] == point} == {i for d, _, i in order if d <= 40}


def test_twelve_cities_in_one_province(spark):
    capitals = spark.createDataFrame([(f"C{i}", "AA" if i < 12 else f"Z{i}", i) for i in range(20)], "name string, province string, pos int")
    near = spark.createDataFrame([], "province string, near string, pos int")
    found = crawl.neighbour_cities(spark.createDataFrame([("AA",), ("ZZ",)], "place string"), capitals, near).collect()
    assert [r["name"] for r in sorted(found, key=lambda r: (r["place"], r["rank"]))] == [f"C{i}" for i in range(12, 18)] + [f"C{i}" for i in range(6)]


def test_claims_against_a_loop(spark):
    rng = random.Random(4)
    for size in (3, 500):
        providers = [(i, "published" if i % 9 else "draft", f"e{i}@x" if i % 7 == 0 else None) for i in range(40)]
        made = [(i, rng.randrange(45), rng.choice(["bad", " "] + [f"e{j}@x" for j in range(50)]), rng.randrange(size)) for i in range(size)]
        owner, owned, wanted = {i: e for i, s, e in providers if s == "published"}, {}, {}
        for i, _, e in providers:
            if e and e not in owned:
                owned[e] = i
        for i, p, e, t in sorted(made, key=lambda c: (c[3], c[0])):
            if "@" not in e:
                wanted[i] = "invalid_input"
            elif owned.get(e, p) != p:
                wanted[i] = "already_has_provider"
            elif p not in owner:
                wanted[i] = "provider_not_found"
            elif owner[p] not in (None, e):
                wanted[i] = "already_claimed"
            else:
                wanted[i], owner[p], owned[e] = "ok", e, p
        got = claims.claim_admission(
            spark.createDataFrame(made, "claim_id int, provider_id int, email string, created_at int"),
            spark.createDataFrame(providers, "provider_id int, status string, owner_email string"))
        assert {r["claim_id"]: r["verdict"] for r in got.collect()} == wanted
    probe = spark.createDataFrame([(1, 1, "a@x", 1), (2, 2, "a@x", 2), (3, 2, "b@x", 3)], "claim_id int, provider_id int, email string, created_at int")
    free = spark.createDataFrame([(1, "published", None), (2, "published", None)], "provider_id int, status string, owner_email string")
    assert [r["verdict"] for r in claims.claim_admission(probe, free).orderBy("claim_id").collect()] == ["ok", "already_has_provider", "ok"]


def test_a_rejection_of_another_keeps_the_owner(spark):
    none = ["CAST(NULL AS STRING) AS owner_email", "CAST(NULL AS STRING) AS profile_status", "CAST(NULL AS INT) AS claimed_at"]
    providers = spark.range(3).selectExpr("id AS provider_id", *none)
    decided = spark.createDataFrame([(1, 0, "a@x", 1, "approved"), (2, 0, "b@x", 2, "rejected"), (3, 1, "a@x", 1, "approved"), (4, 1, "A@x", 2, "rejected")],
                                    "claim_id int, provider_id bigint, email string, created_at int, status string")
    got = claims.claim_transitions(providers, decided).orderBy("provider_id").collect()
    assert [(r["owner_email"], r["profile_status"], r["claimed_at"]) for r in got] == [("a@x", "verified", 1), (None, None, 1), (None, None, None)]


def test_funnel_takes_the_click_after_the_view(spark):
    events = spark.createDataFrame([(1, 1, "phone_click"), (1, 2, "page_view"), (1, 3, "phone_click"), (2, 1, "phone_click")], "session_id int, ts int, event_type string")
    got = {r["session_id"]: (r["at_1"], r["at_2"], r["at_3"], r["depth"]) for r in metrics.funnel_steps(events).collect()}
    assert got == {1: (2, 3, None, 2), 2: (None, None, None, 0)}


def test_linkage_against_a_loop(spark):
    rng = random.Random(11)
    firsts, lasts, cities = ["Anna", "Marco", "Luca", "Sara"], ["Rossi", "Bianchi", "Verdi"], [("Milano", 45.46, 9.19), ("Roma", 41.9, 12.5)]
    register, listings = [], []
    for i in range(90):
        city, lat, lng = rng.choice(cities)
        phone = f"02{rng.randint(1000000, 1000030)}" if i % 2 else None
        name, street = f"{rng.choice(firsts)} {rng.choice(lasts)}", f"Via {rng.choice(['Dante', 'Garibaldi'])} {rng.randint(1, 5)}"
        register.append((i, name, phone, f"{street}, {city}", city, lat, lng))
        listings.append((i, f"Studio {name}" if i % 3 else name.upper() + "o", f"+39 {phone}" if phone and i % 5 else None, f"{street}, {city}", city, lat + 0.001, lng))
    schema = "name string, phone string, address string, comune string, lat double, lng double"
    p = linkage.prepare(spark.createDataFrame(register, "provider_id bigint, " + schema), "provider_id")
    l = linkage.prepare(spark.createDataFrame(listings, "listing_id bigint, " + schema), "listing_id")
    side = lambda df, m: df.select(*[F.col(c).alias(f"{m}_{c}") for c in df.columns])
    every = linkage.match_score_places(side(p, "p").crossJoin(side(l, "l")), 70).select("p_sig", "l_sig", "score").distinct()
    blocked = linkage.match_score_places(linkage.candidate_pairs(linkage.signatures(p, "provider_id"), linkage.signatures(l, "listing_id")), 70)
    expected = {tuple(r) for r in every.collect()}
    assert {tuple(r) for r in blocked.select("p_sig", "l_sig", "score").collect()} == expected and len(expected) > 50
    got = linkage.link(spark.createDataFrame(register, "provider_id bigint, " + schema), spark.createDataFrame(listings, "listing_id bigint, " + schema)).collect()
    assert len({r["provider_id"] for r in got}) == len(got) == len({r["listing_id"] for r in got})
    # Greedy by hand over single rows: highest score first; only the total and the scores must agree.
    sigs = {r["provider_id"]: r["sig"] for r in p.collect()}, {r["listing_id"]: r["sig"] for r in l.collect()}
    score = {(a, b): s for a, b, s in expected}
    edges = sorted(((-score[sigs[0][a], sigs[1][b]], a, b) for a in sigs[0] for b in sigs[1] if (sigs[0][a], sigs[1][b]) in score))
    used_a, used_b, greedy = set(), set(), []
    for s, a, b in edges:
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), greedy.append(-s)
    assert sorted(r["score"] for r in got) == sorted(greedy)


def test_every_pair_that_scores_is_blocked(spark):
    """All combinations of what a score is made of, for names of one and of two words, far north as well."""
    import itertools

    schema = "name string, phone string, address string, comune string, lat double, lng double"
    register, listings = [], []
    for i, (same_phone, surname, other, number, street, comune, far, one, north) in enumerate(itertools.product([0, 1], [0, 1], [0, 1], [0, 1], [0, 1], [0, 1], [0, 1, 2], [0, 1], [0, 1])):
        tag = f"{chr(97 + i // 676 % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}"
        last, first, place, way = f"last{tag}", f"first{tag}", f"town{tag}", f"way{tag}"
        lat, lng = (66.0 if north else 42.0) + i / 20, 9.0 + i / 20
        step = (0.0, 0.0, 0.0)[far] if far == 0 else (0.0, 0.012, 0.5)[far]
        register.append((i, last if one else f"{first} {last}", f"02{i:07d}", f"{way} {i % 90 + 1}", place, lat % 80, lng))
        name = " ".join([last if surname else f"else{tag}", first if other else f"more{tag}"])
        listings.append((i, name, f"+39 02{i if same_phone else i + 5_000_000:07d}", f"{way if street else 'xyz' + tag} {i % 90 + 1 if number else 991}{', ' + place if comune else ''}",
                         "", lat % 80, lng + step * (2 if north else 1)))
    p = linkage.prepare(spark.createDataFrame(register, "provider_id bigint, " + schema), "provider_id")
    l = linkage.prepare(spark.createDataFrame(listings, "listing_id bigint, " + schema), "listing_id")
    side = lambda df, m: df.select(*[F.col(c).alias(f"{m}_{c}") for c in df.columns])
    every = linkage.match_score_places(side(p, "p").join(side(l, "l"), F.col("p_provider_id") == F.col("l_listing_id")), 70).select("p_sig", "l_sig")
    blocked = linkage.candidate_pairs(linkage.signatures(p, "provider_id"), linkage.signatures(l, "listing_id")).select("p_sig", "l_sig")
    assert every.count() > 100 and every.join(blocked, ["p_sig", "l_sig"], "left_anti").count() == 0


def test_a_long_chain_of_equal_scores_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = linkage.settle
    monkeypatch.setattr(linkage, "settle", lambda df, name: rounds.append(name) or real(df, name))
    n = 2000
    edges = spark.range(2 * n).select(
        F.format_string("p%06d", F.ceil(F.col("id") / 2)).alias("p_sig"), F.format_string("l%06d", F.floor(F.col("id") / 2)).alias("l_sig"),
        F.lit(1).cast("bigint").alias("p_copies"), F.lit(1).cast("bigint").alias("l_copies"), F.ceil(F.col("id") / 2).alias("p_first"),
        F.floor(F.col("id") / 2).alias("l_first"), F.lit(80).alias("score"))
    taken = linkage.pick_match(edges).collect()
    assert rounds.count("taken") < 40
    assert len({r["p_sig"] for r in taken}) == len(taken) == len({r["l_sig"] for r in taken}) and len(taken) > 0.6 * n
    used = {r["p_sig"] for r in taken}, {r["l_sig"] for r in taken}
    assert all(r["p_sig"] in used[0] or r["l_sig"] in used[1] for r in edges.collect())


def test_copies_are_assigned_one_to_one(spark):
    schema = "name string, phone string, address string, comune string, lat double, lng double"
    register = spark.range(3000).select(F.col("id").alias("provider_id"), *[F.expr(x) for x in (
        "'Anna Rossi' name", "'02 1234567' phone", "'Via Dante 3, Milano' address", "'Milano' comune", "45.4D lat", "9.2D lng")])
    listings = spark.range(2500).select((F.col("id") + 5).alias("listing_id"), *[F.expr(x) for x in (
        "'Studio Anna Rossi' name", "'02 1234567' phone", "'Via Dante 3, Milano' address", "'Milano' comune", "45.4D lat", "9.2D lng")])
    assert [c.split()[0] for c in schema.split(", ")] == register.columns[1:]
    got = linkage.link(register, listings)
    r = got.agg(F.count("*"), F.count_distinct("provider_id"), F.count_distinct("listing_id"), F.max("provider_id")).first()
    assert tuple(r) == (2500, 2500, 2500, 2499)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, t string, n int")
    new = spark.createDataFrame([(2, "B", 9), (3, "C", 3)], "k int, t string, n int")
    rule = {"n": F.greatest("old.n", "new.n")}
    first = writes.upsert(old, new, ["k"], rule)
    assert {tuple(r) for r in first.collect()} == {(1, "a", 1, "keep"), (2, "B", 9, "update"), (3, "C", 3, "insert")}
    again = writes.upsert(first.drop("action"), new, ["k"], rule).drop("action")
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in first.drop("action").collect()}
    with pytest.raises(ValueError):
        writes.assert_unique(old.unionByName(old), F.col("k"))


@pytest.fixture(scope="module")
def guide(spark):
    tax = spark.createDataFrame([
        (1, "acquisto-prima-casa", "Acquisto prima casa", "Comprare casa"), (2, "donazione-immobile", "Donazione di immobile", None),
        (3, "mutuo", "Mutuo ipotecario", "Mutuo"), (4, "costituzione-societa", "Costituzione società", None),
    ], "service_id bigint, slug string, name string, plain_language_name string")
    terms = spark.createDataFrame([
        (2, "regalare casa ai figli", "intent", 80, None), (3, "prestito casa", "alias", 90, None), (4, "aprire una srl", "alias", 70, None),
        (1, "prestito casa", "boost", 10, None),
    ], "service_id bigint, term string, term_type string, weight int, normalized_term string")
    return tax, terms


@pytest.mark.parametrize("query, slug, score, by", [
    ("Mutuo", "mutuo", 100, "canonical"),
    ("MUTUO IPOTECARIO", "mutuo", 100, "canonical"),
    ("costituzione societa", "costituzione-societa", 100, "canonical"),
    ("prestito casa", "acquisto-prima-casa", 90, "alias"),
    ("aprire una srl subito", "costituzione-societa", 70, "alias"),
    ("mutou", "mutuo", 49, "token"),
    ("vorrei regalare la casa al figlio", "donazione-immobile", 59, "intent"),
    ("donazoine", "donazione-immobile", 47, "token"),
])
def test_rank_services(spark, guide, query, slug, score, by):
    best = search.rank_services(spark.createDataFrame([(query,)], "query string"), *guide, 1).first()
    assert (best["slug"], best["score"], best["matched_by"]) == (slug, score, by)


def test_resolve_service_ignores_generic_text(spark, guide):
    rows = spark.createDataFrame([("studio notarile",), ("notaio",), ("mutuo",), ("zzzz",), ("",)], "query string")
    assert [r["query"] for r in search.resolve_service(rows, *guide).collect()] == ["mutuo"]


def test_reference_sentiment_lexicon(spark):
    rows = spark.createDataFrame([(1, 10, "Poco chiaro ma gentile"), (1, 11, "Molto chiaro!"), (2, 12, "lento e CARO")], "provider_id int, review_id int, text string")
    got = {(r["provider_id"], r["aspect"]): r for r in reviews.aspect_sentiment(rows).collect()}
    clear = got[1, "chiarezza"]
    assert (clear["positive_hits"], clear["negative_hits"], clear["label"], clear["score"]) == (2, 1, "neutral", 0.67)
    assert clear["evidence"] == "10,11" and got[2, "costi"]["label"] == "negative" and got[2, "disponibilita"]["score"] is None


def test_real_province_tables(spark):
    cities = spark.createDataFrame([("MILANO", None), ("Rozzano", None), ("Vergiate", "Distretto di Reggio Calabria"), ("Nowhere", "x")], "comune string, district string")
    got = {r["comune"]: r["province"] for r in crawl.infer_province(cities, crawl.capitals_frame(spark), crawl.extras_frame(spark)).collect()}
    assert got == {"MILANO": "MI", "Rozzano": "MI", "Vergiate": "RC", "Nowhere": None}
    asked = spark.createDataFrame([("MI",), ("roma",), ("AO",), ("Vergiate",)], "place string")
    near = crawl.neighbour_cities(asked, crawl.capitals_frame(spark), crawl.neighbours_frame(spark)).orderBy("place", "rank").collect()
    by = {}
    for r in near:
        by.setdefault(r["place"], []).append(r["name"])
    assert by == {"MI": ["Monza", "Varese", "Como", "Bergamo"], "AO": ["Milano", "Roma", "Torino", "Napoli", "Firenze", "Bologna"],
                  "roma": ["Milano", "Torino", "Napoli", "Firenze", "Bologna", "Genova"]}


def test_sitemap_documents_round_trip(spark, tmp_path):
    urls = spark.range(1000).select(F.concat(F.lit("/a&b/"), "id").alias("path"), F.lit("x").alias("bucket"), F.lit("weekly").alias("changefreq"),
                                    F.lit(0.85).alias("priority"), F.lit("2024-05-06 10:00:00").alias("lastmod"))
    docs = crawl.sitemap_documents(urls, "https://s.example.org", 100)
    assert docs.agg(F.max("urls"), F.sum("urls")).first()[:] == (docs.agg(F.max("urls")).first()[0], 1000) and docs.agg(F.max("urls")).first()[0] <= 100
    crawl.write_documents(docs, str(tmp_path / "maps"))
    read = sitemap.sitemap_locs(spark, str(tmp_path / "maps"))
    assert read.count() == 1000 and read.filter("loc = 'https://s.example.org/a&b/7' AND lastmod = '2024-05-06'").count() == 1


def test_run_log_and_pages(spark, tmp_path):
    (tmp_path / "log.txt").write_text('start\n{"event":"a","slug":"x"}\n{"event":"a"}\n{"event":"b"}\n{bad\n')
    got = {r["event"]: r["n"] for r in runlog.count_events(runlog.read_run_log(spark, str(tmp_path / "log.txt"))).collect()}
    assert got == {"a": 2, "b": 1}
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "p.html").write_text("<p>Città</p>", encoding="utf-8")
    assert pages.read_page_files(spark, str(tmp_path / "html")).first()["html"] == "<p>Città</p>"
    runlog.write_report(spark.range(3), spark.range(1), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "rows")).count() == 3


def test_bad_pages_become_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", "<div onclick='openMapLayer17({bad});'><h1 itemprop='name'>A B</h1>")], "page_id bigint, url string, html string")
    got = extraction.parse_microdata(df).orderBy("page_id").collect()
    assert got[0]["name"] == "" and got[1]["name"] == "A B" and got[1]["lat"] is None
    assert extraction.parse_register_pages(df).filter("error = 'no name found'").count() == 2


def test_unclosed_tags_are_linear_and_end_where_they_should():
    import time

    for page in ("<p>x" * 100_000, "<li>x" * 100_000, "<div>x" * 20_000 + "</span>" * 20_000, "<table>" + "<tr><td>x" * 50_000):
        started = time.process_time()
        extraction._Tree(page, lambda n: ())
        assert time.process_time() - started < 3
    tree = extraction._Tree("<ul><li>uno<li>due<ul><li>a</ul></ul><p>x<div>y</div><table><tr><td>1<td>2<tr><th>3</table>z", lambda n: ())
    assert [tree.text(n) for n in tree.nodes if n.tag in ("li", "p", "td", "th")] == ["uno", "due a", "a", "x", "1", "2", "3"]


def test_jsonld_blocks_keep_their_order(spark):
    many = ",".join('{"@type":"Thing"}' for _ in range(10_050))
    page = (f'<script type="application/ld+json">[{many},{{"@type":"Notary","name":"first"}}]</script>'
            '<script type="application/ld+json">{"@type":"Notary","name":"second"}</script>')
    got = extraction.parse_jsonld(spark.createDataFrame([(1, "u", page)], "page_id int, url string, html string")).first()
    assert got["name"] == "first"


def test_claims_in_one_batch(spark):
    providers = spark.createDataFrame([(1, "published", None), (2, "published", "z@x.it"), (3, "draft", None)], "provider_id bigint, status string, owner_email string")
    rows = [(1, 1, "a@x.it", 10), (2, 1, "b@x.it", 11), (3, 2, "a@x.it", 12), (4, 3, "c@x.it", 13), (5, 1, "nomail", 14), (6, 2, "Z@x.it ", 15), (7, 1, "z@x.it", 16)]
    df = spark.createDataFrame(rows, "claim_id bigint, provider_id bigint, email string, created_at bigint")
    got = {r["claim_id"]: r["verdict"] for r in claims.claim_admission(df, providers).collect()}
    assert got == {1: "ok", 2: "already_claimed", 3: "already_has_provider", 4: "provider_not_found", 5: "invalid_input", 6: "ok", 7: "already_has_provider"}


def test_recipients_are_cut_only_when_asked(spark):
    targets = spark.range(30).select(F.lit(1).alias("submission_id"), F.col("id").alias("pos"), (F.col("id") % 12).alias("provider_id"))
    for limit in (None, 10):
        got = [r["provider_id"] for r in requests.selected_targets(targets, limit).orderBy("place").collect()]
        assert got == list(range(limit or 12))


def test_affinity_of_the_built_in_table(spark):
    tax = spark.createDataFrame([(1, "mutuo", None), (2, "mutuo-ipotecario", 1), (3, "compravendita-immobiliare", None)], "service_id bigint, slug string, canonical_id bigint")
    got = taxonomy.expand_affinity(spark.createDataFrame([("mutuo",)], "slug string"), tax, taxonomy.affinity_edges(spark))
    assert {(r["service_id"], r["match_kind"]) for r in got.collect()} == {(1, "exact"), (3, "related")}


def test_location_search_picks_the_least_radius(spark):
    rows = [(i, f"p{i:02d}", "Alfa" if i < 3 else "Beta", "D", 45.0 + (0 if i < 3 else 0.15 + i / 1000), 9.0, "published") for i in range(30)]
    providers = spark.createDataFrame(rows, "provider_id bigint, full_name string, comune string, district string, lat double, lng double, status string")
    figures = spark.createDataFrame([], "provider_id bigint, services_count bigint, rating_avg double, review_count bigint")
    asked = spark.createDataFrame([("alfa", None, 1), ("beta", None, 9)], "comune string, radius_km int, page int")
    got = directory.search_location(asked, providers, figures).collect()
    alfa = [r for r in got if r["city_key"] == "alfa"]
    beta = [r for r in got if r["city_key"] == "beta"]
    assert {(r["radius_km"], r["scope"], r["total"]) for r in alfa} == {(20, "raggio", 30)} and alfa[0]["exact_city_count"] == 3
    assert {(r["radius_km"], r["scope"], r["total"], r["page"]) for r in beta} == {(None, "comune", 27, 2)} and len(beta) == 12


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i % 5:02d} 0{i % 9}:00:00", i % 4, i % 3, ["page_view", "phone_click", "quote_request"][i % 3]) for i in range(300)]
    raw = spark.createDataFrame(rows, "event_id bigint, t string, session_id bigint, provider_id bigint, event_type string")
    events = raw.select("event_id", F.to_timestamp("t").alias("ts"), "session_id", "provider_id", "event_type")
    late = spark.createDataFrame([(999, "2024-03-01 00:00:00", 9, 9, "other")], raw.schema).select("event_id", F.to_timestamp("t").alias("ts"), "session_id", "provider_id", "event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = metrics.read_event_stream(spark, str(tmp_path / "in"), files_per_trigger=1)

    def drain(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    order = sorted(metrics.METRICS)
    got = drain(metrics.daily_metrics_stream(stream), "daily")
    expected = metrics.daily_metrics(events)
    pick = lambda df: {tuple(r) for r in df.select("provider_id", "day", *order).filter("provider_id <> 9").collect()}
    assert pick(got) == pick(expected) and pick(expected)
    hashed = stream.withColumn("idempotency_hash", F.col("session_id").cast("string"))
    assert drain(metrics.stream_dedup(hashed, "100 days"), "dedup").count() == 5

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"b{batch_id}"))

    for _ in range(2):  # the second run finds nothing new
        metrics.run_incremental(stream, keep, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(*[str(p) for p in sorted((tmp_path / "out").iterdir())]).count() == 301
